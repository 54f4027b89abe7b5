"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontam, jaccard, media, packing, pii, quality, substring, tokens, toxicity, urls
from ._common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": lambda spark, d: quality.op1_quality(table(spark, d, "documents"), table(spark, d, "labels")),
        "op2_packing": lambda spark, d: packing.op2_packing(table(spark, d, "documents"), tokens.tokenizer_path()),
        "op3_url_filters": lambda spark, d: urls.op3_url_filters(table(spark, d, "pages")),
        "op4_decontamination": lambda spark, d: decontam.op4_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op5_ngram_jaccard": lambda spark, d: jaccard.op5_ngram_jaccard(table(spark, d, "documents")),
        "op6_toxicity": lambda spark, d: toxicity.op6_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
        "op7_substring_dedup": lambda spark, d: substring.op7_substring_dedup(table(spark, d, "documents")),
        "op8_token_counts": lambda spark, d: tokens.op8_token_counts(table(spark, d, "documents"), tokens.tokenizer_path()),
        "op9_pii": lambda spark, d: pii.op9_pii(table(spark, d, "documents")),
        "op10_media_audio": lambda spark, d: media.op10_media_audio(table(spark, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"op3_url_filters": urls.OP3_SQL}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
