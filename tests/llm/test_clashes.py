"""Columns of the input that are named like the operators' own."""

from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, media, packing, pii, quality, substring, tokens, toxicity

NAMES = ["_rid", "starts", "sure", "seeds", "hits", "score", "spans", "digest", "n_tokens", "content", "_text", "_base", "_added", "_marks", "media", "_raw", "kept", "c0", "rep", "leaf", "text_score", "bucket"]


def test_clashing_names(spark, tmp_path):
    rows = [(i, f"some text {i} with +49 30 1234567 in it and more words after it", "en", "s", 10) for i in range(6)] + [(9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(f"own {n}") for n in NAMES})
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "entirely different words")], "item_id long, text string")
    results = {
        "substring": substring.remove_repeats(docs),
        "keep": jaccard.keep_one(docs),
        "redact": pii.redact(docs),
        "mark": decontam.mark(docs, items),
        "clean": decontam.decontaminate(docs, items),
        "not toxic": toxicity.without_toxic(docs, toxicity.fit_on(docs, labels)),
        "toxic": toxicity.score(docs, toxicity.fit_on(docs, labels)),
        "quality": quality.score(docs, quality.fit_on(docs, labels)),
        "tokens": tokens.count_tokens(docs, tokens.tokenizer_path()),
        "media": media.encode_media(docs),
    }
    added = {"substring": {"kept"}, "mark": {"hits"}, "toxic": {"score", "spans"}, "quality": {"score", "text_score"}, "tokens": {"digest", "n_tokens"}, "media": {"media"}}
    for name, out in results.items():
        got = out.collect()
        assert len(got) == 7, name
        for n in NAMES:
            if n not in added.get(name, ()):
                assert {r[n] for r in got} == {f"own {n}"}, (name, n)
    assert packing.decompose(docs, tokens.tokenizer_path()).count() > 7
    assert {r.text for r in results["redact"].where("doc_id = 1").collect()} == {"some text 1 with [PHONE] in it and more words after it"}
