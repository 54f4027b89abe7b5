"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two, largest first and at most
the sequence length; each piece is a sequence of its own and joins the bucket of its length. No
sequence crosses documents, none is padded, and a batch is drawn from one bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, utf8
from .tokens import word_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary"


def binary_lengths(total: int, longest: int) -> list[int]:
    """Powers of two, none above ``longest`` (itself one), that add up to ``total``."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def decompose(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, bucket, ids, sequence_id, offset``.

    ``bucket`` is the logarithm of the length; ``ids`` the piece's ids as little-endian unsigned
    32-bit integers (null unless ``with_ids``). ``sequence_id`` is unique and ``offset`` 0, as a
    piece fills its sequence. Nothing is shuffled: cutting a document needs no other document.

    A null or empty text is the end id alone: one piece of length 1. Repeated rows are cut each
    for itself, a null doc_id stays null, an empty table gives no rows, and further columns of
    ``docs`` are ignored. A very long text gives as many full pieces as it holds.
    """
    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(utf8(batch.column("text")))):
                ids = found + end
                total, start = len(ids) // 4, 0
                for length in binary_lengths(total, longest):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(piece), total, length.bit_length() - 1, piece if with_ids else None))
                    start += length
                if len(rows) >= 4096:
                    yield _pieces(rows)
                    rows = []
            if rows:
                yield _pieces(rows)
        encoder.forget()

    pieces = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, PIECES)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Stores the pieces with a folder per bucket, so that a batch reads one length only."""
    pieces.write.partitionBy("bucket").parquet(path)


def op2_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each piece of each row of ``docs``, without the ids themselves.

    Nulls, empty and very long texts, repeated rows, empty tables and further columns as in
    ``decompose``; there are no ties, as a document's pieces follow from its length alone.
    """
    pieces = decompose(docs, tokenizer, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
