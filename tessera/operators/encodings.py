"""Encodings of ordered columns as DataFrame programs, per row group.

``key`` columns (usually the row group) are the unit of encoding and of parallelism: windows are
always partitioned by them. ``pos`` orders the rows within.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import DataError
from ..plans.types import type_name

# Encoding names and ids.
ENCODINGS = {"PLAIN": 0, "RLE": 1, "BIT_PACKED": 2, "DELTA_BINARY": 3, "DELTA_BYTE_ARRAY": 4, "BYTE_STREAM_SPLIT": 5, "DICTIONARY_RLE": 6, "PASSTHROUGH": 7}


def encoding_name(wire: int) -> str:
    for name, n in ENCODINGS.items():
        if n == wire:
            return name
    raise DataError(f"unknown encoding {wire}")


def _window(keys: list[str], pos: str):
    return Window.partitionBy(*keys).orderBy(pos)


def plain(df: DataFrame) -> DataFrame:
    """Plain and pass-through store values as they are."""
    return df


def rle_encode(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """``keys, run_id, first_pos, value, run_length`` of maximal runs of equal values (nulls are equal)."""
    w = _window(keys, pos)
    changed = F.when(F.row_number().over(w) == 1, 1).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    marked = df.select(*keys, pos, value, changed.alias("_new"))
    runs = marked.withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run_id").agg(F.min(pos).alias("first_pos"), F.first(value).alias(value), F.count(F.lit(1)).alias("run_length"))


def rle_decode(runs: DataFrame, keys: list[str], value: str, pos: str = "pos") -> DataFrame:
    """The rows of ``rle_encode``, whose positions are dense within a run."""
    offset = F.explode(F.sequence(F.lit(0).cast("long"), F.col("run_length") - 1)).alias("_o")
    return runs.select(*keys, "first_pos", value, offset).select(*keys, (F.col("first_pos") + F.col("_o")).alias(pos), value)


def delta_of_delta_encode(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """``keys, pos, dod``: the first value, the first difference, then differences of differences; zigzag's varint length too."""
    w = _window(keys, pos)
    v = F.col(value).cast("long")
    one = df.select(*keys, pos, v.alias("_v"), (v - F.lag(v).over(w)).alias("_d"), F.row_number().over(w).alias("_n"))
    dod = F.when(F.col("_n") == 1, F.col("_v")).when(F.col("_n") == 2, F.col("_d")).otherwise(F.col("_d") - F.lag("_d").over(w))
    return one.select(*keys, pos, F.col("_n").alias("n"), dod.alias("dod"))


def delta_of_delta_decode(encoded: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    w = _window(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("dod").over(w)
    delta = encoded.select(*keys, pos, "n", "dod", first.alias("_first"), F.sum(F.when(F.col("n") > 1, F.col("dod")).otherwise(0)).over(w).alias("_d"))
    # the running sum of the differences, which are themselves running sums
    total = F.sum(F.when(F.col("n") > 1, F.col("_d")).otherwise(0)).over(w)
    return delta.select(*keys, pos, (F.col("_first") + total).alias(value))


def dictionary(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """``keys, value, code``: codes in the order of first appearance."""
    first = df.groupBy(*keys, value).agg(F.min(pos).alias("_first"))
    return first.select(*keys, value, (F.row_number().over(_window(keys, "_first")) - 1).cast("long").alias("code"))


def dictionary_encode(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    codes = dictionary(df, keys, pos, value)
    a, b = df.alias("a"), codes.alias("b")
    same = F.lit(True)
    for k in [*keys, value]:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{pos}"), "b.code")


def dictionary_rle_encode(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    return rle_encode(dictionary_encode(df, keys, pos, value), keys, pos, "code")


def dictionary_decode(encoded: DataFrame, codes: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    return encoded.join(codes, [*keys, "code"]).select(*keys, pos, value)


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings begin with together."""
    n = F.least(F.length(a), F.length(b))
    hits = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.left(a, i) == F.left(b, i)))
    return F.coalesce(F.size(hits), F.lit(0))


def prefix_delta_encode(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """``keys, pos, shared, suffix`` against the value before; values must be sorted for it to pay."""
    before = F.lag(value).over(_window(keys, pos))
    with_before = df.select(*keys, pos, value, before.alias("_b"))
    shared = F.when(F.col("_b").isNull(), 0).otherwise(common_prefix(F.col(value), F.col("_b")))
    marked = with_before.select(*keys, pos, value, shared.alias("shared"))
    return marked.select(*keys, pos, F.col("shared").cast("int").alias("shared"), F.substring(value, F.col("shared") + 1, F.length(value)).alias("suffix"))


def prefix_delta_decode(encoded: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Folds each group's suffixes in order; a group is the unit of memory, as when encoding."""
    rows = F.sort_array(F.collect_list(F.struct(pos, "shared", "suffix"))).alias("_rows")
    start = F.struct(F.lit("").alias("last"), F.array().cast(f"array<struct<{pos}:bigint,{value}:string>>").alias("out"))

    def fold(acc: Column, r: Column) -> Column:
        text = F.concat(F.left(acc["last"], r["shared"]), r["suffix"])
        return F.struct(text.alias("last"), F.array_append(acc["out"], F.struct(r[pos].cast("long").alias(pos), text.alias(value))).alias("out"))

    folded = encoded.groupBy(*keys).agg(rows).select(*keys, F.aggregate("_rows", start, fold, lambda acc: acc["out"]).alias("_out"))
    return folded.select(*keys, F.inline("_out"))


def bit_pack(df: DataFrame, keys: list[str], pos: str, flag: str, msb_first: bool = True) -> DataFrame:
    """``keys, byte_no, byte, bits``: eight booleans in a byte."""
    bit = F.pmod(F.col(pos), F.lit(8)).cast("int")
    shift = 7 - bit if msb_first else bit
    weight = F.col(flag).cast("int") * F.pow(F.lit(2), shift).cast("int")
    return df.groupBy(*keys, F.expr(f"`{pos}` div 8").alias("byte_no")).agg(F.sum(weight).cast("int").alias("byte"), F.count(F.lit(1)).cast("int").alias("bits"))


def bit_unpack(packed: DataFrame, keys: list[str], pos: str, flag: str, msb_first: bool = True) -> DataFrame:
    """Bits of whole and last bytes; a byte's bits are dense from its first."""
    each = packed.select(*keys, "byte_no", "byte", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("_i"))
    shift = (7 - F.col("_i")) if msb_first else F.col("_i")
    on = F.pmod(F.floor(F.col("byte") / F.pow(F.lit(2), shift)), F.lit(2)) == 1
    return each.select(*keys, (F.col("byte_no") * 8 + F.col("_i")).cast("long").alias(pos), on.alias(flag))


def byte_stream_split(data: bytes) -> bytes:
    """Bytes of 8-byte (else 4-byte) values by their place in the value."""
    width = 8 if len(data) % 8 == 0 else 4
    if len(data) % width:
        raise DataError("the length isn't a multiple of 4")
    return np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes() if data else b""


def byte_stream_join(data: bytes) -> bytes:
    width = 8 if len(data) % 8 == 0 else 4
    if len(data) % width:
        raise DataError("the length isn't a multiple of 4")
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.tobytes() if data else b""


def map_bytes(df: DataFrame, column: str, each, out: str) -> DataFrame:
    """``df`` with ``out``: ``each(bytes)`` of a binary column, by Arrow batches; null stays null."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if x is None else each(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*names, out])

    return df.mapInArrow(run, schema)


def is_sorted(df: DataFrame, keys: list[str], pos: str, value: str, strict: bool = False) -> DataFrame:
    """``keys, is_sorted``: whether values never fall (``strict``: always rise) along the positions."""
    before = F.lag(value).over(_window(keys, pos))
    good = F.col(value) > before if strict else F.col(value) >= before
    marked = df.select(*keys, F.coalesce(good, before.isNull()).alias("_ok"))
    return marked.groupBy(*keys).agg(F.bool_and("_ok").alias("is_sorted"))


def low_cardinality(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """``column_name, distinct_count, low_cardinality`` of each column."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("distinct_count"), (F.col(c) <= most).alias("low_cardinality")) for c in columns])
    return counts.select(F.inline(rows))


def select_encoding(kind: str) -> str:
    """By type alone: enums in a dictionary, other fixed widths and strings plain, the rest as is."""
    name = type_name(kind)
    if name == "ENUM":
        return "DICTIONARY_RLE"
    return "PASSTHROUGH" if name in ("BLOB", "DECIMAL") else "PLAIN"


def advise_encoding(kind: Column, ordered: Column, few: Column, long_runs: Column, shared_prefix: Column) -> Column:
    """By type and by what the data shows."""
    whole = kind.isin("INT8", "INT16", "INT32", "INT64", "UINT8", "UINT16", "UINT32", "UINT64", "TIMESTAMP", "DATE", "TIME", "DURATION")
    return (
        F.when(kind == "BOOLEAN", "BIT_PACKED")
        .when(kind == "BLOB", "PLAIN")
        .when(whole & ordered, "DELTA_BINARY")
        .when(long_runs, "RLE")
        .when(kind.isin("STRING", "ENUM") & few, "DICTIONARY_RLE")
        .when(kind.isin("STRING") & ordered & shared_prefix, "DELTA_BYTE_ARRAY")
        .when(kind.isin("FLOAT32", "FLOAT64"), "BYTE_STREAM_SPLIT")
        .otherwise("PLAIN")
    )


def reassemble(df: DataFrame, keys: list[str], pos: str, columns: list[str]) -> DataFrame:
    """Rows to one array per column and group, and back to rows: the transposition is lossless."""
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, *columns))).alias("_rows"))
    arrays = packed.select(*keys, *[F.col("_rows")[c].alias(c) for c in [pos, *columns]])
    return arrays.select(*keys, F.inline(F.arrays_zip(pos, *columns)))
