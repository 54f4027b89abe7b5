"""Secondary indexes of row groups: Bloom filters, ranges, exact sets, and three-valued predicates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.predicates import Pred

MAY, NOT, OPEN = "MAY_CONTAIN", "DEFINITELY_NOT", "INCONCLUSIVE"


@dataclass(frozen=True)
class BloomShape:
    """Bits (whole bytes) and hashes for ``items`` values at a false-positive rate."""

    bits: int
    hashes: int

    @classmethod
    def of(cls, items: int, rate: float = 0.01) -> BloomShape:
        if items < 1 or not 0 < rate < 1:
            raise ValueError("a Bloom filter needs items and a rate between 0 and 1")
        bits = math.ceil(-items * math.log(rate) / math.log(2) ** 2)
        return cls(-(-bits // 8) * 8, min(max(math.ceil(bits / items * math.log(2)), 1), 16))


def _positions(shape: BloomShape, value: Column) -> Column:
    """The bits of a value: double hashing over two 64-bit hashes of its text."""
    text = value.cast("string")
    h1, h2 = F.xxhash64(text), F.xxhash64(text, F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(shape.hashes - 1)), lambda i: F.pmod(F.pmod(h1, F.lit(shape.bits)) + i * F.pmod(h2, F.lit(shape.bits)), F.lit(shape.bits)))


def bloom_build(df: DataFrame, keys: list[str], value: str, shape: BloomShape) -> DataFrame:
    """``keys, word, bits``: the set words of each group's filter, 32 bits each (nulls aren't in it).

    A filter is rows, not one value: it is built by partial aggregation and has no size limit.
    """
    each = df.where(F.col(value).isNotNull()).select(*keys, F.explode(_positions(shape, F.col(value))).alias("_p"))
    bit = F.pow(F.lit(2), F.pmod("_p", F.lit(32))).cast("long")
    return each.groupBy(*keys, F.expr("_p div 32").alias("word")).agg(F.bit_or(bit).alias("bits"))


def bloom_merge(*filters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The union of filters of one shape, across the groups that ``keys`` leave."""
    every = filters[0]
    for f in filters[1:]:
        if f.columns != every.columns:
            raise ValueError("filters of different groups can't be merged")
        every = every.union(f)
    return every.groupBy(*(keys or []), "word").agg(F.bit_or("bits").alias("bits"))


def bloom_might_contain(probe: DataFrame, value: str, bloom: DataFrame, keys: list[str], shape: BloomShape) -> DataFrame:
    """``probe`` with ``might_contain``; no false negatives. Rows are told apart by all their columns."""
    tagged = probe.withColumn("_id", F.monotonically_increasing_id())
    need = tagged.select("_id", *keys, F.explode(_positions(shape, F.col(value))).alias("_p")).distinct()
    need = need.select("_id", *keys, F.expr("_p div 32").alias("word"), F.pow(F.lit(2), F.pmod("_p", F.lit(32))).cast("long").alias("_bit"))
    met = need.join(bloom, [*keys, "word"], "left")
    found = met.groupBy("_id").agg(F.bool_and(F.coalesce(F.col("bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).alias("might_contain"))
    return tagged.join(found, "_id", "left").select(*probe.columns, F.coalesce("might_contain", F.lit(False)).alias("might_contain"))


def bloom_stats(bloom: DataFrame, keys: list[str], shape: BloomShape) -> DataFrame:
    """``size_bytes, bits, hashes, bits_set, fill_ratio`` of each filter."""
    on = bloom.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("long").alias("bits_set"))
    return on.select(*keys, F.lit(shape.bits // 8).alias("size_bytes"), F.lit(shape.bits).alias("bits"), F.lit(shape.hashes).alias("hashes"), "bits_set", (F.col("bits_set") / shape.bits).alias("fill_ratio"))


class PackedBloom:
    """A filter in one array, for probing without a join where its size is known to be small."""

    def __init__(self, shape: BloomShape, words: DataFrame, most_bytes: int = 16_000_000):
        if shape.bits // 8 > most_bytes:
            raise ValueError("the filter is too large to go to every executor")
        self.shape, self.array = shape, np.zeros(-(-shape.bits // 32), np.uint32)
        for r in words.select("word", "bits").toLocalIterator():
            self.array[r[0]] |= np.uint32(r[1])

    def probe(self, df: DataFrame, value: str, out: str = "might_contain") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.array)
        probes = df.withColumn("_positions", _positions(self.shape, F.col(value)))
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            k = self.shape.hashes
            for batch in batches:
                at = batch.column("_positions").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, k)
                hit = ((bits[at // 32] >> (at % 32).astype(np.uint32)) & 1).astype(bool).all(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(hit)], [*names, out])

        return probes.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType())]))


def range_contains(low: Column, high: Column, value) -> Column:
    return (low <= value) & (value <= high)


def range_overlaps(low: Column, high: Column, a, b) -> Column:
    return (low <= b) & (high >= a)


def hash_index(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, element_count``: the exact set of each group."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("element_count"))


def hash_index_stats(index: DataFrame, keys: list[str]) -> DataFrame:
    return index.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("element_count").alias("element_count"))


def definitely_contains(probe: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    return probe.join(index.select(*on).distinct(), on, "left_semi")


def composite_index(df: DataFrame, columns: list[str], items: int, rate: float = 0.01) -> DataFrame:
    """``rg_id, column_name, min_str, max_str, distinct_count, element_count, size_bytes``, the size being the Bloom filter's."""
    size = BloomShape.of(items, rate).bits // 8
    wide = df.groupBy("rg_id").agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("ndv", F.count_distinct), ("n", F.count))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__min").cast("string").alias("min_str"), F.col(f"{c}__max").cast("string").alias("max_str"), F.col(f"{c}__ndv").alias("distinct_count"), F.col(f"{c}__n").alias("element_count"), F.lit(size).cast("long").alias("size_bytes")) for c in columns])
    return wide.select("rg_id", F.inline(rows))


def index_size(index: DataFrame) -> DataFrame:
    return index.agg(F.sum("size_bytes").alias("total_size_bytes"), F.count_distinct("column_name").alias("columns"))


def three_valued(pred: Pred, low: Column | None = None, high: Column | None = None, member: Column | None = None) -> Column:
    """What an index says about a predicate: ``low`` and ``high`` of a range index, ``member``: whether a Bloom or hash index may have it."""
    says = lambda may: F.when(may, MAY).when(~may, NOT).otherwise(OPEN)
    v = [F.lit(x) for x in pred.values]
    if pred.op == "ne":
        return F.lit(MAY)
    if pred.op in ("eq", "in"):
        return says(member) if member is not None else F.lit(OPEN)
    if low is None or high is None:
        return F.lit(OPEN)
    if pred.op == "between":
        return says(range_overlaps(low, high, v[0], v[1]))
    if pred.op == "gt":
        return says(high > v[0])
    if pred.op == "lt":
        return says(low < v[0])
    return F.lit(OPEN)


def and3(*parts: Column) -> Column:
    """NOT wins; MAY if all may; else open."""
    any_not, all_may = F.lit(False), F.lit(True)
    for p in parts:
        any_not, all_may = any_not | (p == NOT), all_may & (p == MAY)
    return F.when(any_not, NOT).when(all_may, MAY).otherwise(OPEN)
