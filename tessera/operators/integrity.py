"""Checksums, validation reports and recovery advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REPORT = ("check", "kind", "fatal", "ok", "detail")


def crc32(data: Column) -> Column:
    return F.crc32(data.cast("binary"))


def verify_crc(data: Column, expected: Column) -> Column:
    return F.coalesce(crc32(data) == expected, F.lit(False))


def valid_magic(data: Column, magic: bytes) -> Column:
    return F.substring(data, 1, len(magic)) == F.lit(magic)


def valid_version(major: Column, supported: int = 1) -> Column:
    """Older and equal major versions can be read."""
    return major <= supported


def truncated(size: Column, least: Column) -> Column:
    return size < least


def invalid_offset(offset: Column, size: Column) -> Column:
    return offset >= size


def offsets_report(offsets: DataFrame, file: str, order: str, offset: str, size: str) -> DataFrame:
    """``file, monotonic, in_bounds, positive``: offsets rise strictly, lie within the file, and begin above 0."""
    before = F.lag(offset).over(Window.partitionBy(file).orderBy(order))
    marked = offsets.select(file, F.coalesce(F.col(offset) > before, F.col(offset) > 0).alias("_up"), (F.col(offset) < F.col(size)).alias("_in"), (F.col(offset) > 0).alias("_pos"))
    return marked.groupBy(file).agg(F.bool_and("_up").alias("monotonic"), F.bool_and("_in").alias("in_bounds"), F.bool_and("_pos").alias("positive"))


def row_counts_report(stats: DataFrame, rows: DataFrame) -> DataFrame:
    """``rg_id, expected, actual, ok`` of groups in the statistics or in the rows (``rows`` has rg_id)."""
    actual = rows.groupBy("rg_id").agg(F.count(F.lit(1)).alias("actual"))
    both = stats.select("rg_id", F.col("row_count").alias("expected")).join(actual, "rg_id", "full")
    return both.select("rg_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("ok"))


def recovery_advice(kind: Column, fatal: Column) -> Column:
    """ABORT if fatal; else skip a chunk with a wrong checksum, use the counted rows, or abort."""
    return F.when(fatal, "ABORT").when(kind == "CHECKSUM_MISMATCH", "SKIP_CHUNK").when(kind == "ROW_COUNT_MISMATCH", "USE_CALCULATED").otherwise("ABORT")


def validate_table(table) -> DataFrame:
    """``check, kind, fatal, ok, detail`` of a ``Table``: row counts by group, and dense, unique positions."""
    rows, stats = table.with_groups(), table.statistics()
    counts = row_counts_report(stats, rows).agg(F.bool_and("ok").alias("ok"), F.sum((~F.col("ok")).cast("int")).alias("bad"))
    counts = counts.select(F.lit("row_counts").alias("check"), F.lit("ROW_COUNT_MISMATCH").alias("kind"), F.lit(False).alias("fatal"), F.coalesce("ok", F.lit(True)).alias("ok"), F.concat(F.coalesce("bad", F.lit(0)).cast("string"), F.lit(" groups")).alias("detail"))
    p = F.col(table.position)
    dense = rows.agg(F.count(p).alias("n"), F.min(p).alias("low"), F.max(p).alias("high"), F.count(F.lit(1)).alias("all"))
    good = (F.col("all") == 0) | (F.col("n") == F.col("all")) & (F.col("low") == 0) & (F.col("high") == F.col("all") - 1)
    dense = dense.select(F.lit("positions").alias("check"), F.lit("INVALID_OFFSET").alias("kind"), F.lit(True).alias("fatal"), F.coalesce(good, F.lit(False)).alias("ok"), F.concat_ws(" to ", F.col("low").cast("string"), F.col("high").cast("string")).alias("detail"))
    return counts.unionByName(dense)
