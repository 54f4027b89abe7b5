"""Row-group statistics: one row per group, minimum and maximum in each column's own type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.predicates import Pred, to_prune

#: Rows of a group unless said otherwise.
ROW_GROUP = 100_000


def with_groups(df: DataFrame, position: str, size: int = ROW_GROUP) -> DataFrame:
    """The group of each row from a dense position column: no window, so no shuffle."""
    return df.withColumn("rg_id", F.expr(f"`{position}` div {int(size)}"))


def _ordered(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.ArrayType, T.StructType, T.BinaryType, T.VariantType))


def row_group_stats(df: DataFrame, columns: list[str] | None = None, exact: bool = False, distinct: bool = True) -> DataFrame:
    """``rg_id, row_count`` and per column ``__min, __max, __null_count, __value_count, __ndv``.

    ``df`` has ``rg_id``. Partial aggregation sends one row per group and task; ``exact`` counts
    distinct values exactly, otherwise by a sketch; without ``distinct`` there is no ``__ndv``. Columns without an order have null extremes.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in df.columns if c != "rg_id"] if columns is None else columns
    out = [F.count(F.lit(1)).alias("row_count")]
    for c in columns:
        ordered = _ordered(kinds[c])
        out += [
            (F.min(c) if ordered else F.lit(None).cast(kinds[c])).alias(f"{c}__min"),
            (F.max(c) if ordered else F.lit(None).cast(kinds[c])).alias(f"{c}__max"),
            (F.count(F.lit(1)) - F.count(c)).alias(f"{c}__null_count"),
            F.count(c).alias(f"{c}__value_count"),
        ]
        if distinct:
            out.append((F.count_distinct(c) if exact else F.approx_count_distinct(c)).alias(f"{c}__ndv"))
    return df.groupBy("rg_id").agg(*out)


def report(stats: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """The long form: a row for each group and column, extremes as text."""
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit((types or {}).get(c)).cast("string").alias("logical_type"),
            F.col(f"{c}__min").cast("string").alias("min_str"),
            F.col(f"{c}__max").cast("string").alias("max_str"),
            F.col(f"{c}__null_count").alias("null_count"),
            F.col(f"{c}__ndv").alias("distinct_count"),
            F.col("row_count").alias("total_count"),
        )
        for c in columns
    ]
    return stats.select("rg_id", F.inline(F.array(*rows)))


def accessible_groups(stats: DataFrame, preds: list[Pred]) -> DataFrame:
    """The groups that may hold rows that pass."""
    return stats.where(to_prune(preds, stats.columns)).select("rg_id")


def estimate_rows(stats: DataFrame, preds: list[Pred]) -> DataFrame:
    """Half of each surviving group's rows, rounded down and summed; without predicates too."""
    return stats.where(to_prune(preds, stats.columns)).agg(F.coalesce(F.sum(F.expr("row_count div 2")), F.lit(0)).cast("long").alias("estimated_rows"))


def chunk_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bytes of each column's values by group, as text or binary."""
    size = lambda c: F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)).cast("long").alias(f"{c}__bytes")
    return df.groupBy("rg_id").agg(*[size(c) for c in columns])
