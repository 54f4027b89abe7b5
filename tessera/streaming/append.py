"""Append-only streams into tables of row groups.

A batch of a stream becomes files plus statistics of its own, both under the batch's id: a batch
that runs again after a failure overwrites what it wrote, so statistics and rows never disagree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import row_group_stats, with_groups


def read_files(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def append(stream: DataFrame, path: str, checkpoint: str, position: str, size: int, interval: str | None = None) -> StreamingQuery:
    """Rows to ``path``/rows and statistics to ``path``/stats, by batch; all there is, or at intervals."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # both writes read the batch once; MEMORY_AND_DISK is recomputed if an executor goes
        batch.persist()
        try:
            batch.sortWithinPartitions(position).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows/batch={batch_id}")
            stats = row_group_stats(with_groups(batch, position, size))
            stats.write.mode("overwrite").parquet(f"{path}/stats/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def merged_stats(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Statistics of whole groups from those of batches; distinct counts become upper bounds."""
    stats = spark.read.parquet(f"{path}/stats")
    out = [F.sum("row_count").alias("row_count")]
    for c in columns:
        out += [F.min(f"{c}__min").alias(f"{c}__min"), F.max(f"{c}__max").alias(f"{c}__max")]
        out += [F.sum(f"{c}__{n}").alias(f"{c}__{n}") for n in ("null_count", "value_count", "ndv")]
    return stats.groupBy("rg_id").agg(*out)


def batch_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))
