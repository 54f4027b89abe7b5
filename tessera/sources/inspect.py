"""Looking into files and schemas: what the command line offers, as functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError
from ..plans.evolution import plan_migration
from ..plans.types import Schema, from_spark


def file_row_groups(spark: SparkSession, path: str, most_files: int = 10_000) -> DataFrame:
    """``file, row_group, start, end, row_count, columns`` from the Parquet footers below ``path``; no data is read.

    Footers are read by the JVM through Hadoop's file systems. More than ``most_files`` files are
    refused, as this runs on the driver.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    listed = top.getFileSystem(conf).listFiles(top, True)
    rows: list[tuple] = []
    files = 0
    while listed.hasNext():
        status = listed.next()
        name = status.getPath().getName()
        if name.startswith(("_", ".")) or not name.endswith(".parquet"):
            continue
        files += 1
        if files > most_files:
            raise DataError(f"more than {most_files} files")
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf))
        try:
            for i, block in enumerate(reader.getFooter().getBlocks()):
                start = block.getStartingPos()
                rows.append((status.getPath().toString(), i, start, start + block.getCompressedSize(), block.getRowCount(), block.getColumns().size()))
        finally:
            reader.close()
    return spark.createDataFrame(rows, "file string, row_group int, start long, end long, row_count long, columns int")


def group_of_row(position: int, size: int, rows: int) -> int:
    """The row group of a row."""
    if not 0 <= position < rows:
        raise DataError(f"no row {position} of {rows}")
    return position // size


def concat_column(df: DataFrame, keys: list[str], pos: str, column: str) -> DataFrame:
    """A column's values of each group one after another, without length prefixes; nulls add nothing."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(pos, F.col(column).cast("string").alias("v")))), lambda r: r["v"])
    return df.groupBy(*keys).agg(F.array_join(values, "").alias(column))


def extract_schema(df: DataFrame) -> str:
    """The logical schema as JSON."""
    return json.dumps([{"name": f.name, "type": f.type, "nullability": f.nullability, "metadata": f.metadata} for f in from_spark(df.schema).fields])


def infer_schema(spark: SparkSession, path: str, kind: str, **options) -> Schema:
    """The logical schema of CSV, JSON, ORC or Parquet files."""
    reader = spark.read.options(**({"inferSchema": "true", "header": "true"} if kind == "csv" else {}) | options)
    return from_spark(reader.format(kind).load(path).schema)


def validate_schema(df: DataFrame, schema: Schema) -> list[str]:
    """What keeps ``df`` from having the schema."""
    have = {f.name: f for f in df.schema.fields}
    out = [f"missing: {f.name}" for f in schema.fields if f.name not in have]
    out += [f"extra: {n}" for n in have if schema.by_name(n) is None]
    for f in schema.fields:
        if f.name in have and have[f.name].dataType != f.spark().dataType:
            out.append(f"{f.name}: {have[f.name].dataType.simpleString()} instead of {f.spark().dataType.simpleString()}")
    return out


def compare_schemas(spark: SparkSession, old: Schema, new: Schema) -> DataFrame:
    return plan_migration(old, new).as_df(spark)
