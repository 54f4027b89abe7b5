"""Tables in memory: Parquet files as bytes on the driver, of a stated size at most."""

from __future__ import annotations

import io

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from ..errors import DataError
from .table import Table, WriterConfig

#: Bytes that a file on the driver may have.
MOST_BYTES = 64 << 20
MAGIC = b"PAR1"


def check_bytes(data: bytes) -> None:
    """DataError unless ``data`` begins and ends as a Parquet file does and its footer lies inside."""
    if len(data) < 12 or data[:4] != MAGIC or data[-4:] != MAGIC:
        raise DataError("not a Parquet file, or a truncated one")
    footer = int.from_bytes(data[-8:-4], "little")
    if not 0 < footer <= len(data) - 12:
        raise DataError("the footer lies outside the file")


def from_bytes(spark: SparkSession, data: bytes, start: int = 0, end: int | None = None) -> DataFrame:
    """The rows of a Parquet file that is ``data`` or a slice of it; nothing is read from disk."""
    data = bytes(data[start:end])
    if len(data) > MOST_BYTES:
        raise DataError(f"{len(data)} bytes; a file in memory may have {MOST_BYTES}")
    check_bytes(data)
    try:
        return spark.createDataFrame(pq.read_table(io.BytesIO(data)))
    except pa.ArrowException as e:
        raise DataError(f"damaged Parquet file: {e}") from e


def open_bytes(spark: SparkSession, data: bytes, position: str, size: int, start: int = 0, end: int | None = None) -> Table:
    """A table over bytes; statistics are made when they are asked for."""
    return Table(from_bytes(spark, data, start, end), position, size)


def to_bytes(df: DataFrame, position: str, config: WriterConfig | None = None, most_rows: int = 1_000_000) -> bytes:
    """``df`` in order of position as one Parquet file; DataError beyond ``most_rows`` rows or ``MOST_BYTES``."""
    config = config or WriterConfig()
    rows = df.orderBy(position).limit(most_rows + 1).toArrow()
    if rows.num_rows > most_rows:
        raise DataError(f"more than {most_rows} rows; write a folder instead")
    out = io.BytesIO()
    level = {"compression_level": min(max(config.level, 1), 10)} if config.codec == "zstd" else {}
    pq.write_table(rows, out, row_group_size=config.row_group_size, compression=config.codec, **level)
    if out.tell() > MOST_BYTES:
        raise DataError(f"more than {MOST_BYTES} bytes; write a folder instead")
    return out.getvalue()
