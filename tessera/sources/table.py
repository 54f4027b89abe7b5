"""Tables of row groups: Parquet files with a sidecar of statistics.

Groups are logical: a row's group is its position divided by the group size, so every scan finds
it without a window. ``write`` stores rows sorted by position and asks Parquet for row groups of
the same size; the statistics are computed once, then, and never in a scan.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import DataError
from ..functions.crypto import ColumnEncryption
from ..operators import erasure
from ..operators import stats as S
from ..plans.predicates import Pred, to_filter
from ..plans.types import Schema, conform

#: Surviving groups up to this many become an IN list; more are joined.
MOST_LISTED = 10_000

ENCODINGS = {"auto": {}, "plain": {"parquet.enable.dictionary": "false"}, "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"}}


@dataclass(frozen=True)
class WriterConfig:
    row_group_size: int = S.ROW_GROUP
    codec: str = "zstd"
    level: int = 3
    #: ``plain`` (no dictionaries), ``delta`` (integers and strings by difference) or what Parquet picks.
    encoding: str = "auto"
    encryption: ColumnEncryption | None = None
    #: Parity shards of the stored files, from which damaged or lost ones are rebuilt.
    parity: erasure.Config | None = None

    def __post_init__(self) -> None:
        if self.row_group_size < 1:
            raise ValueError("a row group needs a row")
        if self.codec not in ("zstd", "lz4", "none", "snappy"):
            raise ValueError(f"unknown codec {self.codec!r}")
        if self.encoding not in ENCODINGS:
            raise ValueError(f"unknown encoding {self.encoding!r}")

    def options(self) -> dict[str, str]:
        codec = "uncompressed" if self.codec == "none" else "lz4raw" if self.codec == "lz4" else self.codec
        return {"compression": codec, "parquet.compression.codec.zstd.level": str(min(max(self.level, 0), 10)), "parquet.block.row.count.limit": str(self.row_group_size), **ENCODINGS[self.encoding]}


class Table:
    """A DataFrame with a dense position column, and its statistics."""

    def __init__(self, rows: DataFrame, position: str, size: int = S.ROW_GROUP, stats: DataFrame | None = None):
        if position not in rows.columns:
            raise DataError(f"no position column {position!r}")
        self.rows, self.position, self.size, self.stats = rows, position, size, stats

    # -- sinks

    @classmethod
    def write(cls, df: DataFrame, path: str, position: str, config: WriterConfig | None = None, schema: Schema | None = None, stats_columns: list[str] | None = None) -> Table:
        """Stores the rows, the statistics and the settings.

        ``df`` is read twice, as the ranges of positions are found from a sample; statistics are
        taken from the stored rows. Encrypted columns have none, as extremes would give values away.
        A stored file is the unit of memory where parity is made.
        """
        config = config or WriterConfig()
        df = conform(df, schema) if schema else df
        own = config.encryption
        kinds = {c: df.schema[c].dataType for c in (own.columns if own else ()) if c in df.columns}
        if own and (len(kinds) < len(own.columns) or position in kinds or any(isinstance(k, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for k in kinds.values())):
            raise DataError("encrypted columns must be plain columns of the table, and not the position")
        df = own.encrypt(df) if own else df
        S.with_groups(df, position, config.row_group_size).repartitionByRange("rg_id").sortWithinPartitions(position).drop("rg_id").write.options(**config.options()).mode("errorifexists").parquet(f"{path}/rows")
        spark = df.sparkSession
        stored = spark.read.parquet(f"{path}/rows")
        clear = [c for c in (stored.columns if stats_columns is None else stats_columns) if c not in kinds]
        S.row_group_stats(S.with_groups(stored, position, config.row_group_size), clear).write.parquet(f"{path}/stats")
        if config.parity:
            shards = erasure.encode_column(_files(spark, path), "file", "content", config.parity)
            shards.withColumn("bytes", F.when(F.col("is_parity"), F.col("bytes"))).write.parquet(f"{path}/parity")
        meta = {"position": position, "size": config.row_group_size, "schema_id": schema.schema_id() if schema else None, "rows": stored.schema.json()}
        meta |= {"encrypted": {c: k.simpleString() for c, k in kinds.items()}, "key_check": own.key_check() if own else None}
        meta["parity"] = [config.parity.parity, config.parity.chunk] if config.parity else None
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{path}/meta")
        return cls.open(spark, path, encryption=own)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: Schema | None = None, encryption: ColumnEncryption | None = None) -> Table:
        """Reads the settings; a schema with another fingerprint than the stored one, or another key, is refused.

        Without ``encryption`` encrypted columns are the stored bytes. With it, reading a value that
        was tampered with is an error.
        """
        return cls._opened(spark, path, spark.read.parquet(f"{path}/rows"), schema, encryption)

    @classmethod
    def _opened(cls, spark: SparkSession, path: str, rows: DataFrame, schema: Schema | None, encryption: ColumnEncryption | None) -> Table:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        if schema and meta["schema_id"] not in (None, schema.schema_id()):
            raise DataError("the table was written with another schema")
        types = meta.get("encrypted") or {}
        if encryption and types:
            if meta["key_check"] != encryption.key_check():
                raise DataError("the table was written with another key")
            sealed = ColumnEncryption(encryption.master, tuple(types))
            both = rows.select("*", *[F.col(c).alias(f"_sealed_{c}") for c in types])
            clear = sealed.decrypt(both, types)
            genuine = lambda c: F.when(F.col(f"_sealed_{c}").isNotNull() & F.col(c).isNull(), F.raise_error(F.lit(f"{c}: not genuine")).cast(types[c])).otherwise(F.col(c))
            rows = clear.select(*[genuine(c).alias(c) if c in types else F.col(c) for c in rows.columns])
        return cls(rows, meta["position"], meta["size"], spark.read.parquet(f"{path}/stats"))

    @classmethod
    def recovered(cls, spark: SparkSession, path: str, schema: Schema | None = None, encryption: ColumnEncryption | None = None) -> Table:
        """The table with damaged or lost files rebuilt from parity, for writing to another folder.

        Reading fails if a file has lost more shards of a block than there is parity.
        """
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        kind = T.StructType.fromJson(json.loads(meta["rows"]))
        arrow = to_arrow_schema(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, data in zip(batch.column("file").to_pylist(), batch.column("data").to_pylist()):
                    if data is None:
                        raise DataError(f"{file} has lost too much to be rebuilt")
                    found = pq.read_table(io.BytesIO(data), coerce_int96_timestamp_unit="us")
                    yield from found.select(arrow.names).cast(arrow).to_batches(max_chunksize=10_000)

        files = erasure.recover_column(cls._shards(spark, path, meta), "file", erasure.Config(*meta["parity"]))
        return cls._opened(spark, path, files.mapInArrow(run, kind), schema, encryption)

    @classmethod
    def damage(cls, spark: SparkSession, path: str) -> DataFrame:
        """``file, damaged``: the data shards of each stored file that are lost or altered."""
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        wrong = ~F.col("is_parity") & ~F.coalesce(F.crc32("bytes") == F.col("crc32"), F.lit(False))
        return cls._shards(spark, path, meta).groupBy("file").agg(F.count_if(wrong).alias("damaged"))

    @staticmethod
    def _shards(spark: SparkSession, path: str, meta: dict) -> DataFrame:
        if not meta.get("parity"):
            raise DataError("the table was written without parity")
        have = erasure.encode_column(_files(spark, path), "file", "content", erasure.Config(*meta["parity"])).where("not is_parity")
        have = have.select("file", "block", "shard", F.lit(False).alias("is_parity"), F.col("bytes").alias("found"))
        stored = spark.read.parquet(f"{path}/parity").join(have, ["file", "block", "shard", "is_parity"], "left")
        return stored.withColumn("bytes", F.coalesce("bytes", "found")).drop("found")

    # -- scans

    def with_groups(self) -> DataFrame:
        return S.with_groups(self.rows, self.position, self.size)

    def statistics(self, columns: list[str] | None = None) -> DataFrame:
        return self.stats if self.stats is not None else S.row_group_stats(self.with_groups(), columns)

    def row_count(self) -> int:
        """From the statistics alone where there are any."""
        return self.stats.agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0] if self.stats is not None else self.rows.count()

    def column_statistics(self, name: str) -> DataFrame:
        """One column's extremes and counts over all groups; the distinct count is an upper bound."""
        self.columns([name])
        s = self.statistics([name])
        if f"{name}__min" not in s.columns:
            raise DataError(f"no statistics of {name!r}")
        sums = [F.sum(f"{name}__{n}").alias(n) for n in ("null_count", "value_count", "ndv")]
        return s.agg(F.min(f"{name}__min").alias("min"), F.max(f"{name}__max").alias("max"), *sums, F.sum("row_count").alias("row_count"))

    def full(self) -> DataFrame:
        return self.rows

    def columns(self, names: list[str | int]) -> DataFrame:
        """Columns by name or index, in the order asked for."""
        known = self.rows.columns
        picked = []
        for n in names:
            if isinstance(n, int) and not 0 <= n < len(known) or isinstance(n, str) and n not in known:
                raise DataError(f"no column {n!r}")
            picked.append(known[n] if isinstance(n, int) else n)
        return self.rows.select(*picked)

    def group(self, i: int, columns: list[str | int] | None = None) -> DataFrame:
        """One row group or some of its columns, as a range of positions that Parquet can push down; DataError past the end."""
        if i < 0 or i and self.rows.where(F.col(self.position) >= i * self.size).isEmpty():
            raise DataError(f"no row group {i}")
        picked = self.columns(columns).columns if columns is not None else self.rows.columns
        return self.range(i * self.size, (i + 1) * self.size).select(*picked)

    def range(self, start: int, end: int) -> DataFrame:
        """Rows at positions from ``start`` up to ``end``, exactly."""
        return self.rows.where((F.col(self.position) >= start) & (F.col(self.position) < end))

    def pruned(self, preds: list[Pred], columns: list[str | int] | None = None) -> DataFrame:
        """All rows, or some columns of them, of the groups that may hold rows that pass.

        Without stored statistics those of the predicates' columns are made, extremes and null
        counts only. The surviving groups are merged into position
        ranges, which are pushed down to the files; where there are very many, they are joined.
        """
        named = self.columns(columns).columns if columns is not None else self.rows.columns
        known = sorted({p.column for p in preds} & set(self.rows.columns))
        stats = self.stats if self.stats is not None else S.row_group_stats(self.with_groups(), known, distinct=False)
        keep = S.accessible_groups(stats, preds)
        ids = [r[0] for r in keep.orderBy("rg_id").limit(MOST_LISTED + 1).collect()]
        if len(ids) > MOST_LISTED:
            return self.with_groups().join(keep, "rg_id", "left_semi").select(*named)
        return self.rows.where(self._ranges(ids)).select(*named)

    def _ranges(self, ids: list[int]):
        merged: list[list[int]] = []
        for i in ids:
            if merged and merged[-1][1] == i:
                merged[-1][1] = i + 1
            else:
                merged.append([i, i + 1])
        p = F.col(self.position)
        parts = [(p >= a * self.size) & (p < b * self.size) for a, b in merged]
        # a balanced tree of ORs: a chain of thousands would overflow the planner's stack
        while len(parts) > 1:
            parts = [parts[i] | parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else F.lit(False)

    def filtered(self, preds: list[Pred], columns: list[str | int] | None = None) -> DataFrame:
        """Exactly the rows that pass, or some columns of them: pruned groups and the filter itself."""
        named = self.columns(columns).columns if columns is not None else self.rows.columns
        return self.pruned(preds).where(to_filter(preds)).select(*named)

    def partial_row(self, i: int, columns: list[str]) -> DataFrame:
        """The first row of a group, or none."""
        return self.range(i * self.size, (i + 1) * self.size).orderBy(self.position).limit(1).select(*columns)

    def sample(self, every: int) -> DataFrame:
        return self.rows.where(F.pmod(F.col(self.position), F.lit(every)) == 0)

    def head(self, n: int) -> DataFrame:
        return self.rows.orderBy(self.position).limit(n)

    def inspect(self) -> DataFrame:
        """Each column's type, nullability and place."""
        rows = [(i, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("logical")) for i, f in enumerate(self.rows.schema.fields)]
        return self.rows.sparkSession.createDataFrame(rows, "ordinal int, name string, type string, nullable boolean, logical_type string")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``file, content`` of the stored row files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/rows").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")


def convert(spark: SparkSession, source: str, kind: str, target: str, to: str = "parquet", schema: str | None = None, every: int | None = None, position: str | None = None, **options) -> None:
    """Reads CSV, JSON, ORC or Parquet and writes one of them, or every n-th row by a position column."""
    for k in (kind, to):
        if k not in ("csv", "json", "orc", "parquet"):
            raise DataError(f"unknown format {k!r}")
    reader = spark.read.options(**options)
    df = (reader.schema(schema) if schema else reader).format(kind).load(source)
    if every:
        if not position:
            raise DataError("sampling needs a position column")
        df = df.where(F.pmod(F.col(position).cast("long"), F.lit(every)) == 0)
    df.write.format(to).options(**({"header": "true"} if to == "csv" else {})).save(target)


def parse_range(header) -> dict:
    """Columns ``ok, start, end, size`` of an HTTP byte range ``bytes=a-b`` with a at most b."""
    form = r"^bytes=(\d{1,18})-(\d{1,18})$"
    start, end = (F.nullif(F.regexp_extract(header, form, i), F.lit("")).cast("long") for i in (1, 2))
    ok = F.coalesce(start <= end, F.lit(False))
    return {"ok": ok, "start": F.when(ok, start), "end": F.when(ok, end), "size": F.when(ok, end - start + 1)}


def format_range(start, end):
    return F.format_string("bytes=%d-%d", start, end)


def slice_bytes(data, start, end):
    """The bytes from ``start`` to ``end``, both included, as far as there are any."""
    return F.substring(data, (start + 1).cast("int"), (end - start + 1).cast("int"))
