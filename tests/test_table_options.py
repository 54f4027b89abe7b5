import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException

from tessera.errors import DataError
from tessera.functions.crypto import ColumnEncryption
from tessera.operators.erasure import Config
from tessera.plans import catalogue
from tessera.plans.predicates import Pred
from tessera.sources.table import Table, WriterConfig

from .oracle import compare

KEY, OTHER = bytes(range(32)), bytes(range(1, 33))


@pytest.fixture(scope="module")
def rows(spark):
    at = datetime.datetime(2024, 10, 27, 1, 30, 0, 123456)
    data = [(i, None if i % 7 == 0 else f"name {i}", i * 0.1, at + datetime.timedelta(hours=i), bytes([i % 256, 0, 255])) for i in range(500)]
    return spark.createDataFrame(data, "id long, name string, x double, at timestamp, raw binary").coalesce(1)


def plain(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["q39_codec_advisor", "q88_encrypted_table", "q89_recovered_table"])
def test_queries(spark, sf, name):
    compare(spark, sf, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_encrypted_columns_of_a_table(spark, rows, tmp_path):
    own, path = ColumnEncryption(KEY, ("name", "x", "at", "raw")), str(tmp_path / "t")
    table = Table.write(rows, path, "id", WriterConfig(100, encryption=own))
    assert plain(table.full()) == plain(rows) and table.full().dtypes == rows.dtypes
    assert {c for c in table.stats.columns if "__" in c} == {f"id__{n}" for n in ("min", "max", "null_count", "value_count", "ndv")}
    assert table.filtered([Pred("x", "gt", (49.0,)), Pred("id", "lt", (495,))], ["id"]).count() == 4
    with pytest.raises(DataError, match="statistics"):
        table.column_statistics("x")
    sealed = dict(Table.open(spark, path).full().dtypes)
    assert sealed == {"id": "bigint", "name": "binary", "x": "binary", "at": "binary", "raw": "binary"}
    stored = b"".join(f.read_bytes() for f in Path(path, "rows").glob("*.parquet"))
    assert b"name 3" not in stored
    with pytest.raises(DataError, match="another key"):
        Table.open(spark, path, encryption=ColumnEncryption(OTHER, own.columns))


def test_a_value_from_another_column_is_an_error(spark, rows, tmp_path):
    own, path = ColumnEncryption(KEY, ("name", "raw")), str(tmp_path / "t")
    Table.write(rows, path, "id", WriterConfig(100, encryption=own))
    swapped = spark.read.parquet(f"{path}/rows").selectExpr("id", "raw as name", "x", "at", "raw").collect()
    spark.createDataFrame(swapped, spark.read.parquet(f"{path}/rows").schema).write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(PySparkException, match="not genuine"):
        Table.open(spark, path, encryption=own).full().collect()


@pytest.mark.parametrize("columns", [("id",), ("absent",)])
def test_columns_that_cannot_be_encrypted(rows, tmp_path, columns):
    with pytest.raises(DataError):
        Table.write(rows, str(tmp_path / "t"), "id", WriterConfig(100, encryption=ColumnEncryption(KEY, columns)))


def test_damaged_and_lost_files_are_rebuilt(spark, rows, tmp_path):
    path, own = str(tmp_path / "t"), ColumnEncryption(KEY, ("name",))
    Table.write(rows, path, "id", WriterConfig(100, encryption=own, parity=Config(parity=8, chunk=512)))
    assert all(r.damaged == 0 for r in Table.damage(spark, path).collect())
    file = max(Path(path, "rows").glob("*.parquet"), key=lambda f: f.stat().st_size)
    data = bytearray(file.read_bytes())
    for at in (3, 700, len(data) - 5):
        data[at] ^= 255
    # a checksum file of the local file system would refuse the damaged bytes
    file.with_name(f".{file.name}.crc").unlink()
    file.write_bytes(data[:-2])
    assert max(r.damaged for r in Table.damage(spark, path).collect()) == 3
    assert plain(Table.recovered(spark, path, encryption=own).full()) == plain(rows)
    for i in range(0, len(data) - 2, 512):
        data[i] ^= 1
    file.write_bytes(data)
    with pytest.raises(PySparkException, match="lost too much"):
        Table.recovered(spark, path).full().collect()


def test_without_parity_nothing_is_recovered(spark, rows, tmp_path):
    Table.write(rows, str(tmp_path / "t"), "id")
    with pytest.raises(DataError, match="without parity"):
        Table.recovered(spark, str(tmp_path / "t"))


def test_encoding_choice(rows, tmp_path):
    found = {}
    for kind in ("auto", "plain", "delta"):
        Table.write(rows, str(tmp_path / kind), "id", WriterConfig(100, encoding=kind))
        file = max((tmp_path / kind / "rows").glob("*.parquet"), key=lambda f: f.stat().st_size)
        found[kind] = set(pq.read_metadata(file).row_group(0).column(0).encodings)
    assert "DELTA_BINARY_PACKED" in found["delta"] and "PLAIN" in found["plain"] and not any("DICTIONARY" in e for e in found["plain"])
    with pytest.raises(ValueError):
        WriterConfig(encoding="other")
