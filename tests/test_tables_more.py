import pytest
from pyspark.sql import functions as F

from tessera.errors import DataError
from tessera.functions import entropy
from tessera.operators import erasure
from tessera.plans import catalogue
from tessera.plans.predicates import Pred
from tessera.sources import memory
from tessera.sources.table import Table, WriterConfig

from .oracle import compare


@pytest.mark.parametrize("name", ["q38_byte_entropy", "q40_compression_ratio_estimate", "q42_crc32_rows", "q49_type_compat_matrix", "q60_ecc_roundtrip", "q79_type_conversions"])
def test_changed_queries(spark, sf, name):
    compare(spark, sf, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_repeated_and_null_keys_keep_their_values(spark, tmp_path):
    rows = [(1, "aaaabbbb"), (1, "ccccdddd"), (None, "eeeeffff"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "k int, t string").write.parquet(str(tmp_path / "d"))
    config = erasure.Config(parity=2, chunk=3)
    shards = erasure.encode_column(spark.read.parquet(str(tmp_path / "d")), "k", "t", config)
    for left in (shards, shards.where("shard not in (0, 2)")):
        got = [(r.k, bytes(r.data)) for r in erasure.recover_column(left, "k", config).collect()]
        assert sorted(got, key=str) == sorted(((k, t.encode()) for k, t in rows if t is not None), key=str)
    few = erasure.recover_column(shards.where("shard > 2 or k = 2"), "k", config).collect()
    assert [r.data for r in few if r.k == 1] == [None, None]


def test_groups_and_projections(spark, sf, tmp_path):
    t = Table(spark.read.parquet(f"{sf}/events.parquet"), "event_id", 100)
    n = t.rows.count()
    assert t.group(1, ["value", 0]).columns == ["value", "event_id"] and t.group(0, []).columns == []
    assert t.group((n - 1) // 100).count() > 0
    for bad in (-1, -(-n // 100)):
        with pytest.raises(DataError):
            t.group(bad)
    preds = [Pred("value", "gt", (100.0,))]
    some = t.pruned(preds, ["user_id", "user_id", 1])
    assert some.columns == ["user_id", "user_id", "ts"] and some.count() == t.pruned(preds).count()
    with pytest.raises(DataError):
        t.pruned(preds, ["nothing"])
    stored = Table.write(t.rows, str(tmp_path / "t"), "event_id", WriterConfig(100))
    assert sorted(map(tuple, stored.filtered(preds, ["event_id"]).collect())) == sorted(map(tuple, t.filtered(preds, ["event_id"]).collect()))
    plan = t.filtered(preds, ["event_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "props" not in plan


def test_tables_in_memory(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value", "props")
    data = memory.to_bytes(df.repartition(3), "event_id", WriterConfig(100))
    assert data == memory.to_bytes(df, "event_id", WriterConfig(100))
    back = memory.open_bytes(spark, b"head" + data + b"tail!", "event_id", 100, 4, -5)
    assert sorted(map(tuple, back.full().collect())) == sorted(map(tuple, df.collect())) and back.group(2).count() == 100
    for bad in (b"", data[:-1], data[1:], b"PAR1" + b"x" * 40 + b"\xff\xff\xff\x7fPAR1", data[:40] + data[-20:]):
        with pytest.raises(DataError):
            memory.from_bytes(spark, bad)
    with pytest.raises(DataError):
        memory.to_bytes(df, "event_id", most_rows=5)
    empty = memory.from_bytes(spark, memory.to_bytes(df.limit(0), "event_id"))
    assert empty.columns == df.columns and empty.count() == 0


def test_entropy_forms_agree(spark):
    df = spark.createDataFrame([(1, bytearray(b"aab")), (2, bytearray()), (3, None), (None, bytearray(range(256)))], "k int, d binary")
    got = {r.k: r.entropy for r in entropy.byte_entropy(df, "k", "d").collect()}
    assert got[None] == 8.0 and got[2] == got[3] == 0.0
    plain = {r.k: r.e for r in df.select("k", F.coalesce(entropy.entropy(F.col("d")), F.lit(0.0)).alias("e")).collect()}
    assert all(abs(plain[k] - got[k]) < 1e-9 for k in got)
