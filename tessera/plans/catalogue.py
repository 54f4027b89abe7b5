"""The registered queries of the library's own operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, crypto, entropy
from ..operators import encodings as E
from ..operators import erasure, index, integrity
from ..operators import stats as S
from ..sources import inspect
from ..sources.table import Table, WriterConfig, parse_range
from ..streaming import append
from . import evolution, types
from .predicates import Pred

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: Row-group size of the queries over events and over the others.
EVENTS, ROWS = 2_000, 1_000


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _queries[name] = query
        if sql:
            _sql[name] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, or a temporary one where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def events(spark: SparkSession, d: str) -> Table:
    return Table(read(spark, d, "events"), "event_id", EVENTS)


def with_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Orders with nulls: the tables have none of their own."""
    return read(spark, d, "orders").withColumns({"o_orderstatus": F.nullif("o_orderstatus", F.lit("F")), "o_totalprice": F.when(F.pmod("o_orderkey", F.lit(7)) == 0, F.lit(None)).otherwise(F.col("o_totalprice"))})


NULLED = "(select o_orderkey, o_custkey, nullif(o_orderstatus, 'F') as o_orderstatus, case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders)"

# --- scans -------------------------------------------------------------------------------------

SPAN = (datetime(2024, 1, 10), datetime(2024, 1, 13))


@register("q01_scan_filtered", "select event_id, ts, value from events where ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-13' and value > 100")
def _(spark, d):
    return events(spark, d).filtered([Pred("ts", "between", SPAN), Pred("value", "gt", (100.0,))], ["event_id", "ts", "value"])


@register("q02_full_scan", "select * from customer")
def _(spark, d):
    return Table(read(spark, d, "customer"), "c_custkey", ROWS).full()


@register("q03_project_columns", "select o_totalprice, o_orderkey from orders")
def _(spark, d):
    return Table(read(spark, d, "orders"), "o_orderkey", ROWS).columns(["o_totalprice", 0])


@register("q04_read_row_group", "select * from orders where o_orderkey // 1000 = 3")
def _(spark, d):
    return Table(read(spark, d, "orders"), "o_orderkey", ROWS).group(3)


@register("q05_row_range", "select * from events where event_id >= 2500 and event_id < 4100")
def _(spark, d):
    return events(spark, d).range(2500, 4100)


@register("q06_scan_pruned", "with s as (select event_id // 2000 as g from events group by 1 having max(ts) >= timestamp '2024-01-10' and min(ts) <= timestamp '2024-01-13') select e.* from events e where e.event_id // 2000 in (select g from s)")
def _(spark, d):
    return events(spark, d).pruned([Pred("ts", "between", SPAN)])


for _name, _pred, _where in (
    ("q07_filter_is_null", Pred("o_orderstatus", "is_null"), "o_orderstatus is null"),
    ("q08_filter_is_not_null", Pred("o_totalprice", "is_not_null"), "o_totalprice is not null"),
    ("q09_filter_eq", Pred("o_custkey", "eq", (77,)), "o_custkey = 77"),
    ("q10_filter_ne", Pred("o_orderstatus", "ne", ("O",)), "o_orderstatus <> 'O'"),
    ("q11_filter_gt", Pred("o_totalprice", "gt", (450000.0,)), "o_totalprice > 450000"),
    ("q12_filter_lt", Pred("o_orderdate", "lt", (datetime(1993, 1, 1),)), "o_orderdate < timestamp '1993-01-01'"),
    ("q13_filter_between", Pred("o_orderkey", "between", (1500, 2600)), "o_orderkey between 1500 and 2600"),
):
    register(_name, f"select * from {NULLED} where {_where}")(lambda spark, d, p=_pred: Table(with_nulls(spark, d), "o_orderkey", ROWS).filtered([p]))


@register("q14_filter_conjunction", f"select o_orderkey, o_totalprice from {NULLED} where o_totalprice > 100000 and o_custkey < 500 and o_orderstatus is not null")
def _(spark, d):
    return Table(with_nulls(spark, d), "o_orderkey", ROWS).filtered([Pred("o_totalprice", "gt", (100000.0,)), Pred("o_custkey", "lt", (500,)), Pred("o_orderstatus", "is_not_null")], ["o_orderkey", "o_totalprice"])


@register("q66_partial_row", "select o_custkey, o_totalprice from orders where o_orderkey = 2000")
def _(spark, d):
    return Table(read(spark, d, "orders"), "o_orderkey", ROWS).partial_row(2, ["o_custkey", "o_totalprice"])


@register("q67_inspect_head", "select * from supplier where s_suppkey < 10")
def _(spark, d):
    return Table(read(spark, d, "supplier"), "s_suppkey", ROWS).head(10)


# --- statistics --------------------------------------------------------------------------------


@register(
    "q15_row_group_stats",
    f"select o_orderkey // 1000 as rg_id, count(*) as row_count, min(o_totalprice) as min_price, max(o_totalprice) as max_price, count(*) - count(o_totalprice) as null_price, count(o_totalprice) as values_price, count(distinct o_custkey) as ndv_cust, min(o_orderstatus) as min_status from {NULLED} group by 1",
)
def _(spark, d):
    stats = S.row_group_stats(S.with_groups(with_nulls(spark, d), "o_orderkey", ROWS), ["o_totalprice", "o_custkey", "o_orderstatus"], exact=True)
    return stats.select("rg_id", "row_count", F.col("o_totalprice__min").alias("min_price"), F.col("o_totalprice__max").alias("max_price"), F.col("o_totalprice__null_count").alias("null_price"), F.col("o_totalprice__value_count").alias("values_price"), F.col("o_custkey__ndv").alias("ndv_cust"), F.col("o_orderstatus__min").alias("min_status"))


@register("q16_accessible_row_groups", "select event_id // 2000 as rg_id from events group by 1 having max(value) > 150 and min(ts) < timestamp '2024-01-20'")
def _(spark, d):
    t = events(spark, d)
    return S.accessible_groups(t.statistics(["value", "ts"]), [Pred("value", "gt", (150.0,)), Pred("ts", "lt", (datetime(2024, 1, 20),))])


@register("q17_estimate_result_count", "select coalesce(sum(n // 2), 0)::bigint as estimated_rows from (select count(*) as n from events group by event_id // 2000 having max(ts) >= timestamp '2024-01-10' and min(ts) <= timestamp '2024-01-13')")
def _(spark, d):
    return S.estimate_rows(events(spark, d).statistics(["ts"]), [Pred("ts", "between", SPAN)])


@register(
    "q18_column_stats_all_rgs",
    """select c_custkey // 1000 as rg_id, 'c_custkey' as column_name, 'INT64' as logical_type, min(c_custkey)::varchar as min_str, max(c_custkey)::varchar as max_str, 0::bigint as null_count, count(distinct c_custkey) as distinct_count, count(*) as total_count from customer group by 1
    union all select c_custkey // 1000, 'c_mktsegment', 'STRING', min(c_mktsegment), max(c_mktsegment), 0, count(distinct c_mktsegment), count(*) from customer group by 1
    union all select c_custkey // 1000, 'c_nationkey', 'INT32', min(c_nationkey)::varchar, max(c_nationkey)::varchar, 0, count(distinct c_nationkey), count(*) from customer group by 1""",
)
def _(spark, d):
    df, own = S.with_groups(read(spark, d, "customer"), "c_custkey", ROWS), ["c_custkey", "c_mktsegment", "c_nationkey"]
    return S.report(S.row_group_stats(df, own, exact=True), own, {f.name: f.type for f in types.from_spark(df.select(*own).schema).fields})


@register("q19_reassemble_columns", "select c_custkey // 1000 as rg_id, c_custkey, c_name, c_acctbal from customer")
def _(spark, d):
    df = S.with_groups(read(spark, d, "customer"), "c_custkey", ROWS)
    return E.reassemble(df, ["rg_id"], "c_custkey", ["c_name", "c_acctbal"])


@register("q68_chunk_sizes", "select s_suppkey // 1000 as rg_id, sum(octet_length(encode(s_name)))::bigint as s_name__bytes, sum(octet_length(encode(s_nationkey::varchar)))::bigint as s_nationkey__bytes from supplier group by 1")
def _(spark, d):
    return S.chunk_sizes(S.with_groups(read(spark, d, "supplier"), "s_suppkey", ROWS), ["s_name", "s_nationkey"])


@register("q83_column_statistics", "select min(o_totalprice) as min, max(o_totalprice) as max, 0::bigint as null_count, count(*) as value_count, count(*) as row_count from orders")
def _(spark, d):
    return Table(read(spark, d, "orders"), "o_orderkey", ROWS).column_statistics("o_totalprice").drop("ndv")


@register("q84_concat_column", "select c_custkey // 1000 as rg_id, string_agg(c_mktsegment, '' order by c_custkey) as c_mktsegment from customer group by 1")
def _(spark, d):
    return inspect.concat_column(S.with_groups(read(spark, d, "customer"), "c_custkey", ROWS), ["rg_id"], "c_custkey", "c_mktsegment")


@register("q85_file_row_groups", "select count(*) as row_count from events")
def _(spark, d):
    return inspect.file_row_groups(spark, f"{d}/events.parquet").agg(F.sum("row_count").alias("row_count"))


@register("q86_schema_compare", "select * from (values ('map', 'c_custkey', 'c_custkey', 'INT64', 'INT64', 'IDENTICAL'), ('map', 'c_name', 'c_name', 'STRING', 'STRING', 'IDENTICAL'), ('remove', 'c_nationkey', null, 'INT32', null, 'OPTIONAL'), ('remove', 'c_acctbal', null, 'FLOAT64', null, 'OPTIONAL'), ('remove', 'c_mktsegment', null, 'STRING', null, 'OPTIONAL')) t(action, old_name, new_name, old_type, new_type, detail)")
def _(spark, d):
    df = read(spark, d, "customer")
    return inspect.compare_schemas(spark, types.from_spark(df.schema), types.from_spark(df.select("c_custkey", "c_name").schema))


# --- encodings ---------------------------------------------------------------------------------

RUNS = "select g, event_id, event_type, sum(c) over (partition by g order by event_id) as run_id from (select event_id // 2000 as g, event_id, event_type, case when event_type = lag(event_type) over (partition by event_id // 2000 order by event_id) then 0 else 1 end as c from events)"


def grouped_events(spark, d):
    return S.with_groups(read(spark, d, "events"), "event_id", EVENTS)


@register("q20_rle_encode", f"select g as rg_id, run_id::bigint as run_id, min(event_id) as first_pos, event_type, count(*) as run_length from ({RUNS}) group by g, run_id, event_type")
def _(spark, d):
    return E.rle_encode(grouped_events(spark, d), ["rg_id"], "event_id", "event_type")


@register("q21_rle_decode", "select event_id // 2000 as rg_id, event_id, event_type from events")
def _(spark, d):
    return E.rle_decode(E.rle_encode(grouped_events(spark, d), ["rg_id"], "event_id", "event_type"), ["rg_id"], "event_type", "event_id")


DOD = "select g, event_id, n, v, d, lag(d) over (partition by g order by event_id) as pd from (select event_id // 2000 as g, event_id, row_number() over w as n, epoch_us(ts) as v, epoch_us(ts) - lag(epoch_us(ts)) over w as d from events window w as (partition by event_id // 2000 order by event_id))"


def micros(spark, d):
    return grouped_events(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@register("q22_delta_of_delta_encode", f"select g as rg_id, event_id, n::int as n, case when n = 1 then v when n = 2 then d else d - pd end as dod from ({DOD})")
def _(spark, d):
    return E.delta_of_delta_encode(micros(spark, d), ["rg_id"], "event_id", "us")


@register("q23_delta_decode", "select event_id // 2000 as rg_id, event_id, epoch_us(ts) as us from events")
def _(spark, d):
    return E.delta_of_delta_decode(E.delta_of_delta_encode(micros(spark, d), ["rg_id"], "event_id", "us"), ["rg_id"], "event_id", "us")


DICT = "select g, event_type, row_number() over (partition by g order by f) - 1 as code from (select event_id // 2000 as g, event_type, min(event_id) as f from events group by 1, 2)"


@register("q24_dictionary_encode", f"select e.event_id // 2000 as rg_id, e.event_id, c.code from events e join ({DICT}) c on c.g = e.event_id // 2000 and c.event_type = e.event_type")
def _(spark, d):
    return E.dictionary_encode(grouped_events(spark, d), ["rg_id"], "event_id", "event_type")


@register("q25_dictionary_rle_encode", f"select r.g as rg_id, run_id::bigint as run_id, min(event_id) as first_pos, code, count(*) as run_length from ({RUNS}) r join ({DICT}) c on c.g = r.g and c.event_type = r.event_type group by r.g, run_id, code")
def _(spark, d):
    return E.dictionary_rle_encode(grouped_events(spark, d), ["rg_id"], "event_id", "event_type")


def sorted_names(spark, d):
    """Part names in order within each of the groups by brand."""
    return read(spark, d, "part").select("p_brand", F.concat_ws("/", "p_name", "p_type", F.lpad("p_partkey", 9, "0")).alias("name"))


NAMES_SQL = "(select p_brand, p_name || '/' || p_type || '/' || lpad(p_partkey::varchar, 9, '0') as name from part)"


@register(
    "q26_prefix_delta_encode",
    f"select p_brand, pos, shared, substr(name, shared + 1) as suffix from (select p_brand, name as pos, name, case when b is null then 0 else len(list_filter(range(1, least(length(name), length(b)) + 1), lambda i: left(name, i::int) = left(b, i::int)))::int end as shared from (select *, lag(name) over (partition by p_brand order by name) as b from {NAMES_SQL}))",
)
def _(spark, d):
    df = sorted_names(spark, d).withColumn("pos", F.col("name"))
    return E.prefix_delta_encode(df, ["p_brand"], "pos", "name")


@register("q69_prefix_delta_decode", "select c_nationkey, c_custkey, c_name from customer")
def _(spark, d):
    df = read(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name")
    return E.prefix_delta_decode(E.prefix_delta_encode(df, ["c_nationkey"], "c_custkey", "c_name"), ["c_nationkey"], "c_custkey", "c_name")


def flags(spark, d):
    return grouped_events(spark, d).select("rg_id", "event_id", (F.col("value") > 20).alias("flag"))


@register("q27_bit_pack", "select event_id // 2000 as rg_id, event_id // 8 as byte_no, sum(case when value > 20 then 1 << (7 - event_id % 8)::int else 0 end)::int as byte, count(*)::int as bits from events group by 1, 2")
def _(spark, d):
    return E.bit_pack(flags(spark, d), ["rg_id"], "event_id", "flag")


@register("q28_bit_unpack", "select event_id // 2000 as rg_id, event_id, value > 20 as flag from events")
def _(spark, d):
    return E.bit_unpack(E.bit_pack(flags(spark, d), ["rg_id"], "event_id", "flag"), ["rg_id"], "event_id", "flag")


@register("q70_byte_stream_split", "select event_id, value from events")
def _(spark, d):
    raw = grouped_events(spark, d).select("event_id", "value", bits.little_endian((F.col("value") * 100).cast("long"), 8).alias("raw"))
    packed = raw.groupBy(F.expr("event_id div 64").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("event_id", "value", "raw"))).alias("r"))
    packed = packed.select("r", F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["raw"])), "")).alias("bytes"))
    joined = E.map_bytes(E.map_bytes(packed, "bytes", E.byte_stream_split, "split"), "split", E.byte_stream_join, "back")
    return joined.where(F.col("back") == F.col("bytes")).select(F.inline("r")).select("event_id", "value")


@register("q35_is_sorted_per_rg", "select g as rg_id, bool_and(coalesce(ts >= b, true)) as is_sorted from (select event_id // 2000 as g, ts, lag(ts) over (partition by event_id // 2000 order by event_id) as b from events) group by g")
def _(spark, d):
    return E.is_sorted(grouped_events(spark, d), ["rg_id"], "event_id", "ts")


@register("q36_low_cardinality", "select 'event_type' as column_name, count(distinct event_type) as distinct_count, count(distinct event_type) <= 16 as low_cardinality from events union all select 'user_id', count(distinct user_id), count(distinct user_id) <= 16 from events")
def _(spark, d):
    return E.low_cardinality(read(spark, d, "events"), ["event_type", "user_id"], 16)


@register(
    "q37_encoding_advisor",
    """with m as (select 'event_id' as column_name, 'INT64' as logical_type, (select bool_and(coalesce(event_id >= b, true)) from (select event_id, lag(event_id) over (order by event_id) as b from events)) as ordered, count(distinct event_id) <= 256 as few from events
    union all select 'event_type', 'STRING', (select bool_and(coalesce(event_type >= b, true)) from (select event_type, lag(event_type) over (partition by event_id // 2000 order by event_id) as b from events)), count(distinct event_type) <= 256 from events
    union all select 'value', 'FLOAT64', (select bool_and(coalesce(value >= b, true)) from (select value, lag(value) over (partition by event_id // 2000 order by event_id) as b from events)), count(distinct value) <= 256 from events)
    select column_name, logical_type, case when logical_type = 'INT64' and ordered then 'DELTA_BINARY' when logical_type = 'STRING' and few then 'DICTIONARY_RLE' when logical_type = 'FLOAT64' then 'BYTE_STREAM_SPLIT' else 'PLAIN' end as encoding from m""",
)
def _(spark, d):
    df = grouped_events(spark, d)
    out = None
    for c, kind in (("event_id", "INT64"), ("event_type", "STRING"), ("value", "FLOAT64")):
        ordered = E.is_sorted(df, ["rg_id"], "event_id", c).agg(F.bool_and("is_sorted").alias("ordered"))
        few = E.low_cardinality(df, [c], 256).select(F.col("low_cardinality").alias("few"))
        # each side is one row
        one = few.withColumn("_k", F.lit(1)).join(ordered.withColumn("_k", F.lit(1)), "_k").select(F.lit(c).alias("column_name"), F.lit(kind).alias("logical_type"), "ordered", "few")
        out = one if out is None else out.unionByName(one)
    no = F.lit(False)
    return out.select("column_name", "logical_type", E.advise_encoding(F.col("logical_type"), F.col("ordered"), F.col("few"), no, no).alias("encoding"))


# --- kernels -----------------------------------------------------------------------------------


@register("q29_zigzag", "select s_suppkey, z, s_suppkey * (case when s_suppkey % 2 = 0 then 1 else -1 end) as back from (select s_suppkey, case when s_suppkey % 2 = 0 then 2 * s_suppkey else 2 * s_suppkey - 1 end as z from supplier)")
def _(spark, d):
    v = F.col("s_suppkey") * F.when(F.pmod("s_suppkey", F.lit(2)) == 0, 1).otherwise(-1)
    return read(spark, d, "supplier").select("s_suppkey", bits.zigzag(v).alias("z"), bits.unzigzag(bits.zigzag(v)).alias("back"))


@register("q30_varint", "select o_orderkey, greatest(1, ceil(length(bin(o_orderkey * 1000003)) / 7.0))::int as bytes, o_orderkey * 1000003 as back from orders")
def _(spark, d):
    v = F.col("o_orderkey") * 1000003
    return read(spark, d, "orders").select("o_orderkey", bits.varint_length(v).alias("bytes"), bits.unvarint(bits.varint(v)).alias("back"))


@register("q31_popcount", "select o_orderkey, bit_count(o_orderkey)::int as ones from orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", bits.popcount(F.col("o_orderkey")).alias("ones"))


@register("q32_min_bits", "select o_orderkey, length(bin(o_orderkey))::int as bits, (case when o_orderkey = 0 then 64 else 64 - length(bin(o_orderkey)) end)::int as leading, (case when o_orderkey = 0 then 64 else strpos(reverse(bin(o_orderkey)), '1') - 1 end)::int as trailing from orders")
def _(spark, d):
    v = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", bits.min_bits(v).alias("bits"), bits.leading_zeros(v).alias("leading"), bits.trailing_zeros(v).alias("trailing"))


@register("q33_next_pow2", "select o_orderkey, (case when o_orderkey <= 1 then 1 else 1::bigint << length(bin(o_orderkey - 1))::int end)::bigint as next, o_orderkey > 0 and bit_count(o_orderkey) = 1 as is_power from orders")
def _(spark, d):
    v = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", bits.next_power_of_two(v).alias("next"), bits.is_power_of_two(v).alias("is_power"))


@register("q34_count_bytes", "select doc_id, length(text) - length(replace(text, 'e', '')) as n from documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", bits.count_byte(F.col("text"), "e").cast("long").alias("n"))


@register("q71_pack_bits", "select o_orderkey // 10 as k, string_agg((o_orderkey % 8)::varchar, ',' order by o_orderkey) as back from orders group by 1")
def _(spark, d):
    lists = read(spark, d, "orders").groupBy(F.expr("o_orderkey div 10").alias("k")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("v"))
    small = F.transform("v", lambda x: F.pmod(x, F.lit(8)))
    return lists.select("k", F.array_join(bits.unpack_bits(bits.pack_bits(small, 3), 3, F.size("v")).cast("array<string>"), ",").alias("back"))


@register("q72_pack_booleans", "select o_orderkey // 10 as k, string_agg((o_orderstatus = 'O')::varchar, ',' order by o_orderkey) as back from orders group by 1")
def _(spark, d):
    lists = read(spark, d, "orders").groupBy(F.expr("o_orderkey div 10").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", (F.col("o_orderstatus") == "O").alias("b")))), lambda x: x["b"]).alias("v"))
    return lists.select("k", F.array_join(bits.unpack_flags(bits.pack_flags(F.col("v")), F.size("v")).cast("array<string>"), ",").alias("back"))


@register("q73_little_endian", "select o_orderkey, (o_orderkey * 65537)::decimal(20, 0) as back, reverse_hex as le from (select o_orderkey, concat(substr(h, 15, 2), substr(h, 13, 2), substr(h, 11, 2), substr(h, 9, 2), substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2)) as reverse_hex from (select o_orderkey, lpad(hex(o_orderkey * 65537), 16, '0') as h from orders))")
def _(spark, d):
    raw = bits.little_endian(F.col("o_orderkey") * 65537, 8)
    return read(spark, d, "orders").select("o_orderkey", bits.from_little_endian(raw).alias("back"), F.hex(raw).alias("le"))


@register("q74_xor_reverse", "select o_orderkey, xor(o_orderkey % 256, 90)::int as x, list_reduce(list_transform(range(8), lambda i: ((o_orderkey % 256) >> i & 1) << (7 - i)), lambda a, b: a + b)::int as reversed from orders")
def _(spark, d):
    v = F.pmod("o_orderkey", F.lit(256))
    x = bits.xor_bytes(bits.little_endian(v, 1), F.unhex(F.lit("5A")))
    return read(spark, d, "orders").select("o_orderkey", F.conv(F.hex(x), 16, 10).cast("int").alias("x"), bits.reverse_byte(v).alias("reversed"))


@register("q75_delta_encode", "select o_orderkey // 1000 as rg_id, o_orderkey, (o_custkey - coalesce(lag(o_custkey) over (partition by o_orderkey // 1000 order by o_orderkey), 0))::int as delta from orders")
def _(spark, d):
    return bits.delta_encode(S.with_groups(read(spark, d, "orders"), "o_orderkey", ROWS), ["rg_id"], "o_orderkey", "o_custkey")


@register("q76_delta_decode", "select o_orderkey // 1000 as rg_id, o_orderkey, o_custkey::int as o_custkey from orders")
def _(spark, d):
    df = S.with_groups(read(spark, d, "orders"), "o_orderkey", ROWS)
    return bits.delta_decode(bits.delta_encode(df, ["rg_id"], "o_orderkey", "o_custkey"), ["rg_id"], "o_orderkey", "o_custkey")


@register("q65_size_human", "select o_orderkey, case when s >= 1099511627776 then printf('%.1f TB', s / 1099511627776.0) when s >= 1073741824 then printf('%.1f GB', s / 1073741824.0) when s >= 1048576 then printf('%.1f MB', s / 1048576.0) when s >= 1024 then printf('%.1f KB', s / 1024.0) else printf('%d B', s) end as size from (select o_orderkey, o_orderkey * o_orderkey * 1000 as s from orders)")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", bits.human_size(F.col("o_orderkey") * F.col("o_orderkey") * 1000).alias("size"))


# --- entropy, codecs, integrity ----------------------------------------------------------------

#: A row for each id and length, none for a text without a byte.
ENTROPY = "select doc_id, n, log2(n) - sum(c * log2(c)) / n as h from (select doc_id, n, b, count(*) as c from (select doc_id, length(x) // 2 as n, unnest(regexp_extract_all(x, '..')) as b from (select doc_id, hex(encode({text})) as x from documents)) group by doc_id, n, b) group by doc_id, n"


@register("q38_byte_entropy", f"select doc_id, round(h, 6) as entropy from ({ENTROPY.format(text='text')})")
def _(spark, d):
    return entropy.keyed_entropy(read(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("data")), "doc_id", "data").select("doc_id", F.round("entropy", 6).alias("entropy"))


UNITS = f"select event_type, event_id // {EVENTS} as rg_id, hex(encode(string_agg(props, '' order by event_id))) as x from events group by 1, 2"
UNIT_BYTES = f"select event_type, rg_id, x[1:28] as head, length(x) // 2 as n_bytes, least(length(x) // 2, {entropy.SAMPLE}) as n, unnest(regexp_extract_all(x[1:{2 * entropy.SAMPLE}], '..')) as b from ({UNITS})"
UNIT_ENTROPY = f"select event_type, rg_id, head, n_bytes, log2(n) - sum(c * log2(c)) / n as h from (select event_type, rg_id, head, n_bytes, n, b, count(*) as c from ({UNIT_BYTES}) group by all) group by event_type, rg_id, head, n_bytes, n"
UNIT_MAGIC = " or ".join(f"starts_with(head, '{m}')" for m in entropy.MAGIC.values())


@register("q87_codec_advisor_units", f"select event_type, rg_id, n_bytes, round(h, 6) as entropy, case when n_bytes < {entropy.LEAST} or {UNIT_MAGIC} or h > {entropy.DENSE} then 'NONE' else 'ZSTD' end as codec from ({UNIT_ENTROPY})")
def _(spark, d):
    grouped = S.with_groups(read(spark, d, "events"), "event_id", EVENTS)
    return entropy.advise_units(grouped, ["event_type", "rg_id"], "event_id", "props").withColumn("entropy", F.round("entropy", 6))


DOC_HEX = "select doc_id, hex(encode(coalesce(text, ''))) as x from documents"
DOC_ENTROPY = f"select doc_id, x[1:28] as head, length(x) // 2 as n_bytes, log2(least(length(x) // 2, {entropy.SAMPLE})) - list_sum([c * log2(c) for c in map_values(list_histogram(regexp_extract_all(x[1:{2 * entropy.SAMPLE}], '..')))]) / least(length(x) // 2, {entropy.SAMPLE}) as h from ({DOC_HEX}) where x <> '' union all select doc_id, '', 0, 0.0 from ({DOC_HEX}) where x = ''"


@register("q39_codec_advisor", f"select doc_id, case when n_bytes < {entropy.LEAST} or {UNIT_MAGIC} or h > {entropy.DENSE} then 'NONE' else 'ZSTD' end as codec, round(h, 6) as entropy from ({DOC_ENTROPY})")
def _(spark, d):
    data = F.coalesce("text", F.lit("")).cast("binary")
    docs = read(spark, d, "documents").select("doc_id", data.alias("data")).withColumn("h", entropy.entropy(F.substring("data", 1, entropy.SAMPLE)))
    return docs.select("doc_id", entropy.advise_codec(F.col("data"), F.col("h")).alias("codec"), F.round("h", 6).alias("entropy"))


@register("q40_compression_ratio_estimate", f"select doc_id, round(1 / (1 + exp(-15 * (h / 8 - 0.6))), 5) as ratio, h > 7.4 as dense from ({ENTROPY.format(text='text')})")
def _(spark, d):
    found = entropy.keyed_entropy(read(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("data")), "doc_id", "data")
    return found.select("doc_id", F.round(entropy.ratio_estimate(F.col("entropy")), 5).alias("ratio"), entropy.likely_compressed(F.col("entropy")).alias("dense"))


HEADS = (("a", "1F8B0800", "gzip"), ("b", "504B0304FF", "zip"), ("c", "28B52FFD00", "zstd"), ("d", "04224D18", "lz4"), ("e", "526172211A", "rar"), ("f", "377ABCAF271C", "7z"), ("g", "425A6839", "bzip2"), ("h", "5D00008000FFFFFFFFFFFFFFFFFF", "lzma"), ("i", "5D000080", None), ("j", "1F8B", None), ("k", "00010203", None))


@register("q41_magic_detect", "select * from (values " + ", ".join(f"('{k}', {repr(m) if m else 'null'})" for k, _, m in HEADS) + ") t(k, format)")
def _(spark, d):
    df = spark.createDataFrame([(k, bytearray.fromhex(h)) for k, h, _ in HEADS], "k string, data binary")
    return df.select("k", entropy.magic(F.col("data")).alias("format"))


@register("q77_compress_roundtrip", "select event_id, props as zstd, props as lz4 from events")
def _(spark, d):
    df = read(spark, d, "events").select("event_id", F.col("props").cast("binary").alias("data"))
    for codec in ("zstd", "lz4"):
        df = entropy.decompress(entropy.compress(df, "data", codec, out=f"{codec}_raw"), f"{codec}_raw", codec, out=f"{codec}_back")
    return df.select("event_id", *[F.decode(f"{c}_back", "UTF-8").alias(c) for c in ("zstd", "lz4")])


#: CRC-32 bit by bit would take eight steps a byte; this takes one, from a table that the same rule makes.
CRC_TABLE = "(select list(v order by i) as t from (select i, list_reduce([i::ubigint] || [0::ubigint for z in range(8)], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as v from (select unnest(range(256)) as i)))"
CRC_SQL = f"""select doc_id, xor(list_reduce([4294967295::ubigint] || [('0x' || h)::ubigint for h in regexp_extract_all(hex(encode(text)), '..')], lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint])), 4294967295::ubigint)::bigint as crc32, true as ok from documents, {CRC_TABLE}"""


@register("q42_crc32_rows", CRC_SQL)
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", integrity.crc32(F.col("text")).alias("crc32"), integrity.verify_crc(F.col("text"), integrity.crc32(F.col("text"))).alias("ok"))


@register("q43_validation_report", """select 'row_counts' as "check", 'ROW_COUNT_MISMATCH' as kind, false as fatal, true as ok, '0 groups' as detail union all select 'positions', 'INVALID_OFFSET', true, (min(event_id) = 0 and max(event_id) = count(*) - 1), min(event_id) || ' to ' || max(event_id) from events""")
def _(spark, d):
    return integrity.validate_table(events(spark, d))


REPORTS = ((1, "CHECKSUM_MISMATCH", False), (2, "ROW_COUNT_MISMATCH", False), (3, "INVALID_OFFSET", True), (4, "TRUNCATED", True), (5, "CHECKSUM_MISMATCH", True), (6, "OTHER", False))


@register("q44_recovery_advice", "select id, case when fatal then 'ABORT' when kind = 'CHECKSUM_MISMATCH' then 'SKIP_CHUNK' when kind = 'ROW_COUNT_MISMATCH' then 'USE_CALCULATED' else 'ABORT' end as advice from (values " + ", ".join(f"({i}, '{k}', {str(f).lower()})" for i, k, f in REPORTS) + ") t(id, kind, fatal)")
def _(spark, d):
    return spark.createDataFrame(list(REPORTS), "id int, kind string, fatal boolean").select("id", integrity.recovery_advice(F.col("kind"), F.col("fatal")).alias("advice"))


@register("q78_offsets_report", "select o_custkey % 10 as file, bool_and(coalesce(o_orderkey > b, o_orderkey > 0)) as monotonic, bool_and(o_orderkey < 14000) as in_bounds, bool_and(o_orderkey > 0) as positive from (select *, lag(o_orderkey) over (partition by o_custkey % 10 order by o_orderkey) as b from orders) group by 1")
def _(spark, d):
    df = read(spark, d, "orders").select(F.pmod("o_custkey", F.lit(10)).alias("file"), "o_orderkey", F.col("o_orderkey").alias("off"), F.lit(14000).alias("size"))
    return integrity.offsets_report(df, "file", "o_orderkey", "off", "size")


@register("q45_sha256_fingerprint", "select sha256('id' || chr(4) || chr(0) || 'name' || chr(15) || chr(1)) as schema_sha256")
def _(spark, d):
    schema = types.SchemaBuilder().add("id", "INT64").add("name", "STRING", "OPTIONAL").build()
    # chr(0) is the byte of REQUIRED
    return types.fingerprints(spark, {"s": schema}).select("schema_sha256")


# --- schemas -----------------------------------------------------------------------------------


@register("q46_evolve_widen_cast", "select c_custkey, c_nationkey::bigint as c_nationkey, c_name, null::date as c_since from customer")
def _(spark, d):
    old = types.SchemaBuilder().add("c_custkey", "INT64").add("c_nationkey", "INT32").add("c_name", "STRING").build()
    new = types.SchemaBuilder().add("c_custkey", "INT64").add("c_nationkey", "INT64").add("c_name", "STRING").add("c_since", "DATE", "OPTIONAL").build()
    return evolution.apply_migration(read(spark, d, "customer"), evolution.plan_migration(old, new), new)


@register("q47_evolve_narrow_try", "select o_orderkey, try_cast(trunc(o_totalprice) as int) as o_totalprice, try_cast(o_custkey as tinyint) as o_custkey from orders")
def _(spark, d):
    old = types.SchemaBuilder().add("o_orderkey", "INT64").add("o_totalprice", "FLOAT64").add("o_custkey", "INT64").build()
    new = types.SchemaBuilder().add("o_orderkey", "INT64").add("o_totalprice", "INT32").add("o_custkey", "INT8").build()
    return evolution.apply_migration(read(spark, d, "orders"), evolution.plan_migration(old, new), new)


@register("q48_evolve_add_drop_rename", "select s_suppkey, s_name as name, null::double as rating from supplier")
def _(spark, d):
    old = types.SchemaBuilder().add("s_suppkey", "INT64").add("s_name", "STRING").add("s_acctbal", "FLOAT64", "OPTIONAL").build()
    new = types.SchemaBuilder().add("s_suppkey", "INT64").add("name", "STRING").add("rating", "FLOAT64", "OPTIONAL").build()
    return evolution.apply_migration(read(spark, d, "supplier"), evolution.plan_migration(old, new, {"s_name": "name"}), new)


def _pairs(table: dict[str, str]) -> str:
    return "(values " + ", ".join(f"('{a}', '{b}')" for a, every in table.items() for b in every.split()) + ")"


TYPES = "(values " + ", ".join(f"('{n}')" for n in types.NAMES) + ")"


@register(
    "q49_type_compat_matrix",
    f"""with pairs as (select a.t as from_type, b.t as to_type,
           case when a.t = b.t then 'IDENTICAL' when (a.t, b.t) in (select (x, y) from {_pairs(evolution.WIDENING)} w(x, y)) then 'WIDENING'
                when (a.t, b.t) in (select (x, y) from {_pairs(evolution.NARROWING)} n(x, y)) then 'NARROWING' else 'INCOMPATIBLE' end as level
           from {TYPES} a(t), {TYPES} b(t))
        select *, level in ('IDENTICAL', 'WIDENING') as safe, level <> 'INCOMPATIBLE' as possible from pairs""",
)
def _(spark, d):
    return evolution.compatibility_matrix(spark)


@register("q50_migration_plan", "select * from (values ('map', 'c_custkey', 'c_custkey', 'INT64', 'INT64', 'IDENTICAL'), ('map', 'c_nationkey', 'c_nationkey', 'INT32', 'INT64', 'WIDENING'), ('map', 'c_acctbal', 'c_acctbal', 'FLOAT64', 'FLOAT32', 'NARROWING'), ('add', null, 'c_email', null, 'STRING', 'OPTIONAL'), ('remove', 'c_mktsegment', null, 'STRING', null, 'OPTIONAL')) t(action, old_name, new_name, old_type, new_type, detail)")
def _(spark, d):
    old = types.SchemaBuilder().add("c_custkey", "INT64").add("c_nationkey", "INT32").add("c_acctbal", "FLOAT64").add("c_mktsegment", "STRING", "OPTIONAL").build()
    new = types.SchemaBuilder().add("c_custkey", "INT64").add("c_nationkey", "INT64").add("c_acctbal", "FLOAT32").add("c_email", "STRING", "OPTIONAL").build()
    return evolution.plan_migration(old, new).as_df(spark)


@register("q79_type_conversions", "select * from (values " + ", ".join(f"('{n}', '{a}', '{b}', {str(ok).lower()})" for n, a, b, ok in evolution.CONVERSIONS) + ") t(name, from_type, to_type, safe)")
def _(spark, d):
    return evolution.conversions(spark)


@register("q80_unsigned_conform", "select o_orderkey::decimal(20, 0) as o_orderkey, o_custkey::bigint as o_custkey, o_orderstatus from orders")
def _(spark, d):
    schema = types.SchemaBuilder().add("o_orderkey", "UINT64").add("o_custkey", "UINT32").add("o_orderstatus", "ENUM", metadata={"enum_values": "F,O,P"}).build()
    return types.conform(read(spark, d, "orders"), schema)


# --- indexes -----------------------------------------------------------------------------------


@register("q51_bloom_membership", "select event_id, user_id from events where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def _(spark, d):
    shape = index.BloomShape.of(50_000)
    wanted = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    packed = index.PackedBloom(shape, index.bloom_build(wanted, [], "user_id", shape))
    may = packed.probe(read(spark, d, "events").select("event_id", "user_id"), "user_id").where("might_contain")
    return index.definitely_contains(may, wanted, ["user_id"]).select("event_id", "user_id")


@register("q52_bloom_merge", "select 0::bigint as different_words")
def _(spark, d):
    shape = index.BloomShape.of(10_000)
    df = read(spark, d, "orders")
    parts = [index.bloom_build(df.where(F.pmod("o_orderkey", F.lit(2)) == i), [], "o_custkey", shape) for i in (0, 1)]
    merged, whole = index.bloom_merge(*parts), index.bloom_build(df, [], "o_custkey", shape)
    both = merged.withColumnRenamed("bits", "b").join(whole, "word", "full")
    return both.agg(F.count_if(~F.col("b").eqNullSafe(F.col("bits"))).alias("different_words"))


@register("q53_bloom_stats")
def _(spark, d):
    shape = index.BloomShape.of(ROWS)
    df = S.with_groups(read(spark, d, "orders"), "o_orderkey", ROWS)
    return index.bloom_stats(index.bloom_build(df, ["rg_id"], "o_custkey", shape), ["rg_id"], shape)


@register("q54_range_overlap", "select event_id // 2000 as rg_id, min(ts) <= timestamp '2024-01-13' and max(ts) >= timestamp '2024-01-10' as overlaps, min(value) <= 50 and 50 <= max(value) as contains_50 from events group by 1")
def _(spark, d):
    stats = events(spark, d).statistics(["ts", "value"])
    return stats.select("rg_id", index.range_overlaps(F.col("ts__min"), F.col("ts__max"), *map(F.lit, SPAN)).alias("overlaps"), index.range_contains(F.col("value__min"), F.col("value__max"), F.lit(50.0)).alias("contains_50"))


@register("q55_hash_index", "select o_orderkey // 1000 as rg_id, count(distinct o_custkey) as distinct_count, count(o_custkey) as element_count from orders group by 1")
def _(spark, d):
    df = S.with_groups(read(spark, d, "orders"), "o_orderkey", ROWS)
    return index.hash_index_stats(index.hash_index(df, ["rg_id"], "o_custkey"), ["rg_id"])


@register("q56_predicate_three_valued", "select g as rg_id, case when lo <= 300 and hi >= 200 then 'MAY_CONTAIN' else 'DEFINITELY_NOT' end as in_range, case when hi > 190 then 'MAY_CONTAIN' else 'DEFINITELY_NOT' end as above, 'MAY_CONTAIN' as unequal, 'INCONCLUSIVE' as equal, case when not (lo <= 300 and hi >= 200) then 'DEFINITELY_NOT' else 'INCONCLUSIVE' end as both from (select event_id // 2000 as g, min(value) as lo, max(value) as hi from events group by 1)")
def _(spark, d):
    stats = events(spark, d).statistics(["value"])
    low, high = F.col("value__min"), F.col("value__max")
    inside, same = index.three_valued(Pred("value", "between", (200.0, 300.0)), low, high), index.three_valued(Pred("value", "eq", (5.0,)), low, high)
    return stats.select("rg_id", inside.alias("in_range"), index.three_valued(Pred("value", "gt", (190.0,)), low, high).alias("above"), index.three_valued(Pred("value", "ne", (5.0,))).alias("unequal"), same.alias("equal"), index.and3(inside, same).alias("both"))


@register("q57_in_list_prune", "select event_id, user_id from events where user_id in (3, 14, 15)")
def _(spark, d):
    return events(spark, d).filtered([Pred("user_id", "in", (3, 14, 15))], ["event_id", "user_id"])


@register("q81_composite_index", "select o_orderkey // 1000 as rg_id, 'o_custkey' as column_name, min(o_custkey)::varchar as min_str, max(o_custkey)::varchar as max_str, count(distinct o_custkey) as distinct_count, count(o_custkey) as element_count, 1199::bigint as size_bytes from orders group by 1")
def _(spark, d):
    df = S.with_groups(read(spark, d, "orders"), "o_orderkey", ROWS)
    return index.composite_index(df, ["o_custkey"], ROWS)


# --- security ----------------------------------------------------------------------------------

#: Only for the queries below; real keys come from the caller.
DEMO_KEY, DEMO_SALT = bytes(range(32)), bytes(range(32, 64))


@register("q58_aes_roundtrip", "select c_custkey, c_name as back, null::varchar as wrong_key from customer")
def _(spark, d):
    right, wrong = crypto.Encryption(DEMO_KEY, DEMO_SALT), crypto.Encryption(DEMO_SALT, DEMO_SALT)
    sealed = right.encrypt(F.col("c_name"))
    df = read(spark, d, "customer").select("c_custkey", sealed.alias("sealed"))
    return df.select("c_custkey", right.decrypt(F.col("sealed")).cast("string").alias("back"), wrong.decrypt(F.col("sealed")).cast("string").alias("wrong_key"))


@register("q59_per_column_encrypt", "select c_custkey, c_name, c_nationkey from customer")
def _(spark, d):
    own = crypto.ColumnEncryption(DEMO_KEY, ("c_name", "c_nationkey"))
    sealed = own.encrypt(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"))
    return own.decrypt(sealed, {"c_name": "string", "c_nationkey": "int"})


@register("q60_ecc_roundtrip", "select doc_id, text from documents")
def _(spark, d):
    config = erasure.Config(parity=4, chunk=1024)
    shards = erasure.encode_column(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", config)
    left = shards.where(~F.col("shard").isin(0, 2, 5))
    return erasure.recover_column(left, "doc_id", config).select("doc_id", F.col("data").cast("string").alias("text"))


# --- ingest and streams ------------------------------------------------------------------------

HEADERS = ("bytes=0-99", "bytes=5-5", "bytes=9-3", "bytes=1-2,4-5", "items=0-9", "bytes=-5", "bytes=7-", "")


@register("q61_http_range_parse", r"select h, coalesce(a <= b, false) as ok, case when a <= b then a end as range_start, case when a <= b then b end as range_end, case when a <= b then b - a + 1 end as size from (select h, try_cast(regexp_extract(h, '^bytes=(\d+)-(\d+)$', 1) as bigint) as a, try_cast(regexp_extract(h, '^bytes=(\d+)-(\d+)$', 2) as bigint) as b from (values " + ", ".join(f"('{h}')" for h in HEADERS) + ") t(h))")
def _(spark, d):
    r = parse_range(F.col("h"))
    return spark.createDataFrame([(h,) for h in HEADERS], "h string").select("h", r["ok"].alias("ok"), r["start"].alias("range_start"), r["end"].alias("range_end"), r["size"].alias("size"))


@register("q62_json_ingest", "select event_id, json_extract(props, '$.k')::int as k from events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@register("q63_sample_every_n", "select * from events where event_id % 100 = 0")
def _(spark, d):
    return events(spark, d).sample(100)


@register("q64_streaming_append_stats", "select event_id // 2000 as rg_id, count(*) as row_count, min(ts) as min_ts, max(ts) as max_ts from events group by 1")
def _(spark, d):
    path = work_dir(spark, "stream")
    source = read(spark, d, "events")
    # a pattern, as the table may be one file or a folder
    stream = append.read_files(spark, f"{d}/events.parquet*", source.schema, files_per_batch=1)
    append.append(stream, f"{path}/table", f"{path}/checkpoint", "event_id", EVENTS).awaitTermination()
    merged = append.merged_stats(spark, f"{path}/table", ["ts"])
    return merged.select("rg_id", "row_count", F.col("ts__min").alias("min_ts"), F.col("ts__max").alias("max_ts"))


@register("q82_write_and_reopen", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier where s_acctbal > 5000")
def _(spark, d):
    schema = types.SchemaBuilder().add("s_suppkey", "INT64").add("s_name", "STRING").add("s_nationkey", "INT32").add("s_acctbal", "FLOAT64").build()
    path = work_dir(spark, "table")
    Table.write(read(spark, d, "supplier"), path, "s_suppkey", schema=schema)
    return Table.open(spark, path, schema).filtered([Pred("s_acctbal", "gt", (5000.0,))])


@register("q88_encrypted_table", "select c_custkey, c_name, c_nationkey, c_acctbal from customer where c_acctbal > 5000 and c_nationkey <> 7")
def _(spark, d):
    path, own = work_dir(spark, "table"), crypto.ColumnEncryption(DEMO_KEY, ("c_name", "c_nationkey"))
    source = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    Table.write(source, path, "c_custkey", WriterConfig(ROWS, encryption=own))
    return Table.open(spark, path, encryption=own).filtered([Pred("c_acctbal", "gt", (5000.0,)), Pred("c_nationkey", "ne", (7,))])


@register("q89_recovered_table", "select s_suppkey, s_name, s_acctbal from supplier")
def _(spark, d):
    path = work_dir(spark, "table")
    source = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    Table.write(source, path, "s_suppkey", WriterConfig(ROWS, parity=erasure.Config(parity=4, chunk=1024)))
    return Table.recovered(spark, path).full()
