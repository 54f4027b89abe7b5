"""Runs a query and its SQL over the same files and compares names and values."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    return c


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


def compare(spark, d, query, sql):
    df = query(spark, d)
    names = sorted(df.columns)
    spark_rows = sorted(tuple(canon(r[n]) for n in names) for r in df.collect())
    found = connect(d).sql(sql)
    assert sorted(found.columns) == names, (found.columns, names)
    at = [found.columns.index(n) for n in names]
    sql_rows = sorted(tuple(canon(r[i]) for i in at) for r in found.fetchall())
    assert len(spark_rows) == len(sql_rows), (len(spark_rows), len(sql_rows))
    for a, b in zip(spark_rows, sql_rows):
        assert a == b
