"""Byte entropy over texts that are empty, null or share an id: rows and values are those of the SQL."""

import math

import duckdb
import pytest

from tessera.functions import entropy
from tessera.plans import catalogue

TEXTS = [(1, "plain text"), (2, "zażółć gęślą"), (3, "aaaaa")]
CASES = {
    "empty": [(4, "")],
    "null": [(4, None)],
    "row_twice": [(1, "plain text")],
    "same_id_and_length": [(1, "PLAIN_TEXT"), (1, "tlain pext"), (2, "zażółć gęśla!")],
    "same_id": [(1, "another one")],
    "null_ids": [(None, "ab"), (None, "cd"), (None, "abcd"), (None, ""), (None, None)],
    "nothing": None,
}


def agree(spark, tmp_path, name, more):
    rows = [] if more is None else TEXTS + more
    # a file for each row, so that equal ids come from different tasks
    spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows) or 1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df, found = catalogue.queries()[name](spark, str(tmp_path)), con.sql(catalogue.oracle_sql()[name])
    assert df.columns == found.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(found.fetchall(), key=str)


@pytest.mark.parametrize("case", CASES)
def test_byte_entropy(spark, tmp_path, case):
    agree(spark, tmp_path, "q38_byte_entropy", CASES[case])


@pytest.mark.parametrize("case", CASES)
def test_ratio_estimate(spark, tmp_path, case):
    agree(spark, tmp_path, "q40_compression_ratio_estimate", CASES[case])


def test_dense_and_often_repeated_texts(spark, tmp_path):
    # over 7.4 bits a byte: as many bytes of ASCII as of pairs; and so many copies that the exponential overflows
    dense = "".join(map(chr, range(128))) + "".join(chr(0x80 + 29 * i) for i in range(64))
    agree(spark, tmp_path, "q40_compression_ratio_estimate", [(4, dense), (5, dense[::-1]), *[(6, "many copies of this one")] * 80])


def test_counts_of_a_key_are_added_up(spark):
    rows = [("a", b"aab"), ("a", b"abb"), ("a", b"ab"), ("b", b"\x00\xff" * 3), ("c", b""), ("d", None), (None, bytes(range(256)))]
    for parts in (1, len(rows)):
        df = spark.createDataFrame([(k, v and bytearray(v)) for k, v in rows], "k string, d binary").repartition(parts)
        got = {(r.k, r.n_bytes): r.entropy for r in entropy.keyed_entropy(df, "k", "d").collect()}
        assert set(got) == {("a", 3), ("a", 2), ("b", 6), (None, 256)}
        assert got[None, 256] == 8.0 and got["a", 2] == 1.0 and got["b", 6] == pytest.approx(1.0)
        assert got["a", 3] == pytest.approx(math.log2(3) - 2 * 3 * math.log2(3) / 3)
