import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Nulls everywhere, empty and blank texts, repeated rows, ties, a long text and a clashing column."""
    passage = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i % 5000}x{i // 7}" for i in range(30_000))
    rows = [
        (1, None, "en", "s", 0),
        (2, "", None, None, None),
        (3, " \n\t ", "en", "s", 4),
        (None, "one two three", None, "s", 13),
        (4, "one two three", "en", None, 13),
        (4, "one two three", "en", None, 13),
        (5, passage, "en", "s", len(passage)),
        (6, "before this " + passage + " after that", "en", "s", 100),
        (7, "Ünïcode ñandú <|endoftext|> İstanbul ΣΊΣΥΦΟΣ é 한국어 🎉 x\x1cy", "fr", "s", 50),
        (8, long, "en", "s", len(long)),
        (9, "mail a.b%c@ex-ample.co.uk, card 4111 1111 1111 1111 ip 10.0.0.255 call +49 (0)30 1234567.", "en", "s", 90),
        (10, "x" * 200_000, "en", "s", 200_000),
        (11, "are are are " * 40, "en", "s", 480),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", score string")
    path = str(tmp_path_factory.mktemp("docs") / "odd.parquet")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "empty.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)
