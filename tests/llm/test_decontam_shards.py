import numpy as np

from tessera.llm import decontam


def test_shards_and_order_leave_scores_alone(spark, sf01, monkeypatch, tmp_path):
    items = spark.read.parquet(f"{sf01}/benchmark.parquet").limit(12).collect()
    docs = spark.createDataFrame([(i, " ".join(r.text.split()[: max(6, len(r.text.split()) * 3 // 4)])) for i, r in enumerate(items)], "doc_id long, text string")

    def hits(rows):
        found = decontam.mark(docs, spark.createDataFrame(rows, "item_id long, text string").coalesce(1), 0.3, 0.0, 0.0).select("doc_id", "hits").collect()
        return {(r.doc_id, h.item_id): h.score for r in found for h in r.hits}

    rows = [(r.item_id, r.text) for r in items]
    whole = hits(rows)
    monkeypatch.setattr(decontam, "SHARD_WORDS", 60)
    for order in (rows, rows[::-1], rows[::2] + rows[1::2]):
        got = hits(order)
        assert got.keys() == whole.keys() and whole
        assert np.allclose([got[k] for k in whole], list(whole.values()), atol=1e-6)
    # several passes
    monkeypatch.setattr(decontam, "PASS_INDEXES", 2)
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = hits(rows)
    assert got.keys() == whole.keys() and np.allclose([got[k] for k in whole], list(whole.values()), atol=1e-6)


def test_parts_far_apart_do_not_make_a_hit(spark):
    """Question and answer must be where the passage is, not anywhere in the text."""
    question, answer = "which of the seven rivers of the northern plain carries most water in spring?", "the broad grey river of the eastern gate"
    filler = " ".join(f"filler{i}" for i in range(400))
    docs = spark.createDataFrame([(1, f"{question} {answer}"), (2, f"{question} {filler} {answer}"), (3, f"{filler} {question} {answer} {filler}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"{question} {answer}")], "item_id long, text string")
    assert {r.doc_id for r in decontam.op4_decontamination(docs, items).collect()} == {1, 3}


def test_statistics_are_those_of_all_entries(monkeypatch):
    texts = ["one two three", None, "two three four " * 30, "", "five"]
    plain = decontam.statistics(texts)
    monkeypatch.setattr(decontam, "CELLS", 1)
    merged = decontam.statistics(texts)
    assert (plain.terms == merged.terms).all() and (plain.df == merged.df).all()
    assert plain.entries == merged.entries == 5 and plain.mean == merged.mean == 94 / 5
    assert sorted(plain.df.tolist()) == [1, 1, 3, 4, 4]
