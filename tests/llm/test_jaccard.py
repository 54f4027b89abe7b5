import itertools

import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard


def shingles(text):
    words = (text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def brute(rows):
    """(class, links) of each row by comparing all sets."""
    sets = [shingles(t) for _, t in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    near = {s: set() for s in distinct}
    holds = {}
    for s in distinct:
        for g in s:
            holds.setdefault(g, []).append(s)
    for a in distinct:
        for b in {b for g in a for b in holds[g]}:
            if a is not b and len(a & b) >= 0.8 * len(a | b):
                near[a].add(b)
                near[b].add(a)
    classes = {}
    for s in distinct:
        if s in classes:
            continue
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in classes:
                classes[x] = s
                todo += near[x]
    return sets, near, classes


@pytest.mark.parametrize("which", ["sf01", "odd", "made"])
def test_brute_force(spark, sf01, odd_docs, tmp_path, which):
    if which == "sf01":
        docs = spark.read.parquet(f"{sf01}/documents.parquet")
    elif which == "odd":
        docs = odd_docs
    else:
        base = " ".join(f"t{i}" for i in range(120))
        rows = [(i, base.replace(f" t{10 + i} ", f" z{i} ")) for i in range(60)] + [(100 + i, base) for i in range(40)] + [(200 + i, f"short {i % 3}") for i in range(9)]
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
        docs = spark.read.parquet(str(tmp_path / "d"))
    got = jaccard.near_duplicates(docs).orderBy("_rid").collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text", F.monotonically_increasing_id().alias("r")).orderBy("r").collect()]
    assert [g.doc_id for g in got] == [d for d, _ in rows]
    sets, near, classes = brute(rows)
    assert [g.n_links for g in got] == [len(near.get(s, ())) for s in sets]
    for (a, s), (b, t) in itertools.islice(itertools.combinations(zip(got, sets), 2), 200_000):
        same = bool(s) and bool(t) and classes[s] == classes[t]
        if same or a.doc_id != b.doc_id:
            assert (a.class_id == b.class_id) == same
    assert sum(g.keep for g in got) == len(set(map(id, classes.values()))) + sum(not s for s in sets)


def test_large_buckets_are_split_and_blocked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_SETS", 8)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    base = " ".join(f"t{i}" for i in range(200))
    rows = [(i, base.replace(f" t{10 + i} ", f" z{i} ")) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = jaccard.near_duplicates(docs).collect()
    _, near, _ = brute(rows)
    assert {g.doc_id: g.n_links for g in got} == {i: len(near[shingles(t)]) for i, t in rows}
    assert len({g.class_id for g in got}) == 1


def test_keep_one_and_empty(spark, odd_docs, empty_docs):
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("text = 'one two three'").count() == 1
    assert jaccard.op5_ngram_jaccard(empty_docs).count() == 0


def test_runs_reach_the_recall():
    for similarity in (0.5, 0.6, 0.8, 0.9, 1.0):
        for recall in (0.5, 0.9, 0.99):
            try:
                many = jaccard.runs_needed(similarity, recall)
            except ValueError:
                assert similarity <= 0.6
                continue
            level = 0.75 * similarity + 0.25 * (1 - (1 - similarity) ** 2)
            assert many <= jaccard.VECTOR and 1 - (1 - level**jaccard.LEVELS) ** many >= recall - 1e-9
    assert jaccard.runs_needed(0.8, 0.9999) == 11
    with pytest.raises(ValueError, match="coordinates"):
        jaccard.runs_needed(0.3, 0.9999)


def test_memory_of_a_full_pair_of_blocks():
    """Two blocks at their limit stay far below a worker's share, whatever is alike in them."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    m = 2 * jaccard.BLOCK_SETS
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join([*base[: i % 50], f"z{i}", *base[i % 50 :]]).encode() for i in range(m)]
    leaves = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * 3), pa.array(np.tile(np.array([1, 5, 9]), m)))
    tracemalloc.start()
    reps, root, links = jaccard.compare(texts, np.arange(m), 5, leaves, np.arange(m) % 2, 5, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(reps) == m and not links.any() and not root.any()  # all met in leaf 1
    assert peak < 200e6


def test_strips_equal_the_plain_rule(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "STRIP", 7)
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 40)
    common = np.minimum(rng.integers(0, 30, (40, 40)), np.minimum(sizes[:, None], sizes[None, :])).astype(np.float32)
    got = jaccard.linked(sizes, common, 0.8)
    for i in range(40):
        for j in range(40):
            assert got[i, j] == (i != j and 5 * common[i, j] >= 4 * (sizes[i] + sizes[j] - common[i, j]))
