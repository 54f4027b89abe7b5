import itertools

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import decontam, quality, toxicity
from tessera.llm._common import Words


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n1 = label.sum()
    return (rank[label > 0].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_chain_matches_enumeration():
    rng = np.random.default_rng(0)
    count = np.array([0, 1, 5, 0, 9, 3])
    emission = rng.normal(size=count.sum())
    trans = np.array([[0.0, -0.7], [0.4, 0.9]])
    for strip in (64, 4, 2):
        old, toxicity.STRIP = toxicity.STRIP, strip
        marginal, pairs, log_z, clean = toxicity.chain(emission, count, trans)
        toxicity.STRIP = old
        at = 0
        for d, n in enumerate(count):
            e = emission[at : at + n]
            weights, tags = [], list(itertools.product((0, 1), repeat=int(n)))
            for y in tags:
                weights.append(np.exp(sum(e[i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1))))
            z = sum(weights)
            if n:
                assert np.isclose(log_z[d], np.log(z))
                expected = np.array([sum(w for w, y in zip(weights, tags) if y[i]) / z for i in range(n)])
                assert np.allclose(marginal[at : at + n], expected)
                for k, (a, b) in enumerate(((0, 1), (1, 0), (1, 1))):
                    assert np.isclose(pairs[d, k], sum(w * sum((y[i], y[i + 1]) == (a, b) for i in range(n - 1)) for w, y in zip(weights, tags)) / z)
                assert np.isclose(weights[0], np.exp(clean[d]))
            at += n


def test_toxicity_on_held_out_rows(spark, sf01):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    own = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = toxicity.score(own.select("doc_id", "text"), toxicity.fit_on(docs, labels), spans=False)
    rows = out.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("score", "toxic").collect()
    score, label = np.array(rows, float).T
    assert auc(score, label) > 0.9
    assert ((score >= 0.5) == (label > 0)).mean() > 0.93


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    own = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = quality.score(own, quality.fit_on(docs, labels))
    rows = out.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("score", "quality").collect()
    score, label = np.array(rows, float).T
    assert auc(score, label) > 0.9
    assert ((score >= 0.5) == (label > 0)).mean() > 0.93


def test_models_on_odd_and_empty_tables(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 12)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for some in (labels, none):
        for docs in (odd_docs, empty_docs):
            got = toxicity.op6_toxicity(docs, some).collect()
            assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
            assert quality.op1_quality(docs, some).count() == docs.count()
    spans = toxicity.score(odd_docs, toxicity.fit([b"bad idiot", b"fine day"] * 30, np.array([1, 0] * 30)))
    assert spans.columns == [*(c for c in odd_docs.columns if c != "score"), "score", "spans"]


def test_spans_hold_the_word():
    model = toxicity.fit([b"you are an idiot today", b"you are a friend today", b"what a day", b"such an idiot", b"a nice day an apple"] * 12, np.array([1, 0, 0, 1, 0] * 12))
    words = Words([b"well, an idiot came", b"a nice friend came"])
    marginal, x = toxicity.evidence(model, words)
    assert marginal.argmax() == 2 and (x @ model.scale)[0] > 0 > (x @ model.scale)[1]


def test_decontamination_finds_all_planted(spark, sf01, odd_docs, empty_docs):
    docs, items = spark.read.parquet(f"{sf01}/documents.parquet"), spark.read.parquet(f"{sf01}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.op4_decontamination(docs, items).collect()}
    held = {(d, i) for i, t in ((r.item_id, r.text) for r in items.collect()) for d, x in ((r.doc_id, r.text) for r in docs.collect()) if t in (x or "")}
    assert held and held <= got
    # what else is found shares most of the item's words in order
    texts, tests = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    for d, i in got - held:
        words = lambda t: [w.lower().strip(".,") for w in t.split()]
        have = {tuple(words(texts[d])[k : k + 3]) for k in range(len(words(texts[d])))}
        own = [tuple(words(tests[i])[k : k + 3]) for k in range(len(words(tests[i])) - 2)]
        assert np.mean([g in have for g in own]) > 0.5
    odd_items = spark.createDataFrame([(1, None), (None, "one two three"), (2, ""), (3, "word3 word4 word5 word6. word7 word8 word9"), (3, "word3 word4 word5 word6. word7 word8 word9"), (4, "three")], "item_id long, text string")
    got = decontam.op4_decontamination(odd_docs, odd_items)
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    assert {(5, 3), (6, 3), (4, None), (None, None)} <= pairs and not any(d in (1, 2, 3) for d, _ in pairs)
    assert decontam.op4_decontamination(empty_docs, items).count() == 0
    assert decontam.op4_decontamination(odd_docs, items.limit(0)).count() == 0


def test_search_equals_plain_scores(spark, sf01, monkeypatch):
    """Block-max WAND retrieves exactly what scoring every passage against every entry does."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf01}/benchmark.parquet").collect()]
    index = decontam.build(items)
    texts = [r.text.encode() for r in spark.read.parquet(f"{sf01}/documents.parquet").where("doc_id < 120").collect()]
    words = Words(texts)
    h = decontam.bare_hashes(words)
    dense = np.zeros((len(index.terms), len(index.item_of)))
    for t, b in np.argwhere(index.rows >= 0):
        own = index.weights[index.rows[t, b]]
        dense[t, b * decontam.BLOCK : b * decontam.BLOCK + len(dense[t, b * decontam.BLOCK :][: decontam.BLOCK])] = own[: len(dense[t, b * decontam.BLOCK :][: decontam.BLOCK])]
    for least in (0.15, 0.3, 0.5):
        expected, hit, near = {}, {}, set()
        for d in range(len(texts)):
            own = h[words.offset[d] : words.offset[d + 1]]
            for p in range(-1, -(-len(own) // decontam.STRIDE)):
                part = np.unique(own[max(p, 0) * decontam.STRIDE : (p + 2) * decontam.STRIDE])
                known = np.isin(index.terms, part)
                s = dense[known].sum(0)
                for e in np.flatnonzero(s >= least):
                    expected[d, int(index.item_of[e])] = max(s[e], expected.get((d, int(index.item_of[e])), 0))
                    hit.setdefault((d, int(index.item_of[e])), set()).add(p + 1)
                near |= {(d, int(index.item_of[e])) for e in np.flatnonzero(np.abs(s - least) < 1e-4)}
        rows = decontam.search(index, words, h, least)
        got = {(d, i): s for d, i, s, _ in rows}
        assert {(d, i): where for d, i, _, where in rows if (d, i) not in near} == {k: sorted(v) for k, v in hit.items() if k not in near}
        close = {k for k, s in expected.items() if abs(s - least) < 1e-4}
        assert set(got) - close == set(expected) - close
