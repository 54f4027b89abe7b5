import zlib
from array import array

import corpus_pipeline
from tessera.llm import toxicity
from tessera.llm.tokens import WordEncoder, tokenizer_path

from test_jaccard import brute, shingles
from test_pii import base_spans


def test_stages_by_brute_force(spark, sf01, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    tables = [docs.orderBy("doc_id").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf01)
        if i < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append(docs.orderBy("doc_id").collect())
    start, clean, one, free, safe, pieces = tables
    model = toxicity.fit_on(spark.read.parquet(f"{sf01}/documents.parquet"), spark.read.parquet(f"{sf01}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(spark.read.parquet(f"{sf01}/documents.parquet"), model, spans=False).collect()}
    assert {r.doc_id for r in clean} == {i for i, s in scores.items() if s < 0.5}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.doc_id in {c.doc_id for c in clean}) for r in start if r.doc_id in labels]
    assert sum(t == 1 and kept for t, kept in held) <= 0.1 * sum(t for t, _ in held) and sum(t == 0 and not kept for t, kept in held) <= 0.02 * len(held)
    sets, _, classes = brute([(r.doc_id, r.text) for r in clean])
    kept = {r.doc_id: shingles(r.text) for r in one}
    assert len(one) == len(set(map(id, classes.values()))) + sum(not s for s in sets)
    assert len({id(classes[s]) for s in kept.values() if s}) == sum(bool(s) for s in kept.values())
    items = [r.text for r in spark.read.parquet(f"{sf01}/benchmark.parquet").collect()]
    assert not any(t in r.text for r in free for t in items) and {r.doc_id for r in free} <= set(kept)
    assert sum(any(t in r.text for t in items) for r in one) <= len(one) - len(free) <= 1.2 * sum(any(t in r.text for t in items) for r in one) + 1
    assert [r.doc_id for r in safe] == [r.doc_id for r in free]
    before = {r.doc_id: r.text for r in free}
    for r in safe:
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        if not base_spans(before[r.doc_id]):
            assert len(r.text) > 0.9 * len(before[r.doc_id]) - 40
    encoder = WordEncoder(tokenizer_path())
    own = {}
    for p in pieces:
        own.setdefault(p.doc_id, []).append(p)
    assert set(own) == {r.doc_id for r in safe}
    for r in safe:
        ids = next(encoder.encode([r.text.encode()])) + array("I", [1]).tobytes()
        parts = sorted(own[r.doc_id], key=lambda p: p.start)
        assert sum(p.length for p in parts) * 4 == len(ids)
        assert all(zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in parts)


def test_run_and_odd_tables(spark, sf, odd_docs, empty_docs, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    for which, docs in (("odd", odd_docs.drop("score")), ("empty", empty_docs)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            path = str(tmp_path / f"{name}-{which}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
