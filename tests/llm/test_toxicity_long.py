from tessera.llm import toxicity


def test_long_labelled_texts_teach(spark):
    filler = " ".join(f"word{i % 900}" for i in range(6_000))
    rows = [(i, f"{filler} idiot {filler[: 100 * i]}" if i % 2 else f"a nice day {i}") for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, toxic int")
    taught = toxicity.training_rows(docs, labels, "toxic").collect()
    free = [(t, i % 2) for i, t in rows if not toxicity.held_out(i)]
    assert sorted((r.text, r.y) for r in taught) == sorted(free)
    assert min(len(t) for t, k in free if k) > 24_000
    model = toxicity.fit_on(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, spans=False).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i, _ in rows if toxicity.held_out(i))


def test_without_both_labels_or_rows(spark):
    """One label alone decides; without any row nothing is called toxic."""
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    for labels, said in (([], 0), ([(i, 0) for i in range(20)], 0), ([(i, 1) for i in range(20)], 1), ([(99, 1)], 0), ([(None, 1), (3, None)], 0)):
        model = toxicity.fit_on(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.score >= 0.5 for r in toxicity.score(docs, model).collect()} == {bool(said)}


def test_offsets_are_code_points(spark):
    import numpy as np

    model = toxicity.fit([b"you are an idiot today", b"you are an apple today"] * 40, np.array([1, 0] * 40))
    text = "été 🎉 señor, you are an idiot today 한국"
    docs = spark.createDataFrame([(1, text), (1, text), (None, "an idiot"), (2, None), (3, "")], "doc_id long, text string")
    rows = toxicity.score(docs, model).collect()
    assert {text[s.start : s.end] for r in rows if r.doc_id == 1 for s in r.spans} == {"idiot"}
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.op6_toxicity(docs, labels).collect()
    assert {r.held_out for r in got if r.doc_id is None} == {False} and len(got) == 5
