import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality


def test_all_unlabelled_documents_teach(spark, tmp_path):
    """A source that only the last unlabelled documents by hash have still teaches."""
    ids = [r[0] for r in spark.range(8_000).orderBy(F.xxhash64("id")).collect()]
    labelled, late = set(ids[:600]), set(ids[-60:])
    good, bad = "A calm river ran past the old mill, and the town slept.", "BUY BUY 999 !!! $$$ BUY 12345 !!!"
    rows = [(i, good if i % 2 else bad, "en", "rare" if i in late else "common", 10 + i % 7) for i in range(8_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(i, i % 2) for i in labelled], "doc_id long, quality int")
    model = quality.fit_on(docs, labels)
    rare = quality.meta_view([None], ["rare"], [0])[0][quality.BUCKETS : 2 * quality.BUCKETS].argmax() + quality.BUCKETS
    assert abs(model.views[1].weights[1 + rare]) > 1e-9
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in got]) > 0.99
    pool = quality.pool_views(docs, labels)
    free = docs.where(quality.not_held_out()).count()
    assert pool.count() == free - sum(quality.zlib.crc32(str(i).encode()) % 5 != 0 for i in labelled)
    taught = quality.summed(pool, quality.exchange(list(model.views), model.calibration, 0.0, list(model.views)))[:2]
    assert taught[0] > 6_000 * 0.9


def plain_logistic(x, y, ridge, steps=200):
    """By small steps of plain gradient ascent with a backtracking line, no Newton."""
    w, penalty = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    value = lambda w: -np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() - (penalty * w * w).sum() / 2
    for _ in range(steps * 50):
        g = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - penalty * w
        step = 1.0
        while step > 1e-12 and value(w + step * g) < value(w) + 1e-4 * step * (g @ g):
            step /= 2
        w = w + step * g
        if np.abs(g).max() < 1e-7:
            break
    return w


def test_exchange_equals_brute_force(spark):
    """Each view's slopes are those of the rows that the other view is sure of, summed over all partitions."""
    rng = np.random.default_rng(4)
    n, labelled = 400, 60
    text, meta = rng.normal(size=(n, quality.TEXT_FEATURES)), rng.normal(size=(n, quality.META_FEATURES))
    y = (text[:, 0] + meta[:, 0] > 0).astype(float)
    mean, deviation = np.zeros, np.ones
    both = [quality.View.fit(x[:labelled], y[:labelled], mean(x.shape[1]), deviation(x.shape[1])) for x in (text, meta)]
    scales = quality.calibrated(both, (text[:labelled], meta[:labelled]), y[:labelled])
    rows = [(i, text[i].tolist(), meta[i].tolist()) for i in range(labelled, n)]
    pool = spark.createDataFrame(rows, "doc_id long, text array<double>, meta array<double>").repartition(5)
    got = quality.summed(pool, quality.exchange(both, scales, 0.3, both))
    want, counts = [], []
    for learner, teacher, x, other in ((both[0], 1, text, meta), (both[1], 0, meta, text)):
        total, many = np.zeros(len(learner.weights) * (len(learner.weights) + 1)), 0
        for i in range(labelled, n):
            odds = both[teacher].odds(other[i : i + 1])[0] * scales[teacher][1] + scales[teacher][0] + 0.3
            if abs(odds) > quality.SURE:
                z = quality.View.design(x[i : i + 1], learner.mean, learner.deviation)[0]
                p = 1 / (1 + np.exp(-z @ learner.weights))
                total += np.concatenate([z * (float(odds > 0) - p), (np.outer(z, z) * p * (1 - p)).ravel()])
                many += 1
        want.append(total)
        counts.append(many)
    assert got[:2].tolist() == [counts[1], counts[0]] and min(counts) > 20
    assert np.allclose(got[2:], np.concatenate(want))


def test_calibration_and_fit_equal_plain_ascent():
    rng = np.random.default_rng(9)
    x = np.c_[np.ones(80), rng.normal(size=(80, 3))]
    y = (x[:, 1] + rng.normal(size=80) > 0).astype(float)
    assert np.allclose(quality.logistic(x, y, 3.0), plain_logistic(x, y, 3.0), atol=1e-3)


def test_views_are_apart():
    """The metadata view doesn't change with the text, nor the text view with the metadata."""
    import pyarrow as pa

    def both(text, lang, chars):
        batch = pa.RecordBatch.from_pydict({"text": [text], "lang": [lang], "source": ["s"], "n_chars": [chars]})
        return next(iter(quality.views(batch)))[2:]

    one, other = both("some text", "en", 9), both("QUITE another\n\ntext !!! 99", "en", 9)
    assert (one[1] == other[1]).all() and (one[0] != other[0]).any()
    moved = both("some text", "de", 800)
    assert (one[0] == moved[0]).all() and (one[1] != moved[1]).any()


def test_a_shared_id_teaches_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "en", "s", i) for i in range(50)] + [(2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    text, meta, y = quality.sample_views(docs, [(1, 0), (2, 1)])
    assert len(text) == len(meta) == len(y) == 2
