"""Quality by co-training: a text view and a page-metadata view teach each other.

Both views are logistic regressions over dense features. They start from the same labelled rows;
in each round either view labels every unlabelled document that it is sure of, and these become
training rows of the other view. The unlabelled documents' features are stored once; rounds are
passes over them that return sums (gradients and curvatures), never rows, so the pseudo-labels grow
with the input. At the end each view's log odds are calibrated on labelled rows, a regression
combines them, and all documents are scored in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LETTER, LOWER, Words, chunks, map_arrow, mix, stored, utf8
from .toxicity import logistic

#: Labelled rows of each label that are read to fit.
TRAIN_ROWS = 3_000
#: Exchanges of labels, and Newton steps of each.
ROUNDS, STEPS = 5, 2
#: Calibrated log odds from which a view is sure of an unlabelled document.
SURE = 2.0
RIDGE = 3.0
#: One-hot buckets for each of language and source.
BUCKETS = 24
TEXT_FEATURES, META_FEATURES = 12, 2 * BUCKETS + 3


def text_view(words: Words) -> np.ndarray:
    """(texts, TEXT_FEATURES): repetition, vocabulary, marks, capitals, digits and word lengths."""
    n, h, text = words.count, words.hashes(), words.text_of()
    docs, per = len(n), np.maximum(n, 1)
    start, end, _ = words.bare()
    total = lambda x: np.bincount(text, x, docs)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    first, second = words.raw[start] if len(h) else words.raw[:0], words.raw[np.minimum(start + 1, len(words.raw) - 1)] if len(h) else words.raw[:0]
    upper = lambda x: (x >= 65) & (x <= 90)
    length = (end - start).astype(float)
    marks = (words.end - words.start) - length
    raw_text = np.searchsorted(words.text_start, np.arange(len(words.raw)), side="right") - 1 if docs else np.zeros(0, int)
    raw_text = np.minimum(raw_text, docs - 1)
    digits = np.bincount(raw_text, (words.raw >= 48) & (words.raw <= 57), docs)
    size = np.maximum(np.diff(words.text_start), 1)
    lone = ~LETTER[LOWER[first]]
    mean = total(length) / per
    columns = [
        np.log1p(n), total(same) / per, total(new[np.argsort(order)]) / per, total(marks >= 2) / per, total(lone) / per, total(upper(first) & upper(second)) / per,
        mean / 10, np.sqrt(np.maximum(total(length**2) / per - mean**2, 0)) / 10, digits / size, total(marks > 0) / per, (n == 0).astype(float), np.minimum(n, 20) / 20,
    ]
    return np.stack(columns, axis=1)


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """(texts, META_FEATURES): language and source in hashed buckets, and the length that the metadata state; nulls have a bucket of their own.

    Nothing here is read from the text, so that the two views stay apart.
    """
    out = np.zeros((len(lang), META_FEATURES))
    rows = np.arange(len(lang))
    for k, values in enumerate((lang, source)):
        out[rows, [k * BUCKETS + (0 if v is None else 1 + zlib.crc32(str(v).encode()) % (BUCKETS - 1)) for v in values]] = 1
    chars = np.maximum(np.array([x or 0 for x in n_chars], float), 0)
    out[:, -3] = np.log1p(chars) / 10
    out[:, -2] = np.minimum(chars, 100) / 100
    out[:, -1] = [x is None for x in n_chars]
    return out


def views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, text view, metadata view) of parts of a batch with text, lang, source and n_chars."""
    texts = utf8(batch.column("text"))
    for a, b in chunks(texts):
        part = batch.slice(a, b - a)
        meta = meta_view(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("n_chars").to_pylist())
        yield a, b, text_view(Words(texts[a:b])), meta


@dataclass
class View:
    """A logistic regression on standardised features and their squares."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    @staticmethod
    def design(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / deviation, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z**2], axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> View:
        return cls(mean, deviation, logistic(cls.design(x, mean, deviation), y, RIDGE))

    def slopes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient and curvature of the log likelihood, laid end to end; sums over rows."""
        z = self.design(x, self.mean, self.deviation)
        p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
        return np.concatenate([z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

    def moved(self, slopes: np.ndarray) -> View:
        """The view after a Newton step; the first weight isn't penalised, as in ``logistic``."""
        n = len(self.weights)
        penalty = np.full(n, RIDGE)
        penalty[0] = 1e-6
        move = np.linalg.solve(slopes[n:].reshape(n, n) + np.diag(penalty), slopes[:n] - penalty * self.weights)
        return View(self.mean, self.deviation, self.weights + np.clip(move, -2, 2))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x, self.mean, self.deviation) @ self.weights, -15, 15)


@dataclass
class CoTrained:
    views: tuple[View, View]
    calibration: tuple[np.ndarray, np.ndarray]
    combine: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text's, metadata's) chances of good quality."""
        own = [v.odds(x) * c[1] + c[0] for v, x, c in zip(self.views, (text, meta), self.calibration)]
        both = np.stack([np.ones(len(text)), *own], axis=1) @ self.combine
        chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return chance(both), chance(own[0]), chance(own[1])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def summed(pool: DataFrame, each: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``each(text view, metadata view)`` over all rows of ``pool``: a vector from each task; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = each(matrix(batch.column("text"), TEXT_FEATURES), matrix(batch.column("meta"), META_FEATURES))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([lists(total[None])], ["part"])

    parts = [np.array(r[0]) for r in map_arrow(pool, run, "part array<double>").collect()]
    return np.sum(parts, axis=0) if parts else None


def moments(text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(text)], text.sum(0), meta.sum(0), (text**2).sum(0), (meta**2).sum(0)])


def calibrated(views: list[View], xs: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(intercept, slope) of each view's log odds."""
    return tuple(logistic(np.stack([np.ones(len(y)), v.odds(x)], axis=1), y) for v, x in zip(views, xs))


def exchange(teachers: list[View], scales: tuple[np.ndarray, ...], shift: float, learners: list[View], prior: float | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For ``summed``: how many rows each view teaches, and each learner's slopes on what the other view is sure of.

    ``prior``: the log odds of the labelled rows' own shares. A view must be sure by its evidence, not
    by these shares alone, or one that knows nothing would call everything the commoner label.
    """

    def each(text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        counts, out = [], []
        xs = (text, meta)
        for k in (0, 1):
            odds = teachers[1 - k].odds(xs[1 - k]) * scales[1 - k][1] + scales[1 - k][0] + shift
            sure = np.abs(odds) > SURE
            if prior is not None:
                known = odds - shift - prior
                sure &= (np.abs(known) > SURE) & (known * odds > 0)
            counts.append(sure.sum())
            out.append(learners[k].slopes(xs[k][sure], (odds[sure] > 0).astype(float)))
        return np.concatenate([np.array(counts[::-1], float), *out])

    return each


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Callable[[], DataFrame] | None = None, shift: float = 0.0, rounds: int = ROUNDS, steps: int = STEPS) -> CoTrained | None:
    """Every fifth labelled row is kept for calibration; None if a label is missing.

    ``pool`` gives the unlabelled documents as ``pool_views`` does; ``shift`` is what their log odds
    have beyond those of the labelled rows.
    """
    fold = np.arange(len(y)) % 5 == 0
    if len(y) < 10 or y[~fold].min() == y[~fold].max() or y[fold].min() == y[fold].max():
        return None
    own, held = (text[~fold], meta[~fold]), (text[fold], meta[fold])
    unlabelled = pool() if pool else None
    rest = summed(unlabelled, moments) if pool else None
    total = moments(*own) + (0 if rest is None else rest)
    n, wide = total[0], TEXT_FEATURES + META_FEATURES
    mean = total[1 : 1 + wide] / n
    deviation = np.sqrt(np.maximum(total[1 + wide :] / n - mean**2, 0)) + 1e-3
    cuts = (slice(0, TEXT_FEATURES), slice(TEXT_FEATURES, wide))
    models = [View.fit(x, y[~fold], mean[c], deviation[c]) for x, c in zip(own, cuts)]
    prior = float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds if rest is not None else 0):
        teachers, scales = models, calibrated(models, held, y[fold])
        for _ in range(steps):
            found = summed(unlabelled, exchange(teachers, scales, shift, models, prior))[2:]
            size = len(models[0].weights) * (len(models[0].weights) + 1)
            models = [v.moved(part + v.slopes(x, y[~fold])) for v, part, x in zip(models, (found[:size], found[size:]), own)]
    scales = calibrated(models, held, y[fold])
    scaled = [m.odds(x) * c[1] + c[0] for m, x, c in zip(models, held, scales)]
    return CoTrained((models[0], models[1]), scales, logistic(np.stack([np.ones(int(fold.sum())), *scaled], axis=1), y[fold]))


def not_held_out() -> Column:
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def pool_views(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, meta``: both views of every document that has no label and isn't held out, stored; no text is shuffled."""
    own = docs.where(not_held_out()).select(F.col("doc_id").cast("long"), "text", "lang", "source", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text, meta in views(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists(text), lists(meta)], ["doc_id", "text", "meta"])

    found = map_arrow(own, run, "doc_id long, text array<double>, meta array<double>")
    return stored(found.join(labels.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_anti"), "quality-views")


def sample_views(docs: DataFrame, ids: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text view, metadata view, label) of the documents with these (doc_id, label)."""
    if not ids:
        return np.zeros((0, TEXT_FEATURES)), np.zeros((0, META_FEATURES)), np.zeros(0)
    few = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, _y int"))  # bounded by the row parameters
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").join(few, "doc_id")
    # a doc_id that many rows share teaches by one of them, so that what is collected stays bounded
    own = own.groupBy("doc_id", "_y").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "_y", "row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text, meta in views(batch):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_y"), pa.array(text.tolist()), pa.array(meta.tolist())], ["doc_id", "y", "text", "meta"])

    rows = sorted(tuple(r) for r in map_arrow(own, run, "doc_id long, y int, text array<double>, meta array<double>").collect())
    rows.sort(key=lambda r: int(mix(np.array([r[0]], np.int64).view(np.uint64))[0]))
    shaped = lambda k, width: np.array([r[k] for r in rows], float).reshape(len(rows), width)
    return shaped(2, TEXT_FEATURES), shaped(3, META_FEATURES), np.array([r[1] for r in rows], float)


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> CoTrained | None:
    """Fits on at most ``rows`` rows of each label, those with the lowest hash of doc_id, and on all unlabelled documents.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out of both.
    """
    free = not_held_out()
    taught = labels.where(free & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("_y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = [(r[0], y) for y in (0, 1) for r in taught.where(F.col("_y") == y).orderBy(*order).limit(rows).select("doc_id").collect()]
    text, meta, y = sample_views(docs, ids)
    share = labels.where(free).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    shift = 0.0
    if len(y) and 0 < y.mean() < 1 and share and 0 < share < 1:
        shift = np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    model = co_train(text, meta, y, lambda: pool_views(docs, labels), shift)
    if model:
        model.combine = model.combine + np.array([shift, 0, 0])
    return model


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better), ``text_score`` and ``meta_score``.

    ``docs`` has text, lang, source and n_chars; nulls in any of them have features of their own.
    Without a model (labels missing or all equal) every score is null. Repeated rows get equal
    scores, columns named like those added are replaced, and an empty table stays empty.
    """
    own = [c for c in docs.columns if c.lower() not in ("score", "text_score", "meta_score")]
    schema = docs.select(*own).schema
    for name in ("score", "text_score", "meta_score"):
        schema = schema.add(name, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for a, b, text, meta in views(batch):
                part = batch.slice(a, b - a)
                found = fitted.scores(text, meta) if fitted else [[None] * (b - a)] * 3
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *(pa.array(x, pa.float64()) for x in found)], [*own, "score", "text_score", "meta_score"])

    return map_arrow(docs.select(*own), run, schema)


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: the combined score, each view's, and the prediction.

    Nulls, empty and very long texts, repeated rows and empty tables as in ``score``; equal rows
    get equal scores; a null doc_id is scored but doesn't teach; further columns are ignored.
    """
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return score(own, fit_on(docs, labels)).select("doc_id", "score", "text_score", "meta_score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
