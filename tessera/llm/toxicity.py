"""Toxic spans by a linear-chain conditional random field over words.

Two tags: clean and toxic. Word features are hashed (the word, its prefixes and suffixes, inner
pieces); transitions are learned. Only whole documents are labelled, so tokens get their labels from
them: in a clean document every word is clean; in a toxic one the tokens' labels are the field's own
posteriors given that at least one word is toxic, sharpened round by round. Forward-backward
marginals give spans with offsets; the documents' score is the chance of a toxic word under the
field, calibrated.

The chain is run for a whole batch at once: texts are cut into strips of ``STRIP`` words, transfer
matrices of strips are multiplied in parallel and then chained, so a very long text costs no more
Python steps than many short ones.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ._common import Prefix, Words, chunks, map_arrow, mix, utf8

#: Labelled rows that are read to fit, of each label; their texts are whole, whatever their length.
TRAIN_ROWS = 3_000
#: Weights.
TABLE_BITS = 18
STRIP = 64
#: (kind, bytes): prefixes, suffixes and pieces inside words that are features besides the word.
AFFIXES = (("prefix", 3), ("prefix", 4), ("prefix", 5), ("prefix", 6), ("suffix", 4), ("suffix", 5))
PASSES, RATE, DECAY = 14, 0.35, 2e-4


def features(words: Words) -> np.ndarray:
    """(words, features) indexes into the weights, of the bare words (see ``Words.bare``)."""
    mask = np.uint64((1 << TABLE_BITS) - 1)
    start, end, lower = words.bare()
    prefix = Prefix(lower)
    columns = [prefix.of(start, end)]
    for i, (kind, n) in enumerate(AFFIXES):
        a, b = (start, np.minimum(start + n, end)) if kind == "prefix" else (np.maximum(end - n, start), end)
        columns.append(prefix.of(a, b) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return np.stack([(mix(c) & mask).astype(np.int32) for c in columns], axis=1)


@dataclass
class Field:
    weights: np.ndarray
    bias: float = -5.0
    #: trans[a, b]: log weight of tag b after tag a
    trans: np.ndarray = field(default_factory=lambda: np.array([[0.0, 0.0], [0.0, 1.0]]))
    #: logistic calibration of (log odds of any toxic word, largest log odds of a word)
    scale: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0]))

    def emission(self, found: np.ndarray) -> np.ndarray:
        """Log weight of toxic against clean for each word."""
        out = np.full(len(found), self.bias, np.float32)
        for k in range(found.shape[1]):
            out += self.weights[found[:, k]]
        return np.clip(out, -30, 30)


def chain(emission: np.ndarray, count: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of many sequences laid end to end.

    Returns the toxic marginal of each word; for each pair of neighbours within strips and across
    them the expected clean-toxic, toxic-clean and toxic-toxic transitions summed by sequence;
    and for each sequence log Z and the log weight of the all-clean path.
    """
    docs = len(count)
    strips = np.maximum(-(-count // STRIP), 1)
    first = np.concatenate([[0], np.cumsum(strips)])
    total = int(first[-1])
    doc_of = np.repeat(np.arange(docs), count)
    within = np.arange(len(emission)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(emission) else np.zeros(0, np.int64)
    row, column = first[doc_of] + within // STRIP, within % STRIP
    e = np.zeros((total, STRIP), np.float64)
    real = np.zeros((total, STRIP), bool)
    e[row, column] = np.exp(emission)
    real[row, column] = True
    e[~real] = 1.0
    t = np.exp(trans)
    head = np.zeros((total, STRIP), bool)
    head[first[:-1], 0] = True

    # transfer matrix of each strip: step(m)[b] = sum_a m[a] t[a, b] * (1, e)[b]; where a sequence
    # starts, and where it is over, a word only multiplies
    def step(m0, m1, k):
        n0, n1 = m0 * t[0, 0] + m1 * t[1, 0], m0 * t[0, 1] + m1 * t[1, 1]
        plain = head[:, k] | ~real[:, k]
        n0, n1 = np.where(plain, m0, n0), np.where(plain, m1, n1)
        return n0, n1 * e[:, k]

    size = np.ones(total)
    a0, a1, b0, b1 = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    log = np.zeros(total)
    for k in range(STRIP):
        a0, a1 = step(a0, a1, k)
        b0, b1 = step(b0, b1, k)
        if k % 8 == 7:
            size = np.maximum(np.maximum(a0, a1), np.maximum(b0, b1))
            a0, a1, b0, b1 = a0 / size, a1 / size, b0 / size, b1 / size
            log += np.log(size)
    # chain the strips of each sequence, forwards and backwards
    f0, f1 = np.ones(total), np.ones(total)
    g0, g1 = np.ones(total), np.ones(total)
    scale, most = np.zeros(docs), int(strips.max()) if docs else 0
    for s in range(most):
        own = np.flatnonzero(strips > s)
        at = first[own] + s
        x0, x1 = f0[at], f1[at]
        y0, y1 = x0 * a0[at] + x1 * b0[at], x0 * a1[at] + x1 * b1[at]
        z = y0 + y1
        scale[own] += np.log(z) + log[at]
        more = strips[own] > s + 1
        f0[at[more] + 1], f1[at[more] + 1] = (y0 / z)[more], (y1 / z)[more]
    for s in range(1, most):
        own = np.flatnonzero(strips > s)
        at = first[own + 1] - s  # the s-th strip from the end
        x0, x1 = g0[at], g1[at]
        y0, y1 = a0[at] * x0 + a1[at] * x1, b0[at] * x0 + b1[at] * x1
        z = y0 + y1
        g0[at - 1], g1[at - 1] = y0 / z, y1 / z
    # within strips
    alpha = np.empty((total, STRIP, 2))
    m0, m1 = f0, f1
    for k in range(STRIP):
        m0, m1 = step(m0, m1, k)
        z = m0 + m1
        m0, m1 = m0 / z, m1 / z
        alpha[:, k, 0], alpha[:, k, 1] = m0, m1
    marginal = np.empty((total, STRIP))
    pair = np.zeros((total, 3))
    m0, m1 = g0, g1
    for k in range(STRIP - 1, -1, -1):
        p0, p1 = alpha[:, k, 0] * m0, alpha[:, k, 1] * m1
        marginal[:, k] = p1 / (p0 + p1)
        moves = real[:, k] & ~head[:, k]
        r0, r1 = (alpha[:, k - 1, 0], alpha[:, k - 1, 1]) if k else (f0, f1)
        w0, w1 = m0, e[:, k] * m1
        q01, q10, q11, q00 = r0 * t[0, 1] * w1, r1 * t[1, 0] * w0, r1 * t[1, 1] * w1, r0 * t[0, 0] * w0
        z = q00 + q01 + q10 + q11
        pair += np.where(moves, np.stack([q01, q10, q11]) / z, 0).T
        plain = ~moves
        n0, n1 = t[0, 0] * w0 + t[0, 1] * w1, t[1, 0] * w0 + t[1, 1] * w1
        m0, m1 = np.where(plain, w0, n0), np.where(plain, w1, n1)
        z = m0 + m1
        m0, m1 = m0 / z, m1 / z
    pairs = np.add.reduceat(pair, first[:-1], axis=0) if docs else np.zeros((0, 3))
    clean = trans[0, 0] * np.maximum(count - 1, 0)
    return marginal[row, column], pairs, np.where(count > 0, scale, np.log(2)), clean


def any_toxic(log_z: np.ndarray, clean: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Log odds of one toxic word or more."""
    gap = np.maximum(log_z - clean, 1e-12)
    return np.where(count > 0, np.log(np.expm1(np.minimum(gap, 50)) + 1e-12), -20.0)


def evidence(model: Field, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of words, (1, log odds of any, largest log odds) of texts)."""
    marginal, _, log_z, clean = chain(model.emission(features(words)), words.count, model.trans)
    top = np.full(len(words.count), 1e-9)
    if len(marginal):
        some = words.count > 0
        top[some] = np.maximum.reduceat(marginal, words.offset[:-1][some])
    odds = any_toxic(log_z, clean, words.count)
    top = np.clip(top, 1e-9, 1 - 1e-9)
    return marginal, np.stack([np.ones(len(odds)), np.clip(odds, -12, 12), np.clip(np.log(top / (1 - top)), -12, 12)], axis=1)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> Field:
    """A field from whole documents' labels; without both labels it calls everything clean."""
    model = Field(np.zeros(1 << TABLE_BITS, np.float32))
    labels = np.asarray(labels, np.float64)
    if not len(texts) or labels.min() == labels.max():
        model.scale = np.array([-8.0 if not len(texts) or not labels.max() else 8.0, 0.0, 0.0])
        return model
    order = np.random.default_rng(seed).permutation(len(texts))
    parts = []
    for a in range(0, len(order), 256):
        own = order[a : a + 256]
        words = Words([texts[i] for i in own])
        parts.append((features(words), words.count, labels[own]))
    # the first token labels: features that toxic documents have far more often than clean ones
    seen = np.zeros((2, 1 << TABLE_BITS))
    for found, count, y in parts:
        doc = np.repeat(np.arange(len(count)), count)
        for k in range(found.shape[1]):
            once = np.unique(doc * (1 << TABLE_BITS) + found[:, k])
            seen[1] += np.bincount(once[y[once >> TABLE_BITS] > 0] & ((1 << TABLE_BITS) - 1), minlength=1 << TABLE_BITS)
            seen[0] += np.bincount(once[y[once >> TABLE_BITS] == 0] & ((1 << TABLE_BITS) - 1), minlength=1 << TABLE_BITS)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    lift = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    model.weights = np.where(seen[1] >= 3, np.clip(lift - 1.5, 0, 2), 0).astype(np.float32)
    gain = np.full(1 << TABLE_BITS, 1e-6)
    side = np.full(4, 1e-6)
    for turn in range(PASSES):
        for found, count, y in parts:
            marginal, pairs, log_z, clean = chain(model.emission(found), count, model.trans)
            p_clean = np.exp(-np.maximum(log_z - clean, 0))
            # toxic documents: labels are posteriors given one toxic word at least, so expectations
            # grow by 1 / (1 - P(all clean)); clean documents: all labels are clean
            lift = np.where(y > 0, p_clean / np.maximum(1 - p_clean, 1e-3), -1.0)
            g = np.repeat(lift, count) * marginal
            grad = np.zeros(1 << TABLE_BITS)
            for k in range(found.shape[1]):
                grad += np.bincount(found[:, k], g, 1 << TABLE_BITS)
            grad -= DECAY * len(y) * model.weights
            gain += grad**2
            model.weights += (RATE * grad / np.sqrt(gain + 1)).astype(np.float32)
            rest = np.concatenate([[g.sum()], (lift[:, None] * pairs).sum(0)])
            side += rest**2
            move = 0.1 * rest / np.sqrt(side + 1)
            model.bias = float(np.clip(model.bias + move[0], -12, 0))
            model.trans[0, 1] = np.clip(model.trans[0, 1] + move[1], -3, 3)
            model.trans[1, 0] = np.clip(model.trans[1, 0] + move[2], -3, 3)
            model.trans[1, 1] = np.clip(model.trans[1, 1] + move[3], -3, 3)
    x = np.concatenate([evidence(model, Words(texts[a:b]))[1] for a, b in chunks(texts)])
    model.scale = logistic(x, labels)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the first column isn't penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, y``: at most ``rows`` whole texts of each label, those with the lowest hash of doc_id.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out. A doc_id that is labelled twice
    counts as toxic if either says so, one that many rows share teaches by one of its texts; null
    labels, ids and texts are not used.
    """
    taught = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    taught = taught.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids: list[tuple[int, int]] = []
    for y in (0, 1):
        picked = taught.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        ids += [(r[0], y) for r in picked.select("doc_id").collect()]
    few = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, y int"))  # 2 x rows at most
    return docs.select("doc_id", "text").where("text is not null").join(few, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def class_shares(labels: DataFrame, label: str) -> float:
    """The share of label 1 among all labelled rows that are not held out."""
    taught = labels.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    return taught.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0


def score(docs: DataFrame, model: Field, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``spans`` (start, end in code points, chance), where a word's marginal is 0.5 or more.

    Whole texts are tagged. Null and empty texts get the score of no evidence and no spans;
    repeated rows get equal scores; columns of ``docs`` named like those added are replaced; an
    empty table stays empty.
    """
    own = [c for c in docs.columns if c.lower() not in ("score", "spans")]
    schema = docs.select(*own).schema.add("score", "double")
    if spans:
        schema = schema.add("spans", DataType.fromDDL("array<struct<start:int,end:int,chance:float>>"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = utf8(batch.column(text))
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                marginal, x = evidence(fitted, words)
                chance = 1 / (1 + np.exp(-np.clip(x @ fitted.scale, -30, 30)))
                columns = [pa.array(chance)]
                if spans:
                    lists: list[list] = [[] for _ in range(b - a)]
                    toxic = np.flatnonzero(marginal >= 0.5)
                    if len(toxic):
                        # code points before each byte: those that don't continue a character
                        point = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])
                        of = words.text_of()[toxic]
                        first, last = (point[x[toxic]] - point[words.text_start[of]] for x in (words.start, words.end))
                        for d, i, j, m in zip(of.tolist(), first.tolist(), last.tolist(), marginal[toxic].tolist()):
                            lists[d].append({"start": i, "end": j, "chance": m})
                    columns.append(pa.array(lists, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float32())]))))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *columns], [*own, "score", *["spans"] * spans])

    return map_arrow(docs.select(*own), run, schema)


def without_toxic(docs: DataFrame, model: Field, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is under ``most``, with just their own columns.

    Null and empty texts have no evidence and stay unless nearly all labels are toxic; repeated
    rows go or stay together; columns of any name come back as they are; an empty table stays empty.
    """
    inner = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    return score(docs.toDF(*inner), model, spans=False).where(F.col("score") < most).select(*inner).toDF(*docs.columns)


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Field:
    """The field of the rows that may teach, with its calibration moved to the labels' own shares.

    The rows, bounded by ``TRAIN_ROWS``, meet in one task, which fits and returns the weights (1 MB):
    texts don't go through the driver, nor stay in its memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, t, y) for batch in batches for d, t, y in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("y").to_pylist()))
        y = np.array([r[2] for r in rows], int)
        model = fit([r[1] for r in rows], y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary()), pa.array([float(y.mean()) if len(y) else 0.0])], ["model", "share"])

    found = map_arrow(training_rows(docs, labels, label).select("doc_id", "text", "y").repartition(1), run, "model binary, share double").collect()
    if not found:
        return fit([], np.zeros(0, int))
    model, taught = pickle.loads(found[0]["model"]), found[0]["share"]
    share = class_shares(labels, label)
    if 0 < taught < 1 and 0 < share < 1:
        model.scale = model.scale + np.array([np.log(share / (1 - share)) - np.log(taught / (1 - taught)), 0, 0])
    return model


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: score, prediction and ``spans``, the offending words as ``start:end`` in code points.

    Null and empty texts have the score of no evidence and no spans; a very long text is tagged
    whole; repeated rows and equal texts get equal values; a null doc_id is not held out. Without
    labels of both kinds all scores say the one that is known, clean if none is. An empty table
    stays empty; further columns of ``docs`` are ignored.
    """
    model = fit_on(docs, labels)
    out = score(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
    )


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
