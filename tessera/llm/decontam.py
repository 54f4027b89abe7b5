"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

Items are cut into entries of at most ``ENTRY`` words and indexed with BM25 weights, divided by the
entry's score for itself, so scores run from 0 to 1. Passages are windows of two strides of words,
so that each entry lies in one of them whole. Search is block-max WAND over batches of passages: a
passage is skipped if its terms' largest weights can't reach the threshold, a block of entries if
the terms' largest weights in that block can't, and only what is left is scored. Every entry at or
above the threshold is retrieved; then the item's question and answer must both be found where the
passage is, with as many words around it as the item has, by their word trigrams.

Words and trigrams are compared by 64-bit hashes; a clash would add a term or a trigram that isn't
there, which moves a score or share by one word's part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, chunks, grams, map_arrow, stored, utf8, with_row_id, word_hashes

ENTRY, STRIDE, BLOCK = 32, 32, 16
K1, B = 1.2, 0.75
#: Least BM25 score as a share of the entry's own, and least shares of trigrams.
SCORE, QUESTION, ANSWER = 0.5, 0.6, 0.5
#: Words of the items that one index holds (about 15 MB), and indexes that one pass over the documents
#: holds; beyond that there are more passes.
SHARD_WORDS, PASS_INDEXES = 60_000, 8
#: Cells of bounds that are held at once.
CELLS = 2_000_000

HITS = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"


@dataclass
class Item:
    item_id: int
    question: np.ndarray
    answer: np.ndarray
    #: words of a gram, and of the item
    size: int
    words: int


@dataclass
class Index:
    """``rows[term, block]`` is the row of ``weights`` (term and block by entry in the block), or -1."""

    terms: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    item_of: np.ndarray
    items: list[Item]


def bare_hashes(words: Words) -> np.ndarray:
    start, end, lower = words.bare()
    return word_hashes(lower, start, end)


def answer_start(words: list[bytes]) -> int:
    """Index of the answer's first word: after the last sentence end before the item's end, else its half."""
    ends = [i for i, w in enumerate(words[:-1]) if w[-1:] in b".?!:"]
    return ends[-1] + 1 if ends else len(words) // 2


@dataclass
class Statistics:
    """What BM25 weights need of all entries: in how many each term is, how many there are, their mean length."""

    terms: np.ndarray
    df: np.ndarray
    entries: int
    mean: float


def cut(h: np.ndarray) -> list[np.ndarray]:
    """An item's word hashes as entries."""
    return np.array_split(h, -(-len(h) // ENTRY)) if len(h) else []


def statistics(texts: Iterable[str | None]) -> Statistics:
    """The statistics of all items' entries, from one pass; what is held grows with the distinct terms."""
    terms, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    entries = total = held = 0
    pending: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every, at = np.unique(np.concatenate([terms, *pending]), return_inverse=True)
        return every, np.bincount(at, np.concatenate([df, np.ones(held, np.int64)]), len(every)).astype(np.int64)

    for text in texts:
        for part in cut(bare_hashes(Words([(text or "").encode()]))):
            entries, total = entries + 1, total + len(part)
            pending.append(np.unique(part))
            held += len(pending[-1])
        if held > CELLS:
            terms, df = merged()
            pending, held = [], 0
    return Statistics(*merged(), entries, total / max(entries, 1))


def build(rows: list[tuple[int, str | None]], of_all: Statistics | None = None) -> Index:
    """The index of (item_id, text); items without words are left out.

    ``of_all``: the statistics of all items where ``rows`` are some of them, so that a weight
    doesn't depend on which items share an index.
    """
    of_all = of_all or statistics(text for _, text in rows)
    items, entries, item_of = [], [], []
    for item_id, text in rows:
        raw = (text or "").encode()
        words = Words([raw])
        h = bare_hashes(words)
        if not len(h):
            continue
        size = min(3, len(h))
        parts, middle = grams(h, size), max(answer_start(raw.split()) - size + 1, 0)
        items.append(Item(item_id, np.unique(parts[:middle]), np.unique(parts[middle:]), size, len(h)))
        for part in cut(h):
            entries.append(part)
            item_of.append(len(items) - 1)
    terms = np.unique(np.concatenate(entries)) if entries else np.zeros(0, np.uint64)
    blocks = -(-len(entries) // BLOCK)
    found = [np.unique(np.searchsorted(terms, e), return_counts=True) for e in entries]
    df = of_all.df[np.searchsorted(of_all.terms, terms)]
    idf = np.log(1 + (of_all.entries - df + 0.5) / (df + 0.5))
    rows_at = np.full((len(terms), blocks), -1, np.int32)
    weights: list[np.ndarray] = []
    for e, (t, tf) in enumerate(found):
        w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(entries[e]) / of_all.mean))
        w = w / w.sum()
        for term, value in zip(t.tolist(), w.tolist()):
            r = rows_at[term, e // BLOCK]
            if r < 0:
                r = rows_at[term, e // BLOCK] = len(weights)
                weights.append(np.zeros(BLOCK, np.float32))
            weights[r][e % BLOCK] = value
    table = np.array([*weights, np.zeros(BLOCK)], np.float32)  # the last row is what -1 finds
    bounds = table.max(1)[rows_at] if blocks else np.zeros((len(terms), 0), np.float32)
    return Index(terms, rows_at, table, bounds, np.array(item_of, np.int64), items)


def search(index: Index, words: Words, h: np.ndarray, least: float = SCORE) -> list[tuple[int, int, float, list[int]]]:
    """(text, item, largest score, passages) of each text and item with a passage and entry at ``least`` or above.

    Passage p of a text is its words from ``(p - 1) * STRIDE`` to ``(p + 1) * STRIDE``.
    """
    if not len(index.terms) or not len(h):
        return []
    spot = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[spot] == h)
    text = words.text_of()[known]
    stride = (known - words.offset[:-1][text]) // STRIDE
    # passages are numbered text after text; passage p has strides p - 1 and p
    first = np.concatenate([[0], np.cumsum(-(-words.count // STRIDE) + 1)])
    at = first[text] + stride
    key = np.concatenate([at, at + 1]) * len(index.terms) + np.tile(spot[known], 2)
    key = np.unique(key)
    passage, term = key // len(index.terms), key % len(index.terms)
    # WAND: the largest weight of each term anywhere
    most = np.bincount(passage, index.bounds.max(1)[term], int(first[-1]))
    keep = most[passage] >= least - 1e-4
    passage, term = passage[keep], term[keep]
    best: dict[tuple[int, int], tuple[float, set[int]]] = {}
    blocks = index.bounds.shape[1]
    starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(passage))
    step = max(1, CELLS // (blocks * 40))
    for a in range(0, len(starts), step):
        lo, hi = starts[a], ends[min(a + step, len(starts)) - 1]
        own = starts[a : a + step] - lo
        bound = np.add.reduceat(index.bounds[term[lo:hi]], own, axis=0)
        p, block = np.nonzero(bound >= least - 1e-4)
        if not len(p):
            continue
        size = (ends[a : a + step] - starts[a : a + step])[p]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        pick = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(starts[a : a + step][p], size)
        rows = index.rows[term[pick], np.repeat(block, size)]
        exact = np.add.reduceat(index.weights[rows], begin, axis=0)
        q, slot = np.nonzero(exact >= least)
        entry = block[q] * BLOCK + slot
        own = passage[starts[a : a + step][p[q]]]
        doc = np.searchsorted(first, own, side="right") - 1
        for d, i, x, at in zip(doc.tolist(), index.item_of[entry].tolist(), exact[q, slot].tolist(), (own - first[doc]).tolist()):
            most_so_far, where = best.setdefault((d, i), (0.0, set()))
            where.add(at)
            best[d, i] = max(x, most_so_far), where
    return [(d, i, x, sorted(where)) for (d, i), (x, where) in sorted(best.items())]


def verify(item: Item, h: np.ndarray, passages: list[int], least: tuple[float, float], cache: dict) -> tuple[float, float]:
    """Shares of the question's and of the answer's trigrams around the passage of a text (words ``h``) that suits best."""
    if item.size not in cache:
        cache[item.size] = grams(h, item.size)
    own = cache[item.size]

    def share(parts: np.ndarray, have: np.ndarray) -> float:
        return float(np.isin(parts, have).mean()) if len(parts) else 1.0

    found = []
    for p in passages:
        have = own[max((p - 1) * STRIDE - item.words, 0) : max((p + 1) * STRIDE + item.words - item.size + 1, 0)]
        found.append((share(item.question, have), share(item.answer, have)))
    return max(found, key=lambda x: (x[0] >= least[0] and x[1] >= least[1], x[0] + x[1], x))


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of ``SHARD_WORDS`` words, one after another; weights are those of all items."""
    of_all = statistics(row[1] for row in items.toLocalIterator())
    batch: list[tuple[int, str]] = []
    size = 0
    for row in items.toLocalIterator():
        batch.append((row[0], row[1]))
        size += row[1].count(" ") + 1
        if size >= SHARD_WORDS:
            yield build(batch, of_all)
            batch, size = [], 0
    if batch:
        yield build(batch, of_all)


def searched(docs: DataFrame, some: list[Index], score: float, question: float, answer: float) -> tuple[DataFrame, object]:
    """``docs`` with ``hits`` in ``some`` indexes, from one pass without a shuffle; and the broadcast that it needs."""
    own = docs.columns
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(some)  # at most PASS_INDEXES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for part in batches:
            texts = utf8(part.column("text"))
            hits: list[list] = [[] for _ in texts]
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                h = bare_hashes(words)
                caches: dict[int, dict] = {}
                for index in held:
                    for d, i, x, passages in search(index, words, h, score):
                        item = index.items[i]
                        q, r = verify(item, h[words.offset[d] : words.offset[d + 1]], passages, (question, answer), caches.setdefault(d, {}))
                        if q >= question and r >= answer:
                            hits[a + d].append({"item_id": item.item_id, "score": x, "question": q, "answer": r})
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(hits, kind)], [*own, "hits"])

    return map_arrow(docs, run, docs.withColumn("hits", F.array().cast(HITS)).schema), shared


def mark(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """``docs`` with ``hits``: the benchmark items that each text holds, with scores.

    ``benchmark`` has item_id and text. Its indexes go to the executors, ``PASS_INDEXES`` at a time:
    nearly every benchmark takes one pass over ``docs`` without a shuffle; of more passes only the
    rows with hits are stored, and joined at the end (``docs`` must then be readable again in the
    same order, see ``with_row_id``). The driver holds the distinct terms' counts and one pass's
    indexes. Null and empty texts and items match nothing; items of one or two words are compared
    whole; repeated rows and items each have their own hits; null item ids stay null; very long
    texts are searched whole, passage by passage. A ``hits`` column of ``docs`` is replaced; an
    empty table on either side gives no hits.
    """
    plain = [c for c in docs.columns if c.lower() != "hits"]
    # plain names inside, so that no column of docs can clash
    inner = [c if c == "text" else f"c{i}" for i, c in enumerate(plain)]
    base = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(plain, inner)])
    empty = F.array().cast(HITS)
    made = indexes(benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null"))
    some, more = list(islice(made, PASS_INDEXES)), next(made, None)
    if not some:
        return base.toDF(*plain).withColumn("hits", empty)
    if more is None:
        return searched(base, some, score, question, answer)[0].toDF(*plain, "hits")
    numbered, found = with_row_id(base), None
    while some:
        part, shared = searched(numbered.select("_rid", "text"), some, score, question, answer)
        part = stored(part.where(F.size("hits") > 0).select("_rid", "hits"), "hits")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
        some = [*([] if more is None else [more]), *islice(made, PASS_INDEXES - 1)]
        more = None if not some else next(made, None)
    merged = found.groupBy("_rid").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    return numbered.join(merged, "_rid", "left").select(*inner, F.coalesce("hits", empty).alias("hits")).toDF(*plain, "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item.

    Null and empty texts stay, repeated rows stay or go together, columns of any name (``hits`` too)
    come back as they are, and an empty table on either side leaves ``docs`` whole.
    """
    inner = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    return mark(docs.toDF(*inner), benchmark).where(F.size("hits") == 0).select(*inner).toDF(*docs.columns)


def op4_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` and benchmark item that it holds, with the rounded score and overlaps.

    Nulls, empty and very long texts, repeated rows and empty tables as in ``mark``; a null doc_id
    stays null; of equal scores each has its row.
    """
    hits = mark(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("hits").alias("hit"))
    return hits.select("doc_id", "hit.item_id", F.round("hit.score", 4).alias("score"), F.round("hit.question", 4).alias("question_overlap"), F.round("hit.answer", 4).alias("answer_overlap"))
