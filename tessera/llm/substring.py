"""Repeated passages: seed and extend over winnowed anchors.

Seeds: of the ``GRAM``-word hashes inside each window the smallest is its anchor, so equal windows
have equal anchors and about every tenth position is one. Anchors that occur once in the corpus
can't belong to a repeat. Extension: around every anchor that occurs again, all windows it leads
(up to ``window - GRAM`` words either way) are compared by 96 bits of hash of their whole content,
from two lanes of word hashes that have nothing in common but the words; adjoining repeated windows
make the maximal repeats. Occurrences are counted by partial
aggregation and met by semi joins, so no group is gathered and no pairs are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ._common import Words, chunks, grams, map_arrow, stored, utf8, with_row_id


def gram_size(window: int) -> int:
    return (window + 1) // 2


def leaders(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash at each word, index of each window's first word, its anchor: the smallest gram hash inside)."""
    gram = gram_size(window)
    h, first = words.hashes(), words.windows(window)
    found = np.zeros(len(h), np.uint64)
    found[: max(len(h) - gram + 1, 0)] = grams(h, gram)
    low, span, width = found, 1, window - gram + 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return found, first, low[first]


def anchor_positions(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, anchor) for each position that is the anchor of a window over it.

    A text that has one anchor's content at two places gives two rows.
    """
    gram = gram_size(window)
    found, first, low = leaders(words, window)
    width = window - gram + 1
    at = words.windows(gram)
    own = found[at]
    # a position counts if one of the windows over it has its hash as the smallest: compare with the
    # largest of those minima, which is the loosest condition any window sets
    slots = np.zeros(len(found) + 2 * width, np.uint64)
    slots[first + width - 1] = low
    high, span = slots, 1
    while span * 2 <= width:
        high, span = np.maximum(high[:-span], high[span:]), span * 2
    if span < width:
        high = np.maximum(high[: len(high) - (width - span)], high[width - span :])
    picked = own <= high[at]
    return words.text_of()[at[picked]], own[picked]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """``_rid, anchor`` of the winnowed positions of ``docs`` (``_rid``, ``text``), at most two for each text and anchor.

    Two are enough to know that an anchor occurs again; a text that repeats a phrase over and over
    would give as many as it has words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, texts = batch.column("_rid").to_numpy(), utf8(batch.column("text"))
            for a, b in chunks(texts):
                text, anchor = anchor_positions(Words(texts[a:b]), window)
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                third = np.zeros(len(text), bool)
                third[2:] = (text[2:] == text[:-2]) & (anchor[2:] == anchor[:-2])
                text, anchor = text[~third], anchor[~third]
                yield pa.RecordBatch.from_arrays([pa.array(rid[a:b][text]), _long(anchor)], ["_rid", "anchor"])

    return map_arrow(docs.select("_rid", "text"), run, "_rid long, anchor long")


#: What ``extended`` gives: windows with their counts in a batch; those that are alone in their
#: batch, to be looked up; or the starts of those that the batch itself repeats, by text.
EXTENDED = {"counts": "h1 long, h2 int, n int", "alone": "h1 long, h2 int, _rid long, start int", "sure": "_rid long, sure array<int>"}


def extended(seeded: DataFrame, window: int, what: str) -> DataFrame:
    """The windows that the seeds of each text lead, in one of the forms of ``EXTENDED``.

    A very common passage is repeated within nearly every batch, so its windows are summed there
    and never meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, texts, seeds = batch.column("_rid").to_numpy(), utf8(batch.column("text")), batch.column("seeds")
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                _, first, low = leaders(words, window)
                own = np.unique(seeds.slice(a, b - a).flatten().to_numpy().view(np.uint64))
                spot = np.searchsorted(own, low)
                first = first[own[np.minimum(spot, len(own) - 1)] == low] if len(own) else first[:0]
                h1 = grams(words.hashes(), window)[first].view(np.int64)
                h2 = (grams(words.hashes(1), window)[first] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                order = np.lexsort((h2, h1))
                same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
                new = np.flatnonzero(np.append(True, ~same)[: len(h1)])
                n = np.diff(np.append(new, len(h1)))
                if what == "counts":
                    yield pa.RecordBatch.from_arrays([pa.array(h1[order][new]), pa.array(h2[order][new]), pa.array(n.astype(np.int32))], ["h1", "h2", "n"])
                    continue
                many = np.zeros(len(h1), bool)
                many[order] = np.repeat(n > 1, n)
                pick = np.flatnonzero(many if what == "sure" else ~many)
                text = words.text_of()[first[pick]]
                start = (first[pick] - words.offset[:-1][text]).astype(np.int32)
                if what == "alone":
                    yield pa.RecordBatch.from_arrays([pa.array(h1[pick]), pa.array(h2[pick]), pa.array(rid[a:b][text]), pa.array(start)], ["h1", "h2", "_rid", "start"])
                else:
                    of, at = np.unique(text, return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(text)).astype(np.int32)), pa.array(start))
                    yield pa.RecordBatch.from_arrays([pa.array(rid[a:b][of]), lists], ["_rid", "sure"])

    return map_arrow(seeded, run, EXTENDED[what])


def with_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with ``starts`` and ``sure``: word offsets where a window begins that begins elsewhere too.

    ``docs`` has ``_rid`` and ``text``; both arrays are null where there are none. All columns go
    through the join with the seeds, though only two are used there: the exchange of the texts is
    then the same for all joins, and runs once.
    """
    found = anchors(docs, window)
    again = found.groupBy("anchor").count().where("count > 1").select("anchor")
    seeds = stored(found.join(again, "anchor", "left_semi").groupBy("_rid").agg(F.collect_set("anchor").alias("seeds")), "seeds")
    seeded = docs.join(seeds, "_rid").select(*docs.columns, "seeds")
    twice = extended(seeded, window, "counts").groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2")
    alone = extended(seeded, window, "alone").join(twice, ["h1", "h2"], "left_semi")
    starts = alone.groupBy("_rid").agg(F.collect_list("start").alias("starts"))
    return docs.join(starts, "_rid", "left").join(extended(seeded, window, "sure"), "_rid", "left")


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words the windows at ``starts`` cover."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with ``kept`` (the words outside repeats, joined by a space), ``n_words``, ``n_removed`` and ``repeats``.

    ``repeats`` are the maximal repeated stretches as (start, end) in words, end exclusive. Every
    occurrence goes, the first one too; windows are judged on the input. Repeated rows repeat each
    other's windows. Null texts have no words; texts under ``window`` words stay whole; an empty
    table stays empty; columns of ``docs`` named like those added are replaced.
    """
    own = [c for c in docs.columns if c.lower() not in ("kept", "n_words", "n_removed", "repeats")]
    # plain names inside, so that no column of docs can clash with those of the joins
    inner = [c if c == "text" else f"c{i}" for i, c in enumerate(own)]
    base = with_row_id(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(own, inner)]))
    marked = with_repeats(base, window)
    schema = docs.select(*[f"`{c}`" for c in own]).schema.add("kept", "string").add("n_words", "long").add("n_removed", "long").add("repeats", DataType.fromDDL("array<array<int>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, stretches = [], [], [], []
            for text, *both in zip(utf8(batch.column("text")), batch.column("starts"), batch.column("sure")):
                words = text.split()
                at = np.concatenate([x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in both])
                out = covered(at, len(words), window)
                edge = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0))
                kept.append(b" ".join([w for w, x in zip(words, out.tolist()) if not x]) if len(at) else b" ".join(words))
                sizes.append(len(words))
                gone.append(int(out.sum()))
                stretches.append(edge.reshape(-1, 2).tolist())
            columns = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(stretches, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in inner), *columns], [*own, "kept", "n_words", "n_removed", "repeats"])

    return map_arrow(marked.select(*inner, "starts", "sure"), run, schema)


def op7_substring_dedup(docs: DataFrame) -> DataFrame:
    """The counts and digest of what stays of each document, made where its words are at hand.

    One row for each row of ``docs``; nulls, empty and very long texts, ties, repeated rows and
    empty tables as in ``remove_repeats``; a null doc_id stays null.
    """
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def plain_removal(texts: list[bytes], window: int = 35) -> list[tuple[int, int, str]]:
    """The same by a dictionary of all windows, for tests."""
    from collections import Counter

    split = [t.split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(rest).hexdigest()))
    return out
