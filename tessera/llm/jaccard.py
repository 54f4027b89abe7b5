"""Jaccard join of documents by their word shingles: a chosen-path join.

Equal shingle sets collapse to one representative first. Each representative has a vector of
minimum hashes. A run of the join is a random tree: a node samples one or two coordinates of the
vector (5/4 on average, the reciprocal of the similarity) and sends a set to one child for each, by
its value there. Buckets of few sets are compared by brute force, larger ones split again; those
that are large at the last level hold sets that are nearly all alike and are compared block by
block. Runs repeat until a pair at the threshold meets with the target recall. Buckets with the
same members, in whatever runs, are compared once, and a pair is counted in the smallest bucket
that has both, so link counts need no list of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Words, chunks, grams, map_arrow, mix, sorted_groups, stored, utf8, with_row_id

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Coordinates of the vector of minimum hashes.
VECTOR = 48
#: Levels of a tree, and the sets and shingles of a bucket that is not split further.
LEVELS, MOST_SETS, MOST_SHINGLES = 3, 2_048, 3_000_000
#: Sets and shingles of a block; a bucket of more is compared block by block, and two blocks at most
#: are in memory at once.
BLOCK_SETS, BLOCK_SHINGLES = 1_024, 1_500_000
#: Rows of a matrix of pairs that are worked on at once.
STRIP = 256
#: Shingles in more sets of a bucket than this are counted by matrix products, others by their lists.
FREQUENT = 12

_A = mix(np.arange(1, VECTOR + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_B = mix(np.arange(1, VECTOR + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)

#: Tells shingles of fewer words from others of an equal hash.
_SHORT = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))


def runs_needed(similarity: float, recall: float, levels: int = LEVELS) -> int:
    """Runs after which a pair of this similarity has met in a leaf of the deepest level, with this chance.

    Each run starts from a coordinate of its own. ValueError if there are fewer coordinates than runs.
    """
    if not 0 < similarity <= 1 or not 0 < recall < 1:
        raise ValueError("similarity and recall must lie between 0 and 1")
    level = 0.75 * similarity + 0.25 * (1 - (1 - similarity) ** 2)
    many = 1 if level >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - level**levels))
    if many > VECTOR:
        raise ValueError(f"a recall of {recall} at similarity {similarity} takes {many} runs; the vector has {VECTOR} coordinates")
    return many


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text in turn, offsets). Shorter texts are one shingle."""
    h, first = words.hashes(), words.windows(size)
    starts, found = [first], [grams(h, size)[first]]
    for n in range(1, size):
        own = words.offset[:-1][words.count == n]
        if len(own):
            starts.append(own)
            found.append(grams(h, n)[own] ^ _SHORT[n % len(_SHORT)])
    begin, s = np.concatenate(starts), np.concatenate(found)
    text = words.text_of()[begin] if len(begin) else np.zeros(0, np.int64)
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    s, text = s[new], text[new]
    return s, np.searchsorted(text, np.arange(len(words.count) + 1))


def sign(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``_rid, set1, set2, size, mins``: digest, size and minimum hashes of each text's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, texts = batch.column("_rid").to_numpy(), utf8(batch.column("text"))
            for a, b in chunks(texts):
                s, offset = shingle_sets(Words(texts[a:b]), shingle)
                size = np.diff(offset)
                some = size > 0
                at = offset[:-1][some]
                sums = np.zeros((2, b - a), np.uint64)
                mins = np.zeros((b - a, VECTOR), np.uint32)
                if some.any():
                    for lane in range(2):
                        sums[lane, some] = np.add.reduceat(mix(s ^ _A[lane]), at)
                    for j in range(VECTOR):
                        x = s * _A[j]
                        x ^= x >> np.uint64(32)
                        x *= _B[j]
                        mins[some, j] = np.minimum.reduceat(x, at) & np.uint64(0xFFFFFFFF)
                flat = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * VECTOR, pa.array(mins.view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(rid[a:b]), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(size.astype(np.int32)), flat], ["_rid", "set1", "set2", "size", "mins"])

    return map_arrow(docs.select("_rid", "text"), run, "_rid long, set1 long, set2 long, size int, mins array<int>")


def _children(node: Column, fresh: Column, mins: Column) -> Column:
    """Keys of the children of ``node`` that a set goes to; ``fresh``: its first coordinate."""
    second = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(VECTOR)).cast("int")
    child = lambda j: F.xxhash64(node, j, F.get(mins, j))
    both = F.array(child(fresh), child(second))
    return F.array_distinct(F.when(F.pmod(F.xxhash64(node, F.lit(2)), F.lit(4)) == 0, both).otherwise(F.array(child(fresh))))


def buckets(sets: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``rep, leaf, n, shingles``: the leaves that each set is compared in, without repeated memberships."""
    many = runs_needed(similarity, recall)
    roots = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda r: _children(F.xxhash64(F.lit("run"), r), r, F.col("mins")))
    nodes = sets.select("rep", "size", F.explode(F.flatten(roots)).alias("key"))
    leaves = []
    for level in range(1, LEVELS + 1):
        held = nodes.groupBy("key").agg(
            F.count("*").alias("n"),
            F.sum("size").alias("shingles"),
            F.bit_xor(F.xxhash64("rep")).alias("m1"),
            F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("m2"),
        )
        held = stored(held.where("n > 1"), "buckets", small=True)
        large = (F.col("n") > MOST_SETS) | (F.col("shingles") > MOST_SHINGLES)
        last = level == LEVELS or held.where(large).limit(1).count() == 0
        small = held if last else held.where(~large)
        leaves.append(nodes.select("rep", "key").join(small, "key"))
        if last:
            break
        split = nodes.join(held.where(large).select("key"), "key", "left_semi").join(sets.select("rep", "mins"), "rep")
        first = F.pmod(F.xxhash64("key", F.lit(0)), F.lit(VECTOR)).cast("int")
        nodes = split.select("rep", "size", F.explode(_children(F.col("key"), first, F.col("mins"))).alias("key"))
        nodes = stored(nodes, "nodes", small=True)
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    return every.groupBy("rep", "n", "shingles", "m1", "m2").agg(F.min("key").alias("own")).select("rep", "n", "shingles", F.xxhash64("n", "m1", "m2").alias("leaf"))


def _intersections(s: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """(m, m) sizes of the intersections of ``m`` sets, given as hashes and the set of each."""
    order = np.argsort(s, kind="stable")
    s, owner = s[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    df = np.diff(np.append(first, len(s)))
    out = np.zeros((m, m), np.float32)
    often = df > FREQUENT
    starts, sizes = first[often], df[often]
    width = max(64, min(4096, 8_000_000 // max(m, 1)))
    for a in range(0, len(starts), width):
        part = sizes[a : a + width]
        at = np.concatenate([np.arange(x, x + n) for x, n in zip(starts[a : a + width], part)])
        member = np.zeros((m, len(part)), np.float32)
        member[owner[at], np.repeat(np.arange(len(part)), part)] = 1
        out += member @ member.T
    flat = out.ravel()
    for n in range(2, FREQUENT + 1):
        own = owner[first[df == n][:, None] + np.arange(n)]
        for i in range(n):
            for j in range(n):
                if i != j and len(own):
                    np.add.at(flat, own[:, i] * m + own[:, j], 1)
    return out


def linked(sizes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs reach the similarity, a strip of rows at a time; the diagonal is not set."""
    out = np.empty(common.shape, bool)
    own = sizes.astype(np.float64) * similarity
    for a in range(0, len(sizes), STRIP):
        least = own[a : a + STRIP, None] + own[None, :]
        least -= 1e-3
        least /= 1 + similarity
        np.greater_equal(common[a : a + STRIP], least, out=out[a : a + STRIP])
    np.fill_diagonal(out, False)
    return out


def compare(texts: list[bytes], reps: np.ndarray, leaf: int, leaves: pa.ListArray, block: np.ndarray, shingle: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, smallest set that it is connected with here, links counted here) of a bucket or two blocks of one."""
    m = len(texts)
    parts = [shingle_sets(Words(texts[a:b]), shingle) for a, b in chunks(texts)]
    s, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([np.diff(p[1]) for p in parts])
    pairs = linked(sizes, _intersections(s, np.repeat(np.arange(m), sizes), m), similarity)
    if block.min() != block.max():
        pairs &= block[:, None] != block[None, :]
    if not pairs.any():
        return reps[:0], reps[:0], np.zeros(0, np.int64)
    root, highest = reps.copy(), np.iinfo(np.int64).max
    while True:
        before = root.copy()
        for a in range(0, m, STRIP):
            np.minimum(root[a : a + STRIP], np.where(pairs[a : a + STRIP], root[None, :], highest).min(1), out=root[a : a + STRIP])
        if (before == root).all():
            break
    # a pair that also meets in a smaller leaf is counted there
    keys, own = leaves.flatten().to_numpy(), np.repeat(np.arange(m), np.diff(leaves.offsets.to_numpy()))
    lower = keys < leaf
    keys, own = keys[lower], own[lower]
    names, at = np.unique(keys, return_inverse=True)
    links = np.zeros(m, np.int64)
    width = max(64, 4_000_000 // m)
    members = []
    for a in range(0, len(names), width):
        in_part = (at >= a) & (at < a + width)
        members.append((own[in_part], at[in_part] - a, min(width, len(names) - a)))
    for a in range(0, m, STRIP):
        free = pairs[a : a + STRIP].copy()
        for of, column, n in members:
            member = np.zeros((m, n), np.float32)
            member[of, column] = 1
            free &= member[a : a + STRIP] @ member.T < 0.5
        links[a : a + STRIP] = free.sum(1)
    some = pairs.any(1)
    return reps[some], root[some], links[some]


def links_and_edges(texts: DataFrame, leaves: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``rep, root, links`` for each set and bucket with a link. ``texts``: rep, text."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = leaves.select("rep", "leaf", blocks.alias("blocks"))
    per_set = placed.groupBy("rep").agg(F.collect_list(F.struct("leaf", "blocks")).alias("places"))
    full = texts.join(per_set, "rep").select("rep", "text", F.sort_array(F.transform("places", lambda p: p["leaf"])).alias("leaves"), F.explode("places").alias("p"))
    full = full.select("rep", "text", "leaves", F.col("p.leaf").alias("leaf"), F.col("p.blocks").alias("blocks"), F.pmod(F.xxhash64("rep"), F.col("p.blocks")).cast("int").alias("block"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = full.select("rep", "text", "leaves", "leaf", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    keys = ["leaf", "b1", "b2"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in sorted_groups(batches, keys):
            group = group.combine_chunks()
            lists = group.column("leaves").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)), lists.flatten())
            out.append(compare([x or b"" for x in group.column("text").cast(pa.binary()).to_pylist()], group.column("rep").to_numpy(), group.column("leaf")[0].as_py(), lists, group.column("block").to_numpy(), shingle, similarity))
            if len(out) >= 500:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return map_arrow(dealt, run, "rep long, root long, links long")


def _edges(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in range(3)], ["rep", "root", "links"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node of its component) for all nodes of ``edges`` (a, b).

    Alternating large and small stars; each round's edges are stored, and rounds end when they
    no longer change.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", small=True)
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "edges", small=True)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``docs``' rows as ``_rid, doc_id, class_id, copy_of, n_links, keep``.

    Documents are linked when the Jaccard similarity of their shingle sets is at least
    ``similarity``; classes are connected components. ``class_id`` and ``copy_of`` are the doc_id
    of the first row of the class and of the first row with the same set, ``n_links`` the number
    of other distinct sets that are linked, and ``keep`` marks the first row of each class.

    Null and empty texts (and those of white space only) have no set: each is a class of its own
    and kept. Texts of fewer words than a shingle are one shingle. Repeated rows are copies. A
    null doc_id is replaced by a negative number from its row. A very long text is one set, compared
    whole. An empty table stays empty; other columns are ignored, whatever their names. Shingles are
    compared by 64-bit hashes: a clash would count as one common shingle.
    ``docs`` must be readable again in the same order (see ``with_row_id``).
    """
    base = with_row_id(docs.select("doc_id", "text"))
    signed = stored(sign(base, shingle), "signed")
    sets = signed.where("size > 0").groupBy("set1", "set2", "size", "mins").agg(F.min("_rid").alias("rep"))
    sets = stored(sets, "sets")
    leaves = stored(buckets(sets, similarity, recall), "leaves", small=True)
    found = stored(links_and_edges(base.select(F.col("_rid").alias("rep"), "text"), leaves, shingle, similarity), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    info = sets.select("set1", "set2", "size", "rep").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.select("set1", "set2", "size", "rep", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = base.select("_rid", F.coalesce("doc_id", -1 - F.col("_rid")).alias("name"))
    info = info.join(named.select(F.col("_rid").alias("rep"), F.col("name").alias("rep_name")), "rep").join(named.select(F.col("_rid").alias("root"), F.col("name").alias("root_name")), "root")
    rows = base.select("_rid", "doc_id").join(signed.select("_rid", "set1", "set2", "size"), "_rid")
    out = rows.join(info, ["set1", "set2", "size"], "left")
    own = F.coalesce("doc_id", -1 - F.col("_rid"))
    return out.select(
        "_rid",
        "doc_id",
        F.coalesce("root_name", own).alias("class_id"),
        F.coalesce("rep_name", own).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.coalesce("root", "_rid") == F.col("_rid")).alias("keep"),
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` doesn't keep.

    Rows without words (null, empty, white space) all stay; of repeated rows the first stays;
    columns of any name come back as they are; an empty table stays empty.
    """
    rid = "_rid"
    while rid in docs.columns:
        rid += "_"
    gone = near_duplicates(docs, shingle, similarity).where("not keep").select(F.col("_rid").alias(rid))
    return with_row_id(docs, rid).join(gone, rid, "left_anti").select(*docs.columns)


def op5_ngram_jaccard(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: its class, the document with the same set, and its links.

    Nulls, empty and very long texts, ties, repeated rows and empty tables as in
    ``near_duplicates``; other columns of ``docs`` are ignored.
    """
    return near_duplicates(docs).select("doc_id", "class_id", "copy_of", "n_links")
