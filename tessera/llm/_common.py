"""Helpers that the operators share: row ids, shared folders, batches of texts and word hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere. Hashes are computed over whole Arrow batches with
numpy. A word goes through a bijection of 64 bits, eight bytes at a time, so that words of equal
length up to eight bytes never clash, and long words are digested by BLAKE2b; a run of words is
joined half by half through the same bijection. No step is linear, so that no structure of words
(alternating letters, exchanged halves) makes hashes meet. Two lanes start from different seeds.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; one longer text is hashed alone.
CHUNK_BYTES = 1_000_000
#: Bytes of an Arrow batch that goes to a Python worker, but for one longer row.
BATCH_BYTES = 8 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
#: Words of more bytes than this are hashed by BLAKE2b.
LONG_WORD = 256
#: Where ``spark.checkpoint.dir`` is unset: this process's own folder.
_own_dir: dict[str, str] = {}
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which all executors share.

    Where that setting is empty a temporary folder takes its place if Spark runs in this process
    alone (``local[*]``); on a cluster, where others wouldn't see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_dir.get("path")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_dir["path"] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has the folder deleted when the driver's JVM ends; results may need it until then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def stored(df: DataFrame, what: str, small: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there.

    ``small``: rows of a few numbers. They are written by fewer tasks, of the size that Spark is told
    to aim at, as for small files the making of a file takes longer than its rows.
    """
    spark, name = df.sparkSession, "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    path, was = shared_dir(spark, what), spark.conf.get(name, None)
    if small:
        spark.conf.set(name, "false")
    try:
        df.write.parquet(path)
    finally:
        if small:
            spark.conf.unset(name) if was is None else spark.conf.set(name, was)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_id(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """Adds a unique long to each row.

    ``docs`` must be a table or files, which give the same rows in the same order when an executor
    is lost and a task runs again; results of shuffles have to be stored first.
    """
    return docs.withColumn(name, F.monotonically_increasing_id())


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and idle ones keep what they once held."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def map_arrow(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_BYTES``, which bounds what a worker holds.

    The limit is a setting of the session; it stays lowered, as Spark reads it when a plan runs,
    which is after the operator has returned. The README says so too. When a task ends, its worker
    gives back what was freed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            give_back()

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    now = conf.get(name, "64m").strip().lower()
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "b": 1}
    size = int(now.rstrip("bkmg") or 0) * next((scale[c] for c in now.removesuffix("b")[-1:] if c in scale), 1)
    if not 0 < size <= BATCH_BYTES:
        conf.set(name, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most so many bytes, but of one text at least."""
    first = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield first, i
            first, total = i, 0
        total += len(text)
    if first < len(texts):
        yield first, len(texts)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's first ``n`` powers and those of its inverse modulo 2**64."""
    have = _powers[-1] if _powers else None
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for value in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            run = np.full(size, value, np.uint64)
            run[0] = 1
            both.append(np.multiply.accumulate(run))
        have = (both[0], both[1])
        if size <= 1 << 21:
            _powers[:] = [have]
    return have[0][:n], have[1][:n]


class Prefix:
    """Prefix polynomial of bytes, for cheap hashes of any pieces of words; only for features, where a clash does no harm."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[:-1], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.down[starts]


_SEEDS = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of each ``raw[start:end]`` (uint64)."""
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(_MULTIPLIER) ^ _SEEDS[lane])
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero(size <= LONG_WORD)
    at, left = start[live], size[live]
    while len(live):
        out[live] = mix(out[live] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), "little")
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two in this order; for either one fixed, a bijection of the other."""
    return mix(a ^ (b * np.uint64(_MULTIPLIER) + _SEEDS[3]))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``hashes[i : i + size]`` for each i that has so many: by runs of 1, 2, 4, ..."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    power, width, parts = hashes, 1, []
    while width <= size:
        if size & width:
            parts.append((width, power))
        if 2 * width <= size:
            power = joined(power[:-width], power[width:])
        width *= 2
    many = len(hashes) - size + 1
    out, at = None, 0
    for width, power in reversed(parts):
        piece = power[at : at + many]
        out, at = (piece if out is None else joined(out, piece)), at + width
    return out if size > 1 else mix(out)


_all = np.arange(256, dtype=np.uint8)
LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)
#: ASCII digits, lower-case letters and all other characters than ASCII.
LETTER = ((_all >= 97) & (_all <= 122)) | ((_all >= 48) & (_all <= 57)) | (_all >= 128)


class Words:
    """The words of some texts: where they are, which text they are of, and their hashes."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.buffer, np.uint8)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.diff(space.view(np.int8), prepend=np.int8(1))
        self.raw = raw
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        if len(self.end) > len(self.start):
            self.end = self.end[1:]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths + 1, out=self.text_start[1:])
        #: offset[i]:offset[i + 1] are the words of text i
        self.offset = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.offset)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return word_hashes(self.raw, self.start, self.end, lane)

    def bare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words without the marks at their edges, and all bytes with A-Z in lower case; of a word of marks alone the middle one is left."""
        lower = LOWER[self.raw]
        letter = LETTER[lower]
        at = np.arange(len(lower))
        following = np.minimum.accumulate(np.where(letter, at, len(lower))[::-1])[::-1][self.start]
        previous = np.maximum.accumulate(np.where(letter, at, -1))[self.end - 1]
        middle = self.start + (self.end - self.start) // 2
        marks = following >= self.end
        start, end = np.where(marks, middle, following), np.where(marks, middle, previous) + 1
        return start, end, lower

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, size: int) -> np.ndarray:
        """Index of the first word of every run of ``size`` words within one text."""
        many = np.maximum(self.count - size + 1, 0)
        return np.arange(many.sum()) + np.repeat(self.offset[:-1] - np.cumsum(many) + many, many)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by ``keys`` (long or int columns)."""
    pending: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if pending and key != last:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(batch.slice(a, b - a))
            last = key
    if pending:
        yield pa.Table.from_batches(pending)
