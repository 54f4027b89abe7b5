"""Reed-Solomon erasure coding of byte columns: a systematic Cauchy code over GF(2^8).

Data is cut into blocks of at most ``256 - parity`` shards, so any length can be coded; each block
survives the loss of up to ``parity`` of its shards, at known places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataError

#: x^8 + x^4 + x^3 + x^2 + 1
POLYNOMIAL = 0x11D


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x <<= 1
        if x & 256:
            x ^= POLYNOMIAL
    return exp, log


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    exp, log = _tables()
    out = exp[log[a] + log[b]]
    return np.where((a == 0) | (b == 0), 0, out).astype(np.uint8)


def inverse(a: int) -> int:
    exp, log = _tables()
    return int(exp[255 - log[a]])


def product(matrix: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(rows, k) times (k, bytes)."""
    out = np.zeros((len(matrix), data.shape[1]), np.uint8)
    for i in range(matrix.shape[1]):
        out ^= multiply(matrix[:, i : i + 1], data[i : i + 1])
    return out


def cauchy(data: int, parity: int) -> np.ndarray:
    return np.array([[inverse((data + p) ^ d) for d in range(data)] for p in range(parity)], np.uint8).reshape(parity, data)


def solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The data of a square system by elimination."""
    m, r = matrix.copy(), right.copy()
    n = len(m)
    for i in range(n):
        pivot = next((j for j in range(i, n) if m[j, i]), None)
        if pivot is None:
            raise DataError("too many shards are missing")
        if pivot != i:
            m[[i, pivot]], r[[i, pivot]] = m[[pivot, i]], r[[pivot, i]]
        scale = np.uint8(inverse(int(m[i, i])))
        m[i], r[i] = multiply(m[i], scale), multiply(r[i], scale)
        for j in range(n):
            if j != i and m[j, i]:
                f = m[j, i]
                m[j] ^= multiply(m[i], f)
                r[j] ^= multiply(r[i], f)
    return r


@dataclass(frozen=True)
class Config:
    parity: int
    chunk: int = 4096

    def __post_init__(self) -> None:
        if not 1 <= self.parity <= 32:
            raise ValueError("1 to 32 parity shards")
        if not 1 <= self.chunk <= 65536:
            raise ValueError("chunks of 1 to 65536 bytes")

    def shards(self, size: int) -> int:
        """Data shards of ``size`` bytes."""
        return max(1, -(-size // self.chunk))


def encode(data: bytes, config: Config) -> list[tuple[int, int, bool, bytes]]:
    """(block, shard, is_parity, bytes) of all shards; the last data shard is filled up with zeros."""
    total = config.shards(len(data))
    full = np.frombuffer(data.ljust(total * config.chunk, b"\0"), np.uint8).reshape(total, config.chunk)
    most, out = 256 - config.parity, []
    for block, a in enumerate(range(0, total, most)):
        part = full[a : a + most]
        out += [(block, i, False, row.tobytes()) for i, row in enumerate(part)]
        extra = product(cauchy(len(part), config.parity), part)
        out += [(block, len(part) + i, True, row.tobytes()) for i, row in enumerate(extra)]
    return out


def recover(shards: list[tuple[int, int, bytes]], size: int, config: Config) -> bytes:
    """The data from (block, shard, bytes) that are left; DataError where a block has too few."""
    total, most = config.shards(size), 256 - config.parity
    by_block: dict[int, dict[int, bytes]] = {}
    for block, shard, raw in shards:
        by_block.setdefault(block, {})[shard] = raw
    out = []
    for block, a in enumerate(range(0, total, most)):
        k = min(most, total - a)
        have = by_block.get(block, {})
        if all(i in have for i in range(k)):
            out += [have[i] for i in range(k)]
            continue
        chosen = sorted(have)[:k]
        if len(chosen) < k:
            raise DataError(f"block {block} has {len(chosen)} of {k} shards that it needs")
        whole = np.concatenate([np.eye(k, dtype=np.uint8), cauchy(k, config.parity)])
        data = solve(whole[chosen], np.stack([np.frombuffer(have[i], np.uint8) for i in chosen]))
        out += [row.tobytes() for row in data]
    return b"".join(out)[:size]


def encode_column(df: DataFrame, key: str, data: str, config: Config) -> DataFrame:
    """A row per shard: ``key, value_id, size, block, shard, is_parity, bytes, crc32``. Null data give none.

    ``value_id`` tells values apart whose keys are equal or null; it numbers the rows of ``df``, which
    must be a table or files, or stored before.
    """
    source = df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("value_id"), F.col(data).cast("binary").alias("data")).where("data is not null")
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, v, raw in zip(batch.column("key"), batch.column("value_id").to_pylist(), batch.column("data").to_pylist()):
                rows = encode(raw, config)
                n = len(rows)
                block, shard, parity, parts = zip(*rows)
                columns = [pa.array([k.as_py()] * n, k.type), pa.array([v] * n, pa.int64()), pa.array([len(raw)] * n, pa.int64()), pa.array(block, pa.int32()), pa.array(shard, pa.int32()), pa.array(parity), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "value_id", "size", "block", "shard", "is_parity", "bytes"])

    out = source.mapInArrow(run, f"key {kind}, value_id long, size long, block int, shard int, is_parity boolean, bytes binary")
    return out.withColumnRenamed("key", key).withColumn("crc32", F.crc32("bytes"))


def recover_column(shards: DataFrame, key: str, config: Config) -> DataFrame:
    """``key, data`` from the shards that are left and whose checksum is right, a row per value; null where too few are.

    The shards of one value meet in one task: a value is the unit of memory.
    """
    good = F.when(F.crc32("bytes") == F.col("crc32"), F.struct("block", "shard", "bytes"))
    grouped = shards.groupBy("value_id").agg(F.first(key).alias("key"), F.first("size").alias("size"), F.collect_list(good).alias("parts"))
    kind = shards.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for size, parts in zip(batch.column("size").to_pylist(), batch.column("parts").to_pylist()):
                try:
                    out.append(recover([(p["block"], p["shard"], p["bytes"]) for p in parts], size, config))
                except DataError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "data"])

    return grouped.select("key", "size", "parts").mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)
