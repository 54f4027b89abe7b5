"""Token counts by digest cache, and the encoder that packing uses too.

Tokens of a text are those of its words one after another whenever the tokenizer treats ASCII
white space as a border (its normaliser folds runs of it, its splitter never crosses it and no
added token holds any). ``WordEncoder`` uses this to encode each distinct word once; for other
tokenizers it encodes whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CHUNK_BYTES, chunks, gone_at_exit, map_arrow, shared_dir, utf8

#: Words that an encoder remembers before it starts anew.
CACHED_WORDS = 400_000

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"
#: The session's setting that names the folder of the lasting cache.
CACHE_SETTING = "spark.tessera.tokenCache"


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file, as little-endian unsigned 32-bit integers.

    Words of printable Latin characters are cut by the tokenizer's own pattern and each distinct
    piece is encoded by its model once; other words, and those that may hold an added token, go
    through the whole tokenizer, as do texts where words can't be encoded apart.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = splits_at_spaces(spec)
        pattern = piece_pattern(spec) if self.by_word else None
        self.pattern = regex.compile(pattern) if pattern else None
        starts = sorted({re.escape(a["content"].encode()[:2]) for a in spec.get("added_tokens") or ()})
        self.added = re.compile(b"|".join(starts)) if starts else None
        self.cached = cached
        self.ids: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, parts: list[bytes]) -> list[bytes]:
        texts = [x.decode("utf-8", "replace") for x in parts]
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        plain = piece if piece.isascii() else "".join(BYTE_CHARS[b] for b in piece.encode())
        ids = self.pieces[piece] = array("I", [t.id for t in self.tokenizer.model.tokenize(plain)]).tobytes()
        return ids

    def learn(self, words: list[bytes]) -> None:
        """Makes sure that ``ids`` has all of the (distinct) ``words``; others may be forgotten."""
        if len(self.ids) + len(words) > self.cached:
            self.ids = {w: self.ids[w] for w in words if w in self.ids}
        if len(self.pieces) > self.cached:
            self.pieces.clear()
        new = [w for w in words if w not in self.ids]
        rest = []
        if self.pattern:
            ids, find, known, added = self.ids, self.pattern.findall, self.pieces, self.added
            if added and not added.search(b"\n".join(new)):
                added = None
            for w in new:
                text = w.decode("utf-8", "replace")
                if not (text.isprintable() if text.isascii() else LATIN(text)) or added and added.search(w):
                    rest.append(w)
                    continue
                # none of these characters combines, so only the case is left to normalise
                found = find(text.lower())
                if len(found) == 1:
                    ids[w] = known.get(found[0]) or self._piece(found[0])
                else:
                    ids[w] = b"".join([known.get(p) or self._piece(p) for p in found])
        else:
            rest = new
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            self.ids.update(zip(part, self._whole(part)))

    def forget(self) -> None:
        """Frees the words; other tasks of the worker process may not need them."""
        self.ids, self.pieces = {}, {}

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        for a, b in chunks(texts, 4 * CHUNK_BYTES):  # the longer, the fewer distinct words
            if not self.by_word:
                yield from self._whole(texts[a:b])
                continue
            try:
                column = pa.array(texts[a:b], pa.binary()).cast(pa.string())
            except pa.ArrowInvalid:
                column = pa.array([t.decode("utf-8", "replace") for t in texts[a:b]])
            split = pc.ascii_split_whitespace(column)
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.cast(pa.binary()).to_pylist()
            self.learn(words)
            parts = [self.ids[w] for w in words]
            size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            flat, start = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
            # the ids of all words in turn, picked from those of the distinct words
            word = coded.indices.to_numpy()
            n = size[word]
            end = np.cumsum(n)
            ids = flat[np.arange(n.sum()) + np.repeat(start[word] - end + n, n)]
            border = np.concatenate([[0], end])[split.offsets.to_numpy()].tolist()
            for i, j in zip(border, border[1:]):
                yield ids[i:j].tobytes()


@cache
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process: reading the vocabulary takes longer than a small task."""
    return WordEncoder(path)


#: Printable characters of the Latin blocks, whose classes no Unicode version has changed.
LATIN = re.compile("[!-~\xa1-\xac\xae-\u024f]+").fullmatch


def _byte_chars() -> list[str]:
    """The character that byte-level models use for each byte: itself if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


BYTE_CHARS = _byte_chars()


def piece_pattern(spec: dict) -> str | None:
    """The pattern of a tokenizer that cuts words by it, spells the pieces in bytes and merges them."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if len(steps) != 2 or steps[1].get("type") != "ByteLevel" or steps[1].get("use_regex") or steps[1].get("add_prefix_space"):
        return None
    names = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    if (spec.get("model") or {}).get("type") != "BPE" or (spec["model"].get("dropout") or 0) or names != ["NFC", "Replace", "Lowercase"]:
        return None
    return steps[0]["pattern"].get("Regex")


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's file says that white space ends every token and leaves none itself."""
    norm = spec.get("normalizer") or {}
    steps = norm.get("normalizers", [norm]) if norm else []
    folds = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    known = all(s.get("type") in ("NFC", "Lowercase", "Replace") for s in steps)
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre]) if pre else []
    split = parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
    pattern = str(parts[0].get("pattern", {}).get("Regex", "")) if parts else ""
    takes_space = re.search(r"\\s(?!\\)", pattern.replace(r"[^\s\p{L}\p{N}]", "")) is not None or " " in pattern
    added = spec.get("added_tokens") or []
    plain = all(not (set(a["content"]) & set(" \t\n\r\x0b\x0c")) and not a.get("lstrip") and not a.get("rstrip") and not a.get("single_word") for a in added)
    return bool(folds and known and split and not takes_space and plain and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding"))


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: counts of another file never mix with these."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counts(path: str, texts: list[bytes]) -> list[int]:
    """Tokens of each text, by the library that the file is for."""
    if path.endswith(".model"):
        model = sentence_model(path)
        return [len(model.encode(t.decode("utf-8", "replace"), num_threads=1)) for t in texts]
    return [len(ids) // 4 for ids in word_encoder(path).encode(texts)]


@cache
def sentence_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``digest``, each distinct content encoded once.

    The normalised content is the text itself, null as empty (any further folding could change
    what a tokenizer sees). Contents whose (digest, tokenizer version) is in the cache, a Parquet
    folder, are looked up; of the others one text per digest is encoded and its count appended,
    so that the next run finds it. ``cache`` None: the folder that the session's setting
    ``spark.tessera.tokenCache`` names, and where that is unset too a new one in the shared
    directory, which begins empty and goes when the driver ends.

    Nulls and empty texts count 0 tokens and 0 bytes; repeated rows each come back; an empty table
    gives an empty result; columns of ``docs`` named like those added are replaced.
    """
    spark = docs.sparkSession
    cache = cache or spark.conf.get(CACHE_SETTING, None)
    own_cache = not cache
    cache = cache or shared_dir(spark, "token-cache")
    version = tokenizer_version(tokenizer)
    own = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "digest")]
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(*own, F.octet_length(content).cast("long").alias("n_bytes"), F.sha2(content.cast("binary"), 256).alias("digest"))
    known = read_cache(docs, cache, version)
    every = docs.select(F.sha2(content.cast("binary"), 256).alias("digest"), content.alias("content"))
    if known is not None:
        every = every.join(known, "digest", "left_anti")
    misses = every.groupBy("digest").agg(F.first("content").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = counts(tokenizer, utf8(batch.column("content")))
            yield pa.RecordBatch.from_arrays([batch.column("digest").cast(pa.string()), pa.array([version] * len(sizes), pa.string()), pa.array(sizes, pa.int64())], ["digest", "tokenizer", "n_tokens"])
        if not tokenizer.endswith(".model"):
            word_encoder(tokenizer).forget()

    map_arrow(misses, run, CACHE_SCHEMA).write.mode("append").parquet(cache)
    if own_cache:
        gone_at_exit(spark, cache)
    return keyed.join(read_cache(docs, cache, version), "digest", "left")


def read_cache(docs: DataFrame, cache: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) of this tokenizer version, one row per digest; None before the first run."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    # only runs at the same time can append a digest twice; without an aggregate in between, Spark
    # can split the join where one digest has very many documents
    twice = rows.groupBy("digest").count().where("count > 1").limit(1).count()
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")) if twice else rows


def op8_token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, cache: str | None = None) -> DataFrame:
    """A row for each row of ``docs``: bytes, tokens and whether these are over the limit.

    Nulls, empty and very long texts, repeated rows, ties and empty tables as in ``count_tokens``;
    a null doc_id stays null; further columns of ``docs`` are ignored.
    """
    out = count_tokens(docs.select("doc_id", "text"), tokenizer, cache)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


#: The tokenizer of the registered queries.
VOCABULARY = "word_bpe_49k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
