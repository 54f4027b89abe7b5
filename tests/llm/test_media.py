import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import media


def test_query_round_trip(spark, sf01, odd_docs, empty_docs):
    docs = spark.read.parquet(f"{sf01}/documents.parquet").where("doc_id < 100").select("doc_id", "text").union(odd_docs.where("doc_id is not null").select("doc_id", "text"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    got = media.op10_media_audio(docs).collect()
    assert len(got) == docs.count()
    by_text = {}
    for r in got:
        raw = next(t for t in texts[r.doc_id] if len(t) == r.n_bytes and hashlib.sha256(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")).hexdigest() == r.payload_sha256)
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert r.payload_bytes == len(payload) and r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.wav(payload)
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.feature
        assert by_text.setdefault(raw, r.feature) == r.feature
    assert len(set(by_text.values())) > 0.9 * len(by_text)
    assert media.op10_media_audio(empty_docs).count() == 0


@given(st.binary(max_size=300))
def test_wav_is_lossless(data):
    assert media.read_wav(media.wav(media.pad(data))) == (media.pad(data), media.STORED_RATE)
    assert len(media.pad(data)) % 64 == 0 < len(media.pad(data))
    for bad in (data[:40], media.wav(media.pad(data))[:-1]):
        with pytest.raises(ValueError):
            media.read_wav(bad)


@pytest.mark.parametrize("rates", [(12_000, 8_000), (8_000, 12_000), (8_000, 8_000), (44_100, 8_000)])
def test_polyphase_equals_the_plain_filter(rates):
    a, b = rates
    x = np.random.default_rng(0).normal(size=501).astype(np.float32)
    got = media.resample(x, a, b)
    up, down = b // np.gcd(a, b), a // np.gcd(a, b)
    if up == down:
        assert (got == x).all()
        return
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    plain = np.convolve(stuffed, media.low_pass(up, down))[: len(x) * up : down]
    assert np.allclose(got, plain[: len(got)], atol=1e-4)


def test_tone_is_found():
    t = np.arange(24_000) / 12_000
    tone = np.where((t > 0.5) & (t < 1.0), np.sin(2 * np.pi * 1000 * t), 0)
    _, found = media.features_of(media.wav(bytes((128 + 100 * tone).astype(np.uint8))))
    (a, b), = found.spans
    assert 0.4 < a * media.HOP / found.rate < 0.55 and 0.95 < b * media.HOP / found.rate < 1.1
    peak = found.mel[(a + b) // 2].argmax()
    top = 2595 * np.log10(1 + 4000 / 700)
    centre = 700 * (10 ** (np.linspace(0, top, media.MELS + 2) / 2595) - 1)
    assert abs(centre[peak + 1] - 1000) < 120


def test_tensors(spark, odd_docs, empty_docs):
    stored = media.encode_media(odd_docs)
    assert stored.columns == [*odd_docs.columns, "media"]
    rows = media.audio_features(stored).where("doc_id = 8").orderBy("patch").collect()
    assert [r.patch for r in rows] == list(range(len(rows))) and all(len(r.log_mel) == media.PATCH * media.MELS for r in rows)
    assert rows[0].start_s == 0 and all(x.end_s > x.start_s for x in rows)
    column = media.tensor_column(pa.array([r.log_mel for r in rows], pa.list_(pa.float32())))
    assert column.type.shape == [media.PATCH, media.MELS] and len(column) == len(rows)
    assert media.audio_features(media.encode_media(empty_docs)).count() == 0
