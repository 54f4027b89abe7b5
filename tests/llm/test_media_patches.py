import numpy as np
import pyarrow as pa

from tessera.llm import media


def test_query_covers_the_patches(spark, odd_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {}
    for r in media.audio_features(media.encode_media(docs)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    got = {r.doc_id: r.feature for r in media.op10_media_audio(docs).collect()}
    assert got.keys() == rows.keys()
    for doc_id, own in rows.items():
        own.sort(key=lambda r: r.patch)
        tensors = media.tensor_column(pa.array([r.log_mel for r in own], pa.list_(pa.float32())))
        columns = [pa.array([r[c] for r in own]) for c in ("patch", "start_s", "end_s", "active")]
        batch = pa.RecordBatch.from_arrays([*columns, tensors], ["patch", "start_s", "end_s", "active", "log_mel"])
        assert got[doc_id].endswith(":" + media.patch_digest(batch))


def test_digest_depends_on_tensors_and_spans():
    _, found = media.features_of(media.wav(media.pad(bytes(range(256)) * 90)))
    one = media.patch_digest(media.patch_batch(found))
    assert one.split(":")[0] == str(-(-len(found.mel) // media.PATCH)) and int(one.split(":")[0]) > 1
    other = media.Features(found.mel.copy(), found.spans, found.rate)
    other.mel[-1, -1] = np.nextafter(other.mel[-1, -1], np.float32(np.inf))
    assert media.patch_digest(media.patch_batch(other)) != one and other.digest() == found.digest()
    slower = media.Features(found.mel, found.spans, found.rate // 2)
    assert media.patch_digest(media.patch_batch(slower)) != one


def test_stored_tensors_are_those_of_the_query(spark, odd_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    stored = {r.doc_id: r for r in media.audio_tensors(media.encode_media(docs)).collect()}
    rows = media.op10_media_audio(docs).collect()
    assert len(rows) == len(stored)
    for r in rows:
        patches = media.read_stream(stored[r.doc_id].tensors)
        kind = patches.schema.field("log_mel").type
        assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [media.PATCH, media.MELS]
        assert patches.num_rows == r.n_patches == stored[r.doc_id].n_patches and r.feature.endswith(":" + media.patch_digest(patches))
        start, end = (patches.column(c).to_numpy() for c in ("start_s", "end_s"))
        assert (start < end).all() and (start[1:] < end[:-1] + 1e-9).all()
        # the spans reach to the last sample
        assert end[-1] * media.TARGET_RATE >= r.payload_bytes * media.TARGET_RATE / media.STORED_RATE - 1


def test_resampling_computes_the_wanted_outputs():
    rng = np.random.default_rng(2)
    for n, rate, target in ((64, 12_000, 8_000), (1_000, 12_000, 8_000), (333, 8_000, 12_000), (50, 8_000, 8_000), (700, 44_100, 8_000)):
        x = rng.normal(size=n).astype(np.float32)
        got = media.resample(x, rate, target)
        if rate == target:
            assert (got == x).all()
            continue
        g = np.gcd(rate, target)
        up, down = target // g, rate // g
        wide = np.zeros(n * up, np.float32)
        wide[::up] = x
        want = np.convolve(wide, media.low_pass(up, down))[: n * up : down]
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-4)


def test_log_mel_and_segments_by_plain_sums():
    """Frames by a plain discrete Fourier sum, segments by a loop with a state."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=2_000) * np.repeat([0.01, 1, 0.01, 0.5], 500)).astype(np.float32)
    mel = media.log_mel(x, media.TARGET_RATE)
    frames = -(-(len(x) - media.FRAME) // media.HOP) + 1
    padded = np.r_[x, np.zeros((frames - 1) * media.HOP + media.FRAME - len(x))]
    t, k = np.arange(media.FRAME), np.arange(media.FFT // 2 + 1)[:, None]
    turn = np.exp(-2j * np.pi * k * t / media.FFT)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * t / media.FRAME)
    for i in (0, 3, frames // 2, frames - 1):
        power = np.abs(turn @ (padded[i * media.HOP : i * media.HOP + media.FRAME] * hann)) ** 2
        assert np.allclose(mel[i], np.log(power @ media.mel_bank(media.TARGET_RATE) + 1e-6), atol=2e-3)
    energy = 10 * np.log10(np.exp(mel).mean(1))
    energy = (energy - energy.mean()) / energy.std()
    on, plain = False, []
    for i, e in enumerate(energy):
        if not on and e >= media.RISE:
            on, begin = True, i
        elif on and e < media.FALL:
            on = False
            plain.append((begin, i))
    plain += [(begin, len(energy))] if on else []
    assert media.segments(mel) == plain and len(plain) >= 1
