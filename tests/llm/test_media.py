import numpy as np
import pytest

from tessera.llm import media


@pytest.mark.parametrize("size", [64, 512, 576, 704, 768, 832, 2048 * 256 + 512 + 192])
def test_the_ends_lie_in_frames(size):
    a = bytes(k * 37 % 251 for k in range(size))
    for b in (a[:-1] + bytes([a[-1] ^ 128]), bytes([a[0] ^ 128]) + a[1:]):
        spectra = [np.abs(np.fft.rfft(media.framed(x) * media._window, axis=1)) for x in (a, b)]
        assert not np.allclose(*spectra, atol=1)


def test_texts_that_differ_at_the_end_differ_in_their_fingerprint():
    tone = lambda step: bytes(int(128 + 100 * np.sin(k * step)) for k in range(192))
    a, b = (bytes([128] * 512) + tone(step) for step in (0.3, 2.1))
    assert [x.tolist() for x in media.peaks(a)] != [x.tolist() for x in media.peaks(b)]


def test_a_known_tone_gives_its_bin():
    k = 40  # bin of a tone of k cycles a frame
    tone = bytes(int(round(128 + 100 * np.sin(2 * np.pi * k * n / media.FRAME))) for n in range(20 * media.FRAME))
    at, bins = media.peaks(tone)
    low, high = media._edges[:2]
    inner = (bins >= low) & (bins < high) & (at > 4) & (at < 70)
    assert inner.any() and set(bins[inner].tolist()) == {k}


def brute_feature(payload):
    """Peaks and pairs by plain loops over frames, bands and later peaks."""
    import hashlib

    x = [0.0] * media.HOP + [b - 128.0 for b in payload]
    x += [0.0] * (media.HOP + (-len(payload)) % media.HOP)
    frames = [np.array(x[k : k + media.FRAME], np.float32) for k in range(0, len(x) - media.FRAME + 1, media.HOP)]
    power = [np.abs(np.fft.rfft(f * media._window)) for f in frames]
    peaks = []
    for block in range(0, len(frames), media.SPAN):
        for lo, hi in zip(media._edges[:-1], media._edges[1:]):
            best = max(((power[t][b], -t, -b) for t in range(block, min(block + media.SPAN, len(frames))) for b in range(lo, hi)))
            peaks.append((-best[1], -best[2]))
    peaks.sort()
    pairs = sorted((peaks[k][0], (int(peaks[k][1]) << 20) | (int(peaks[k + j][1]) << 10) | min(peaks[k + j][0] - peaks[k][0], 1023)) for k in range(len(peaks)) for j in range(1, media.FAN + 1) if k + j < len(peaks))
    t, c = (np.array([p[i] for p in pairs], np.int32) for i in (0, 1))
    return f"{len(t)}:{hashlib.sha256(t.tobytes() + c.tobytes()).hexdigest()}"


def test_every_contract_field_against_brute_force(spark):
    import hashlib
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in media.op1_media(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.limit(60).collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        wav = media.wav_of(payload)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (g.media_bytes, g.media_sha256, g.feature) == (len(wav), hashlib.sha256(wav).hexdigest(), brute_feature(payload))
