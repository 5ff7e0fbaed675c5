import hashlib
import zlib

import numpy as np

from packetlake.llm import media
from packetlake.llm.media import FRAME, HOP, RATE, media_columns, op3_media_columns, peak_pairs, read_wav, spectral_peaks


def test_round_trip_of_whole_texts(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall())
    rows = op3_media_columns(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(payload), len(payload) + 44)
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 33), (4, "é" * 33), (None, "a"), (5, "ab cd " * 200_000)]
    docs = spark.createDataFrame([(d, t, "m", 1) for d, t in rows], "doc_id long, text string, media string, feature long")
    got = media_columns(docs).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes) for r in got) == [(0, 1, 64), (1, 0, 64), (2, 0, 64), (3, 64, 64), (4, 66, 128), (4, 66, 128), (5, 1_200_000, 1_200_000)]
    assert len({r.feature for r in got if r.doc_id in (1, 2)}) == len({r.media_sha256 for r in got if r.doc_id == 4}) == 1
    for r in got:
        assert read_wav(bytes(r.media))[: r.n_bytes] == (dict((d, t) for d, t in rows)[r.doc_id] or "").encode()
        assert hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
    assert media_columns(docs.limit(0)).count() == 0


def test_a_tone_gives_its_bin():
    tone = (128 + 90 * np.sin(2 * np.pi * 1000 / RATE * np.arange(200 * HOP + FRAME))).astype(np.uint8).tobytes()
    peaks = spectral_peaks(tone)
    assert len(peaks) == 201 and (peaks == 1000 * FRAME // RATE).any(axis=1).all()
    pairs = peak_pairs(peaks)
    assert (np.diff(pairs) > 0).all() and (pairs >> 20).max() == 199


def test_blocks_join_without_a_seam(monkeypatch):
    from packetlake.llm import media

    data = np.random.default_rng(1).integers(0, 256, 30_000, np.uint8).tobytes()
    whole = spectral_peaks(data)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert (spectral_peaks(data) == whole).all()


def plain_peaks(samples):
    """Frame by frame and bin by bin, with a plain sum for the transform."""
    frames = 1 + max(0, -(-(len(samples) - media.FRAME) // media.HOP))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    out = []
    for k in range(frames):
        x = np.zeros(media.FRAME)
        part = np.frombuffer(samples[k * media.HOP : k * media.HOP + media.FRAME], np.uint8).astype(float) - 128
        x[: len(part)] = part
        power = np.rint(np.abs(turn @ (x * np.hanning(media.FRAME))) * media.GRAIN)
        found = [(-power[i], i) for i in range(1, len(power) - 1) if power[i] > power[i - 1] and power[i] >= power[i + 1]]
        best = sorted((i for _, i in sorted(found)[: media.PEAKS]), reverse=True)
        out.append(best + [-1] * (media.PEAKS - len(best)))
    return np.array(out)


def test_peaks_and_pairs_against_plain_versions():
    rng = np.random.default_rng(8)
    texts = [b"abcdefgh" * 80, b"the same words again and again " * 30, rng.integers(32, 127, 1500, np.uint8).tobytes(), b"a" * 700]
    for t in texts:
        got, want = media.spectral_peaks(media.padded(t)), plain_peaks(media.padded(t))
        assert (got == want).mean() > 0.99  # last bits may move a border case
        pairs = sorted(i << 20 | int(a) << 12 | int(b) << 4 | d for d in range(1, media.AHEAD + 1) for i in range(len(got) - d) for a in got[i] for b in got[i + d] if a >= 0 and b >= 0)
        assert media.peak_pairs(got).tolist() == pairs


def test_of_equal_peaks_the_lower_bin_counts():
    x = np.zeros(media.FRAME)
    x[0] = 100  # weighted zero by the window: silence but for rounding
    assert (media.spectral_peaks((x + 128).astype(np.uint8).tobytes()) == -1).all()
