import hashlib
import io
import wave
import zlib

import numpy as np

from saffron.llm import media
from tests.conftest import SMALL
from tests.llm.rows import docs


def padded(text):
    raw = (text or "").encode()
    size = max(576, -(-len(raw) // 576) * 576)
    return raw + b"\xff" * (size - len(raw)), len(raw)


def test_digests_equal_a_plain_reading(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(docs(spark).where("doc_id is not null").selectExpr("doc_id + 1000000", "text"))
    have = {}
    for r in media.digests(df).collect():
        have.setdefault(r["doc_id"], r)
    for r in df.collect():
        payload, n = padded(r["text"])
        row = have[r["doc_id"]]
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert row["media_bytes"] == len(payload) + 44
        assert 0 <= row["tail_crc32"] < 2**32


def test_equal_texts_have_equal_values_and_files_read_back(spark):
    df = docs(spark, [(1, "same text " * 300), (2, "same text " * 300), (3, None), (4, "")], clash=True)
    rows = {r["doc_id"]: r for r in media.media_columns(df).collect()}
    assert rows[1][1:] == rows[2][1:] and rows[3][1:] == rows[4][1:]
    with wave.open(io.BytesIO(rows[1]["media"])) as w:
        assert w.readframes(w.getnframes()) == padded("same text " * 300)[0]
    assert rows[1]["fingerprint"] == sorted(rows[1]["fingerprint"])
    assert media.digests(docs(spark, [])).count() == 0


def test_peak_pairs_of_a_tone():
    t = np.arange(576 * 40)
    tone = (128 + 100 * np.sin(2 * np.pi * 50 * t / 576) * (1 + 0.5 * np.sin(2 * np.pi * t / 4000))).astype(np.uint8)
    codes = media.fingerprint(tone.tobytes())
    bins = (codes >> 14) & 0x1FF
    assert len(codes) and 49 in bins  # the bin of 50 periods in a frame, counted without the constant
    part = media.fingerprint(tone[576 * 10 :].tobytes())
    shifted = {int(c) & 0x7FFFFF for c in codes}
    assert sum(int(c) & 0x7FFFFF in shifted for c in part) >= len(part) // 2  # pairs survive a cut


def brute_pairs(samples):
    """The codes by a transform written out: the loudest bin of each band and frame, peaks in time, the next three each."""
    x = [(b - 128) for b in samples]
    window = np.hanning(576).astype(np.float32)
    frames = [np.array(x[at : at + 576], np.float32) * window for at in range(0, len(x) - 575, 288)]
    waves = np.exp(-2j * np.pi * np.outer(np.arange(1, 289), np.arange(576)) / 576)
    energy = np.array([np.abs(waves @ f) ** 2 for f in frames]).reshape(len(frames), 4, 72)
    peaks = []
    for t in range(len(frames)):
        for band in range(4):
            here = energy[t, band].max()
            if (t == 0 or here > energy[t - 1, band].max()) and (t + 1 == len(frames) or here >= energy[t + 1, band].max()):
                peaks.append((t, band * 72 + int(energy[t, band].argmax())))
    codes = [t << 23 | f << 14 | g << 5 | u - t for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 4] if u - t <= 31]
    return sorted(codes)


def test_the_array_equals_a_transform_written_out(spark):
    texts = ["A few words of prose, and then some more of them. " * n for n in (1, 30, 90)] + ["x", "Grüße " * 500]
    rows = {r["doc_id"]: r for r in media.digests(docs(spark, [(i, t) for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        codes = rows[i]["pairs"]
        assert codes == brute_pairs(padded(text)[0])
        assert rows[i]["feature"] == f"{len(codes)}:{hashlib.sha256(np.array(codes, '<i8').tobytes()).hexdigest()[:32]}"
