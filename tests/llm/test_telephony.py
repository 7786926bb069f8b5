import hashlib
import struct

import numpy as np
import pytest

from geoweft.llm import media

from .data import documents, frame


def plain_adpcm(block):
    """One block, one code after the other."""
    value, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = step // 8 + (code & 1) * (step // 4) + (code >> 1 & 1) * (step // 2) + (code >> 2 & 1) * step
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(media.INDEX_STEP[code])))
            out.append(value)
    return out


def test_adpcm_equals_a_plain_decoder():
    data = np.random.default_rng(2).integers(0, 256, 5 * 64).astype(np.uint8).tobytes()
    want = [x for i in range(0, len(data), 64) for x in plain_adpcm(data[i : i + 64])]
    assert media.adpcm_decode(data, 64).tolist() == want


def test_malformed_files_are_null(spark):
    good = media.wave(bytes(range(256)), media.MU_LAW)
    bad = [media.wave(b"\1" * 64, media.IMA_ADPCM, block=n, bits=4) for n in (0, 2, 4)] + [media.wave(b"\1" * 8, media.MU_LAW, rate=0), media.wave(b"\1" * 8, media.PCM, channels=0), media.wave(b"\1" * 8, media.PCM, bits=24), good[:20], b"", None]
    rows = [(i, m, "old") for i, m in enumerate([good, *bad])]
    got = media.stored_pcm(spark.createDataFrame(rows, "id int, media binary, pcm string"), to=8000)
    assert got.columns == ["id", "media", "pcm"]
    got = {r["id"]: r["pcm"] for r in got.collect()}
    assert got[0] == media.MU.astype("<i2").tobytes() and all(got[i] is None for i in range(1, len(rows)))


def test_every_format_in_a_table(spark):
    wave = (6000 * np.sin(np.arange(400) / 9)).astype(np.int16)
    stereo = np.stack([wave, -wave // 2], 1).ravel()
    eight = ((wave >> 8) + 128).astype(np.uint8)
    files = [
        (media.wave(bytes(range(256)), media.A_LAW), media.A), (media.wave(wave.astype("<i2").tobytes(), media.PCM, 8000, 2, 16), wave),
        (media.wave(stereo.astype("<i2").tobytes(), media.PCM, 8000, 4, 16, 2), np.rint((wave.astype(int) + (-wave // 2)) / 2).astype(np.int16)),
        (media.wave(eight.tobytes(), media.PCM, 8000, 1, 8), (eight.astype(np.int16) - 128) << 8),
        (media.wave(media.adpcm_encode(wave, 64), media.IMA_ADPCM, block=64, bits=4), media.adpcm_decode(media.adpcm_encode(wave, 64), 64)),
    ]
    got = media.stored_pcm(spark.createDataFrame([(i, m) for i, (m, _) in enumerate(files)], "id int, media binary"), to=8000).collect()
    for r in got:
        assert r["pcm"] == files[r["id"]][1].astype("<i2").tobytes()


def test_a_lower_rate_has_no_alias():
    t = np.arange(4000)
    high = media.resampled((9000 * np.sin(2 * np.pi * 3400 / 8000 * t)).astype(np.int16), 8000, 4000)[20:-20]
    low = media.resampled((9000 * np.sin(2 * np.pi * 300 / 8000 * t)).astype(np.int16), 8000, 4000)[20:-20]
    assert np.abs(high).max() < 500 and np.abs(low).max() > 8500
    with pytest.raises(ValueError):
        media.resampled(low, 0, 8000)


def test_query_columns(spark):
    text_of = {(r[0], len((r[1] or "").encode())): (r[1] or "").encode() for r in documents()}
    for r in media.text_media(frame(spark)).collect():
        raw = text_of[r["doc_id"], r["n_bytes"]]
        pay = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        codes = np.frombuffer(pay, np.uint8)
        digest = lambda x: hashlib.sha256(np.asarray(x).astype("<i2").tobytes()).hexdigest()
        assert r["adpcm_sha256"] == digest([x for i in range(0, len(pay), 64) for x in plain_adpcm(pay[i : i + 64])])
        assert r["pcm_sha256"] == digest(media.resampled(media.MU[codes], 8000, 16000)) and r["alaw_sha256"] == digest(media.resampled(media.A[codes], 8000, 16000))
        pcm = media.MU[codes].astype(np.int64)
        assert r["feature"].startswith(f"n={len(pcm)};sum={pcm.sum()};sq={(pcm**2).sum()};min={pcm.min()};max={pcm.max()};zc={sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))};")
