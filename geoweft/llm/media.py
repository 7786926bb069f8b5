"""Media columns: telephony audio.

mu-law and A-law samples expand through 256-entry tables made from the G.711 rule; IMA ADPCM blocks are decoded side by
side, one numpy step for each sample position over all blocks, of all texts of a batch in the query. Samples are resampled by linear
interpolation, after a low-pass where the rate falls.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import slices

RATE, WIDE = 8000, 16000
BYTES = 2_000_000  # of text held at once; a sample of 16 bits and its steps take some dozen bytes each
MU_LAW, A_LAW, IMA_ADPCM, PCM = 7, 6, 0x11, 1  # format tags of WAVE


def mu_law_table() -> np.ndarray:
    """PCM value of each mu-law code: complement, then sign, 3-bit exponent and 4-bit mantissa around a bias of 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """PCM value of each A-law code: even bits flipped, then sign, exponent and mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exp, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(exp == 0, size, size + 0x100 << np.maximum(exp - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MU, A = mu_law_table(), a_law_table()
#: Fixed values of the IMA ADPCM format: change of the step index by code, and the step sizes.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
    143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
    1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


def adpcm_step(code: np.ndarray, value: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = STEPS[index]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
    return value, np.clip(index + INDEX_STEP[code], 0, 88)


def adpcm_decode(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: blocks of `block` bytes, each a 4-byte header (first sample, step index) and two codes a byte. A short last block is padded."""
    if block < 5:
        raise ValueError("a block holds a header of 4 bytes and one byte of codes or more")
    if not data:
        return np.zeros(0, np.int16)
    n = -(-len(data) // block)
    raw = np.frombuffer(data.ljust(n * block, b"\0"), np.uint8).reshape(n, block)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2].astype(np.int32), 88)
    out = np.empty((n, 1 + 2 * (block - 4)), np.int16)
    out[:, 0] = value
    for i in range(2 * (block - 4)):
        code = (raw[:, 4 + i // 2] >> (4 * (i % 2)) & 15).astype(np.int32)
        value, index = adpcm_step(code, value, index)
        out[:, 1 + i] = value
    return out.ravel()


def adpcm_encode(samples: np.ndarray, block: int) -> bytes:
    """The reverse, nearest code first; the last block is filled with its last sample."""
    each = 1 + 2 * (block - 4)
    if not len(samples):
        return b""
    n = -(-len(samples) // each)
    rows = np.concatenate([samples, np.full(n * each - len(samples), samples[-1])]).astype(np.int32).reshape(n, each)
    value, index = rows[:, 0].copy(), np.zeros(n, np.int32)
    out = np.zeros((n, block), np.uint8)
    out[:, :2] = rows[:, 0].astype("<i2").reshape(n, 1).view(np.uint8)
    for i in range(each - 1):
        tried = [adpcm_step(np.full(n, c, np.int32), value, index) for c in range(16)]
        best = np.argmin([np.abs(v - rows[:, 1 + i]) for v, _ in tried], axis=0)
        value, index = (np.choose(best, [x[j] for x in tried]) for j in (0, 1))
        out[:, 4 + i // 2] |= (best << (4 * (i % 2))).astype(np.uint8)
    return out.tobytes()


def low_pass(samples: np.ndarray, share: float, taps: int = 33) -> np.ndarray:
    """Samples without what lies above `share` of the band: a windowed sinc whose weights sum to 1; the ends are continued."""
    at = np.arange(taps) - taps // 2
    kernel = np.sinc(at * share) * np.hanning(taps + 2)[1:-1]
    return np.convolve(np.pad(samples.astype(np.float64), taps // 2, mode="edge"), kernel / kernel.sum(), mode="valid")


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate, by linear interpolation; what the lower rate cannot hold is filtered out first."""
    if rate < 1 or to < 1:
        raise ValueError("a rate is 1 or more")
    if not len(samples) or rate == to:
        return samples.astype(np.int16)
    n = max(1, len(samples) * to // rate)
    smooth = low_pass(samples, to / rate) if to < rate else samples
    return np.clip(np.rint(np.interp(np.arange(n) * rate / to, np.arange(len(samples)), smooth)), -32768, 32767).astype(np.int16)


def wave(data: bytes, tag: int, rate: int = RATE, block: int = 1, bits: int = 8, channels: int = 1) -> bytes:
    """A RIFF/WAVE file with this data chunk; samples of the channels alternate."""
    fmt = struct.pack("<HHIIHHH", tag, channels, rate, rate * block, block, bits, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wave_parts(media: bytes) -> tuple[int, int, int, bytes, int, int]:
    """Format tag, rate, block size, data, channels and bits of a RIFF/WAVE file; ValueError if it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, tag, rate, block, channels, bits = 12, 0, 0, 1, 1, 8
    while at + 8 <= len(media):
        kind, (n,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if kind == b"fmt ":
            tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data":
            return tag, rate, block, media[at + 8 : at + 8 + n], channels, bits
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def pcm_of(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of a WAVE file in mu-law, A-law, mono IMA ADPCM, or PCM of 8 or 16 bits; several channels are averaged.

    ValueError for any other file, and for one whose header makes no sense.
    """
    tag, rate, block, data, channels, bits = wave_parts(media)
    if rate < 1 or channels < 1:
        raise ValueError("a file has a rate and a channel")
    if tag in (MU_LAW, A_LAW) and bits == 8:
        samples = (MU if tag == MU_LAW else A)[np.frombuffer(data, np.uint8)]
    elif tag == IMA_ADPCM and channels == 1:
        samples = adpcm_decode(data, block)
    elif tag == PCM and bits == 16:
        samples = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int16)
    elif tag == PCM and bits == 8:
        samples = (np.frombuffer(data, np.uint8).astype(np.int16) - 128) << 8
    else:
        raise ValueError(f"format {tag} with {channels} channels of {bits} bits is not telephony audio")
    if channels > 1:
        samples = np.rint(samples[: len(samples) // channels * channels].reshape(-1, channels).mean(1)).astype(np.int16)
    return samples, rate


def stored_pcm(media: DataFrame, column: str = "media", to: int = WIDE) -> DataFrame:
    """All columns of media, and pcm in place of one of that name: little-endian 16-bit samples at `to` Hz of a telephony WAVE file.

    pcm is null where the column is null or holds no such file.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for m in b.column(column):
                try:
                    samples, rate = pcm_of(m.as_py())
                    out.append(resampled(samples, rate, to).astype("<i2").tobytes())
                except (ValueError, TypeError, struct.error):
                    out.append(None)
            kept = [c for c in b.schema.names if c != "pcm"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out, pa.binary())], names=[*kept, "pcm"])

    return media.mapInArrow(decode, StructType([f for f in media.schema.fields if f.name != "pcm"]).add("pcm", "binary"))


def features(payload: np.ndarray) -> str:
    """Of the expanded samples: count, sum, sum of squares, least, most, sign changes, and the energy of the same at 4 kHz."""
    pcm = MU[payload]
    wide, half = pcm.astype(np.int64), resampled(pcm, RATE, RATE // 2).astype(np.int64)
    signs = int(np.count_nonzero(np.diff(pcm < 0)))
    return f"n={len(pcm)};sum={wide.sum()};sq={(wide * wide).sum()};min={pcm.min()};max={pcm.max()};zc={signs};half={(half * half).sum()}"


MEDIA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pcm_sha256 string, alaw_sha256 string, adpcm_sha256 string"
ADPCM_BLOCK = 64


def text_media(docs: DataFrame, pad: int = 64, with_media: bool = False) -> DataFrame:
    """Store every text as mu-law audio and describe what is read back.

    The UTF-8 bytes (null: none), padded with 0 to a positive multiple of `pad`, become the 8-bit samples of a WAVE file
    without loss; digests and features come from the samples parsed out of that file. One row for every row, nulls and
    repeated ids included; equal texts give equal values. pcm_sha256 is the digest of the expanded samples, stored as 16-bit PCM at 16 kHz;
    alaw_sha256 and adpcm_sha256 are those of the same payload read as A-law, and as IMA ADPCM blocks of 64 bytes. with_media adds the file itself.
    """
    schema = MEDIA + (", media binary" if with_media else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def stored(samples: np.ndarray) -> str:
        return hashlib.sha256(pcm_of(wave(resampled(samples, RATE, WIDE).astype("<i2").tobytes(), PCM, WIDE, 2, 16))[0].astype("<i2").tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, most=BYTES)):
            backs, rows = [], []
            for t in pc.fill_null(b.column("text"), ""):
                raw = t.as_py().encode()
                media = wave(raw.ljust(max(1, -(-len(raw) // pad)) * pad, b"\0"), MU_LAW)
                back = wave_parts(media)[3]
                backs.append(back)
                own = np.frombuffer(back, np.uint8)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(own), stored(MU[own]), stored(A[own]), media))
            filled = [x.ljust(-(-len(x) // ADPCM_BLOCK) * ADPCM_BLOCK, b"\0") for x in backs]
            blocks = adpcm_decode(b"".join(filled), ADPCM_BLOCK).astype("<i2")
            ends = np.cumsum([len(x) // ADPCM_BLOCK * (1 + 2 * (ADPCM_BLOCK - 4)) for x in filled])
            coded = [hashlib.sha256(blocks[e - len(x) // ADPCM_BLOCK * (1 + 2 * (ADPCM_BLOCK - 4)) : e].tobytes()).hexdigest() for x, e in zip(filled, ends.tolist(), strict=True)]
            values = [[r[i] for r in rows] for i in range(9)] + [coded] + ([[r[9] for r in rows]] if with_media else [])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(v, k) for v, k in zip(values, kinds, strict=False)]], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
