"""Telephony audio columns: G.711 mu-law and A-law, and IMA ADPCM in WAV, decoded to resampled 16-bit PCM.

Companded samples are expanded through lookup tables of 256 values. ADPCM depends on order inside a block only, so
blocks of many files are stacked and decoded together: one numpy step for each sample position, over all blocks.
PCM is resampled by a windowed-sinc filter in whole numbers, so equal input gives equal output on any machine.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import pin, small_batches, utf8

RATE = 8000
BLOCK = 64
#: WAV format tags.
A_LAW, MU_LAW, IMA_ADPCM = 6, 7, 17
CODECS = {A_LAW: "alaw", MU_LAW: "mulaw", IMA_ADPCM: "ima_adpcm"}

# Step sizes and index changes of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mu_law() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _a_law() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, mantissa = code >> 4 & 7, code & 15
    size = np.where(part == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: _mu_law(), A_LAW: _a_law()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks x 2 * (size - 4) + 1) of mono IMA ADPCM blocks (blocks x size bytes)."""
    n, size = blocks.shape
    out = np.empty((n, 2 * (size - 4) + 1), np.int16)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[:, 0] = sample
    for i in range(2 * (size - 4)):
        code = (blocks[:, 4 + i // 2] >> 4 * (i % 2)) & 15
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        sample = np.clip(np.where(code & 8, sample - change, sample + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, 88)
        out[:, i + 1] = sample
    return out


def write_wav(payload: bytes, tag: int) -> bytes:
    """A mono WAV file with the payload as its samples, 8 bits each, or as ADPCM blocks of 64 bytes."""
    adpcm = tag == IMA_ADPCM
    align, bits = (BLOCK, 4) if adpcm else (1, 8)
    per_block = 2 * (BLOCK - 4) + 1
    rate = RATE * BLOCK // per_block if adpcm else RATE
    extra = struct.pack("<HH", 2, per_block) if adpcm else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", tag, 1, RATE, rate, align, bits) + extra
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload) & 0xFFFFFFFF) + payload
    return b"RIFF" + struct.pack("<I", len(body) + 4 & 0xFFFFFFFF) + b"WAVE" + body


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Format tag and sample data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data" and tag is not None:
            return tag, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without format or data")


def decode(files: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """16-bit PCM at 8 kHz of many files; the ADPCM blocks of all of them are decoded side by side."""
    out: list = [None] * len(files)
    stacked, owners = [], []
    for i, (tag, data) in enumerate(files):
        if tag in TABLES:
            out[i] = TABLES[tag][np.frombuffer(data, np.uint8)]
        elif tag == IMA_ADPCM:
            stacked.append(np.frombuffer(data[: len(data) // BLOCK * BLOCK], np.uint8).reshape(-1, BLOCK))
            owners.append(i)
        else:
            raise ValueError(f"unknown format {tag}")
    if stacked:
        blocks = np.concatenate(stacked)
        pcm = np.concatenate([decode_adpcm(blocks[a : a + 16384]) for a in range(0, max(1, len(blocks)), 16384)])
        stop = np.cumsum([len(s) for s in stacked])
        for i, a, b in zip(owners, stop - [len(s) for s in stacked], stop, strict=True):
            out[i] = pcm[a:b].ravel()
    return out


#: Half of a symmetric interpolation filter at the half-sample, Hann-windowed sinc in 1/32768.
_HALF = 8
_TAPS = np.array([math.sin(math.pi * (k + 0.5)) / (math.pi * (k + 0.5)) * (0.5 + 0.5 * math.cos(math.pi * (k + 0.5) / _HALF)) for k in range(_HALF)])
_TAPS = np.round(_TAPS * 16384 / _TAPS.sum()).astype(np.int64)
_TAPS[0] += 16384 - _TAPS.sum()


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate: the samples, and between them sums over eight neighbours on either side."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    for at in range(0, len(pcm), 1 << 20):
        n = min(1 << 20, len(pcm) - at)
        lo, hi = at - _HALF + 1, at + n + _HALF
        x = np.zeros(n + 2 * _HALF - 1, np.int64)
        a, b = max(lo, 0), min(hi, len(pcm))
        x[a - lo : b - lo] = pcm[a:b]
        total = np.full(n, 16384, np.int64)
        for k in range(_HALF):
            total += _TAPS[k] * (x[_HALF - 1 - k : _HALF - 1 - k + n] + x[_HALF + k : _HALF + k + n])
        out[2 * at + 1 : 2 * (at + n) : 2] = np.clip(total >> 15, -32768, 32767)
    return out


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, root mean square, sign changes and checksum of resampled PCM."""
    total = sum(int((pcm[a : a + (1 << 20)].astype(np.int64) ** 2).sum()) for a in range(0, len(pcm), 1 << 20))
    peak = int(np.abs(pcm.astype(np.int32)).max()) if len(pcm) else 0
    turns = int(np.count_nonzero(np.diff(pcm < 0)))
    rms = math.isqrt(total // max(1, len(pcm)))
    return f"{codec}:{len(pcm)}:{peak}:{rms}:{turns}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def payload(text: bytes) -> bytes:
    """The bytes, padded with zeros to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's bytes as the samples of a WAV file, written to shared storage.

    The checksum of the payload chooses among the three formats, so equal texts make equal files. A null text counts as
    empty and makes one block of zeros. Rows with equal or null identifiers make a file each.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(source.dtypes)["_id"]
    tags = list(CODECS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("_text").to_pylist())
            files = [write_wav(p, tags[zlib.crc32(p) % 3]) for p in map(payload, texts)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_id"), sizes, pa.array(files, pa.binary())], names=["_id", "n_bytes", "media"])

    with small_batches(docs.sparkSession, 128):
        stored = pin(source.mapInArrow(run, f"_id {kind}, n_bytes long, media binary"))
    return stored.withColumnRenamed("_id", id_col)


def read_audio(stored: DataFrame, keep_pcm: bool = False) -> DataFrame:
    """The stored rows without ``media``, with payload figures, the feature string and, if asked for, ``pcm``.

    ``pcm`` is little-endian 16-bit PCM at 16 kHz. Columns beside ``media`` are passed on. An empty table gives an
    empty table.
    """
    others = [c for c in stored.columns if c != "media"]
    source = stored.select(F.struct(*others).alias("row"), "media")
    kinds = ["long", "string", "long", "long", "string", "string"] + ["binary"] * keep_pcm
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"][: len(kinds)]
    schema = f"row {source.schema['row'].dataType.simpleString()}, " + ", ".join(map(" ".join, zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = b.column("media").to_pylist()
            files = [read_wav(m) for m in media]
            pcm = [resample_double(x) for x in decode(files)]
            arrays = [
                b.column("row"), pa.array([len(d) for _, d in files], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for _, d in files], pa.string()),
                pa.array([zlib.crc32(d[-BLOCK:]) for _, d in files], pa.int64()), pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                pa.array([feature(CODECS[t], x) for (t, _), x in zip(files, pcm, strict=True)], pa.string()),
            ]
            if keep_pcm:
                arrays.append(pa.array([x.astype("<i2").tobytes() for x in pcm], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *names])

    with small_batches(stored.sparkSession, 128):
        out = pin(source.mapInArrow(run, schema))
    return out.select("row.*", *names)
