import hashlib
import zlib

import numpy as np
import pytest

from cuemill.llm import audio


def slow_adpcm(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - diff if code & 8 else sample + diff))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(sample)
    return out


def test_tables_against_known_values():
    mu, a = audio.TABLES[audio.MU_LAW], audio.TABLES[audio.A_LAW]
    assert [int(mu[c]) for c in (0x00, 0x80, 0x7F, 0xFF, 0x0F, 0x8F)] == [-32124, 32124, 0, 0, -16764, 16764]
    assert [int(a[c]) for c in (0x55, 0xD5, 0x2A, 0xAA, 0x00, 0x80)] == [-8, 8, -32256, 32256, -5504, 5504]
    assert (np.diff(np.sort(mu.astype(int))) >= 0).all() and len(set(a.tolist())) == 256


def test_adpcm_across_blocks():
    blocks = np.random.default_rng(2).integers(0, 256, (50, 64), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]
    assert audio.decode_adpcm(blocks[:0]).shape == (0, 121)


@pytest.mark.parametrize("tag", audio.CODECS)
@pytest.mark.parametrize("n", [64, 128, 6400])
def test_wav_round_trip(tag, n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert audio.read_wav(audio.write_wav(data, tag)) == (tag, data)


def test_resampling_keeps_a_tone_and_does_not_depend_on_segments():
    t = np.arange(4000)
    tone = (12000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    got = audio.resample_double(tone)
    want = 12000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
    assert np.abs(got[100:-100] - want[100:-100]).max() < 40
    long = np.random.default_rng(1).integers(-32768, 32768, (1 << 20) + 50).astype(np.int16)
    a, b = audio.resample_double(long), audio.resample_double(long[1000:])
    assert np.array_equal(a[2 * 1020 :], b[2 * 20 :])


def test_documents(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x" * 64, "c"), (4, "é" * 70_001, "d"), (None, "z", "e"), (3, "x" * 64, "f")] + [(10 + i, "t" * i, "") for i in range(1, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    stored = audio.store_audio(docs)
    got = audio.read_audio(stored, keep_pcm=True).collect()
    assert len(got) == len(rows) and {r.feature.split(":")[0] for r in got} == set(audio.CODECS.values())
    for r in got:
        text = next((t or "").encode() for d, t, _ in rows if d == r.doc_id)
        data = text + bytes(-len(text) % 64) or bytes(64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        pcm = np.frombuffer(r.pcm, "<i2")
        codec, samples, peak, *_ = r.feature.split(":")
        tag = {v: k for k, v in audio.CODECS.items()}[codec]
        one = audio.TABLES[tag][np.frombuffer(data, np.uint8)] if tag in audio.TABLES else sum((slow_adpcm(data[i : i + 64]) for i in range(0, len(data), 64)), [])
        assert pcm[::2].tolist() == list(one) and len(pcm) == int(samples) and int(peak) == np.abs(pcm.astype(int)).max()
        media = audio.write_wav(data, tag)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert audio.read_audio(audio.store_audio(empty)).count() == 0
