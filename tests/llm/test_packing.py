import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cuemill.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "Hello, it's the DOG's 2nd day — don't!", "naïve ÀÉÎ ß µ ª º ½²³ x\x85y\xa0z", "<|endoftext|> a <|x", "日本語 テスト", "éà",
    "''s 'S 'LL I'LL we'VE\t\n x''re", "\x00\x1f\x7f a\x0bb\x0cc", "İstanbul ǅ ﬁ", "🎉🎉 ok", "a" * 3000, "12345 1a2b", "soft\xadhyphen", "  lead and trail  ",
]


def test_word_tokenizer_equals_the_library():
    library, ours = Tokenizer.from_file(VOCABULARY), packing.WordTokenizer(VOCABULARY)
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aZé'sßtI 9½-\n\xa0<|>.ÿ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for text, got in zip(texts, ours.encode(texts), strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_word_tokenizer_forgets(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    library, ours = Tokenizer.from_file(VOCABULARY), packing.WordTokenizer(VOCABULARY)
    for _ in range(2):
        for text, got in zip(TEXTS * 9, ours.encode(TEXTS * 9), strict=True):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(ours.known) <= 5


def test_fullest_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 60)
        best = max(s for n in range(len(items) + 1) for c in combinations(items, n) if (s := sum(c)) <= room)
        counts = {k: items.count(k) for k in items}
        got = packing.fullest(counts, room)
        assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_bound(seed):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(5000):
        k = min(2048, int(rng.paretovariate(0.8) * 20))
        histogram[k] = histogram.get(k, 0) + 1
    rows, bins = packing.plan_bins(histogram)
    assert {k: sum(r[2] - r[1] for r in rows if r[0] == k) for k in histogram} == histogram
    assert bins <= -(-sum(k * n for k, n in histogram.items()) // 2048) + 1


def test_packs_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "y"), (50, None, "z"), (3, "again", ""), (60, "word " * 5000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    packed = packing.pack_documents(docs, VOCABULARY, keep_ids=True).cache()
    got = packed.collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids + [0]) for _, t, _ in rows)
    pieces = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault((r.doc_id, r.piece if r.doc_id == 60 or r.doc_id == 10 else -r.ids_crc32), []).append(r)
    assert sorted(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in got if r.doc_id != 60) == [w for w in want if len(w) <= 2048]
    long = sorted((r for r in got if r.doc_id == 60), key=lambda r: r.piece)
    assert [(r.start, r.length) for r in long] == [(0, 2048), (2048, 2048), (4096, 905)]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 2048
    assert len(bins) == -(-sum(r.length for r in got) // 2048)
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert whole == {k: sum(n for _, n in v) for k, v in bins.items()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, VOCABULARY).count() == 0
