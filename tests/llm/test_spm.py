import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cuemill.llm import spm

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "   ", "Hello  world\n a\tb  c ", "naïve Ünï ßtraße", "日本語のテキスト一二三", "🎉🎉 ok \x00\x01", "a" * 500, " " * 40 + "x" + " " * 17,
    "ﬁ Ａ１ ½", "aaaa bbbb abababababab", "<s> </s> <unk> <0x41>", "é", "x" * 300 + "日" * 300,
]


@pytest.fixture(scope="module")
def both():
    return spm.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_equal_the_library(both):
    ours, library = both
    rng = random.Random(3)
    words = ["the", "tion", "reation", "éaux", "schung", "ción", "Thedhain", "ing", "über", "123", "--", "日本", "$$$", "\n", "  "]
    texts = TEXTS + ["".join(rng.choice(words) + rng.choice(["", " ", "."]) for _ in range(60)) for _ in range(150)]
    texts += ["".join(rng.choice("abcdeéñ ▁.\n日") for _ in range(80)) for _ in range(150)]
    for text in texts:
        assert ours.encode(text).tolist() == library.encode(text), text


def test_stream_in_any_portions(both):
    """Portions do not matter, and a stream holds a bounded window where paths meet."""
    ours, library = both
    rng = random.Random(4)
    text = spm.MARK + "thedhain" * 50 + spm.MARK + "日本語の" * 30 + "abababab" * 20
    want = library.encode(text[1:])
    for _ in range(5):
        stream, got, at, held = ours.stream(), [], 0, 0
        while at < len(text):
            n = rng.randint(1, 90)
            got += stream.feed(text[at : at + n])
            at, held = at + n, max(held, len(stream.text))
        assert got + stream.end() == want and held < 200


def plain_merges(ours, library, text):
    """Best piece first, leftmost among equals, everything looked at anew after each merge."""
    parts = list(text)
    while True:
        found = [(library.get_score(ours.ids[x + y]), -k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ours.ids]
        if not found:
            return parts
        k = -max(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_merging_is_the_brute_force(both):
    ours, library = both
    rng = random.Random(5)
    words = ["▁thedhain", "▁ation", "schung", "ab", "aaaaaaa", "x", ""] + ["".join(rng.choice("etaoinshrdlu▁é") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    for word in words:
        assert ours.merged(word) == plain_merges(ours, library, word), word


def test_whole_stretches_and_streams_agree(both):
    """The furthest position first or all positions in order: the ids are the same."""
    ours, _ = both
    rng = random.Random(6)
    for _ in range(300):
        stretch = "▁" + "".join(rng.choice("etaoinshrdlu.,\n日") for _ in range(rng.randint(0, 2 * ours.longest - 1)))
        stream = ours.stream()
        assert ours._whole(stretch) == stream.feed(stretch) + stream.end(), stretch


def test_documents(spark, both):
    _, library = both
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "z", ""), (3, None, ""), (3, "word " * 20_000, ""), (90, "a▁b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = spm.encode_documents(docs, MODEL)
    got = [np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()]
    assert sorted(got) == sorted(library.encode(t or "") for _, t, _ in rows)
    texts = sorted(r.text for r in spm.decode_documents(encoded, MODEL).collect())
    assert texts == sorted((t or "").replace("▁", " ") for _, t, _ in rows)
    figures = spm.round_trip(docs, MODEL).collect()
    assert [r.same for r in figures].count(False) == 1 and len(figures) == len(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spm.round_trip(empty, MODEL).count() == 0 and spm.decode_documents(spm.encode_documents(empty, MODEL), MODEL).count() == 0
