import random
import zlib

import numpy as np
import pytest

from cuemill.llm import langid

SYLLABLES = {"aa": "ka mo ri tu ne sa", "bb": "strom glent pfack droth blusk", "cc": "воз дух пра мир сло"}


def prose(rng, lang, words):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(words)).capitalize() + "."


def corpus(rng, n):
    langs = ["aa"] * 4 + ["bb"] * 2 + ["cc"]
    return [(i, prose(rng, lang, rng.randint(3, 60)), lang, "x") for i in range(n) for lang in [langs[i % 7]]]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_documents(spark):
    rows = corpus(random.Random(2), 400)
    # labels of held-out rows are wrong: they must not be learnt
    docs = spark.createDataFrame([(i, t, "zz" if held(i) else lang, s) for i, t, lang, s in rows], "doc_id long, text string, lang string, row string")
    found = {r.doc_id: r for r in langid.identify(docs.repartition(5)).collect()}
    assert len(found) == 400 and {r.lang_pred for r in found.values()} == {"aa", "bb", "cc"}
    assert all(found[i].held_out == held(i) for i, *_ in rows)
    own = [i for i, *_ in rows if held(i)]
    assert np.mean([found[i].lang_pred == rows[i][2] for i in own]) >= 0.98
    assert all(0 <= r.score <= 1 and r.rejected == (r.score < langid.NARROW) for r in found.values())


def test_matches_one_document_at_a_time(spark):
    """The answers are those of whole texts encoded apart with the same dictionaries; long texts count to their end."""
    rng = random.Random(3)
    rows = corpus(rng, 120)
    rows += [(1000, prose(rng, "bb", 40) + " " + prose(rng, "aa", 9000), "aa", ""), (1001, "same", None, ""), (1002, "same", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.train(docs)
    assert model.languages == ["aa", "bb", "cc"] and all(0 < len(d) <= langid.DICTIONARY_BYTES for d in model.dictionaries)
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    compressors = model.compressors()
    for i, text, *_ in rows:
        data = langid.folded(text)
        total = {k: sum(len(c.compress(data[a : a + langid.PIECE_BYTES])) for a in range(0, len(data), langid.PIECE_BYTES)) for k, c in zip(model.languages, compressors, strict=True)}
        ranked = sorted(total.values())
        best = min(model.languages, key=total.get)
        assert found[i].lang_pred == best and abs(found[i].score - (1 - ranked[0] / ranked[1])) < 1e-12
    assert found[1000].lang_pred == "aa" and found[1001][2:] == found[1002][2:]


@pytest.mark.parametrize("text", [None, "", " \n", "12 34 !?", "中", "é"])
def test_texts_without_letters(spark, text):
    docs = spark.createDataFrame([*corpus(random.Random(4), 60), (None, text, None, "x")], "doc_id long, text string, lang string, source string")
    r = langid.identify(docs).where("doc_id is null").first()
    assert (r.lang_pred != "und") == any(c.isalpha() for c in text or "") and r.held_out is False
    assert r.lang_pred != "und" or (r.score, r.rejected) == (0, True)


def test_nothing_learnt_and_empty(spark):
    docs = spark.createDataFrame([(1, "text", None, ""), (2, "text", None, "")], "doc_id long, text string, lang string, source string")
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.identify(docs).collect()} == {("und", 0.0, True)}
    assert langid.identify(docs.limit(0)).collect() == []


def test_hot_copies_count_once_in_the_sample(spark):
    """One text that most rows share is one entry of the sample; at most so many texts are taken."""
    rng = random.Random(6)
    rows = [(i, "one and the same text", "aa", "") for i in range(900)] + corpus(rng, 900)
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    by = {k: [r for r in got if r.lang == k] for k in SYLLABLES}
    assert all(len({r["rank"] for r in v}) == len(v) <= langid.SAMPLE_TEXTS for v in by.values()) and len(by["aa"]) == langid.SAMPLE_TEXTS
    assert sum(r.passage == "one and the same text" for r in got) <= 1
