import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.llm import lm_score, queries

ROWS = [(i, " ".join(np.random.default_rng(i).choice(["the", "of", "Ab", "cd", "ef", "gh", "é", f"rare{i}"], 30)), i % 3 == 0) for i in range(60)]
ROWS += [(100, None, True), (101, "", None), (102, "...", False), (None, "the of zz", None), (5, "of the", True), (103, "word the " * 200_000, False)]


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^0-9a-z\x80-\U0010ffff\s]+", (text or "").lower())


def brute(rows, background):
    """Losses of each document under models of all other documents, from plain counters; ``background`` says who is in that sample."""
    docs = [(d, tokens(t), (not y and background(d), bool(y))) for d, t, y in rows]

    def counted(some):
        word, pair, first = Counter(), Counter(), Counter()
        for ws in some:
            word.update(ws)
            pair.update(zip(["<s>", *ws], ws))
            first.update(["<s>", *ws] if ws else [])  # the last word is followed by the end
        return word, pair, first

    whole = [counted([ws for _, ws, y in docs if y[k]]) for k in (0, 1)]
    distinct, out = len({w for _, ws, _ in docs for w in ws}), []
    less = lambda x: max(x - lm_score.DISCOUNT, 0)
    for d, ws, y in docs:
        own, loss = counted([ws]), [0.0, 0.0]
        for k in (0, 1):
            mine = int(y[k])
            word, pair, first = whole[k]
            size = sum(word.values()) - mine * len(ws)
            for v, w in zip(["<s>", *ws], ws):
                single = (1 - lm_score.UNSEEN) * less(word[w] - mine * own[0][w]) / size + lm_score.UNSEEN / distinct if size else 1 / distinct
                context = first[v] - mine * own[2][v]
                known = context > lm_score.DISCOUNT
                given = less(pair[v, w] - mine * own[1][v, w]) / context if known else 0
                loss[k] -= math.log(lm_score.WEIGHT * given + (1 - lm_score.WEIGHT if known else 1) * single)
        n = max(1, len(ws))
        out.append((d, len(ws), loss[1] / n, loss[0] / n))
    return out


@pytest.mark.parametrize("chunk", [1 << 21, 200])
def test_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", chunk)
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in ROWS], "doc_id long, text string, good boolean, score string, place long, rest string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.target_loss, r.background_loss) for r in lm_score.score_documents(docs, F.col("good")).collect())
    weight = [sum(len((t or "").encode()) for _, t, y in ROWS if bool(y) == k) for k in (False, True)]
    flag = spark.createDataFrame(list({(d,) for d, *_ in ROWS}), "id long").select("id", lm_score.sampled("id", min(1, weight[1] / weight[0])))
    sample = {r[0]: r[1] for r in flag.collect()}
    want = sorted((str(a), *b) for a, *b in brute(ROWS, sample.get))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-6)


def test_every_word_counts(spark):
    """A word of few documents tells target from background, whatever the number of words in the corpus."""
    rng = np.random.default_rng(3)
    text = lambda: " ".join(rng.choice([f"w{k}" for k in range(20_000)], 200))
    rows = [(i, text() + (" rarity" if i < 8 else " seldom" if i < 60 else ""), i < 8 or i > 60) for i in range(100)]
    rows += [(200 + i, f"{t} {word}", False) for i, t in enumerate([text()] * 2) for word in [("rarity", "seldom")[i]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    score = {r.doc_id: r.score for r in lm_score.score_documents(docs, F.col("good")).collect()}
    assert score[200] < score[201]


def test_junk_is_not_like_the_target(spark):
    """Random words that neither corpus has say nothing; texts of the target's kind score below them."""
    rng = np.random.default_rng(4)
    kinds = [[f"{k}{i}" for i in range(300)] for k in ("t", "b")]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 200)), i % 2 == 0) for i in range(120)]
    rows += [(500 + i, " ".join(rng.choice(kinds[0], 200)), False) for i in range(10)]
    rows += [(600 + i, "".join(rng.choice(list("abcdefgh "), 900)), False) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    score = {r.doc_id: r.score for r in lm_score.score_documents(docs, F.col("good")).collect()}
    target, like, junk = ([score[i] for i in ids] for ids in (range(0, 120, 2), range(500, 510), range(600, 610)))
    assert max(target) < min(junk) and max(like) < min(junk) and max(map(abs, junk)) < 0.5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_query_tells_good_from_bad(spark):
    """The chance that a document labelled good scores better than one labelled bad."""
    score = {r.doc_id: r.score for r in queries.op5_lm_scoring(spark, "/root/testdata/sf0.01").collect()}
    labels = [(r.quality, score[r.doc_id]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    good, bad = (np.array([x for q, x in labels if q == k]) for k in (1, 0))
    assert (good[:, None] < bad[None, :]).mean() >= 0.95


def test_text_identifiers_and_empty(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "x y")], "doc_id string, text string")
    assert {r.doc_id: r.n_words for r in lm_score.score_documents(docs, F.col("doc_id") == "a").collect()} == {"a": 2, "b": 2}
    docs = spark.createDataFrame([], "doc_id long, text string, good boolean")
    assert lm_score.score_documents(docs, F.col("good")).count() == 0
