import numpy as np

from cuemill.llm import quality
from cuemill.llm.common import utf8


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    good_words = "the of and to in ba ke lomi tursen gramiba losen kelo misen".split()
    out = []
    for i in range(n):
        words = [str(rng.choice(good_words)) for _ in range(rng.integers(30, 120))]
        kind = rng.integers(0, 8)
        text = " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words)).capitalize()
        if kind == 0:
            text = " ".join(w + "$$$" for w in words)
        elif kind == 1:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 2:
            text = " ".join(w for w in words[:6] for _ in range(15))
        out.append((i, text, int(kind > 2)))
    return out


def slow_em(code, count, rounds):
    """The same estimation, one document at a time."""
    k = len(quality.LABELLERS)
    docs = [[c // 3**j % 3 for j in range(k)] for c, n in zip(code, count) for _ in range(n)]
    table = [[[0.1, 0.3, 0.6], [0.1, 0.005, 0.895]] for _ in range(k)]
    good = 0.8
    for _ in range(rounds):
        post = []
        for d in docs:
            a, b = good, 1 - good
            for j, v in enumerate(d):
                a, b = a * table[j][1][v], b * table[j][0][v]
            post.append(a / (a + b))
        new = [[[1.0] * 3 for _ in (0, 1)] for _ in range(k)]
        for d, p in zip(docs, post):
            for j, v in enumerate(d):
                new[j][1][v] += p
                new[j][0][v] += 1 - p
        table = [[[x / sum(row) for x in row] for row in t] for t in new]
        good = min(0.99, max(0.01, sum(post) / len(post)))
    return good, np.array(table)


def test_em_matches_brute_force():
    texts = utf8([t for _, t, _ in corpus(120)])
    code, count = np.unique(quality.votes(texts), return_counts=True)
    good, table = slow_em(code.tolist(), count.tolist(), 5)
    got = quality.estimate(code, count, rounds=5)
    assert abs(got.good - good) < 1e-9 and np.allclose(got.table, table)


def test_figures_do_not_depend_on_neighbours():
    texts = utf8([t for _, t, _ in corpus(40)] + ["", None, "a a a", "x\nx\nx"])
    assert np.allclose(quality.figures(texts), np.concatenate([quality.figures([t]) for t in texts]), equal_nan=True)


def test_scores_agree_with_truth(spark):
    docs = corpus(700, 1)
    table = spark.createDataFrame([(d, t, "x") for d, t, _ in docs], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in quality.score_quality(table).collect()}
    assert sum(got[d].kept == bool(y) for d, _, y in docs) >= 0.97 * len(docs)
    assert all(got[d].kept for d, _, y in docs if y)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "word " * 60_000), (3, "word"), (4, "x" * 3_000_000)]
    got = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    assert quality.score_quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0
