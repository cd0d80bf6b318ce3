"""Steps whose time or memory grew too fast, against plain Python, and how they are planned."""

from collections import Counter

import numpy as np

from cuemill.functions import align
from cuemill.operators import clauses as Z
from cuemill.operators import search as K
from cuemill.operators import segments as S
from cuemill.operators import verify as A
from tests.test_align import plain_alignment


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_repetition_counts_n_grams_without_folds_over_arrays(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "C", "d-e", "f'"], n)) for n in range(40)] + ["x y z " * 9, "one two three four five six", None]
    rows = spark.createDataFrame([(1, i, t, 0, 9000) for i, t in enumerate(texts)], "video_id long, seg_idx long, text string, start_ms long, end_ms long")
    out = S.surface_health(rows)
    assert "lambda" not in plan(out)
    for r in out.collect():
        units = (texts[r.seg_idx] or "").lower().split()
        top = {n: max(Counter(tuple(units[i : i + n]) for i in range(len(units) - n + 1)).values(), default=0) for n in (2, 3, 4)}
        best = max((min(c * n, len(units)) for n, c in top.items() if c >= 2 and len(units) >= 2 * n), default=0)
        want = round(best / len(units), 6) if len(units) >= 6 else 0.0
        assert (r.words, r.repetition) == ((len(units), want) if texts[r.seg_idx] is not None else (None, None))


def test_vector_topk_meets_in_blocks(spark):
    """Many copies, equal scores at the cut, other lengths, nulls; more than one block on either side."""
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(60, 8)).astype(np.float32)
    vectors = [(i, [float(x) for x in unit[i % 60 if i % 3 else 0]]) for i in range(400)]
    vectors += [(400, [1.0, 2.0]), (401, None), (402, [None] * 8), (403, [0.0] * 8), (404, []), (450, [3.0, 1.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    out = K.vector_topk(table.where("vec_id % 25 = 0"), table, 7, 50)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect())
    want = []
    for q, x in vectors:
        if q % 25 or x is None:
            continue
        scores = []
        for i, y in vectors:
            if y and len(y) == len(x) and None not in y:
                scores.append((-round(sum(np.float64(a) * np.float64(b) for a, b in zip(np.float32(x), np.float32(y), strict=True)), 6), i))
        want += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:7], 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-9)
    assert "explode" not in plan(out).lower()
    best = K.Best(np.arange(2), np.eye(2), 3)
    for n in range(20):
        best.add(np.arange(n * 10, n * 10 + 10), np.ones((10, 2)))
        assert len(best.row) == 6


def test_lexicon_deals_texts_not_words(spark):
    rows = spark.createDataFrame([(1, 2, "Ab cd AB"), (1, 0, "XX aB THE the"), (1, 1, "ALL CAPS"), (2, 5, "é Ab")], "video_id long, seg_idx long, text string")
    out = S.surface_lexicon(rows)
    assert sorted(map(tuple, out.collect())) == [(1, "ab", "aB"), (1, "cd", "cd"), (1, "the", "THE"), (1, "xx", "XX"), (2, "ab", "Ab")]
    physical = S.surface_lexicon(rows)._jdf.queryExecution().executedPlan().toString()
    assert physical.index("Generate") < physical.index("Exchange") and "HashAggregate" in physical


def test_words_of_the_corpus_do_not_meet_in_one_task(spark):
    chunks = spark.createDataFrame([(1, 0, "the cat the dog"), (1, 1, "the end"), (2, 0, "the the"), (3, 0, "")], "video_id long, chunk_idx long, text string")
    queries = spark.createDataFrame([(7, 1, "the Cat"), (8, 2, "the"), (9, 3, "the")], "query_id long, video_id long, query string")
    out = K.bm25_topk(queries, chunks)
    assert "LeftSemi" not in plan(out) and plan(out).count("explode(words") == 0
    n, length, mean = {"the": 3, "cat": 1}, {(1, 0): 4, (1, 1): 2, (2, 0): 2}, 8 / 3
    part = lambda w, tf, at: max(np.log((3 - n[w] + 0.5) / (n[w] + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[at] / mean))
    want = {(7, 1, 0): part("the", 2, (1, 0)) + part("cat", 1, (1, 0)), (7, 1, 1): part("the", 1, (1, 1)), (8, 2, 0): part("the", 2, (2, 0))}
    assert {(r.query_id, r.video_id, r.chunk_idx): r.score for r in out.collect()} == {k: round(float(v), 6) for k, v in want.items()}


def test_clause_review_holds_few_videos_and_reads_lines_once(spark):
    rows = [(v, i, i * 10, i * 10 + 9, t, "Zh" if v % 3 == 0 else "En") for v in range(200) for i, t in enumerate(["It was cold because", "We left early.", "Then it rained.", None])]
    seg = spark.createDataFrame(rows, "video_id long, seg_idx long, start_ms long, end_ms long, text string, profile string")
    reviewed = plan(Z._reviewed(seg))
    assert "Join" not in reviewed and "RLIKE" not in reviewed and Z.VIDEOS < 1000
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out, log = Z.review_clauses(seg)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    want = []
    for v in range(200):
        kept, _ = Z.review([(i, a, z, t or "", p in Z.PROFILES) for w, i, a, z, t, p in rows if w == v])
        want += [(v, *x[:4]) for x in kept]
    assert sorted((r.video_id, r.seg_idx, r.start_ms, r.end_ms, r.text) for r in out.collect()) == sorted(want) and 100 < log.count() < 200


def test_alignment_looks_at_a_band_only(spark, monkeypatch):
    """Words heard with gaps and misspelt: few cells are worked out, the pairs are the plain ones; tasks are stated."""
    rng = np.random.default_rng(9)
    a = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(120)]
    b = [w + "x" * (k % 4 == 1) for k, w in enumerate(a) if k % 6 != 5]
    seen, count = align.edit_distances, []
    monkeypatch.setattr(align, "edit_distances", lambda x, y, pairs: count.append(len(pairs)) or seen(x, y, pairs))
    pairs = [(a, b), (b, a), (a, a[::-1]), (a[:7], b), (["x" * 70, "é" * 3], ["x" * 69 + "y", "éaé", ""]), (["a"], ["b"] * 40)]
    assert align.alignments(pairs[:1]) == [plain_alignment(a, b)] and sum(count) < len(a) * len(b) / 3
    assert align.alignments(pairs) == [plain_alignment(*p) for p in pairs]
    monkeypatch.setattr(align, "LETTERS", 1)
    assert align.alignments(pairs[:2]) == [plain_alignment(*p) for p in pairs[:2]]
    seg = spark.createDataFrame([(1, 0, "One two.", 0, 1000)], "video_id long, seg_idx long, text string, start_ms long, end_ms long")
    words = spark.createDataFrame([(1, 0, 0, "one", 0, 90), (1, 0, 1, "two", 80, 2000)], "video_id long, seg_idx long, at long, word string, start_ms long, end_ms long")
    assert A.align_words(seg, words)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
