"""The chain's log is what its stages noted, not the stages run again; loops by one order of the tokens."""

import random

from pyspark.sql import functions as F

from cuemill.operators import canonical as C
from cuemill.operators import sequence as W

SCHEMA = "video_id long, seg_idx long, segment_id string, start_ms long, end_ms long, text string, profile string"


def test_log_is_read_from_settled_tables(spark):
    texts = ["we said we said", "this is the N A S A rule.", "rule.", "then go ，", "百分之五 and more. Then he left. So did we", " "]
    rows = [(v, i, f"{v}-{i}", i * 3000, i * 3000 + 2900, t, ["En", "Zh", "Auto"][v % 3]) for v in range(6) for i, t in enumerate(texts)]
    seg = spark.createDataFrame(rows, SCHEMA)
    tokens = spark.createDataFrame([(v, 0, p, "we", p * 100, p * 100 + 90, 0.9) for v in range(6) for p in range(5)], "video_id long, seg_idx long, pos long, token string, start_ms long, end_ms long, confidence double")
    known = {
        "tokens": tokens, "glossary": spark.createDataFrame([("left", "LEFT"), (" ", "_")], "alias string, canonical string"),
        "punctuation": seg.where("seg_idx = 3").select("video_id", "seg_idx", F.lit(4).alias("char_offset"), F.lit(0.9).alias("confidence")),
    }
    final, log = C.canonicalize_corpus(seg, known)
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and plan.count("Join ") <= 3
    seen = {(r.stage, r.operation, r.before, r.after) for r in log.collect()}
    assert any(a == "itn" and "百分之五" in x and "5%" in y for a, _, x, y in seen)
    assert {a for a, *_ in seen} >= {"boundary", "dedupe", "itn", "entity"} and ("dedupe", "remove_duplicate", "rule.", "") in seen
    assert all(t.strip() for (t,) in final.select("text").collect()) and final.where("video_id = 1").count() > 3


def test_loops_by_one_order(spark):
    rng = random.Random(4)
    rows = [(v, s, p, rng.choice(["a", "a", "a", "b", None]), 100 * p * rng.choice([1, 1, 9]), 100 * p + 90) for v in range(4) for s in range(60) for p in range(rng.randint(0, 30))]
    tok = spark.createDataFrame(rows, "video_id long, seg_idx long, pos long, token string, start_ms long, end_ms long")
    want = W.collapse_loops(tok).where("n > 1").select("video_id", "seg_idx", "token")
    got = W.token_loops(tok)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 20
    assert W.token_loops(tok)._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
