"""The canonical chain: literal cases, a replay of the log, and the rendering check."""

import os
import re
from collections import Counter

import pytest

from cuemill.operators import canonical as C
from cuemill.plans import registry

DATA = "/root/testdata/sf0.001"
SEG = "video_id long, seg_idx long, segment_id string, start_ms long, end_ms long, text string, profile string"
TOK = "video_id long, seg_idx long, pos long, token string, start_ms long, end_ms long, confidence double"
#: video -> (profile, segments (start, end, text), texts that come out)
CASES = {
    1: ("Zh", [(0, 1200, "我们行驶了579点。八公里，达成率百分之八十二点六。")], ["我们行驶了579.8公里，达成率82.6%。"]),
    2: ("Zh", [(0, 5000, "第一句。第二句。")], ["第一句。", "第二句。"]),
    3: ("Zh", [(0, 300, "好的。"), (500, 900, "下一句。")], ["好的。", "下一句。"]),
    4: ("En", [(0, 200, "um"), (1000, 1400, "人工智能")], ["um", "人工智能"]),
    5: ("Zh", [(0, 700, "C O T C")], ["COTC"]),
    6: ("En", [(0, 800, "no no no!")], ["no no no!"]),
    7: ("En", [(0, 900, "Please"), (1000, 2000, "have some.")], ["Please have some."]),
    8: ("Zh", [(0, 9000, "第一句话到这里。第二句话到这里！第三句话到这里？")], ["第一句话到这里。", "第二句话到这里！", "第三句话到这里？"]),
    9: ("Zh", [(0, 1000, "很多上班族"), (1000, 2000, "足的一天。")], ["很多上班族的一天。"]),
    10: ("En", [(0, 2000, "She had no family and"), (2000, 2300, "起。"), (9000, 9900, "She went home.")], ["She had no family and no friends.", "She went home."]),
    11: ("En", [(0, 900, "She had no"), (900, 1800, "family and"), (1800, 2000, "起。"), (9000, 9900, "She went home.")], ["She had no family and no friends.", "She went home."]),
    12: ("En", [(0, 900, "We went to the park"), (800, 3000, "The Park, in Spring, was Nice (see https://A.org/B).")], ["We went to the park", "in Spring, was Nice (see https://A.org/B)."]),
    13: ("Zh", [(0, 900, "昨天我们去公园"), (800, 3000, "去公园，天气很好。我喜欢春天")], ["昨天我们去公园", "天气很好。", "我喜欢春天"]),
    14: ("En", [(0, 700, "go go go go go now, please.")], ["go now, please."]),
    15: ("En", [(0, 12_000, "HOW'S THE GAME PRETTY GOOD RIGHT I DON'T THINK IT'S FUN")], ["How's the game?", "Pretty good, right.", "I don't think it's fun."]),
    16: ("En", [(0, 900, "Mr. Gray left."), (1000, 1500, " "), (1600, 1700, None)], ["Mr. Gray left."]),
}


def tables(spark):
    rows = [(v, k, f"{v}-{k}", *s, profile) for v, (profile, segs, _) in CASES.items() for k, s in enumerate(segs)]
    bridges = [(9, "9-0", "9-1", None, "的一天。", False, 0.9), (10, "10-0", "10-1", "She had no family and no friends.", None, True, 0.8)]
    words = [(14, 0, k, w, k * 100, k * 100 + 80, 0.9) for k, w in enumerate("go go go go go now please".split())]
    words += [(2, 0, 0, "第一句", 0, 600, 0.9), (2, 0, 1, "第二句", 1900, 2500, 0.9)]
    return spark.createDataFrame(rows, SEG), {
        "bridge": spark.createDataFrame(bridges, "video_id long, left_segment_id string, right_segment_id string, left_text string, right_text string, drop_right boolean, confidence double"),
        "rewrite": spark.createDataFrame([(11, 0, ["11-0", "11-1", "11-2"], "She had no family and no friends.", "reheard", 0.85)], "video_id long, order int, target_segment_ids array<string>, replacement_text string, rule_id string, confidence double"),
        "surface": spark.createDataFrame([(15, 0, "How's the game? Pretty good, right. I don't think it's fun.", 0.88)], "video_id long, seg_idx long, observed string, confidence double"),
        "tokens": spark.createDataFrame(words, TOK),
        "confidence": spark.createDataFrame([(4, 0, 0.3), (4, 1, 0.3)], "video_id long, seg_idx long, avg_confidence double"),
        "glossary": spark.createDataFrame([("qqq", "x")], "alias string, canonical string"),
    }


def test_cases(spark):
    seg, known = tables(spark)
    final, log = C.canonicalize_corpus(seg, known)
    got = {}
    for r in final.orderBy("video_id", "seg_idx").collect():
        got.setdefault(r.video_id, []).append(r)
    assert {v: [r.text for r in some] for v, some in got.items()} == {v: want for v, (_, _, want) in CASES.items()}
    assert all([r.seg_idx for r in some] == list(range(len(some))) for some in got.values())
    assert [(r.segment_id, r.start_ms, r.end_ms) for r in got[2]] == [("2-0#s1", 0, 600), ("2-0#s2", 1900, 2500)] and got[7][0].segment_id == "7-0"
    rows = [(r.video_id, r.stage, r.operation, r.rule_id, r.confidence) for r in log.collect()]
    for want in [
        (1, "itn", "normalize_number", "spoken_percentage", 0.99), (2, "boundary", "split_boundary", "sentence_split_alignment_timeline", 0.9),
        (4, "integrity", "tag_anomaly", "filler_only_segment_preserved", 0.6), (4, "integrity", "tag_anomaly", "low_confidence_script_outlier", 0.75),
        (5, "entity", "stitch_acronym", "generic_spaced_acronym_3plus", 0.95), (7, "boundary", "merge_boundary", "short_gap_without_sentence_terminal", 0.88),
        (8, "boundary", "split_boundary", "sentence_split_strong_punctuation_estimated_time", 0.52), (9, "boundary", "cross_boundary_rewrite", "authoritative_bridge_right_rewrite", 0.9),
        (10, "boundary", "repair_boundary_fragment", "authoritative_bridge_drop_verified_boundary_fragment", 0.8), (11, "verification", "verification_correction", "reheard", 0.85),
        (12, "dedupe", "remove_duplicate", "adjacent_chunk_overlap", 0.99), (14, "dedupe", "remove_duplicate", "high_repetition_decode_loop", 0.98),
        (15, "surface_repair", "normalize_punctuation", "decoder_surface_retry_punctuation_projection", 0.88), (15, "typography", "normalize_casing", "decoder_surface_standard_casing", 0.97),
    ]:
        assert want in rows
    assert not any(r[0] in (3, 6, 16) for r in rows)
    assert C.unrendered(final).collect() == []
    assert C.unrendered(final.limit(1).selectExpr("*", "array('other') AS tokens")).first().error == "text_rendering"


def test_fidelity_keeps_words(spark):
    seg, known = tables(spark)
    final, log = C.canonicalize_corpus(seg.where("video_id in (1, 5, 9, 12)"), known, fidelity=True)
    texts = {(r.video_id, r.text) for r in final.collect()}
    assert {(5, "C O T C"), (12, "in Spring, was Nice (see https://A.org/B).")} <= texts and any(v == 1 and "百分之八十二点六" in t for v, t in texts)
    assert {r.stage for r in log.collect()} <= {"boundary", "dedupe", "typography", "semantic_boundary"}


def test_nothing(spark):
    final, log = C.canonicalize_corpus(spark.createDataFrame([(1, 0, "a", 0, 1, None, "En")], SEG))
    assert final.collect() == [] and log.collect() == []


def flat(text):
    return re.sub(r"\s+", " ", text or "").strip(" ")


def replayed(texts, log):
    """The texts of a video after the rows of its log, each of which must find what it says it changed."""
    live = Counter(texts)
    order = ["boundary/normalize_punctuation", "surface_repair", "dedupe/high", "boundary/split_boundary", "boundary/merge_boundary", "dedupe/adjacent", "itn", "entity/stitch", "entity/normalize", "semantic_boundary", "typography"]
    stage = lambda r: next(i for i, name in enumerate(order) if f"{r.stage}/{r.operation}".startswith(name) or f"{r.stage}/{r.rule_id}".startswith(name))
    for k in range(len(order)):
        todo = [r for r in log if r.operation != "tag_anomaly" and stage(r) == k]
        while todo:
            bar = todo[0].operation in ("split_boundary", "merge_boundary", "merge_semantic_boundary", "relocate_boundary")
            parts = lambda t: [flat(x) for x in (t.split(" | ") if bar else [t])]
            ready = next((r for r in todo if not Counter(parts(r.before)) - live), None)
            assert ready is not None, (order[k], todo[0])
            todo.remove(ready)
            live = live - Counter(parts(ready.before)) + Counter(x for x in parts(ready.after) if x)
    return live


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_t23_query_follows_from_its_log(spark):
    """Replaying the log over the raw texts gives the canonical ones; nothing changes, comes or goes without a row."""
    raw, final, log = {}, {}, {}
    for r in registry._canonical_input(spark, DATA)[0].collect():
        if flat(r.text):
            raw.setdefault(r.video_id, []).append(flat(r.text))
    for name, out in (("t23_canonical", final), ("t23_log", log)):
        for r in registry.QUERIES[name](spark, DATA).collect():
            out.setdefault(r.video_id, []).append(r)
    seen = Counter(r.operation for some in log.values() for r in some)
    assert all(seen[x] for x in ("normalize_punctuation", "split_boundary", "remove_duplicate", "stitch_acronym", "normalize_casing"))
    assert {r.rule_id for some in log.values() for r in some if r.operation == "remove_duplicate"} == {"adjacent_chunk_overlap", "high_repetition_decode_loop"}
    barred = {v for v, some in raw.items() if any("|" in t for t in some)}  # a bar in a text cannot be told from the log's
    assert len(barred) < 0.5 * len(raw)
    for v, texts in raw.items():
        if v not in barred:
            assert replayed(texts, log.get(v, [])) == Counter(flat(r.text) for r in final.get(v, [])), v
