"""Evidence in list order, cut overlaps that keep the text, and the clause table, against plain replays."""

import random

import pytest
from pyspark.sql import functions as F

from cuemill.operators import clauses, edits, sequence


def plain_rewrites(segs, rewrites):
    live, log = [list(s) for s in segs], []
    for _, targets, text, rule, sure in rewrites:
        places = sorted(next((k for k, s in enumerate(live) if s[1] == t), -1) for t in targets)
        if not targets or -1 in places or any(b != a + 1 for a, b in zip(places, places[1:])):
            continue
        text, part = (text or "").strip(), live[places[0] : places[-1] + 1]
        if not text and len(live) <= len(targets):
            continue
        before = " ".join(s[4].strip() for s in part if s[4].strip())
        log.append((part[0][0], before, text, rule, sure))
        live[places[0] : places[-1] + 1] = [[part[0][0], part[0][1], part[0][2], part[-1][3], text]] if text else []
    return live, log


def plain_bridges(segs, bridges):
    live, log = [list(s) for s in segs], []
    for _, left, right, one, two, drop, sure in bridges:
        found = [next((s for s in live if s[1] == t), None) for t in (left, right)]
        if None in found or left == right:
            continue
        kind = "_boundary_fragment" if drop else ""
        for s, text, rule in zip(found, (one, two), (f"authoritative_bridge{kind}_left_rewrite", "authoritative_bridge_right_rewrite")):
            if text and text.strip() and text != s[4]:
                log.append((s[0], s[4], text.strip(), rule, sure))
                s[4] = text.strip()
        if drop:
            live.remove(found[1])
            log.append((found[1][0], found[1][4], "", "authoritative_bridge_drop_verified_boundary_fragment", sure))
    return live, log


SEG = "video_id long, seg_idx long, segment_id string, start_ms long, end_ms long, text string, s string"


def videos(rng, n):
    return {v: [(k, f"s{k}", k * 100, k * 100 + 90, f" text {v} {k} ") for k in range(rng.randint(1, 7))] for v in range(n)}


def check(spark, data, frame, run, plain, edits_of):
    rows = [(v, *s, "z") for v, segs in data.items() for s in segs]
    kept, log = run(spark.createDataFrame(rows, SEG), frame)
    want = {v: plain(segs, edits_of.get(v, [])) for v, segs in data.items()}
    assert sorted((r.video_id, r.seg_idx, r.segment_id, r.start_ms, r.end_ms, r.text) for r in kept.collect()) == sorted((v, *s) for v, (live, _) in want.items() for s in live)
    assert sorted((r.video_id, r.seg_idx, r.before, r.after, r.rule_id, r.confidence) for r in log.collect()) == sorted((v, *x) for v, (_, made) in want.items() for x in made)
    return want


def test_j13_rewrites_in_order(spark):
    """Overlapping, repeated, missing and empty targets; each rewrite sees what those before it left."""
    rng = random.Random(1)
    data, of = videos(rng, 40), {}
    for v in list(data)[:34]:
        of[v] = []
        for order in range(rng.randint(1, 6)):
            first = rng.randint(0, 6)
            targets = [f"s{k}" for k in range(first, first + rng.randint(1, 3))]
            targets += [targets[0]] * (rng.random() < 0.1)
            rng.shuffle(targets)
            of[v].append((order, targets, rng.choice(["", None, f" new {order} ", f"again {order}"]), f"rule {order}", order / 10))
    rows = [(v, *e) for v, some in of.items() for e in some]
    frame = spark.createDataFrame(rows, "video_id long, order int, target_segment_ids array<string>, replacement_text string, rule_id string, confidence double")
    want = check(spark, data, frame, edits.rewritten, plain_rewrites, of)
    assert sum(len(log) for _, log in want.values()) > 30
    data, of = {0: [(0, "s0", 0, 1, "a"), (1, "s1", 1, 2, "b")]}, {0: [(0, ["s0", "s1"], "ab", "x", 0.5), (1, ["s1"], "back", "x", 0.5)]}
    frame = spark.createDataFrame([(0, *e) for e in of[0]], frame.schema)
    assert check(spark, data, frame, edits.rewritten, plain_rewrites, of)[0][0] == [[0, "s0", 0, 2, "ab"]]


def test_j14_bridges_in_order(spark):
    """Several bridges a segment, each on the text that the one before left, and dropped segments."""
    rng = random.Random(2)
    data, of = videos(rng, 40), {}
    for v in list(data)[:34]:
        of[v] = []
        for order in range(rng.randint(1, 5)):
            k = rng.randint(0, 5)
            texts = [rng.choice([None, " ", f"t{rng.randint(0, 2)}", f" text {v} {x} "]) for x in (k, k + 1)]
            of[v].append((order, f"s{k}", f"s{k + rng.choice([0, 1, 1, 1])}", *texts, rng.random() < 0.3, order / 10))
    rows = [(v, *e) for v, some in of.items() for e in some]
    frame = spark.createDataFrame(rows, "video_id long, order int, left_segment_id string, right_segment_id string, left_text string, right_text string, drop_right boolean, confidence double")
    want = check(spark, data, frame, edits.bridged, plain_bridges, of)
    assert sum(len(log) for _, log in want.values()) > 30


def test_no_evidence(spark):
    seg = spark.createDataFrame([(1, 0, "a", 0, 1, "x", "z")], SEG)
    frame = spark.createDataFrame([], "video_id long, order int, target_segment_ids array<string>, replacement_text string")
    kept, log = edits.rewritten(seg, frame)
    assert [tuple(r) for r in kept.collect()] == [(1, 0, "a", 0, 1, "x", "z")] and log.collect() == []


@pytest.mark.parametrize(
    ("left", "right", "rest"),
    [
        ("We went to the park", "The Park, in Spring, was Nice (see https://A.org/B).", "in Spring, was Nice (see https://A.org/B)."),
        ("昨天我们去公园", "去公园，天气很好。我喜欢春天", "天气很好。我喜欢春天"),
        ("It cost 3.50 EUR", "3.50 EUR; that is ＡＢＣ too much", "that is ＡＢＣ too much"),
        ("one two", "Two", "Two"), ("and four", "Four.", ""), ("nothing here", " Other Words. ", " Other Words. "), ("", "x", "x"), ("the_end", "the_end_of it", "the_end_of it"),
    ],
)
def test_w13_keeps_the_text(spark, left, right, rest):
    seg = spark.createDataFrame([(1, 0, 0, 900, left), (1, 1, 1000, 2000, right)], "video_id long, seg_idx long, start_ms long, end_ms long, text string")
    assert sequence.dedupe_overlap(seg).where("seg_idx = 1").first().rest == rest


def sentences(rng):
    words = [w for r in (clauses.UNFINISHED, clauses.FORWARD, clauses.COORDINATORS, clauses.SUBJECTS, clauses.RELATIVES, clauses.DETERMINERS, clauses.LINKING, clauses.PREDICATES) for w in r]
    words += "Instead of the last time just then yet despite walked Stingy shop, dog 3 1,000 don't 'quoted' bed red".split()
    some = [rng.choice(words) for _ in range(rng.randint(0, 12))]
    return " ".join(w.capitalize() if rng.random() < 0.2 else w for w in some) + rng.choice([".", ".", "?", "!", "...", "", '."', "?)"])


def test_w25_table_means_the_same_to_columns(spark):
    """The expressions that choose videos and the review itself read the same traits."""
    rng = random.Random(3)
    texts = list({sentences(rng) for _ in range(1500)})
    names = sorted({r.trait for r in clauses.RULES} | {"asks"})
    has = clauses._has(F.col("text"))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", *(has(n).alias(n) for n in names)).collect()
    seen = set()
    for r in rows:
        found = {n for n in names if r[n]}
        assert found == clauses.traits(r.text)[0], r.text
        seen |= found
    assert seen == set(names)


def test_w24_positions_of_a_crowded_moment(spark):
    """A third of all items arrive at once; positions follow arrival, then item, and no range holds them all."""
    rows = [(k, 5000 if k % 3 == 0 else k * 7 % 9973) for k in range(3000)]
    new = spark.createDataFrame(rows, "item_id long, arrival long").repartition(6)
    got = {r.item_id: r.position for r in sequence.append_positions(new, spark.createDataFrame([(4,), (9,)], "position long")).collect()}
    assert got == {k: 10 + i for i, (_, k) in enumerate(sorted((a, k) for k, a in rows))}
    assert sequence.append_positions(new.limit(0), spark.createDataFrame([], "position long")).collect() == []
    assert [r.position for r in sequence.append_positions(new.limit(1), spark.createDataFrame([], "position long")).collect()] == [1]
