"""Alignment, bridges, pause repairs and the glossary against plain Python that looks at everything."""

import os
import random
import re
import time

import pytest

from cuemill.functions import align
from cuemill.operators import bridges, pauses, repair, verify
from cuemill.plans import registry, views

DATA = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(above + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def near(a, b):
    return 1 - distance(a, b) / max(len(a), len(b), 1)


def plain_alignment(a, b, gap=0.72):
    cost = {(i, 0): i * gap for i in range(len(a) + 1)} | {(0, j): j * gap for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (1 - near(a[i - 1], b[j - 1])), cost[i - 1, j] + gap, cost[i, j - 1] + gap)
    out, i, j = [], len(a), len(b)
    while i and j:
        if cost[i, j] == cost[i - 1, j - 1] + (1 - near(a[i - 1], b[j - 1])):
            i, j = i - 1, j - 1
            out.append((i, j, near(a[i], b[j])))
        elif cost[i, j] == cost[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def some_words(rng, n):
    return ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("block", [7, align.BLOCK])
@pytest.mark.parametrize("cells", [300, align.BATCH_CELLS])
def test_alignments_are_the_plain_ones(monkeypatch, block, cells):
    """In any batches, with moves kept or worked out again."""
    monkeypatch.setattr(align, "BLOCK", block)
    monkeypatch.setattr(align, "BATCH_CELLS", cells)
    rng = random.Random(block + cells)
    pairs = [(some_words(rng, rng.randint(0, 25)), some_words(rng, rng.randint(0, 25))) for _ in range(60)]
    pairs += [([], ["a"]), (["a"], []), (["same"] * 9, ["same"] * 9), (["hello", "big", "world"], ["hello", "worle"])]
    assert align.alignments(pairs) == [plain_alignment(a, b) for a, b in pairs]
    assert align.alignments([]) == []


def test_long_alignment_takes_little_time():
    rng = random.Random(1)
    a = [f"w{rng.randint(0, 900)}{rng.choice(['', 's', 'ing'])}" for _ in range(1500)]
    b = [x if rng.random() < 0.8 else rng.choice(a) for x in a]
    began = time.process_time()
    (found,) = align.alignments([(a, b)])
    assert time.process_time() - began < 2 and len(found) > 1400 and all(s == near(a[i], b[j]) for i, j, s in found)


def test_edit_distances():
    rng = random.Random(2)
    a, b = some_words(rng, 40) + [""], some_words(rng, 30) + [""]
    pairs = [(i, j) for i in range(len(a)) for j in range(len(b))]
    import numpy as np

    assert align.edit_distances(a, b, np.array(pairs)).tolist() == [distance(a[i], b[j]) for i, j in pairs]
    assert align.edit_distances(a, b, np.zeros((0, 2), np.int64)).tolist() == []


# --- bridges ---------------------------------------------------------------------------------------------------


def units(text):
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z']+|[^\W_]", text)]


def plain_bridge(left, right, bridge):
    """Every stretch of the sides at every place of the bridge; the best pair by the documented order."""
    a, b, c = units(left)[-96:], units(right)[:96], units(bridge)[:192]
    same = lambda x, i, j: 0 <= i < len(x) and 0 <= j < len(c) and x[i][0] == c[j][0]
    wide = lambda part: 5 if 2 * sum(bool(re.match("[一-鿿]", w)) for w, *_ in part) >= len(part) else 3

    def runs(x):
        for i in range(len(x)):
            for j in range(len(c)):
                if same(x, i, j) and not same(x, i - 1, j - 1):
                    n = 0
                    while same(x, i + n, j + n):
                        n += 1
                    yield i, j, n

    best = None
    for i, j, n in runs(a):
        if len(a) - i - n > 8 or n < wide(a[i : i + n]):
            continue
        for k, m, size in runs(b):
            for late in range(min(max(size - 3, 0), 6) + 1):
                part = b[k + late : k + size]
                need = min(wide(part), 3) if len(b) <= 6 and k + late <= 1 else wide(part)
                between = m + late - (j + n)
                if k + late > 6 or len(part) < need or not 0 <= between <= 48:
                    continue
                middle = bridge[c[j + n - 1][2] : c[m + late][1]].strip(" ")
                worth = 10 if middle[-1:] and middle[-1] in "。？！.?!" else 8 if middle[-1:] and middle[-1] in "，；：,;:" else 0
                rank = (n + len(part) + worth, -i, -j, -k, -m, -late)
                if best is None or rank > best[0]:
                    best = rank, a[i + n - 1][2], b[k + late][1], middle, n + len(part)
    if best is None:
        return left, right, 0
    _, cut, start, middle, matched = best
    head = left[:cut].rstrip(" ")
    blank = " " if re.search("[0-9A-Za-z]$", head) and re.match("[0-9A-Za-z]", middle) else ""
    new = (head + blank + middle).strip(" "), right[start:].lstrip(" \t\n.,?!:;，。？！：；、")
    return (*new, matched) if all(new) else (left, right, 0)


def test_w19_bridges(spark):
    rng = random.Random(3)
    words = ["aa", "Bb", "cc", "dd", "ee", "ff", "去", "公", "园", "x.", "y,", "z!", "it's"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [
        ("晚上可能我中了南墙才会回头吧，可能我见了黄河才会倒。", "死心吧，可能我偏要一条路走到黑吧，可能我还没遇见那个他吧。", "晚上可能我中了南墙才会回头吧，可能我见了黄河才会死心吧，可能我偏要一条路走到黑吧。"),
        ("很多上班族", "足的一天。", "很多上班族的一天。"), ("a b", "c d", "e f"), ("", "x", "y"), ("a b", "c d", "e f"),
    ]
    for _ in range(150):
        a, b = text(rng.randint(3, 130)), text(rng.randint(2, 110))
        over = " ".join(a.split()[-rng.randint(1, 12) :]) + rng.choice([" ", ". ", ", zz "]) + " ".join(b.split()[rng.randint(0, 3) : rng.randint(4, 12)])
        rows.append((a + rng.choice([" qq", ""]), rng.choice(["vv ", ""]) + b, over))
    frame = spark.createDataFrame([(*r, "k") for r in rows] + [(None, "x", None, "k")], "left string, right string, bridge string, _k0 string")
    got = bridges.bridge_rewrite(frame).collect()
    assert sorted((r.left or "", r.right, r.bridge or "", r.new_left, r.new_right, r.matched) for r in got) == sorted([(*r, *plain_bridge(*r)) for r in rows] + [("", "x", "", "", "x", 0)])
    by = {r.left: r for r in got}
    assert by[rows[0][0]].new_left.endswith("可能我见了黄河才会死心吧，") and by["很多上班族"].new_right == "的一天。" and sum(r.matched > 0 for r in got) > 50


def test_w19_moves_no_rows(spark):
    frame = spark.createDataFrame([("a b", "c d", "a b c d")], "left string, right string, bridge string")
    assert "Exchange" not in bridges.bridge_rewrite(frame)._jdf.queryExecution().executedPlan().toString()


def test_w19_query(spark):
    text = {(r.video_id, r.seg_idx): r.text for r in views.seg(spark, DATA).collect()}
    for r in registry.QUERIES["w19_bridges"](spark, DATA).collect():
        one, two = text[r.video_id, r.seg_idx], text[r.video_id, r.seg_idx + 1]
        assert (r.new_left, r.new_right, r.matched) == plain_bridge(one + " zq", "qz " + two, one + ". " + two)


# --- word times ------------------------------------------------------------------------------------------------


def test_t21_word_times(spark):
    """Each pair, time and similarity of the query is what the plain alignment of the segment gives."""
    known = {}
    for r in views.tok(spark, DATA).orderBy("video_id", "seg_idx", "pos").collect():
        if r.pos % 6 != 5:
            known.setdefault((r.video_id, r.seg_idx), []).append((r.token + "x" * (r.pos % 4 == 1), r.start_ms, r.end_ms))
    want = []
    for s in views.seg(spark, DATA).collect():
        own = [m for m in re.findall(r"[0-9A-Za-z']+", s.text) if m.strip("'")]
        timed = known.get((s.video_id, s.seg_idx), [])
        pairs = [p for p in plain_alignment([w.lower().strip("'") for w in own], [t[0] for t in timed]) if p[2] >= 0.5]
        last = s.start_ms
        for i, j, share in pairs if len(pairs) >= 2 and 2 * len(pairs) >= len(own) else []:
            start = max(min(max(timed[j][1], s.start_ms), s.end_ms), last)
            end = max(min(max(timed[j][2], timed[j][1], s.start_ms), s.end_ms), start)
            want.append((s.video_id, s.seg_idx, i, own[i], start, end, round(share, 6)))
            last = start
    got = [tuple(r) for r in registry.QUERIES["t21_word_times"](spark, DATA).collect()]
    assert sorted(got) == sorted(want) and len({g[6] for g in got}) > 3


# --- pause repairs ---------------------------------------------------------------------------------------------

STRONG = ".?!。？！"


def joined(segs):
    """(text, spans by segment) of a video."""
    text, spans = "", {}
    for idx, _, _, t in segs:
        t = re.sub(r"\s+", " ", t or "").strip(" ")
        if t:
            text += " " if text and re.search(r"[\x21-\x7E]$", text) and re.match("[0-9A-Za-z]", t) else ""
            spans[idx] = (len(text), len(text) + len(t))
            text += t
    return text, spans


def plain_windows(segs, pauses_):
    text, spans = joined(segs)
    out = []
    for a, b in pauses_:
        mid = (a + b) / 2
        flat = {s[0]: re.sub(r"[\s\"')\]】》]+$", "", s[3] or "") for s in segs}
        if not 200 <= b - a <= 3000 or any(abs(s[2] - mid) <= 450 and flat[s[0]][-1:] and flat[s[0]][-1] in STRONG for s in segs):
            continue
        hit = next((s for s in segs if s[0] in spans and s[1] <= mid <= s[2]), None)
        if hit is None:
            continue
        lo, hi = spans[hit[0]]
        at = int(lo + int((hi - lo) * min((mid - hit[1]) / max(hit[2] - hit[1], 50), 1) + 0.5))
        if not any(c in STRONG for c in text[max(at - 2, lo) : min(at + 3, hi)]):
            out.append(("pause", max(mid - 4500, 0), mid + 4500, a, b, mid, at, at))
    for s in segs:
        if s[0] in spans:
            lo, hi = spans[s[0]]
            if s[2] - s[1] >= 2800 and len(re.findall("[0-9A-Za-z']+", text[lo:hi])) >= 7 and hi > lo + 12:
                out.append(("scan", max(s[1] - 750, 0), s[2] + 750, None, None, None, lo, hi))
    return sorted(out, key=lambda w: (w[0], w[6], w[1]))


def hinted(hint, left, right):
    words = [(m[1].lower().strip("'"), any(c in STRONG for c in m[2])) for m in re.finditer(r"([0-9A-Za-z']*[0-9A-Za-z][0-9A-Za-z']*)([^0-9A-Za-z]*)", hint or "")]
    return any(x[1] and near(x[0], left) >= 0.72 and near(y[0], right) >= 0.72 for x, y in zip(words, words[1:]))


def clamp(x):
    return min(max(x, 0), 1)


def plain_repairs(segs, pauses_, heard, hints):
    """One video, window by window and pair by pair."""
    text, spans = joined(segs)
    own = [(m[0].lower().strip("'"), m.start(), m.end()) for m in re.finditer("[0-9A-Za-z']+", text) if m[0].strip("'")]
    found = []
    for number, (kind, _, _, g0, g1, mid, low, high) in enumerate(plain_windows(segs, pauses_)):
        timed = sorted(heard.get(number, []))
        if kind == "pause":
            first = next((k for k, w in enumerate(own) if w[2] >= low), len(own) - 1)
            lo, hi = max(first - 14, 0), min(first + 18, len(own))
        else:
            lo = max(next((k for k, w in enumerate(own) if w[2] > low), 0) - 2, 0)
            hi = min(max((k + 1 for k, w in enumerate(own) if w[1] < high), default=len(own)) + 2, len(own))
        if hi <= lo + 3 or len(timed) < 3:
            continue
        pairs = plain_alignment([w[0] for w in own[lo:hi]], [t[1].lower() for t in timed])
        best = None
        for at, ((i, j, s), (i1, j1, s1)) in enumerate(zip(pairs, pairs[1:]) if len(pairs) >= 5 else []):
            if i1 != i + 1 or j1 <= j or s < 0.6 or s1 < 0.6:
                continue
            offset = own[lo + i1][1]
            if any(c in STRONG for c in text[max(offset - 2, 0) : offset + 3]):
                continue
            gaps = sorted(g for x, y in zip(timed[max(j - 4, 0) : j1 + 5], timed[max(j - 4, 0) + 1 : j1 + 5]) if (g := max(y[2] - x[3], 0)) <= 1200)
            gap = max(timed[j1][2] - timed[j][3], 0) / 1000
            relative = gap * 1000 / (max(gaps[len(gaps) // 2], 30) if gaps else 60)
            t = (timed[j][3] + timed[j1][2]) / 2
            agrees = hinted(hints.get(number), own[lo + i][0], own[lo + i1][0])
            mark = next((k for k in range(offset, min(offset + 42, len(text))) if text[k] in STRONG), None)
            if mark is not None and not (re.search("[0-9A-Za-z]", text[mark + 1 :]) and 1 <= len(re.findall("[0-9A-Za-z']+", text[offset:mark])) <= 5):
                mark = None
            if kind == "scan":
                paused = any(b > a and abs((a + b) / 2 - t) <= 750 for a, b in pauses_)
                fits = (gap >= 0.42 and relative >= 2) or (gap >= 0.28 and relative >= 2.8 and (agrees or paused)) or (agrees and gap >= 0.22 and relative >= 2)
                sure = (s + s1) / 2 * 0.42 + clamp((gap - 0.18) / 0.72) * 0.25 + clamp((relative - 1.5) / 6) * 0.15 + 0.08 * paused + 0.10 * agrees
                fits, error, size, when = fits and mark is not None, 0, gap * 1000, t
            else:
                silence, error = (g1 - g0) / 1000, abs(t - mid)
                fits = error <= 650 and timed[j][3] <= g1 + 500 and timed[j1][2] >= g0 - 500
                fits = fits and (agrees or silence >= 0.52 or (silence >= 0.2 and gap >= 0.16 and relative >= 2.4))
                sure = (s + s1) / 2 * 0.40 + clamp((silence - 0.2) / 0.7) * 0.2 + clamp(1 - error / 650) * 0.22 + clamp(gap / 0.45) * 0.08 + 0.12 * agrees + clamp((relative - 1) / 4) * 0.1
                size, when = g1 - g0, mid
            rank = (round(min(sure, 1), 6), -error, -at)
            if fits and sure >= 0.58 and (best is None or rank > best[0]):
                best = rank, (offset, kind, when, size, min(sure, 1), mark, agrees, text[max(offset - 42, 0) : offset + 42])
        if best:
            found.append(best[1])
    out = []
    for r in sorted(found, key=lambda r: r[:4]):
        if not out or (abs(r[0] - out[-1][0]) > 2 and abs(r[2] - out[-1][2]) > 200):
            out.append(r)
    place = lambda p: next(((k, p - a) for k, (a, z) in spans.items() if a <= p <= z), None) if p is not None else (None, None)
    return [(*place(r[0]), *place(r[5]), r[2], r[3], round(r[4], 6), r[6], r[7], r[1]) for r in out]


def test_t22_query(spark):
    seg, timed, gaps, windows, hints = registry._paused(spark, DATA)
    grouped = {}
    for name, frame, columns in (("seg", seg, ["seg_idx", "start_ms", "end_ms", "text"]), ("gap", gaps, ["gap_start", "gap_end"]), ("timed", timed, ["window", "at", "word", "start_ms", "end_ms"]), ("hint", hints, ["window", "hint"]), ("win", windows, ["window", "kind", "low", "high"])):
        for r in frame.select("video_id", *columns).distinct().collect():
            grouped.setdefault(r[0], {}).setdefault(name, []).append(tuple(r)[1:])
    want, kinds = [], set()
    for video, t in grouped.items():
        segs, pauses_ = sorted(t.get("seg", [])), sorted(t.get("gap", []))
        assert [(w[0], w[6], w[7]) for w in plain_windows(segs, pauses_)] == [w[1:] for w in sorted(t.get("win", []))]
        heard = {}
        for w, *rest in t.get("timed", []):
            heard.setdefault(w, []).append(tuple(rest))
        rows = plain_repairs(segs, pauses_, heard, dict(t.get("hint", [])))
        kinds |= {r[-1] for r in rows}
        want += [(video, *r) for r in rows]
    got = [tuple(r) for r in registry.QUERIES["t22_pause_repairs"](spark, DATA).collect()]
    assert len(got) == len(want) > 20 and kinds == {"scan", "pause"}
    close = lambda r: (*r[:7], round(r[7], 5), *r[8:])
    assert sorted(map(close, map(tuple, got)), key=str) == sorted(map(close, want), key=str)
    assert sum(r[3] is not None for r in want) > 5


def one_video(spark, heard, gaps, text="Yet she refused to buy new ones every morning. Her breakfast consisted of rice.", segs=None):
    segs = segs or [(1, 0, 29_000, 33_700, text)]
    seg = spark.createDataFrame(segs, "video_id long, seg_idx long, start_ms long, end_ms long, text string")
    pauses_ = spark.createDataFrame(gaps, "video_id long, gap_start long, gap_end long")
    timed = spark.createDataFrame([(1, w, k, word, 29_000 + a, 29_000 + b) for w, words in heard.items() for k, (word, a, b) in enumerate(words)], "video_id long, window int, at int, word string, start_ms long, end_ms long")
    return seg, timed, pauses_


HEARD = [
    ("yet", 100, 280), ("she", 340, 480), ("refused", 540, 860), ("to", 920, 1020), ("buy", 1080, 1220), ("new", 1280, 1420), ("ones", 1480, 1680), ("every", 2300, 2500),
    ("morning", 2560, 2880), ("her", 2940, 3060), ("breakfast", 3120, 3440), ("consisted", 3500, 3820), ("of", 3880, 3980), ("rice", 4040, 4240),
]


def test_t22_moves_a_misplaced_mark(spark):
    """A scan without any pause of the detector finds the long gap before "every", where the mark after "morning" belongs."""
    seg, timed, none = one_video(spark, {0: HEARD}, [])
    (r,) = pauses.pause_repairs(seg, timed, none).collect()
    text = seg.first().text
    assert (r.kind, r.char_offset, r.remove_char_offset) == ("scan", text.index("every"), text.index(".")) and r.confidence >= 0.58
    evidence = repair.derive_evidence(pauses.pause_repairs(seg, timed, none, hints=spark.createDataFrame([(1, 0, "new ones. Every morning")], "video_id long, window int, hint string")), spark.createDataFrame([], "video_id long, seg_idx long, decision string, severe boolean, observed string"))
    fixed = repair.apply_punctuation(seg, evidence["punctuation"]).first().text
    assert fixed == "Yet she refused to buy new ones. every morning Her breakfast consisted of rice."


@pytest.mark.parametrize(("gap", "windows"), [((31_200, 31_820), 1), ((31_200, 31_480), 1), ((31_200, 31_390), 0), ((28_000, 31_820), 0)])
def test_t22_pause_windows(spark, gap, windows):
    seg, _, pauses_ = one_video(spark, {0: HEARD}, [(1, *gap)])
    assert pauses.pause_windows(seg, pauses_).where("kind = 'pause'").count() == windows


def test_t22_known_boundary_and_empty(spark):
    segs = [(1, 0, 29_000, 31_200, "Yet she refused to buy new ones."), (1, 1, 31_800, 33_700, "Every morning she counted her coins."), (1, 2, 40_000, 41_000, None)]
    seg, timed, pauses_ = one_video(spark, {}, [(1, 31_200, 31_820)], segs=segs)
    assert pauses.pause_windows(seg, pauses_).where("kind = 'pause'").count() == 0
    assert pauses.pause_repairs(seg, timed, pauses_).collect() == [] and pauses.pause_repairs(seg.limit(0), timed, pauses_).collect() == []


# --- glossary --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [repair.GLOSSARY_BYTES, 2000])
def test_t7_many_aliases(spark, shard):
    """Nested and overlapping aliases; the earliest, then the longest is replaced, also where the glossary comes in shards."""
    rng = random.Random(8)
    table = {"".join(rng.choice("abc é") for _ in range(rng.randint(1, 5))): f"<{k}>" for k in range(300)} | {"公园": "P", "ab.c": "dot"}
    texts = ["".join(rng.choice("abc é.公园") for _ in range(rng.randint(0, 60))) for _ in range(120)] + ["", None, "ab.c", "abxc"]
    pattern = re.compile("|".join(re.escape(a) for a in sorted(table, key=len, reverse=True)))
    glossary = spark.createDataFrame([*table.items(), ("", "x"), (None, "y"), ("ab.c", "eot")], "alias string, canonical string")
    seg = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "seg_idx long, text string, alias string")
    got = {r.seg_idx: (r.text, r.replaced) for r in repair.apply_glossary(seg, glossary, shard).collect()}
    assert got == {k: (None, 0) if t is None else pattern.subn(lambda m: table[m[0]], t) for k, t in enumerate(texts)}
    assert [r.replaced for r in repair.apply_glossary(seg, glossary.limit(0)).collect()] == [0] * len(texts)


def test_t7_time_does_not_grow_with_the_aliases(spark):
    texts = spark.createDataFrame([(k, "some words and name%d here " % k * 20) for k in range(50)], "seg_idx long, text string")
    glossary = spark.range(200_000).selectExpr("concat('name', id) AS alias", "concat('Name-', id) AS canonical")
    rows = repair.apply_glossary(texts, glossary).collect()
    assert all(r.replaced == 20 and f"Name-{r.seg_idx} " in r.text for r in rows)


pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_t21_empty_and_clipped(spark):
    seg = spark.createDataFrame([(1, 0, 0, 1000, "one two three"), (1, 1, 0, 1000, None)], "video_id long, seg_idx long, start_ms long, end_ms long, text string")
    words = spark.createDataFrame([(1, 0, 0, "one", -50, 90), (1, 0, 1, "two", 80, 2000), (1, 1, 0, "x", 0, 1)], "video_id long, seg_idx long, at long, word string, start_ms long, end_ms long")
    assert [tuple(r) for r in verify.align_words(seg, words).collect()] == [(1, 0, 0, "one", 0, 90, 1.0), (1, 0, 1, "two", 80, 1000, 1.0)]
