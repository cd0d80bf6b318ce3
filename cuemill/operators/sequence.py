"""Ordered jobs over segments, tokens and pauses: windows where neighbours matter, folds where the result of a step does."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.functions.settle import settled
from cuemill.operators.joins import entity_variants


def by_video():
    """Rows of a video in order."""
    return Window.partitionBy("video_id").orderBy("seg_idx")


def _ordered(df: DataFrame, *fields: str) -> DataFrame:
    """One row per video with its segments as a sorted array ``s`` of structs; a video is a bounded group."""
    return df.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", *fields))).alias("s"))


def chunk_segments(seg: DataFrame, most: int = 5, chars: int = 420) -> DataFrame:
    """Search chunks of up to five segments, ended once they hold 420 characters; the last segment opens the next.

    A fold over the lengths keeps the open chunk's start and size and emits (first, last) places.
    """
    size = F.length("text") + F.length(X.text_of("translated_text"))
    rows = _ordered(seg.withColumn("size", size).withColumn("snippet", _snippet()), "segment_id", "start_ms", "end_ms", "size", "snippet")
    kind = "struct<at:int,n:int,chars:int,out:array<struct<first:int,last:int>>>"
    start = F.lit(None).cast(kind)
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] > 0) & ((a["n"] >= most) | (a["chars"] >= chars))
        here = a["at"] + a["n"]  # place of x, counted from 1
        closed = F.array(F.struct(a["at"].alias("first"), (here - 1).alias("last")))
        # a chunk of several segments hands its last one on, a chunk of one does not
        carry = a["n"] > 1
        last_size = x["before"]
        n, c = F.when(carry, 1).otherwise(0), F.when(carry, last_size).otherwise(0)
        at = F.when(carry, here - 1).otherwise(here)
        # a carried segment of 420 characters or more is a chunk of its own
        again = full & carry & (c >= chars)
        alone = F.array(F.struct(at.alias("first"), at.alias("last")))
        out = F.when(again, F.concat(a["out"], closed, alone)).when(full, F.concat(a["out"], closed)).otherwise(a["out"])
        new_at = F.when(again, here).when(full, at).otherwise(a["at"])
        new_n = F.when(again, 1).when(full, n + 1).otherwise(a["n"] + 1)
        new_chars = F.when(again, x["size"]).when(full, c + x["size"]).otherwise(a["chars"] + x["size"])
        return F.struct(new_at.cast("int").alias("at"), new_n.cast("int").alias("n"), new_chars.cast("int").alias("chars"), out.alias("out"))

    def finish(a: Column) -> Column:
        stop = a["at"] + a["n"] - 1
        tail = F.array(F.struct(a["at"].alias("first"), stop.alias("last")))
        single = F.array(F.struct(stop.alias("first"), stop.alias("last")))
        return F.when(a["n"] == 0, a["out"]).when(a["n"] > 1, F.concat(a["out"], tail, single)).otherwise(F.concat(a["out"], tail))

    sizes = F.transform("s", lambda x, i: F.struct(x["size"].cast("int").alias("size"), F.when(i > 0, F.get(F.col("s"), i - 1)["size"]).otherwise(0).cast("int").alias("before")))
    chunks = rows.withColumn("cuts", F.aggregate(sizes, start, step, finish)).select("video_id", "s", F.posexplode("cuts").alias("chunk_idx", "cut"))
    part = F.slice("s", F.col("cut.first"), F.col("cut.last") - F.col("cut.first") + 1)
    chunks = chunks.withColumn("part", part)
    texts = F.filter(F.transform("part", lambda x: x["snippet"]), lambda t: t != "")
    return chunks.select(
        "video_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.element_at("part", 1)["start_ms"].alias("start_ms"), F.element_at("part", -1)["end_ms"].alias("end_ms"),
        F.transform("part", lambda x: x["segment_id"]).alias("segment_ids"), F.array_join(texts, " ").alias("text"),
    )


def _snippet() -> Column:
    tr, text = F.trim(X.text_of("translated_text")), F.trim("text")
    return F.when((tr != "") & (tr != text), F.concat(text, F.lit(" ("), tr, F.lit(")"))).otherwise(text)


def _bins(rows: DataFrame, opens: "callable") -> DataFrame:
    """(video_id, seg_idx, bin) by a fold; ``opens(state, x)`` gives (starts a new bin, size after x in either case)."""
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("end"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new, fresh, grown = opens(a, x)
        new = new & (a["n"] > 0)
        number = a["bin"] + F.when(new, 1).otherwise(0)
        return F.struct(
            number.cast("int").alias("bin"), F.when(new | (a["n"] == 0), fresh).otherwise(grown).cast("long").alias("size"),
            F.when(new, 1).otherwise(a["n"] + 1).cast("int").alias("n"), x["end_ms"].cast("long").alias("end"), F.concat(a["out"], F.array(number.cast("int"))).alias("out"),
        )

    out = rows.withColumn("bins", F.aggregate("s", start, step, lambda a: a["out"]))
    return out.select("video_id", F.explode(F.arrays_zip("s", "bins")).alias("x")).select("video_id", "x.s.*", F.col("x.bins").cast("long").alias("bin"))


def note_batches(seg: DataFrame, chars: int = 6000) -> DataFrame:
    """Bins of up to 6000 characters of lines ``[#i] text``; numbers restart in each bin."""
    rows = _ordered(seg.where(F.trim("text") != "").withColumn("t", F.trim("text")), "t", "end_ms")

    def opens(a: Column, x: Column):
        line = lambda i: F.length(F.concat(F.lit("[#"), i.cast("string"), F.lit("] "), x["t"])) + 1
        grown = a["size"] + line(a["n"] + 1)
        return grown > chars, line(F.lit(1)), grown

    bins = _bins(rows, opens)
    number = F.row_number().over(Window.partitionBy("video_id", "bin").orderBy("seg_idx"))
    return bins.select("video_id", "seg_idx", "bin", number.cast("long").alias("number"))


#: Profiles whose words are written without spaces.
CJK = X.CJK_PROFILES


def _profiled(seg: DataFrame) -> DataFrame:
    """Segments with a ``profile`` column; Auto where there is none."""
    return seg if "profile" in seg.columns else seg.withColumn("profile", F.lit("Auto"))


def note_paragraphs(seg: DataFrame, gap_ms: int = 2500, chars: int = 220) -> DataFrame:
    """Paragraphs: a new one after a gap of 2.5 s or once the texts of the current one hold 220 characters.

    Texts are joined by a blank, without one where ``profile`` is Zh, Ja or Ko.
    """
    rows = _ordered(_profiled(seg).where(F.trim("text") != "").withColumn("t", F.trim("text")), "t", "start_ms", "end_ms", "profile")

    def opens(a: Column, x: Column):
        return (x["start_ms"] - a["end"] > gap_ms) | (a["size"] >= chars), F.length(x["t"]), a["size"] + F.length(x["t"])

    bins = _bins(rows, opens)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "t"))), lambda p: p["t"])
    joined = F.when(F.first("profile").isin(*CJK), F.array_join(texts, "")).otherwise(F.array_join(texts, " "))
    return bins.groupBy("video_id", "bin").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), joined.alias("paragraph"))


#: A strong mark at the end, before closing quotes and brackets.
STRONG_END = f"[{X.STRONG_MARKS}][\"'”’)\\]】》]*\\s*$"


def _hard_starts(seg: DataFrame, evidence: DataFrame, near_ms: int) -> DataFrame:
    """(video_id, seg_idx) of segments whose start, or whose predecessor's end, has a boundary of confidence 0.5 within reach."""
    points = seg.withColumn("ended", F.lag("end_ms").over(by_video()))
    points = points.select("video_id", "seg_idx", F.explode(F.array("start_ms", "ended")).alias("t")).where("t is not null")
    cell = lambda c: F.floor(F.col(c) / (near_ms + 1))
    points = points.withColumn("cell", F.explode(F.array(cell("t") - 1, cell("t"), cell("t") + 1)))
    known = evidence.where(F.col("kind").isin("strong_punctuation", "alignment_boundary") & (F.col("confidence") >= 0.5))
    known = known.select("video_id", "time_ms", cell("time_ms").alias("cell"))
    return points.join(known, ["video_id", "cell"]).where(F.abs(F.col("t") - F.col("time_ms")) <= near_ms).select("video_id", "seg_idx").distinct()


def merge_adjacent(seg: DataFrame, evidence: DataFrame | None = None, near_ms: int = 120) -> DataFrame:
    """Neighbours joined while the left side has no strong end and both stay short; the sum is the next left side.

    Limits by ``profile``: 120 characters, 8 s and a gap of 0.42 s for En, 0.45 s for others; 36, 6.5 s and 0.52 s for Zh, Ja
    and Ko. Segments that overlap stay apart, as do those with boundary ``evidence`` (video_id, time_ms, kind, confidence)
    within 0.12 s of the cut. ``parts`` holds the joined texts in order, which ``merge_log`` turns into log rows.
    """
    rows = _profiled(seg).where(F.trim("text") != "").withColumn("t", F.trim("text"))
    rows = rows.withColumn("hard", F.lit(False)) if evidence is None else (
        rows.join(_hard_starts(rows, evidence, near_ms).withColumn("hard", F.lit(True)), ["video_id", "seg_idx"], "left").withColumn("hard", F.coalesce("hard", F.lit(False)))
    )
    rows = _ordered(rows, "t", "start_ms", "end_ms", "profile", "hard")
    kind = "struct<bin:int,chars:int,start:bigint,end:bigint,open:boolean,n:int,out:array<int>>"
    start = F.from_json(F.lit('{"bin":0,"chars":0,"start":0,"end":0,"open":false,"n":0,"out":[]}'), kind)

    def step(a: Column, x: Column) -> Column:
        cjk = x["profile"].isin(*CJK)
        size, gap = F.length(x["t"]), F.when(x["profile"] == "En", 420).when(cjk, 520).otherwise(450)
        short = (a["chars"] + size <= F.when(cjk, 36).otherwise(120)) & (x["end_ms"] - a["start"] <= F.when(cjk, 6500).otherwise(8000))
        join = (a["n"] > 0) & a["open"] & ~x["hard"] & (x["start_ms"] >= a["end"]) & (x["start_ms"] - a["end"] <= gap) & short
        number = a["bin"] + F.when(join | (a["n"] == 0), 0).otherwise(1)
        return F.struct(
            number.cast("int").alias("bin"), F.when(join, a["chars"] + F.when(cjk, 0).otherwise(1) + size).otherwise(size).cast("int").alias("chars"),
            F.when(join, a["start"]).otherwise(x["start_ms"]).cast("bigint").alias("start"), F.when(join, F.greatest(a["end"], x["end_ms"])).otherwise(x["end_ms"]).cast("bigint").alias("end"),
            (~x["t"].rlike(STRONG_END)).alias("open"), (a["n"] + 1).cast("int").alias("n"), F.concat(a["out"], F.array(number.cast("int"))).alias("out"),
        )

    out = rows.withColumn("bins", F.aggregate("s", start, step, lambda a: a["out"])).select("video_id", F.explode(F.arrays_zip("s", "bins")).alias("x")).select("video_id", "x.s.*", "x.bins")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "t"))), lambda p: p["t"])
    joined = out.groupBy("video_id", "bins").agg(
        F.min("seg_idx").alias("seg_idx"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("merged"),
        F.first("profile").alias("profile"), parts.alias("parts"),
    )
    text = F.when(F.col("profile").isin(*CJK), F.array_join("parts", "")).otherwise(F.array_join("parts", " "))
    return joined.withColumn("text", text).drop("bins")


def merge_log(merged: DataFrame) -> DataFrame:
    """One log row for each join of ``merge_adjacent``: the texts before, with a bar between, and after."""
    blank = F.when(F.col("profile").isin(*CJK), "").otherwise(" ")
    rows = merged.where("merged > 1").select("video_id", "seg_idx", "parts", blank.alias("blank"), F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("n"))
    left = F.expr("array_join(slice(parts, 1, n), blank)")
    right = F.element_at("parts", F.col("n") + 1)
    return log_rows(rows, "boundary", "merge_boundary", F.concat(left, F.lit(" | "), right), F.concat(left, "blank", right), "short_gap_without_sentence_terminal", 0.88)


def log_rows(rows: DataFrame, stage: str, operation: str | Column, before: Column, after: Column, rule: str | Column, confidence: float | Column) -> DataFrame:
    """Rows of the transform log: what a stage changed in a segment, by which rule, and how sure it is."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        "video_id", "seg_idx", F.lit(stage).alias("stage"), lit(operation).alias("operation"), before.alias("before"), after.alias("after"),
        lit(rule).alias("rule_id"), lit(confidence).cast("double").alias("confidence"),
    )


def pauses(speech: DataFrame, least_ms: int = 200, most_ms: int = 3000) -> DataFrame:
    """Gaps of 0.2 to 3 s between neighbouring spans of speech, and their middles."""
    gap = F.lead("start_ms").over(by_video()) - F.col("end_ms")
    out = speech.withColumn("gap_ms", gap).where((F.col("gap_ms") >= least_ms) & (F.col("gap_ms") <= most_ms))
    return out.select("video_id", "seg_idx", F.col("end_ms").alias("from_ms"), "gap_ms", (F.col("end_ms") + F.floor(F.col("gap_ms") / 2)).alias("mid_ms"))


def thin_pauses(gaps: DataFrame, apart_ms: int = 1200) -> DataFrame:
    """Pauses at least 1.2 s apart: of two closer ones the longer stays, compared with the last kept."""
    rows = gaps.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("mid_ms", "gap_ms", "seg_idx"))).alias("s"))
    kind = "array<struct<mid_ms:bigint,gap_ms:bigint,seg_idx:bigint>>"

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        near = last.isNotNull() & (x["mid_ms"] - last["mid_ms"] < apart_ms)
        return F.when(~near, F.concat(a, F.array(x))).when(x["gap_ms"] > last["gap_ms"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(x))).otherwise(a)

    kept = rows.select("video_id", F.aggregate("s", F.array().cast(kind), step).alias("kept"))
    return kept.select("video_id", F.inline("kept")).select("video_id", "seg_idx", "mid_ms", "gap_ms")


def pause_budget(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """At most clamp(ceil(seconds / 10), 12, 90) pauses a video: equal-count buckets, the longest of each, last on ties."""
    budget = F.least(F.greatest(F.ceil(F.col("total_ms") / 10_000), F.lit(12)), F.lit(90))
    per = Window.partitionBy("video_id")
    rows = kept.join(totals, "video_id").withColumn("budget", budget).withColumn("n", F.count(F.lit(1)).over(per)).withColumn("rank", F.row_number().over(per.orderBy("mid_ms")) - 1)
    bucket = F.when(F.col("n") <= F.col("budget"), F.col("rank")).otherwise(F.floor(F.col("rank") * F.col("budget") / F.col("n")))
    return rows.groupBy("video_id", bucket.alias("bucket")).agg(F.max(F.struct("gap_ms", "mid_ms")).alias("m")).select("video_id", "m.mid_ms", "m.gap_ms")


def local_gap(tok: DataFrame) -> DataFrame:
    """Upper median of the gaps up to 1.2 s from four words before to five after each word; 0.06 s without any, at least 0.03 s."""
    w = Window.partitionBy("video_id").orderBy("seg_idx", "pos")
    gap = F.greatest(F.lead("start_ms").over(w) - F.col("end_ms"), F.lit(0))
    rows = tok.withColumn("gap", gap)
    frame = F.sort_array(F.collect_list(F.when(F.col("gap") <= 1200, F.col("gap"))).over(w.rowsBetween(-4, 4)))
    median = F.try_element_at(frame, F.floor(F.size(frame) / 2).cast("int") + 1)
    return rows.select("video_id", "seg_idx", "pos", F.greatest(F.coalesce(median, F.lit(60)), F.lit(30)).alias("local_gap_ms"))


def fixed_windows(totals: DataFrame, size_ms: int = 120_000) -> DataFrame:
    """Windows of 120 s over (video_id, total_ms), the last one clipped."""
    rows = totals.where("total_ms > 0").select("video_id", "total_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total_ms") - 1) / size_ms))).alias("window"))
    start = F.col("window") * size_ms
    return rows.select("video_id", "window", start.alias("start_ms"), F.least(start + size_ms, "total_ms").alias("end_ms"))


def collapse_loops(tok: DataFrame, times: int = 4, within_ms: int = 1500) -> DataFrame:
    """Tokens, where a run of one token four times or more within 1.5 s in its segment is left once.

    ``n`` is the size of the run a token stands for, ``source_ids`` the places it came from, ``span_end_ms`` its last end.
    """
    order = Window.partitionBy("video_id", "seg_idx").orderBy("pos")
    same = Window.partitionBy("video_id", "seg_idx", "token").orderBy("pos")
    run = Window.partitionBy("video_id", "seg_idx", "token", "island")
    rows = tok.withColumn("island", F.row_number().over(order) - F.row_number().over(same))
    rows = rows.withColumn("k", F.row_number().over(run.orderBy("pos"))).withColumn("size", F.count(F.lit(1)).over(run))
    loop = (F.col("size") >= times) & (F.max("end_ms").over(run) - F.min("start_ms").over(run) <= within_ms)
    rows = rows.withColumn("loop", loop).withColumn("ids", F.collect_list("pos").over(run.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("last", F.max("end_ms").over(run)).where("not loop or k = 1")
    ids = F.when(F.col("loop"), F.array_join(F.col("ids").cast("array<string>"), ",")).otherwise(F.col("pos").cast("string"))
    return rows.select(
        "video_id", "seg_idx", "pos", "token", "start_ms", "end_ms", F.when(F.col("loop"), F.col("last")).otherwise(F.col("end_ms")).alias("span_end_ms"),
        F.when(F.col("loop"), F.col("size")).otherwise(1).cast("long").alias("n"), ids.alias("source_ids"),
    )


def token_loops(tok: DataFrame, times: int = 4, within_ms: int = 1500) -> DataFrame:
    """(video_id, seg_idx, token) of the runs that ``collapse_loops`` leaves once, by one order of a segment's tokens."""
    order = Window.partitionBy("video_id", "seg_idx").orderBy("pos")
    starts = F.when(F.lag("token").over(order).eqNullSafe(F.col("token")) & (F.row_number().over(order) > 1), 0).otherwise(1)
    rows = tok.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(order))
    span = F.max("end_ms") - F.min("start_ms")
    runs = rows.groupBy("video_id", "seg_idx", "token", "_run").agg(F.count(F.lit(1)).alias("n"), span.alias("span"))
    return runs.where((F.col("n") >= max(times, 2)) & (F.col("span") <= within_ms)).select("video_id", "seg_idx", "token")


def stitch_acronyms(tok: DataFrame, gap_ms: int = 500) -> DataFrame:
    """Runs of three to six single letters with gaps up to 0.5 s, cut every six, as one word."""
    w = Window.partitionBy("video_id").orderBy("seg_idx", "pos")
    single = F.col("token").rlike("^[A-Za-z]$")
    start = ~F.coalesce(F.lag(single).over(w), F.lit(False)) | (F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms)
    rows = tok.withColumn("single", single).withColumn("starts", F.when(single & start, 1).otherwise(0)).withColumn("run", F.sum("starts").over(w)).where("single")
    rows = rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("video_id", "run").orderBy("seg_idx", "pos")) - 1) / 6))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "pos", "token"))), lambda x: x["token"])
    out = rows.groupBy("video_id", "run", "part").agg(F.upper(F.array_join(parts, "")).alias("acronym"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))
    return out.where("n >= 3").select("video_id", "acronym", "start_ms", "end_ms")


def bridge_candidates(seg: DataFrame, gap_ms: int = 850, most: int = 4) -> DataFrame:
    """Cuts where the left side is unfinished, the gap short, and the right side short or overlapping; the first four a video."""
    units = X.lexical_units(F.col("text"))
    rows = seg.withColumn("units", units).withColumn("finished", F.trim("text").rlike(f"[{X.STRONG_MARKS}]$"))
    nxt = lambda c: F.lead(c).over(by_video())
    rows = rows.select("video_id", "seg_idx", "finished", "units", nxt("units").alias("right"), (nxt("start_ms") - F.col("end_ms")).alias("gap_ms"))
    lengths = F.sequence(F.lit(1), F.greatest(F.least(F.size("units"), F.size("right"), F.lit(12)), F.lit(1)))
    equal = F.filter(lengths, lambda n: F.slice("units", F.greatest(F.size("units") - n + 1, F.lit(1)), n) == F.slice("right", F.lit(1), n))
    rows = rows.where(F.col("right").isNotNull()).withColumn("overlap", F.when((F.size("units") > 0) & (F.size("right") > 0), F.coalesce(F.array_max(equal), F.lit(0))).otherwise(0))
    ok = rows.where(~F.col("finished") & (F.abs("gap_ms") <= gap_ms) & ((F.size("right") <= 8) | (F.col("overlap") >= 2)))
    return ok.withColumn("rank", F.row_number().over(by_video())).where(F.col("rank") <= most).select("video_id", "seg_idx", "gap_ms", F.col("overlap").cast("long").alias("overlap"))


def anchors(a: DataFrame, b: DataFrame, least: int = 2) -> DataFrame:
    """Maximal equal runs between two token lists (video_id, pos, token): islands on the diagonals."""
    both = a.select("video_id", "token", F.col("pos").alias("i")).join(b.select("video_id", "token", F.col("pos").alias("j")), ["video_id", "token"])
    diagonal = both.withColumn("diagonal", F.col("i") - F.col("j"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("video_id", "diagonal").orderBy("i"))
    runs = diagonal.withColumn("island", island).groupBy("video_id", "diagonal", "island").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= least).select("video_id", "i", "j", "n")


def drop_near_duplicates(seg: DataFrame, within_ms: int = 120) -> DataFrame:
    """Segments left out that have the text of the last one kept and start less than 0.12 s from it."""
    rows = _ordered(seg.withColumn("t", F.trim("text")), "t", "start_ms")
    start = F.from_json(F.lit('{"at":0,"n":0,"keep":[]}'), "struct<at:bigint,t:string,n:int,keep:array<boolean>>")

    def step(a: Column, x: Column) -> Column:
        again = (a["n"] > 0) & (a["t"] == x["t"]) & (F.abs(x["start_ms"] - a["at"]) < within_ms)
        keep = ~F.coalesce(again, F.lit(False))
        return F.struct(
            F.when(keep, x["start_ms"]).otherwise(a["at"]).cast("bigint").alias("at"), F.when(keep, x["t"]).otherwise(a["t"]).alias("t"), F.lit(1).alias("n"),
            F.concat(a["keep"], F.array(keep)).alias("keep"),
        )

    kept = rows.withColumn("keep", F.aggregate("s", start, step, lambda a: a["keep"])).select("video_id", F.explode(F.arrays_zip("s", "keep")).alias("x"))
    return seg.join(kept.where("x.keep").select("video_id", "x.s.seg_idx"), ["video_id", "seg_idx"], "left_semi")


def dedupe_overlap(seg: DataFrame, near_ms: int = 300, most: int = 16) -> DataFrame:
    """The longest token suffix of a segment that begins the next one is cut from the next, where they touch in time.

    One token must have four characters. The left side is what an earlier cut has left of it; a segment that is cut away
    whole is nobody's left side. ``rest`` is the original text behind the last token that is cut, without the blanks and marks
    that were between; the whole text where nothing is cut, empty for a segment to drop.
    """
    rows = _ordered(seg.withColumn("units", X.tokens(F.col("text"))), "units", "text", "start_ms", "end_ms")
    start = F.from_json(F.lit('{"left":[],"end":0,"cuts":[]}'), "struct<left:array<string>,end:bigint,cuts:array<int>>")

    def step(a: Column, x: Column) -> Column:
        left, units = a["left"], x["units"]
        lengths = F.sequence(F.lit(1), F.greatest(F.least(F.size(left), F.size(units), F.lit(most)), F.lit(1)))
        equal = F.filter(lengths, lambda n: (F.slice(left, F.greatest(F.size(left) - n + 1, F.lit(1)), n) == F.slice(units, F.lit(1), n)) & ((n > 1) | (F.length(F.get(units, F.lit(0))) >= 4)))
        touch = (F.size(left) > 0) & (F.size(units) > 0) & (x["start_ms"] <= a["end"] + near_ms)
        cut = F.when(touch, F.coalesce(F.array_max(equal), F.lit(0))).otherwise(0).cast("int")
        return F.struct(F.slice(units, cut + 1, F.size(units)).alias("left"), x["end_ms"].cast("bigint").alias("end"), F.concat(a["cuts"], F.array(cut)).alias("cuts"))

    cuts = rows.withColumn("cuts", F.aggregate("s", start, step, lambda a: a["cuts"])).select("video_id", F.explode(F.arrays_zip("s", "cuts")).alias("x"))
    # tokens of the text in its own letters; a run of word characters never gives one back to the next token
    skip, word, other = rf"[\s{X.ASCII_PUNCT}]*", "[0-9A-Za-z_]++", rf"[^\s0-9A-Za-z_{X.ASCII_PUNCT}]"
    pattern = F.concat(F.lit(f"^(?:{skip}(?:{word}|{other})){{"), F.col("x.cuts").cast("string"), F.lit("}"))
    text = F.coalesce("x.s.text", F.lit(""))
    size = F.coalesce(F.length(F.regexp_substr(X.fold_width(text), pattern)), F.lit(0))
    left = F.regexp_replace(F.substring(text, size + 1, F.length(text)), r"^[\s,.;:!?，。！？；：、]+", "")
    rest = F.when(F.col("x.cuts") > 0, left).otherwise(text)
    return cuts.select("video_id", "x.s.seg_idx", F.col("x.cuts").cast("long").alias("cut"), rest.alias("rest"))


def monotone_starts(tok: DataFrame) -> DataFrame:
    """Token starts that never fall behind an earlier one."""
    w = Window.partitionBy("video_id").orderBy("seg_idx", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return tok.withColumn("start_ms", F.max("start_ms").over(w))


def append_positions(new: DataFrame, queue: DataFrame) -> DataFrame:
    """New queue items (item_id, arrival) at the positions after the queue's last one, in order of arrival, then of item.

    Two levels: items are dealt out by ranges of (arrival, item), where a moment with very many items is many ranges, and
    numbered inside each; a range's items follow those of the ranges before it, which is a sum over one row a range.
    """
    row = F.col("_row")
    ranged = new.select("item_id", "arrival").repartitionByRange("arrival", "item_id").sortWithinPartitions("arrival", "item_id")
    ranged = settled(ranged.withColumn("_row", F.monotonically_increasing_id()).select("item_id", F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("at")))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("shift"))  # a row a range
    last = queue.agg(F.coalesce(F.max("position"), F.lit(0)).alias("last"))
    out = ranged.join(F.broadcast(shift), "part").crossJoin(F.broadcast(last))
    return out.select("item_id", (F.col("last") + F.col("shift") + F.col("at") + 1).cast("long").alias("position"))


def context_windows(seg: DataFrame) -> DataFrame:
    """A second of context and more on both sides of a segment: clamp((18 - core) / 2, 2, 5.5) s; valid from 2 to 18.05 s."""
    core = (F.col("end_ms") - F.col("start_ms")) / 1000
    pad = F.least(F.greatest((18 - core) / 2, F.lit(2.0)), F.lit(5.5))
    lo = F.greatest(F.col("start_ms") / 1000 - pad, F.lit(0.0))
    hi = F.col("end_ms") / 1000 + pad
    return seg.select("video_id", "seg_idx", F.round(lo, 6).alias("from_s"), F.round(hi, 6).alias("to_s"), ((hi - lo >= 2) & (hi - lo <= 18.05)).alias("valid"))


def _plan(duration: float, gaps: list[tuple[float, float]], target: float, low: float, high: float, overlap: float) -> Iterator[tuple]:
    start = 0.0
    while duration - start > high:
        best = max(
            ((min(b, start + high) - max(a, start + low) - 0.05 * abs((a + b) / 2 - start - target), (a + b) / 2) for a, b in gaps if b - a >= 0.18 and start + low <= (a + b) / 2 <= start + high),
            default=None,
        )
        cut = best[1] if best else start + target
        yield start, cut, best is None
        start = cut if best else cut - overlap
    yield start, duration, False


def plan_chunks(totals: DataFrame, gaps: DataFrame, target: float = 30.0, low: float = 20.0, high: float = 40.0, overlap: float = 1.0) -> DataFrame:
    """Chunks cut in the middle of the best pause between ``low`` and ``high`` seconds, else at the target with overlap.

    Each cut moves the next window, so a video is planned in one piece; its pauses are few.
    """
    spans = gaps.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct((F.col("from_ms") / 1000).alias("a"), ((F.col("from_ms") + F.col("gap_ms")) / 1000).alias("b")))).alias("gaps"))
    rows = totals.join(spans, "video_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                own = [] if r.gaps is None else [(g["a"], g["b"]) for g in r.gaps]
                out += [(r.video_id, i, *c) for i, c in enumerate(_plan(r.total_ms / 1000, own, target, low, high, overlap))]
            yield pd.DataFrame(out, columns=["video_id", "chunk", "start_s", "end_s", "is_soft_cut"])

    return rows.mapInPandas(run, "video_id long, chunk long, start_s double, end_s double, is_soft_cut boolean")


#: Words that end with a full stop inside a sentence.
ABBREVIATIONS = "mr mrs ms dr prof sr jr st vs etc e.g i.e u.s u.k no inc ltd co".split()


def split_sentences(seg: DataFrame) -> DataFrame:
    """Segments split after strong marks and their closing quotes, not in decimals, abbreviations and initials; times by
    linear share of characters (W10, without tokens)."""
    marks = r"(?<=[.!?。！？][\"')\]”’]{0,3})(?<![\"')\]”’.!?。！？](?=[\"')\]”’.!?。！？]))\s+"
    text = F.trim("text")
    stop = F.regexp_replace(text, r"(?i)\b(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.\s+", "$1.\x1d")
    stop = F.regexp_replace(stop, r"\b([A-Z])\.\s+", "$1.\x1d")
    parts = F.transform(F.split(stop, marks), lambda p: F.replace(p, F.lit("\x1d"), F.lit(" ")))
    rows = seg.where(text != "").select("video_id", "seg_idx", "start_ms", "end_ms", F.posexplode(parts).alias("part", "sentence"))
    per = Window.partitionBy("video_id", "seg_idx")
    size = F.length("sentence")
    before = F.coalesce(F.sum(size).over(per.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(size).over(per)
    span = F.col("end_ms") - F.col("start_ms")
    at = lambda n: F.col("start_ms") + F.floor(span * n / F.greatest(total, F.lit(1)))
    return rows.select("video_id", "seg_idx", F.col("part").cast("long").alias("part"), at(before).alias("start_ms"), at(before + size).alias("end_ms"), "sentence")


def suspicions(seg: DataFrame, health: DataFrame, memory: DataFrame | None = None, names: DataFrame | None = None, most: int = 16) -> DataFrame:
    """Segments that look wrong, by score, 16 a video, in order of time.

    Reasons: micro (up to 1.4 s with six units or fewer, or up to 0.55 s) 0.36; isolated between longer neighbours within
    1.2 s 0.34; boundary fragment, isolated within 0.6 s on both sides, 0.14; a name one or two letters off a known one
    0.58; degenerate surface 0.92. From 0.52 on, and only with a segment on either side of the target unless degenerate.
    The target of a boundary fragment takes in the previous segment where both stay within 8 s. ``hotwords`` are the known
    names that variants stand for, then the video's most frequent ones, twelve at most. ``memory`` is (video_id,
    normalized, canonical, rank), ``names`` the names in texts (video_id, seg_idx, normalized).
    """
    h = health.select("video_id", "seg_idx", "severe")
    rows = seg.join(h, ["video_id", "seg_idx"])
    long = F.col("end_ms") - F.col("start_ms")
    gap = F.greatest(F.col("start_ms") - F.lag("end_ms").over(by_video()), F.lit(0))
    rows = rows.withColumn("long", long).withColumn("before", gap)
    rows = rows.withColumn("units", F.when(long <= 1400, F.size(X.tokens(F.col("text")))))  # of short segments only
    rows = rows.withColumns({
        "after": F.lead("before").over(by_video()), "long_before": F.lag("long").over(by_video()), "long_after": F.lead("long").over(by_video()),
        "start_before": F.lag("start_ms").over(by_video()), "k": F.row_number().over(by_video()), "id_before": F.lag("seg_idx").over(by_video()),
    })
    if memory is None or names is None:
        rows = rows.withColumn("variants", F.array().cast("array<string>")).withColumn("known", F.array().cast("array<string>"))
    else:
        near = entity_variants(names.select("video_id", F.col("normalized").alias("name")).distinct(), memory)
        near = near.join(memory.select("video_id", F.col("normalized").alias("entity"), "canonical"), ["video_id", "entity"])
        near = names.join(near.withColumnRenamed("name", "normalized"), ["video_id", "normalized"]).groupBy("video_id", "seg_idx").agg(F.sort_array(F.collect_set("canonical")).alias("variants"))
        known = memory.groupBy("video_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", "canonical"))), lambda x: x["canonical"]), 1, 12).alias("known"))
        rows = rows.join(near, ["video_id", "seg_idx"], "left").join(known, "video_id", "left")
        rows = rows.withColumn("variants", F.coalesce("variants", F.array().cast("array<string>"))).withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    micro = ((F.col("long") <= 1400) & (F.col("units") <= 6)) | (F.col("long") <= 550)
    isolated = F.coalesce(micro & (F.col("before") <= 1200) & (F.col("after") <= 1200) & (F.col("long_before") >= 1200) & (F.col("long_after") >= 1200), F.lit(False))
    fragment = isolated & (F.col("before") <= 600) & (F.col("after") <= 600)
    variant = F.size("variants") > 0
    kinds = ((micro, 36, "micro"), (isolated, 34, "isolated"), (fragment, 14, "fragment"), (variant, 58, "variant"), (F.col("severe"), 92, "degenerate"))
    score = F.least(sum((F.when(c, n).otherwise(0) for c, n, _ in kinds[1:]), F.when(micro, 36).otherwise(0)), F.lit(100))
    reasons = F.array_join(F.array_compact(F.array(*(F.when(c, name) for c, _, name in kinds))), ",")
    wide = fragment & (F.col("long_before") <= 6000) & (F.col("end_ms") - F.col("start_before") <= 8000)
    wide = F.coalesce(wide, F.lit(False))
    inside = (F.col("k") - F.when(wide, 1).otherwise(0) > 1) & F.col("after").isNotNull()
    low = F.transform("variants", lambda x: F.lower(x))
    rows = rows.withColumns({
        "score": score, "reasons": reasons, "first_target": F.when(wide, F.col("id_before")).otherwise(F.col("seg_idx")),
        "hotwords": F.slice(F.concat("variants", F.filter("known", lambda x: ~F.array_contains(low, F.lower(x)))), 1, 12),
    })
    rows = rows.where((F.col("score") >= 52) & (F.col("severe") | inside))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "start_ms"))
    out = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    return out.select("video_id", "seg_idx", "first_target", (F.col("score") / 100).alias("score"), "reasons", "hotwords")


def thin_cuts(seg: DataFrame, evidence: DataFrame, least: float = 0.5, chars: int = 1, apart_ms: int = 80) -> DataFrame:
    """Cuts (video_id, seg_idx, char_offset, time_ms, confidence) inside their segment, none within one character or 80 ms of
    the last one kept (W11)."""
    spans = seg.select("video_id", "seg_idx", F.length("text").alias("n"), "start_ms", "end_ms")
    inside = (F.col("char_offset") > 0) & (F.col("char_offset") < F.col("n")) & (F.col("time_ms") > F.col("start_ms")) & (F.col("time_ms") < F.col("end_ms"))
    rows = evidence.where(F.col("confidence") >= least).join(spans, ["video_id", "seg_idx"]).where(inside)
    cuts = rows.groupBy("video_id", "seg_idx").agg(F.sort_array(F.collect_set(F.struct(F.col("char_offset").cast("long").alias("char_offset"), F.col("time_ms").cast("long").alias("time_ms")))).alias("s"))

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        near = last.isNotNull() & ((x["char_offset"] - last["char_offset"] <= chars) | (x["time_ms"] - last["time_ms"] <= apart_ms))
        return F.when(near, a).otherwise(F.concat(a, F.array(x)))

    kept = cuts.select("video_id", "seg_idx", F.aggregate("s", F.array().cast("array<struct<char_offset:bigint,time_ms:bigint>>"), step).alias("kept"))
    return kept.select("video_id", "seg_idx", F.inline("kept"))
