"""Lookups as set joins: as-of, nearest, range, matching, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import text as X


def with_source_key(df: DataFrame) -> DataFrame:
    return df.withColumn("source_key", X.source_key(F.col("platform"), F.col("source_url")))


def lookup_sources(requests: DataFrame, videos: DataFrame) -> DataFrame:
    """Each requested source (pos, platform, source_url) with the library's video of that key, or null."""
    found = with_source_key(videos).groupBy("source_key").agg(F.min("video_id").alias("video_id"))
    return with_source_key(requests).join(found, "source_key", "left").select("pos", "source_url", "source_key", "video_id")


def hydrate(videos: DataFrame, artifacts: DataFrame, queue: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Videos with the states of their three artifacts, and their first open queue item, by ``position`` or else ``ts``.

    ``files`` (video_id, media_ok, transcript_ok, translation_ok, note_ok, language), one row a video, says which files are
    there and valid: a ready artifact without its file counts as missing, a transcript as failed; ``media_status`` and
    ``transcript_language`` come from it.
    """
    kinds = {"standard_transcript": "transcript_status", "translation": "translation_status", "note": "note_status"}
    states = artifacts.groupBy("video_id").agg(*(F.max(F.when(F.col("artifact_type") == k, F.col("state"))).alias(v) for k, v in kinds.items()))
    order = F.struct("position" if "position" in queue.columns else "ts", "item_id")
    first = queue.where(~F.col("state").isin("cancelled", "completed")).groupBy("video_id").agg(F.min_by("item_id", order).alias("queue_item_id"))
    out = videos.join(states, "video_id", "left").join(first, "video_id", "left")
    out = out.select("video_id", *(F.coalesce(v, F.lit("missing")).alias(v) for v in kinds.values()), "queue_item_id")
    if files is None:
        return out
    held = out.join(files.select("video_id", "media_ok", "transcript_ok", "translation_ok", "note_ok", "language"), "video_id", "left")
    there = lambda c: F.coalesce(c, F.lit(False))
    valid = lambda status, ok, without: F.when((F.col(status) == "ready") & ~there(ok), without).otherwise(F.col(status)).alias(status)
    return held.select(
        "video_id", valid("transcript_status", "transcript_ok", "failed"), valid("translation_status", "translation_ok", "missing"), valid("note_status", "note_ok", "missing"),
        "queue_item_id", F.when(there("media_ok"), "available").otherwise("missing").alias("media_status"), F.col("language").alias("transcript_language"),
    )


def asof_segment(points: DataFrame, seg: DataFrame, tolerance_ms: int | None = None) -> DataFrame:
    """For each point (video_id, t) the last segment that starts by then; with a tolerance only up to that after its end.

    Points and segments are put in one order, so nothing multiplies and one window does the lookup.
    """
    p = points.select("video_id", F.col("t"), F.lit(1).alias("kind"), F.lit(None).cast("struct<seg_idx:bigint,start_ms:bigint,end_ms:bigint>").alias("s"))
    q = seg.select("video_id", F.col("start_ms").alias("t"), F.lit(0).alias("kind"), F.struct("seg_idx", "start_ms", "end_ms").alias("s"))
    w = Window.partitionBy("video_id").orderBy("t", "kind", "s.seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = q.unionByName(p).withColumn("hit", F.last("s", ignorenulls=True).over(w)).where("kind = 1")
    hit = F.col("hit") if tolerance_ms is None else F.when(F.col("t") <= F.col("hit.end_ms") + tolerance_ms, F.col("hit"))
    return out.select("video_id", "t", hit["seg_idx"].alias("seg_idx"))


def nearest_pause(points: DataFrame, pauses: DataFrame, within_ms: int = 750) -> DataFrame:
    """The nearest pause middle within the distance, the earlier of two equally near; a bucketed range join."""
    left = points.select("video_id", "t", F.explode(F.sequence(F.floor(F.col("t") / within_ms) - 1, F.floor(F.col("t") / within_ms) + 1)).alias("cell"))
    right = pauses.select("video_id", F.col("mid_ms"), F.floor(F.col("mid_ms") / within_ms).alias("cell"))
    near = left.join(right, ["video_id", "cell"]).withColumn("distance", F.abs(F.col("t") - F.col("mid_ms"))).where(F.col("distance") <= within_ms)
    return near.groupBy("video_id", "t").agg(F.min(F.struct("distance", "mid_ms")).alias("m")).select("video_id", "t", "m.mid_ms", "m.distance")


def nearest_evidence(candidates: DataFrame, evidence: DataFrame, within: int = 14) -> DataFrame:
    """Of the evidence in a candidate's segment the nearest by characters, up to 14 away."""
    both = candidates.join(evidence, ["video_id", "seg_idx"]).withColumn("gap", F.abs(F.col("char_offset") - F.col("evidence_offset")))
    best = both.where(F.col("gap") <= within).groupBy("video_id", "seg_idx", "char_offset").agg(F.min(F.struct("gap", "evidence_offset")).alias("m"))
    return best.select("video_id", "seg_idx", "char_offset", "m.evidence_offset", "m.gap")


def locate(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The first span (video_id, seg_idx, span_start, span_end) that holds a point, ends included, and the place in it.

    Spans may touch but not overlap, as those of ``char_spans``. Points and span ends are put in one falling order, so that
    the last end before a point is the nearest one after it, and nothing multiplies.
    """
    p = points.select("video_id", "t", F.lit(0).alias("kind"), F.lit(None).cast("struct<span_start:bigint,seg_idx:bigint>").alias("s"))
    q = spans.select("video_id", F.col("span_end").alias("t"), F.lit(1).alias("kind"), F.struct("span_start", "seg_idx").alias("s"))
    order = [F.desc(c) for c in ("t", "kind", "s.span_start", "s.seg_idx")]
    w = Window.partitionBy("video_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hit = q.unionByName(p).withColumn("hit", F.last("s", ignorenulls=True).over(w)).where("kind = 0 and hit.span_start <= t")
    return hit.select("video_id", "t", F.col("hit.seg_idx").alias("seg_idx"), (F.col("t") - F.col("hit.span_start")).alias("local"))


def char_spans(seg: DataFrame) -> DataFrame:
    """Start and end of each segment in the joined text: a space between two ASCII letters, digits or marks."""
    text = F.trim("text")
    rows = seg.where(text != "").select("video_id", "seg_idx", text.alias("t"))
    w = Window.partitionBy("video_id").orderBy("seg_idx")
    before = F.lag("t").over(w)
    space = F.when(before.isNotNull() & before.rlike(r"[\x21-\x7E]$") & F.col("t").rlike(r"^[0-9A-Za-z]"), 1).otherwise(0)
    rows = rows.withColumn("space", space).withColumn("n", F.length("t"))
    total = F.sum(F.col("space") + F.col("n")).over(w)
    return rows.select("video_id", "seg_idx", (total - F.col("n")).cast("long").alias("span_start"), total.cast("long").alias("span_end"))


def drop_known_boundaries(candidates: DataFrame, seg: DataFrame, within_ms: int = 450) -> DataFrame:
    """Pause candidates (video_id, mid_ms) without a sentence end nearby; anti join over time cells."""
    ends = seg.where(F.trim("text").rlike(f"[{X.STRONG_MARKS}]$")).select("video_id", "end_ms")
    cells = ends.select("video_id", "end_ms", F.explode(F.sequence(F.floor(F.col("end_ms") / within_ms) - 1, F.floor(F.col("end_ms") / within_ms) + 1)).alias("cell"))
    c = candidates.withColumn("cell", F.floor(F.col("mid_ms") / within_ms))
    near = (c["video_id"] == cells["video_id"]) & (c["cell"] == cells["cell"]) & (F.abs(c["mid_ms"] - cells["end_ms"]) <= within_ms)
    return c.join(cells, near, "left_anti").drop("cell")


def partition_cues(cues: DataFrame, targets: DataFrame) -> DataFrame:
    """Cues before, in and after a target by their middle, and the share of the target that cues cover.

    One row per target: texts joined in order, coverage by merged intervals.
    """
    both = cues.join(targets.select("video_id", F.col("t_start"), F.col("t_end")), "video_id")
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    both = both.withColumn("side", F.when(mid < F.col("t_start"), "before").when(mid > F.col("t_end"), "after").otherwise("target"))
    key = ["video_id", "t_start", "t_end"]
    lo, hi = F.greatest("start_ms", "t_start"), F.least("end_ms", "t_end")
    reach = F.max("hi").over(Window.partitionBy(*key).orderBy("lo", "seg_idx").rowsBetween(Window.unboundedPreceding, -1))
    inside = both.withColumn("lo", lo).withColumn("hi", hi).where("lo < hi").withColumn("reach", reach)
    fresh = F.greatest(F.col("hi") - F.greatest("lo", F.coalesce("reach", "lo")), F.lit(0))
    covered = inside.groupBy(*key).agg(F.sum(fresh).alias("covered"))
    joined = lambda side: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("seg_idx", "text")))), lambda r: r["text"]), " ")
    texts = both.groupBy(*key).agg(*(joined(s).alias(f"{s}_text") for s in ("before", "target", "after")))
    share = F.coalesce(F.col("covered") / F.greatest(F.col("t_end") - F.col("t_start"), F.lit(1)), F.lit(0.0))
    return texts.join(covered, key, "left").select(*key, "before_text", "target_text", "after_text", F.round(F.least(share, F.lit(1.0)), 6).alias("coverage"))


def entity_variants(candidates: DataFrame, memory: DataFrame) -> DataFrame:
    """Names (video_id, name) not in memory that are one or two edits from one that is: both of four letters or more."""
    known = memory.select("video_id", F.col("normalized").alias("entity"), "rank")
    new = candidates.join(known.select("video_id", F.col("entity").alias("name")), ["video_id", "name"], "left_anti")
    both = new.join(known, "video_id").where((F.length("name") >= 4) & (F.length("entity") >= 4) & (F.abs(F.length("name") - F.length("entity")) <= 2))
    far = F.when((F.length("name") >= 10) | (F.length("entity") >= 10), 2).otherwise(1)
    near = both.where(F.levenshtein("name", "entity") <= far)
    return near.groupBy("video_id", "name").agg(F.min_by("entity", "rank").alias("entity"))


def match_results(results: DataFrame, videos: DataFrame) -> DataFrame:
    """Search results (result_id, url) with the library's video of the same URL or, failing that, of the same key."""
    by_url = videos.groupBy(F.col("source_url").alias("url")).agg(F.min("video_id").alias("url_video"))
    by_key = with_source_key(videos).groupBy("source_key").agg(F.min("video_id").alias("key_video"))
    keyed = results.withColumn("source_key", X.source_key(F.col("platform"), F.col("url")))
    out = keyed.join(by_url, "url", "left").join(by_key, "source_key", "left")
    return out.select("result_id", F.coalesce("url_video", "key_video").alias("video_id"), F.when(F.col("url_video").isNotNull(), "url").when(F.col("key_video").isNotNull(), "key").alias("matched_by"))


def delete_cascade(ids: DataFrame, table: DataFrame, results_only: bool = False) -> DataFrame:
    """A dependent table without the rows of deleted videos; ``results_only`` keeps source media and audio."""
    if not results_only:
        return table.join(ids, "video_id", "left_anti")
    kept = table.where(F.col("artifact_type").isin("source_media", "prepared_audio"))
    return table.where(~F.col("artifact_type").isin("source_media", "prepared_audio")).join(ids, "video_id", "left_anti").unionByName(kept)


def hit_segments(hits: DataFrame, seg: DataFrame) -> DataFrame:
    """Segments that any hit (video_id, segment_ids) covers."""
    ids = hits.select("video_id", F.explode("segment_ids").alias("segment_id")).distinct()
    return seg.join(ids, ["video_id", "segment_id"], "left_semi")
