"""Model drafts of notes: cut to size, placed in time, and merged to one note a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions import text as X

SUMMARY, POINT, TITLE, CONTENT, MERGED = 2000, 600, 120, 800, 2500
_CHAPTER = "struct<timestamp_ms:bigint,title:string,content:string>"


def _cut(text: Column, chars: int) -> Column:
    return F.substring(F.trim(X.text_of(text)), 1, chars)


def _points(points: Column, most: int, bullets: bool = True) -> Column:
    clean = F.transform(F.coalesce(points, F.array().cast("array<string>")), lambda p: _cut(p, POINT))
    if bullets:
        clean = F.transform(clean, lambda p: F.trim(F.regexp_replace(p, r"^\s*(?:[-*•·]|\d+[.)、])\s*", "")))
    return F.slice(F.array_distinct(F.filter(clean, lambda p: p != "")), 1, most)


def normalize_drafts(drafts: DataFrame, batches: DataFrame) -> DataFrame:
    """Drafts (video_id, part, summary, key_points, chapters) of batches (video_id, part, start_ms, end_ms, starts).

    Texts are cut to 2000, 600, 120 and 800 characters, points to eight distinct ones. A chapter's time comes from its
    segment number, else from its own time, taken as seconds below 1000 in longer batches, else from the chapter before;
    it stays inside the batch. Chapters without title or content, or that repeat a long summary, go; then those with the
    title of the last one kept, or its content within 10 s; eight stay.
    """
    rows = drafts.join(batches.select("video_id", "part", "start_ms", "end_ms", "starts"), ["video_id", "part"])
    rows = rows.withColumn("summary", _cut(F.col("summary"), SUMMARY)).withColumn("key_points", _points(F.col("key_points"), 8))
    c = F.transform(F.coalesce("chapters", F.array().cast(drafts.schema["chapters"].dataType)), lambda x: F.struct(x["start_id"].alias("id"), F.coalesce(x["timestamp_ms"], F.lit(0)).alias("t"), _cut(x["title"], TITLE).alias("title"), _cut(x["content"], CONTENT).alias("content")))
    rows = rows.withColumn("c", F.filter(c, lambda x: (x["title"] != "") & (x["content"] != "") & ~((x["content"] == F.col("summary")) & (F.octet_length(x["content"]) > 80))))
    low, high = F.col("start_ms").cast("long"), F.col("end_ms").cast("long")
    inside = lambda t: F.greatest(low, F.least(high, t))
    start = F.struct(low.alias("last"), F.array().cast(f"array<{_CHAPTER}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        by_id = F.when((x["id"] >= 1) & (x["id"] <= F.size("starts")), F.get("starts", (x["id"] - 1).cast("int"))).when(x["id"] > 1000, x["id"]).otherwise(a["last"])
        own = F.when(x["t"] <= 0, a["last"]).when((x["t"] < 1000) & (high > 10_000), x["t"] * 1000).otherwise(x["t"])
        at = inside(F.when(x["id"].isNotNull(), by_id).otherwise(own).cast("long"))
        return F.struct(at.alias("last"), F.concat(a["out"], F.array(F.struct(at.alias("timestamp_ms"), x["title"].alias("title"), x["content"].alias("content")))).alias("out"))

    placed = F.aggregate("c", start, step, lambda a: a["out"])
    numbered = F.transform(placed, lambda x, i: F.struct(x["timestamp_ms"].alias("timestamp_ms"), i.alias("i"), x["title"].alias("title"), x["content"].alias("content")))

    def again(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        same = last.isNotNull() & ((last["title"] == x["title"]) | ((x["timestamp_ms"] - last["timestamp_ms"] < 10_000) & (last["content"] == x["content"])))
        return F.when(same, a).otherwise(F.concat(a, F.array(F.struct(x["timestamp_ms"].alias("timestamp_ms"), x["title"].alias("title"), x["content"].alias("content")))))

    rows = rows.withColumn("placed", F.array_sort(numbered))
    kept = F.slice(F.aggregate("placed", F.array().cast(f"array<{_CHAPTER}>"), again), 1, 8)
    return rows.select("video_id", "part", "summary", "key_points", kept.alias("chapters"))


def merge_notes(parts: DataFrame, merged: DataFrame) -> DataFrame:
    """One note a video: (video_id, summary, key_points, chapters) from its normal parts.

    A video of one part has its summary and points; of several, those of the model's merge (video_id, summary, key_points),
    cut to 2500 characters and ten distinct points. Chapters of all parts come in order of time.
    """
    flat = F.array_sort(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "chapters"))), lambda p: p["chapters"])))
    notes = parts.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.first("summary").alias("own"), F.first("key_points").alias("own_points"), flat.alias("chapters"))
    out = notes.join(merged.select("video_id", F.col("summary").alias("theirs"), F.col("key_points").alias("their_points")), "video_id", "left")
    one = F.col("n") == 1
    return out.select(
        "video_id", F.when(one, F.col("own")).otherwise(_cut(F.col("theirs"), MERGED)).alias("summary"),
        F.when(one, F.col("own_points")).otherwise(_points(F.col("their_points"), 10, bullets=False)).alias("key_points"), "chapters",
    )
