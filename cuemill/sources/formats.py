"""Readers and writers of transcript formats. Readers take a table (file, body) so that any text source will do."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.functions.settle import settled

#: File extensions of media.
VIDEO_EXTENSIONS = "mp4 mkv mov avi webm flv m4v wmv ts".split()
AUDIO_EXTENSIONS = "mp3 m4a wav aac flac ogg opus wma".split()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (file, body)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))


def _clock_ms(text: Column) -> Column:
    """Milliseconds of clocks with one, two or three parts and a comma or dot."""
    parts = F.transform(F.split(F.replace(text, F.lit(","), F.lit(".")), ":"), lambda p: F.trim(p).try_cast("double"))
    return F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x) * 1000).cast("long")


def parse_srt(files: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Cues (file, cue, start_ms, end_ms, text) of subtitle bodies; with windows only those whose middle a window holds.

    Blocks end at blank lines and before a number line that a clock line follows; an index line may be missing, model tags go, a
    cue lasts 0.05 s at least.
    """
    ends = r"\n[ \t]*\n+|\n(?=[ \t]*\d+[ \t]*\n[ \t]*[0-9:.,]+[ \t]*-->)"
    blocks = files.select("file", F.posexplode(F.split(F.regexp_replace("body", "\r\n?", "\n"), ends)).alias("cue", "block"))
    line = F.regexp_extract("block", r"(?m)^[ \t]*([0-9:.,]+)[ \t]*-->[ \t]*([0-9:.,]+).*$", 0)
    rows = blocks.withColumn("line", line).where("line <> ''")
    start, end = (_clock_ms(F.regexp_extract("line", r"([0-9:.,]+)[ \t]*-->[ \t]*([0-9:.,]+)", i)) for i in (1, 2))
    text = F.regexp_replace(F.regexp_replace(F.substring_index("block", "-->", -1), r"^[^\n]*\n?", ""), r"<\|[^|]*\|>", "")
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    out = rows.select("file", F.col("cue").cast("long").alias("cue"), start.alias("start_ms"), F.greatest(end, start + 50).alias("end_ms"), text.alias("text"))
    out = out.where("start_ms is not null and text <> ''")
    if windows is not None:
        mid = (F.col("start_ms") + F.col("end_ms")) / 2
        out = out.join(windows, "file").where((mid >= F.col("from_ms")) & (mid < F.col("to_ms")))
    return out


#: The keys of cue lists in the order they are read, and those of whole texts.
LISTS, TEXTS = ("segments", "utterances", "results", "chunks"), ("text", "transcript", "transcription", "output")
_TAGGED = r"(\[[0-9]+(?:\.[0-9]+)?\](?:\s*\[S\d+\])?\s*[^\[\]]+?\s*\[[0-9]+(?:\.[0-9]+)?\])"
_TAG_PARTS = r"\[([0-9.]+)\](?:\s*\[S\d+\])?\s*([^\[\]]+?)\s*\[([0-9.]+)\]"


#: What a body of JSON looks like from its start: the parser itself takes ``[0.5] text`` for an array and leaves the text.
_JSON = r'^\s*(?:\{|\[\s*(?:[\]{\["]|-?[0-9][^\]]*\]\s*$)|"|(?:-?[0-9.eE+-]+|true|false|null)\s*$)'


def _variant(body: str) -> Column:
    return F.when(F.col(body).rlike(_JSON), F.try_parse_json(body))


def _is(v: Column, kind: str) -> Column:
    """A variant as an array or a map of variants; null where it is none."""
    return F.try_variant_get(v, "$", {"array": "array<variant>", "object": "map<string,variant>"}[kind])


def _number(item: Column, *keys: str) -> Column:
    """The first of the keys that holds a number."""
    found = [F.when(F.schema_of_variant(F.try_variant_get(item, f"$.{k}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(item, f"$.{k}", "double")) for k in keys]
    return F.coalesce(*found)


def _string(item: Column, *keys: str) -> Column:
    found = [F.when(F.schema_of_variant(F.try_variant_get(item, f"$.{k}", "variant")) == "STRING", F.try_variant_get(item, f"$.{k}", "string")) for k in keys]
    return F.coalesce(*found)


def _cue_items(bodies: DataFrame) -> DataFrame:
    """(_k, path, item): the entries of cue lists in objects of any depth, ``path`` in the order they are read.

    Level by level: of an object the lists under the known keys, in their order, then what is under its other keys: an array is
    a list too, an object is looked into in turn. A body that is an array is a list.
    """
    once = bodies.select("_k", "body").dropDuplicates(["_k"])
    nodes = settled(once.select("_k", _variant("body").alias("v"), F.array().cast("array<string>").alias("path")))
    found = [nodes.select("_k", "path", F.posexplode(_is(F.col("v"), "array")).alias("pos", "item"))]
    rank = F.coalesce(*(F.when(F.col("key") == k, F.lit(f"0{i}")) for i, k in enumerate(LISTS)), F.concat(F.lit("1"), "key"))
    while not nodes.isEmpty():  # once a level of nesting
        children = nodes.select("_k", "path", F.explode(_is(F.col("v"), "object")).alias("key", "v"))
        children = children.select("_k", F.concat("path", F.array(rank)).alias("path"), "key", "v")
        found.append(children.select("_k", "path", F.posexplode(_is(F.col("v"), "array")).alias("pos", "item")))
        nodes = settled(children.where(~F.col("key").isin(*LISTS) & _is(F.col("v"), "object").isNotNull()).select("_k", "v", "path"))
    rows = reduce(DataFrame.unionByName, found)
    return rows.select("_k", F.concat("path", F.array(F.lpad(F.col("pos").cast("string"), 10, "0"))).alias("path"), "item")


def _spoken(value: object) -> str:
    """The text of a parsed body without lists: the first that is not blank, known keys before others, arrays joined by blanks."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return " ".join(filter(str.strip, map(_spoken, value)))
    if not isinstance(value, dict):
        return ""
    return next(filter(str.strip, (_spoken(value[k]) for k in [*(k for k in TEXTS if k in value), *sorted(value)])), "")


def _whole_text(body: str | None) -> str | None:
    try:
        return None if body is None else _spoken(json.loads(body))
    except ValueError:  # something follows the JSON
        return body


def parse_asr_json(bodies: DataFrame) -> DataFrame:
    """Cues (id, cue, start_s, end_s, text) of recogniser bodies (id, body, duration), whatever their nesting (S3).

    Entries of cue lists (``_cue_items``) count if they have a start, an end and a text; their order is ``cue``. A body without such takes
    the first text in it: tagged text ``[t0] words [t1]`` in its parts, any other as one cue; a body that is no JSON is that text itself.
    Valid JSON without speech has no cues, nor has a null body. Times are clamped to the duration, a cue lasts 0.05 s where there is room.
    """
    rows = bodies.withColumn("_k", F.sha2(F.coalesce("body", F.lit("")), 256)).withColumn("v", _variant("body"))
    start, end, text = _number(F.col("item"), "start", "start_time"), _number(F.col("item"), "end", "end_time"), _string(F.col("item"), "text", "transcript")
    items = _cue_items(rows.where("v is not null")).select("_k", "path", start.alias("start"), end.alias("end"), X.clean_asr(text).alias("text"))
    items = items.where("start is not null and end is not null and text is not null")
    spoken = F.col("text").rlike(r"[\p{L}\p{N}]")
    listed = items.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("path", "start", "end", "text"))).alias("items"), F.max(spoken).alias("spoken"))

    @F.pandas_udf("string")
    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(_whole_text)

    rows = rows.join(listed, "_k", "left").withColumn("spoken", F.coalesce("spoken", F.lit(False)))
    alone = F.when(F.col("v").isNotNull() & ~F.col("spoken"), F.col("body"))
    rows = rows.withColumn("whole", F.when(F.col("v").isNull(), F.col("body")).when(~F.col("spoken"), whole(alone)))
    cue = lambda a, z, t: F.struct(a.alias("start"), z.alias("end"), X.clean_asr(t).alias("text"))
    tagged = F.transform(
        F.regexp_extract_all("whole", F.lit(_TAGGED), F.lit(1)),
        lambda t: cue(F.regexp_extract(t, _TAG_PARTS, 1).try_cast("double"), F.regexp_extract(t, _TAG_PARTS, 3).try_cast("double"), F.regexp_extract(t, _TAG_PARTS, 2)),
    )
    one = F.array(cue(F.lit(0.0), F.col("duration").cast("double"), F.col("whole")))
    own = F.transform("items", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    cues = F.when(F.col("spoken"), own).when(F.size(tagged) > 0, tagged).when(F.trim("whole") != "", one)
    out = rows.select("id", "duration", F.posexplode(cues).alias("cue", "c"))
    start = F.least(F.greatest("c.start", F.lit(0.0)), "duration")
    end = F.least(F.greatest(F.col("c.end"), start + 0.05), F.greatest(F.col("duration"), start))
    return out.select("id", F.col("cue").cast("long").alias("cue"), start.alias("start_s"), end.alias("end_s"), F.col("c.text").alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def parse_silence_log(lines: DataFrame) -> DataFrame:
    """Pauses (file, start_s, end_s) of log lines (file, line_no, line): each end takes the last start before it."""
    start = F.regexp_extract("line", r"silence_start:\s*(-?[0-9.]+)", 1).try_cast("double")
    end = F.regexp_extract("line", r"silence_end:\s*(-?[0-9.]+)", 1).try_cast("double")
    rows = lines.select("file", "line_no", start.alias("s"), end.alias("e")).where("s is not null or e is not null")
    w = Window.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("before", F.lag("s").over(w))
    return rows.where("e is not null and before is not null and before >= 0 and e > before").select("file", F.col("before").alias("start_s"), F.col("e").alias("end_s"))


def srt_text(seg: DataFrame, bilingual: bool = False) -> DataFrame:
    """(video_id, body): numbered subtitle blocks, the translation under the text where asked for."""
    text = F.trim("text")
    if bilingual:
        text = F.when(F.trim(X.text_of("translated_text")) != "", F.concat_ws("\n", text, F.trim("translated_text"))).otherwise(text)
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("start_ms", "seg_idx"))
    block = F.concat(number.cast("string"), F.lit("\n"), X.clock(F.col("start_ms")), F.lit(" --> "), X.clock(F.col("end_ms")), F.lit("\n"), text)
    rows = seg.select("video_id", number.alias("n"), block.alias("block"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x["block"])
    return rows.groupBy("video_id").agg(F.concat(F.array_join(parts, "\n\n"), F.lit("\n")).alias("body"))


def write_texts(bodies: DataFrame, path: str, extension: str = "srt") -> None:
    """One folder per video, written by the tasks: ``path/video_id=…/``."""
    bodies.select(F.col("body").alias("value"), "video_id").write.partitionBy("video_id").option("lineSep", "\n").text(f"{path}/{extension}")


def markdown(seg: DataFrame, notes: DataFrame) -> DataFrame:
    """(video_id, body): front matter, summary, points and the transcript with its clocks.

    ``notes`` is (video_id, title, summary, key_points array<string>).
    """
    line = F.concat(F.lit("**["), X.short_clock(F.floor(F.col("start_ms") / 1000)), F.lit("]** "), F.trim("text"), F.when(F.trim(X.text_of("translated_text")) != "", F.concat(F.lit("\n> "), F.trim("translated_text"))).otherwise(""))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", line.alias("line")))), lambda x: x["line"])
    body = seg.groupBy("video_id").agg(F.array_join(parts, "\n\n").alias("transcript"))
    quoted = F.concat(F.lit('"'), F.replace(F.replace("title", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    points = F.array_join(F.transform("key_points", lambda p: F.concat(F.lit("- "), p)), "\n")
    text = F.concat(F.lit("---\ntitle: "), quoted, F.lit("\n---\n\n## Summary\n\n"), F.col("summary"), F.lit("\n\n## Key points\n\n"), points, F.lit("\n\n## Transcript\n\n"), F.col("transcript"), F.lit("\n"))
    return notes.join(body, "video_id").select("video_id", text.alias("body"))


def read_search_results(bodies: DataFrame) -> DataFrame:
    """Rows of search dumps (page, body): results without id go, tags are stripped, cover addresses get https."""
    item = "array<struct<bvid:string,title:string,author:string,pic:string,duration:string,play:bigint,pubdate:bigint>>"
    rows = bodies.select("page", F.posexplode(F.from_json("body", f"struct<data:struct<result:{item}>>")["data"]["result"]).alias("at", "r")).where("coalesce(r.bvid, '') <> ''")
    pic = X.text_of(F.col("r.pic"))
    cover = F.when(pic.startswith("//"), F.concat(F.lit("https:"), pic)).when(pic.startswith("http://"), F.regexp_replace(pic, "^http://", "https://")).otherwise(pic)
    return rows.select(
        "page", F.col("at").cast("long").alias("at"), F.col("r.bvid").alias("id"), X.strip_html(F.col("r.title")).alias("title"), F.col("r.author").alias("author"), cover.alias("cover"),
        F.concat(F.lit("https://www.bilibili.com/video/"), F.col("r.bvid")).alias("url"), X.play_count(F.coalesce("r.play", F.lit(0))).alias("plays"), X.china_date(F.coalesce("r.pubdate", F.lit(0))).alias("published"),
    )


def extract_links(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """The first http(s) address of a text that is not the machine's own, and its platform."""
    parts = F.split(F.col(column), r"[\s,，。；;)）\]】}\"'>》]")
    good = F.filter(parts, lambda p: p.rlike("^(?i)https?://[^/?#]") & ~F.lower(p).rlike(r"^https?://(localhost|127\.0\.0\.1|\[?::1\]?|0\.0\.0\.0)(:\d+)?([/?#]|$)"))
    rows = df.select(id_col, F.get(good, F.lit(0)).alias("raw")).where("raw is not null")
    modal = F.regexp_extract("raw", r"[?&]modal_id=(\d+)(?:[&#]|$)", 1)
    platform = X.platform_of(F.col("raw"))
    return rows.select(id_col, F.when((platform == "douyin") & (modal != ""), F.concat(F.lit("https://www.douyin.com/video/"), modal)).otherwise(F.col("raw")).alias("url"), platform.alias("platform"))


def media_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Media files under a path by extension, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("extension", extension).where(F.col("extension").isin(VIDEO_EXTENSIONS + AUDIO_EXTENSIONS)).withColumn("audio_only", F.col("extension").isin(AUDIO_EXTENSIONS))


def resolve_transcripts(standard: DataFrame, checkpoint: DataFrame, raw: DataFrame) -> DataFrame:
    """Segments of each video from its best document (video_id, body): standard, else checkpoint, else raw.

    Documents hold ``segments`` with seconds; times are rounded to milliseconds. A document that does not parse counts
    as missing.
    """
    kind = "struct<segments:array<struct<id:string,start:double,end:double,text:string>>>"
    tables = [t.select("video_id", F.lit(p).alias("source"), F.lit(i).alias("priority"), F.from_json("body", kind)["segments"].alias("segments")) for i, (p, t) in enumerate((("standard", standard), ("checkpoint", checkpoint), ("raw", raw)))]
    rows = tables[0].unionByName(tables[1]).unionByName(tables[2]).where("segments is not null")
    best = rows.groupBy("video_id").agg(F.min_by(F.struct("source", "segments"), "priority").alias("b"))
    out = best.select("video_id", "b.source", F.posexplode("b.segments").alias("seg_idx", "s"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return out.select("video_id", F.col("seg_idx").cast("long").alias("seg_idx"), "source", F.col("s.id").alias("segment_id"), ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), F.col("s.text").alias("text"))
