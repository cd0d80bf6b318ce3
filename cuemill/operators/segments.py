"""Segment tables: views, health, tags, translation coverage, invariants."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import text as X

_LEXICAL = re.compile(X.LEXICAL)


def with_language(df: DataFrame, column: str = "text") -> DataFrame:
    """Script counts and the dominant language of each row."""
    t = F.col(column)
    counts = {"han": X.HAN, "kana": X.KANA, "hangul": X.HANGUL}
    return df.withColumns({"latin_words": X.latin_words(t), **{k: X.count_matches(t, p) for k, p in counts.items()}, "language": X.language(t)})


def pending_translation(seg: DataFrame) -> DataFrame:
    """Segments without a translation whose text is not Chinese."""
    return seg.where((F.trim(X.text_of("translated_text")) == "") & (X.language(F.col("text")) != "Chinese"))


def raw_view(seg: DataFrame) -> DataFrame:
    """Segments as recognised, in order of time."""
    return seg.select("video_id", "seg_idx", "segment_id", "start_ms", "end_ms", "text")


def standard_view(seg: DataFrame, tok: DataFrame) -> DataFrame:
    """Float seconds and the mean token confidence, null without tokens."""
    mean = tok.groupBy("video_id", "seg_idx").agg(F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    out = seg.join(mean, ["video_id", "seg_idx"], "left")
    return out.select("video_id", "seg_idx", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", "avg_confidence")


def note_text(seg: DataFrame) -> DataFrame:
    """``note_text``: the translation, or the text where that is blank; ``snippet``: both where they differ."""
    tr, text = F.trim(X.text_of("translated_text")), F.trim("text")
    snippet = F.when((tr != "") & (tr != text), F.concat(text, F.lit(" ("), tr, F.lit(")"))).otherwise(text)
    return seg.withColumns({"note_text": F.when(tr != "", tr).otherwise(text), "snippet": snippet})


def violations(seg: DataFrame, tok: DataFrame) -> DataFrame:
    """Rows that break an invariant: end before start, token out of its segment, tokens out of order."""
    spans = seg.select("video_id", "seg_idx", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    w = Window.partitionBy("video_id", "seg_idx").orderBy("pos")
    rows = tok.withColumn("before", F.lag("start_ms").over(w)).join(spans, ["video_id", "seg_idx"])
    kinds = F.array(
        F.when(F.col("start_ms") > F.col("end_ms"), "token_span"),
        F.when((F.col("start_ms") < F.col("s")) | (F.col("end_ms") > F.col("e")), "token_outside"),
        F.when(F.col("before") > F.col("start_ms"), "token_order"),
    )
    bad = rows.select("video_id", "seg_idx", F.explode(F.array_compact(kinds)).alias("error"))
    own = spans.where("s > e").select("video_id", "seg_idx", F.lit("segment_span").alias("error"))
    return bad.unionByName(own).groupBy("video_id", "seg_idx", "error").agg(F.count(F.lit(1)).alias("n"))


def repeated(units: list[str]) -> int:
    """How many words the repeats of one n-gram cover at most, n from 2 to 4; 0 under six words (A5)."""
    best, size = 0, len(units)
    for n in (2, 3, 4) if size >= 6 else ():
        most = max(Counter(zip(*(units[i:] for i in range(n)))).values()) if size >= 2 * n else 0
        if most < 2:  # no longer one repeats either
            break
        best = max(best, min(most * n, size))
    return best


def surface_health(seg: DataFrame) -> DataFrame:
    """Words, letters, case, marks, repetition and the flags that follow from them, per segment (A4, A5)."""
    t = F.col("text")

    @F.pandas_udf("words long, covered long")
    def counted(low: pd.Series) -> pd.DataFrame:
        units = [_LEXICAL.findall(x or "") for x in low]
        return pd.DataFrame({"words": [len(u) for u in units], "covered": [repeated(u) for u in units]}, dtype="int64")

    words = F.when(t.isNotNull(), F.col("counts.words"))
    repetition = F.when(words < 6, 0.0).otherwise(F.col("counts.covered") / words)
    out = seg.withColumn("counts", counted(F.lower(t))).select(
        *seg.columns, words.alias("words"), X.count_matches(t, "[A-Za-z]").alias("letters"), X.count_matches(t, "[A-Z]").alias("capitals"),
        X.count_matches(t, f"[{X.STRONG_MARKS}]").alias("strong_marks"), F.round(repetition, 6).alias("repetition"),
    )
    ratio = F.when(F.col("letters") > 0, F.round(F.col("capitals") / F.col("letters"), 6)).otherwise(0.0)
    out = out.withColumn("upper_ratio", ratio).drop("capitals")
    duration = F.col("end_ms") - F.col("start_ms")
    out = out.withColumn("case_degenerated", (F.col("words") >= 4) & (F.col("letters") >= 12) & (F.col("upper_ratio") >= 0.9))
    out = out.withColumn("punctuation_degenerated", (duration >= 8000) & (F.col("words") >= 10) & (F.col("strong_marks") == 0))
    severe = (duration >= 10_000) & F.col("punctuation_degenerated") & (F.col("case_degenerated") | (F.col("repetition") >= 0.24))
    return out.withColumn("severe", severe)


#: Segments that consist of a filler alone.
FILLERS = "啊 呃 额 嗯 哦 噢 喔 哎 欸 唉 呀 哇 哈 嘿 uh um erm hmm hm".split()


def tag_integrity(seg: DataFrame, confidence: DataFrame) -> DataFrame:
    """Tags of suspicious segments, first rule that fits; nothing is deleted but blank segments (T5).

    ``confidence`` is (video_id, seg_idx, avg_confidence); ``profile`` of a segment comes from its language tag.
    """
    rows = seg.where(F.trim("text") != "").join(confidence, ["video_id", "seg_idx"], "left")
    text, conf = F.trim("text"), F.col("avg_confidence")
    bare = F.regexp_replace(text, rf"[\s{X.ASCII_PUNCT}]", "")
    loop = F.lit(False)
    for n in (1, 2, 3, 4):
        runs = F.length(F.regexp_extract(bare, r"^(.{%d})\1{3,}" % n, 0))
        loop = loop | ((F.length(bare) >= 4 * n) & (runs > 0) & (runs >= F.length(bare) - n))
    loop = (F.length(bare) >= 8) & loop & (conf.isNull() | (conf < 0.55))
    cjk, latin = X.count_matches(text, r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"), X.count_matches(text, "[A-Za-z]")
    outlier = ((F.col("profile") == "En") & (cjk > 0) & (latin == 0) & (cjk <= 6)) | ((F.col("profile") == "Zh") & (latin > 0) & (cjk == 0) & (latin <= 3))
    plain = F.regexp_replace(text, rf"[\s{X.ASCII_PUNCT}，。！？：；、…—]", "")
    rule = (
        F.when(loop, "probable_decode_loop").when(outlier & (conf < 0.45), "low_confidence_script_outlier").when(plain.isin(FILLERS), "filler_only_segment_preserved")
    )
    return rows.withColumn("rule_id", rule)


def transcript_text(seg: DataFrame) -> DataFrame:
    """One text per video: segments in order of time, one a line."""
    parts = F.sort_array(F.collect_list(F.struct("start_ms", "seg_idx", "text")))
    return seg.groupBy("video_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("body"))


def transcript_hash(seg: DataFrame, translated: bool = False) -> DataFrame:
    """SHA-256 over a video's segments, with or without translations."""
    fields = ["seg_idx", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), X.text_of("text")] + [X.text_of("translated_text")] * translated
    one = F.struct("seg_idx", F.concat_ws("\x1f", *fields[1:]).alias("row"))
    rows = F.transform(F.sort_array(F.collect_list(one)), lambda r: r["row"])
    return seg.groupBy("video_id").agg(F.sha2(F.array_join(rows, "\x1e"), 256).alias("hash"), F.count(F.lit(1)).alias("segments"))


def translation_coverage(seg: DataFrame) -> DataFrame:
    """Segments, translated ones and pending ones per video."""
    has = F.trim(X.text_of("translated_text")) != ""
    wants = ~has & (X.language(F.col("text")) != "Chinese")
    return seg.groupBy("video_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("translated"), F.count_if(wants).alias("pending"))


def degenerate_groups(seg: DataFrame) -> DataFrame:
    """Split parts regrouped by the id before ``#s``; whether their joined text is upper-case prose (A3)."""
    key = F.substring_index("segment_id", "#s", 1)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))), lambda p: p["text"])
    joined = seg.groupBy("video_id", key.alias("base_id")).agg(F.array_join(parts, " ").alias("joined"))
    t = F.col("joined")
    letters, capitals = X.count_matches(t, "[A-Za-z]"), X.count_matches(t, "[A-Z]")
    flag = (F.size(X.lexical_units(t)) >= 4) & (letters >= 12) & (capitals >= 0.9 * letters)
    return joined.select("video_id", "base_id", flag.alias("degenerate"))


def surface_lexicon(seg: DataFrame) -> DataFrame:
    """First surface of each lower-cased word among segments that are not all capitals (A2)."""
    letters, capitals = X.count_matches(F.col("text"), "[A-Za-z]"), X.count_matches(F.col("text"), "[A-Z]")
    # the texts are dealt by video once, and their words counted where they lie: a number as place keeps the grouping in hash tables
    healthy = seg.where(capitals < 0.9 * letters).select("video_id", "seg_idx", "text").repartition("video_id")
    words = healthy.select("video_id", "seg_idx", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), F.lit(1))).alias("pos", "surface"))
    first = words.groupBy("video_id", "surface").agg(F.min(F.col("seg_idx") * F.lit(1 << 31) + F.col("pos")).alias("place"))
    return first.groupBy("video_id", F.lower("surface").alias("word")).agg(F.min_by("surface", "place").alias("surface"))


def media_fingerprint(df: DataFrame, id_col: str, body: str) -> DataFrame:
    """SHA-256 over a body's length and three samples of up to 64 KiB: start, middle, end."""
    b, size = F.col(body), F.octet_length(body)
    take = 65536
    middle = F.floor(F.greatest(size - take, F.lit(0)) / 2).cast("int") + 1
    last = F.greatest(size - take, F.lit(0)).cast("int") + 1
    parts = [F.hex(F.substring(b.cast("binary"), F.lit(1), F.lit(take))), F.hex(F.substring(b.cast("binary"), middle, F.lit(take))), F.hex(F.substring(b.cast("binary"), last, F.lit(take)))]
    return df.select(id_col, size.cast("long").alias("n_bytes"), F.sha2(F.concat_ws(":", size.cast("string"), *parts), 256).alias("fingerprint"))


def same_media(prints: DataFrame, id_col: str) -> DataFrame:
    """Fingerprints that several files share: the smallest id and the number of files."""
    return prints.groupBy("fingerprint", "n_bytes").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("files")).where("files > 1")
