"""Corpus repair: spoken numbers, glossary, punctuation evidence, entities, JSON from noise, similarity and its gate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import text as X

#: Bytes of a glossary that are broadcast at once.
GLOSSARY_BYTES = 64 << 20
# Chinese digits, and the units of numbers.
DIGITS = {c: i for i, group in enumerate(("0零〇", "1一幺", "2二两", "3三", "4四", "5五", "6六", "7七", "8八", "9九")) for c in group}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10_000, "亿": 100_000_000}
_D, _N = "".join(DIGITS), "".join(DIGITS) + "".join(UNITS)
_PERCENT = re.compile(rf"百分之\s*([{_N}]+)(?:[点.]([{_D}]+))?")
_DECIMAL = re.compile(rf"([{_N}]+)\s*点[。，、\s]?\s*([{_D}]+)")
_SPACED = re.compile(r"(\d+)\s*\.\s*(\d+)")


def cardinal(text: str) -> int | None:
    """Value of a numeral; None for forms such as 二百五 whose last unit is left out."""
    if not any(c in UNITS for c in text):
        return int("".join(str(DIGITS[c]) for c in text)) if text else None
    tail = re.split("[百千万亿]", text)[-1]
    if "百" in text or "千" in text or "万" in text or "亿" in text:
        if len(tail) == 1 and tail in DIGITS and DIGITS[tail] != 0:
            return None
    total = section = digit = 0
    for c in text:
        if c in DIGITS:
            digit = DIGITS[c]
        elif UNITS[c] < 10_000:
            section, digit = section + (digit or 1) * UNITS[c], 0
        elif c == "万":
            total, section, digit = total + (section + digit or 1) * UNITS[c], 0, 0
        else:
            total, section, digit = (total + section + digit or 1) * UNITS[c], 0, 0
    return total + section + digit


def spoken_numbers(text: str) -> str:
    """Spoken percentages and decimals in figures; what is ambiguous stays."""
    digits = lambda s: "".join(str(DIGITS[c]) for c in s)

    def percent(m: re.Match) -> str:
        whole = cardinal(m[1])
        return m[0] if whole is None else f"{whole}.{digits(m[2])}%" if m[2] else f"{whole}%"

    def decimal(m: re.Match) -> str:
        whole = cardinal(m[1])
        return m[0] if whole is None else f"{whole}.{digits(m[2])}"

    return _SPACED.sub(r"\1.\2", _DECIMAL.sub(decimal, _PERCENT.sub(percent, text)))


def normalise_numbers(seg: DataFrame) -> DataFrame:
    """Segments with spoken numbers in figures, and the text before where it changed; only candidates reach Python."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(spoken_numbers)

    candidate = F.col("text").rlike(rf"百分之|点|\d\s*\.\s*\d")
    out = seg.withColumn("new", F.when(candidate, run(F.when(candidate, F.col("text")).otherwise(""))).otherwise(F.col("text")))
    return out.withColumn("before", F.when(F.col("new") != F.col("text"), F.col("text"))).withColumn("text", F.col("new")).drop("new")


def _matches(texts: Column, aliases: Broadcast) -> Column:
    """All places (start, end, canonical) of a shard's aliases in a text, of those that start together the longest.

    One automaton over all aliases, built once in a Python worker; the time of a text does not depend on their number.
    """

    @F.pandas_udf("array<struct<start:int,end:int,canonical:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = ahocorasick.Automaton()
        for alias, canonical in aliases.value:
            machine.add_word(alias, (len(alias), canonical))
        machine.make_automaton()
        for batch in batches:
            out = []
            for text in batch:
                longest: dict[int, tuple[int, str]] = {}
                for last, (size, canonical) in machine.iter(text or ""):
                    start = last - size + 1
                    if start not in longest or longest[start][0] <= last:
                        longest[start] = (last + 1, canonical)
                out.append([{"start": a, "end": z, "canonical": c} for a, (z, c) in sorted(longest.items())])
            yield pd.Series(out)

    return run(texts)


def apply_glossary(seg: DataFrame, glossary: DataFrame, shard_bytes: int = GLOSSARY_BYTES) -> DataFrame:
    """Aliases of an external glossary (alias, canonical) replaced, earliest first, then longest, without overlap.

    ``replaced`` counts them. Of several canonical names of an alias the smallest counts; empty and null aliases none; null texts
    stay null. The aliases are dealt by hash into shards of at most about ``shard_bytes``, so what is broadcast at once has that
    size whatever the glossary's; each shard finds its places, and one fold over all of a text's places chooses.
    """
    spark = seg.sparkSession
    aliases = glossary.where("alias <> ''").groupBy("alias").agg(F.min("canonical").alias("canonical")).where("canonical is not null")
    weight = F.octet_length("alias") + F.octet_length("canonical") + 64
    shards = -(-(aliases.agg(F.sum(weight)).first()[0] or 0) // shard_bytes)
    found = []
    for k in range(shards):
        part = aliases.where(F.pmod(F.xxhash64("alias"), F.lit(shards)) == k).collect() if shards > 1 else aliases.collect()
        found.append(_matches(F.col("text"), spark.sparkContext.broadcast([tuple(r) for r in part])))
    kind = "array<struct<start:int,end:int,canonical:string>>"
    if shards <= 1:
        rows = seg.withColumn("_places", found[0] if found else F.array().cast(kind))
    else:  # a worker holds one shard: each has its own pass over the texts, which then meet again
        keyed = seg.withColumn("_row", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
        texts = keyed.select("_row", "text").dropDuplicates(["_row"])
        passes = [texts.select("_row", one.alias("_found")) for one in found]
        every = passes[0]
        for one in passes[1:]:
            every = every.unionByName(one)
        rows = keyed.join(every.groupBy("_row").agg(F.flatten(F.collect_list("_found")).alias("_places")), "_row", "left").drop("_row")

    def choose(a: Column, x: Column) -> Column:
        free = x["start"] >= a["at"]
        text = F.concat(a["text"], F.substring("text", a["at"] + 1, x["start"] - a["at"]), x["canonical"])
        return F.when(free, F.struct(x["end"].alias("at"), text.alias("text"), (a["n"] + 1).alias("n"))).otherwise(a)

    order = F.array_sort("_places", lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["end"] - x["end"]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"))
    rows = rows.withColumn("_g", F.aggregate(order, start, choose))
    text = F.concat("_g.text", F.substring("text", F.col("_g.at") + 1, F.length("text")))
    return rows.withColumn("replaced", F.coalesce("_g.n", F.lit(0).cast("long"))).withColumn("text", F.when(F.col("_g.n") > 0, text).otherwise(F.col("text"))).drop("_g", "_places")


def set_strong_mark(t: Column, k: Column, cjk: Column, spaced: bool = True) -> Column:
    """``t`` with a strong mark behind its first ``k`` characters, before blanks there: a weak mark is replaced, a strong one
    stays. Outside Chinese, Japanese and Korean a blank follows, with ``spaced``, where neither blank nor closing mark does."""
    left = F.rtrim(F.regexp_replace(F.substring(t, F.lit(1), k.cast("int")), r"\s+$", ""))
    rest = F.substring(t, F.length(left) + 1, F.length(t))
    mark = F.when(cjk, "。").otherwise(".")
    blank = F.when(~cjk & rest.rlike(r"^[^\s)\]}】》〉”’\"']"), " ").otherwise("") if spaced else F.lit("")
    return (
        F.when((left == "") | left.rlike(f"[{X.STRONG_MARKS}]$"), t)
        .when(left.rlike(f"[{X.WEAK_MARKS}]$"), F.concat(F.substring(left, F.lit(1), F.length(left) - 1), mark, rest))
        .otherwise(F.concat(left, mark, blank, rest))
    )


def is_cjk(seg: DataFrame) -> Column:
    """Whether a segment's profile, if it has one, is written without blanks."""
    return F.coalesce(F.col("profile").isin(*X.CJK_PROFILES), F.lit(False)) if "profile" in seg.columns else F.lit(False)


def plain_blanks(text: Column, cjk: Column) -> Column:
    return F.when(cjk, F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(F.trim(F.regexp_replace(text, r"\s+", " ")))


def apply_punctuation(seg: DataFrame, evidence: DataFrame, least: float = 0.58) -> DataFrame:
    """Marks moved as evidence says: a strong mark set at each boundary (video_id, seg_idx, char_offset, confidence), and the
    mark at (remove_seg_idx, remove_char_offset), where those columns are there and filled, taken out (T9).

    Offsets are of the text before; edits go from the right, at one place the removal first.
    """
    sure = evidence.where(F.col("confidence") >= least)
    edits = sure.select("video_id", "seg_idx", F.struct(F.col("char_offset").cast("int").alias("at"), F.lit(False).alias("out")).alias("edit"))
    if "remove_char_offset" in evidence.columns:
        gone = sure.where("remove_seg_idx is not null and remove_char_offset is not null")
        edits = edits.unionByName(gone.select("video_id", F.col("remove_seg_idx").alias("seg_idx"), F.struct(F.col("remove_char_offset").cast("int").alias("at"), F.lit(True).alias("out")).alias("edit")))
    good = edits.groupBy("video_id", "seg_idx").agg(F.sort_array(F.collect_set("edit"), asc=False).alias("edits"))
    cjk = is_cjk(seg)

    def put(t: Column, e: Column) -> Column:
        mark = F.substring(t, e["at"] + 1, F.lit(1)).rlike(f"[{X.STRONG_MARKS}{X.WEAK_MARKS}]")
        without = F.when(mark & (e["at"] >= 0), F.concat(F.substring(t, F.lit(1), e["at"]), F.substring(t, e["at"] + 2, F.length(t)))).otherwise(t)
        return F.when(e["out"], without).otherwise(set_strong_mark(t, e["at"], cjk))

    out = seg.join(good, ["video_id", "seg_idx"], "left")
    return out.withColumn("text", F.when(F.col("edits").isNotNull(), plain_blanks(F.aggregate("edits", F.col("text"), put), cjk)).otherwise(F.col("text"))).drop("edits")


#: Words that are no names, and titles with their short forms.
STOPWORDS = (
    "a an and are as at be been but by for from had has have he her hers him his i if in into is it its me my no not of on or our please "
    "she so that the their them there they this to was we were what when where which who will with would you your"
).split()
TITLES = {"mrs": "mrs", "missus": "mrs", "mr": "mr", "mister": "mr", "ms": "ms", "dr": "dr", "doctor": "dr"}


def entity_candidates(seg: DataFrame) -> DataFrame:
    """Names in texts: a title with a capitalised word, CamelCase, acronyms outside all-capital prose (A1)."""
    t = F.col("text")
    titles = "|".join(TITLES)
    titled = F.regexp_extract_all(t, F.lit(rf"((?i:\b(?:{titles}))\b\.?\s*[A-Z][A-Za-z'-]+)"), F.lit(1))
    plain = F.regexp_extract_all(t, F.lit(r"(?<![A-Za-z'-])([A-Za-z'-]{2,})(?![A-Za-z'-])"), F.lit(1))
    # a name has two capitals, so the other words are not looked at one by one
    capital = F.regexp_extract_all(t, F.lit(r"(?<![A-Za-z'-])(?=[a-z'-]*+[A-Z][a-z'-]*+[A-Z])([A-Za-z'-]{2,})(?![A-Za-z'-])"), F.lit(1))
    letters, capitals = X.count_matches(t, "[A-Za-z]"), X.count_matches(t, "[A-Z]")
    prose = F.when(t.rlike("[A-Z][a-z'-]*[A-Z]"), (letters >= 12) & (F.size(plain) >= 3) & (capitals >= 0.9 * letters))

    def named(w: Column) -> Column:
        up, low = F.length(F.regexp_replace(w, "[^A-Z]", "")), F.length(F.regexp_replace(w, "[^a-z]", ""))
        kind = ((up >= 2) & (low == 0)) | ((F.length(w) >= 4) & (up >= 2) & (low >= 1))
        return kind & ~F.lower(w).isin(STOPWORDS)

    words = F.filter(capital, named)
    both = F.concat(F.transform(titled, lambda s: F.struct(F.lit(True).alias("titled"), s.alias("surface"))), F.transform(words, lambda s: F.struct(F.lit(False).alias("titled"), s.alias("surface"))))
    # whether a text is in capitals is found once, below the rows of its names
    rows = seg.select("video_id", "seg_idx", both.alias("both"), prose.alias("prose")).select("video_id", "seg_idx", "prose", F.explode("both").alias("c")).select("video_id", "seg_idx", "prose", "c.*")
    rows = rows.where(~(~F.col("titled") & F.col("prose") & F.col("surface").rlike("^[^a-z]+$")))
    title = F.lower(F.regexp_extract("surface", r"^([A-Za-z]+)", 1))
    name = F.regexp_extract("surface", r"([A-Z][A-Za-z'-]+)$", 1)
    short = F.element_at(F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv)), title)
    rows = rows.where(~F.col("titled") | ~F.lower(name).isin(STOPWORDS))
    return rows.select("video_id", "seg_idx", "surface", F.when(F.col("titled"), F.concat_ws(" ", short, F.lower(name))).otherwise(F.lower("surface")).alias("normalized"))


def entity_memory(seg: DataFrame, most: int = 32, candidates: DataFrame | None = None) -> DataFrame:
    """Names of a video that occur twice or more, with their best alias; the 32 most frequent (A1). ``candidates`` are those of
    ``entity_candidates``, where they are known already."""
    counts = (entity_candidates(seg) if candidates is None else candidates).groupBy("video_id", "normalized", "surface").agg(F.count(F.lit(1)).alias("n"))
    first = F.lower(F.regexp_extract("surface", r"^([A-Za-z]+)\b", 1))
    score = F.struct((first.isin(list(TITLES)) & (F.length(first) <= 3)).cast("int").alias("short"), F.col("n"), F.lower("surface").alias("s"), F.col("surface").alias("x"))
    groups = counts.groupBy("video_id", "normalized").agg(F.max(score)["x"].alias("canonical"), F.sum("n").alias("occurrences")).where("occurrences >= 2")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("occurrences"), "canonical"))
    return groups.withColumn("rank", rank).where(F.col("rank") <= most)


def hotwords(variants: DataFrame, memory: DataFrame, most: int = 12) -> DataFrame:
    """Distinct words whatever their case, variants first, then memory by rank, at most 12 a video."""
    rows = variants.select("video_id", "word", F.lit(0).alias("part"), F.col("pos")).unionByName(memory.select("video_id", F.col("canonical").alias("word"), F.lit(1).alias("part"), F.col("rank").alias("pos")))
    one = rows.groupBy("video_id", F.lower("word").alias("key")).agg(F.min(F.struct("part", "pos", "word")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("m.part", "m.pos", "key"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most).select("video_id", "rank", "m.word")


def _outermost(text: str) -> str | None:
    best, stack, quoted, skip = None, [], False, False
    for i, c in enumerate(text):
        if quoted:
            skip, quoted = (c == "\\" and not skip), not (c == '"' and not skip)
        elif c == '"' and stack:
            quoted = True
        elif c == "{":
            stack.append(i)
        elif c == "}" and stack:
            start = stack.pop()
            if best is None or i > best[1] or start < best[0]:
                best = (start, i)
    return None if best is None else text[best[0] : best[1] + 1]


def extract_json(df: DataFrame, column: str) -> DataFrame:
    """The outermost JSON object of noisy text: the latest that closes, from its earliest brace (T14); null without one."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _outermost(t or ""))

    return df.withColumn("json", run(column))


def merge_points(points: Column, most: int = 10) -> Column:
    """Key points without bullets and numbers, blanks out, first occurrences in order, at most ten."""
    clean = F.transform(points, lambda p: F.trim(F.regexp_replace(p, r"^\s*(?:[-*•·]|\d+[.)、])\s*", "")))
    return F.slice(F.array_distinct(F.filter(clean, lambda p: p != "")), 1, most)


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """Token edit ratio and size ratio of (first_pass, observed): tokens become single characters for one edit distance.

    The characters are of the planes beyond the first, a million of them, one for each distinct token of the pair.
    """
    rows = pairs.withColumn("a", X.tokens(F.col("first_pass"))).withColumn("b", X.tokens(F.col("observed")))
    rows = rows.withColumn("all", F.array_distinct(F.concat("a", "b")))
    point = lambda t: F.lpad(F.hex(F.array_position("all", t) + 0xFFFF), 8, "0")
    letters = lambda arr: F.decode(F.unhex(F.array_join(F.transform(arr, point), "")), "UTF-32")
    rows = rows.withColumn("ca", letters("a")).withColumn("cb", letters("b"))
    longest = F.greatest(F.size("a"), F.size("b"), F.lit(1))
    return rows.select(
        *pairs.columns, F.round(F.levenshtein("ca", "cb") / longest, 6).alias("edit_ratio"),
        F.round(F.size("b") / F.greatest(F.size("a"), F.lit(1)), 6).alias("size_ratio"), (F.col("ca") == F.col("cb")).alias("equivalent"),
    )


def safety_gate(metrics: DataFrame, edit: float = 0.55, context: float = 0.65, coverage: float = 0.35) -> DataFrame:
    """Decision on a proposed rewrite from its metrics, with the reasons against it."""
    grounded = F.col("time_grounded") & (F.col("coverage") >= coverage)
    aligned = F.col("text_aligned") & (F.col("context") >= context)
    kind = F.when(F.trim("observed") == "", "fragment_removal").when(F.col("edit_ratio") <= edit, "lexical_replacement").otherwise("large_rewrite")
    against = F.array_compact(F.array(
        F.when(~F.col("time_grounded"), "TARGET_NOT_PRECISELY_TIME_GROUNDED"), F.when(~F.col("text_aligned"), "TARGET_NOT_TEXT_ALIGNED"),
        F.when(F.col("time_grounded") & (F.col("coverage") < coverage), "TARGET_TIME_COVERAGE_LOW"), F.when(F.col("context") < 0.40, "CONTEXT_PRESERVATION_LOW"),
    ))
    safe = (F.col("context") >= 0.40) & (grounded | aligned)
    decision = F.when(F.col("equivalent") & safe, "VERIFIED").when(safe & (kind != "large_rewrite"), "CORRECTED").otherwise("UNCERTAIN")
    return metrics.withColumns({"kind": kind, "decision": decision, "reasons": against})


def outcome_counts(verdicts: DataFrame) -> DataFrame:
    """Decisions per video (A10)."""
    one = lambda d: F.count_if(F.col("decision") == d).alias(d.lower())
    return verdicts.groupBy("video_id").agg(one("CORRECTED"), one("VERIFIED"), one("UNCERTAIN"))


def clean_chapters(drafts: DataFrame, seg: DataFrame, most: int = 8, near_ms: int = 10_000) -> DataFrame:
    """Chapters (video_id, start_idx, title, content) placed at their segment's start, in order; repeats of the last kept
    title or content within 10 s go, eight stay (W23)."""
    at = seg.select("video_id", F.col("seg_idx").alias("start_idx"), "start_ms")
    rows = drafts.join(at, ["video_id", "start_idx"]).where(F.trim("title") != "")
    s = rows.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("start_ms", "start_idx", F.trim("title").alias("title"), F.trim("content").alias("content")))).alias("s"))

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        again = last.isNotNull() & ((last["title"] == x["title"]) | (last["content"] == x["content"])) & (x["start_ms"] - last["start_ms"] <= near_ms)
        return F.when(again, a).otherwise(F.concat(a, F.array(x)))

    kept = s.select("video_id", F.slice(F.aggregate("s", F.array().cast("array<struct<start_ms:bigint,start_idx:bigint,title:string,content:string>>"), step), 1, most).alias("kept"))
    return kept.select("video_id", F.posexplode("kept").alias("chapter", "c")).select("video_id", F.col("chapter").cast("long").alias("chapter"), "c.*")


def derive_evidence(repairs: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """The typed evidence tables that follow from pause repairs and verification results."""
    moved = [c for c in ("remove_seg_idx", "remove_char_offset") if c in repairs.columns]
    return {
        "boundary": repairs.where("confidence >= 0.5").select("video_id", "seg_idx", "char_offset", "confidence"),
        "punctuation": repairs.where("confidence >= 0.58 and language_supported").select("video_id", "seg_idx", "char_offset", *moved, "confidence"),
        "rewrite": results.where("decision = 'CORRECTED'").select("video_id", "seg_idx", "observed"),
        "surface": results.where("decision = 'VERIFIED' and severe").select("video_id", "seg_idx", "observed"),
    }
