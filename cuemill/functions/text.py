"""Expressions over text columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of ASCII letters, digits and underscores, or any other single character but space and ASCII punctuation.
TOKEN = r"([0-9a-z_]+|[^\s0-9a-z_!-/:-@\[-`{-~])"
#: ASCII words with inner apostrophes and hyphens.
LEXICAL = r"([0-9a-z'’-]+)"
STRONG_MARKS = ".?!。？！"
WEAK_MARKS = ",;:，；：、"
CJK_PROFILES = ("Zh", "Ja", "Ko")
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
# Scripts as ranges of code points.
HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"
KANA = r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}]"
HANGUL = r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"
ASCII_PUNCT = r"!-/:-@\[-`{-~"


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold_width(text: Column) -> Column:
    """Full-width ASCII forms as ASCII."""
    return F.translate(text, _FULL, _HALF)


def tokens(text: Column) -> Column:
    """Mixed-script tokens in order."""
    return F.regexp_extract_all(F.lower(fold_width(text)), F.lit(TOKEN), F.lit(1))


def lexical_units(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LEXICAL), F.lit(1))


def count_matches(text: Column, pattern: str) -> Column:
    """Characters of the text that match a one-character pattern; they are taken out by runs."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"(?:{pattern})++", ""))).cast("long")


def latin_words(text: Column) -> Column:
    words = F.split(text, rf"[\s{ASCII_PUNCT}]+")
    return F.size(F.filter(words, lambda w: w.rlike("[A-Za-z]"))).cast("long")


def language(text: Column) -> Column:
    """Dominant language by scripts: kana, hangul, Chinese rules, else English."""
    han, kana, hangul = (count_matches(text, p) for p in (HAN, KANA, HANGUL))
    latin = latin_words(text)
    chinese = ((kana == 0) & (hangul == 0)) & (((han > 0) & (latin == 0)) | (han >= 15) | ((han >= 4) & (han >= latin)))
    return (
        F.when((kana > 0) & (kana >= hangul) & (kana >= han), "Japanese")
        .when((hangul > 0) & (hangul >= han), "Korean")
        .when(chinese, "Chinese")
        .when((latin >= 3) & (latin >= han), "English")
        .when(han > 0, "Chinese")
        .otherwise("English")
    )


def language_profile(tag: Column) -> Column:
    """Profile of a language tag; anything unknown, or none, is Auto (P5)."""
    t = F.lower(F.trim(text_of(tag)))
    return (
        F.when(t.startswith("zh") | t.isin("cmn", "yue", "chinese", "mandarin"), "Zh")
        .when(t.startswith("en") | (t == "english"), "En")
        .when(t.startswith("ja") | (t == "japanese"), "Ja")
        .when(t.startswith("ko") | (t == "korean"), "Ko")
        .when(t == "mixed", "Mixed")
        .otherwise("Auto")
    )


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


#: Host suffixes of each platform.
PLATFORM_HOSTS = {
    "bilibili": ("bilibili.com", "b23.tv"),
    "douyin": ("douyin.com",),
    "youtube": ("youtube.com", "youtu.be"),
    "tiktok": ("tiktok.com",),
    "twitter": ("twitter.com", "x.com"),
    "kuaishou": ("kuaishou.com",),
    "xiaohongshu": ("xiaohongshu.com", "xhslink.com"),
    "weibo": ("weibo.com", "weibo.cn"),
}


def platform_of(url: Column) -> Column:
    """Platform by host suffix, else ``video``."""
    host = text_of(host_of(url))
    out = None
    for name, hosts in PLATFORM_HOSTS.items():
        hit = F.lit(False)
        for h in hosts:
            hit = hit | (host == h) | host.endswith("." + h)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("video")


def source_key(platform: Column, source: Column) -> Column:
    """One key for all spellings of a source (P1). The text is lower-cased before it is read as a URL."""
    low, kind = F.lower(F.trim(source)), F.lower(text_of(platform))
    bv = F.regexp_extract(F.upper(source), "BV([A-Z0-9]{0,10})", 1)
    host = text_of(F.try_parse_url(low, F.lit("HOST")))
    path_id = F.regexp_replace(text_of(F.try_parse_url(low, F.lit("PATH"))), "^/+", "")
    query_id = text_of(F.try_parse_url(low, F.lit("QUERY"), F.lit("v")))
    is_short = (host == "youtu.be") | host.endswith(".youtu.be")
    is_tube = (kind == "youtube") | low.contains("youtube.com") | low.contains("youtu.be")
    plain = F.regexp_replace(F.regexp_replace(low, r"[?#].*$", ""), "/+$", "")
    return (
        F.when(kind == "local", F.concat(F.lit("local:"), F.replace(low, F.lit("\\"), F.lit("/"))))
        .when((kind == "bilibili") & (F.length(bv) >= 8), F.concat(F.lit("bilibili:bv"), F.lower(bv)))
        .when(is_tube & is_short & (path_id != ""), F.concat(F.lit("youtube:"), path_id))
        .when(is_tube & ~is_short & (query_id != ""), F.concat(F.lit("youtube:"), query_id))
        .when(low.rlike("^[a-z][a-z0-9+.-]*://[^/?#]"), plain)
        .otherwise(low)
    )


def clock(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm."""
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def short_clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    s = F.greatest(F.round(seconds), F.lit(0)).cast("long")
    hours = F.floor(s / 3600)
    rest = F.format_string("%02d:%02d", F.floor(s / 60) % 60, s % 60)
    return F.when(hours > 0, F.concat(F.format_string("%02d:", hours), rest)).otherwise(rest)


def _one_decimal(raw: Column, unit: int) -> Column:
    """``raw / unit`` with one decimal, rounded as the exact value of the double is, ties to the even digit.

    Only a remainder of exactly half a tenth needs a look at the double: twenty times its fraction against the odd
    number it stands for, in terms that doubles hold exactly.
    """
    tenth = unit // 10
    low, rest = F.floor(raw / tenth), raw % tenth
    value = raw / float(unit)
    part = value - F.floor(value)
    odd = (low % 10) * 2 + 1 - part * 4
    up = F.when(rest != tenth // 2, rest > tenth // 2).when(part * 16 != odd, part * 16 > odd).otherwise(low % 2 == 1)
    tenths = low + up.cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def play_count(raw: Column) -> Column:
    """Counts from ten thousand and from a hundred million on with one decimal and their unit (P10)."""
    return (
        F.when(raw >= 100_000_000, F.concat(_one_decimal(raw, 100_000_000), F.lit("亿")))
        .when(raw >= 10_000, F.concat(_one_decimal(raw, 10_000), F.lit("万")))
        .otherwise(raw.cast("string"))
    )


def china_date(epoch: Column) -> Column:
    """Date at UTC+8 of epoch seconds; empty for zero and below."""
    return F.when(epoch > 0, F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor((epoch + 28800) / 86400).cast("int")), "yyyy-MM-dd")).otherwise("")


def strip_html(text: Column) -> Column:
    """Text without tags, the five basic entities replaced, trimmed."""
    out = F.regexp_replace(text, "<[^>]*>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def clean_asr(text: Column) -> Column:
    """Recogniser output without model, speaker and time tags."""
    out = F.regexp_replace(text, r"<\|[^|]*\|>", "")
    out = F.regexp_replace(out, r"\[(?:S\d+|[0-9]+(?:\.[0-9]+)?)\]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def clean_translation(text: Column) -> Column:
    """Model output without chat markers, role and label prefixes, end tokens, back-ticks and blank lines."""
    out = F.regexp_replace(text, r"<\|(?:im_start|im_end|endoftext)\|>|</s>|<s>", "")
    out = F.regexp_replace(out, r"(?i)^(?:\s*(?:assistant|user|system|translation|translated text|output)\s*[:：]?\s*\n|\s*(?:assistant|translation|translated text|output)\s*[:：]\s*)+", "")
    out = F.regexp_replace(out, r"```[a-z]*", "")
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.trim(F.array_join(lines, "\n"))


def collapse_marks(text: Column) -> Column:
    """Runs of CJK marks as their strongest mark; among equals the first."""
    run = r"[，、；：。！？]*"
    out = F.regexp_replace(text, rf"[，、；：。]*([！？]){run}", "$1")
    out = F.regexp_replace(out, r"[，、；：]*(。)[，、；：。]*", "$1")
    return F.regexp_replace(out, r"([，、；：])[，、；：]+", "$1")
