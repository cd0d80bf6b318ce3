"""The registered queries of the transcript jobs, and the same results as DuckDB SQL.

Every query reads the test tables in full. Integers come out as BIGINT, doubles rounded, lists as text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.functions.settle import settled
from cuemill.operators import bridges as G
from cuemill.operators import canonical as C
from cuemill.operators import clauses as Z
from cuemill.operators import edits as D
from cuemill.operators import joins as J
from cuemill.operators import notes as N
from cuemill.operators import pauses as B
from cuemill.operators import repair as P
from cuemill.operators import search as K
from cuemill.operators import segments as S
from cuemill.operators import sentences as SE
from cuemill.operators import sequence as W
from cuemill.operators import tables as T
from cuemill.operators import typography as Y
from cuemill.operators import verify as A
from cuemill.plans import views as V
from cuemill.sources import formats as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, lists as text."""
    kind = dict(df.dtypes)
    one = lambda c: F.col(c).cast("long") if kind[c] in ("int", "smallint", "tinyint") else F.concat_ws(",", F.col(c).cast("array<string>")) if kind[c].startswith("array") else F.col(c)
    return df.select(*(one(c).alias(c) for c in df.columns))


def query(name: str, sql: str | None = None, views: str = "", recursive: bool = False):
    def add(f):
        QUERIES[name] = lambda spark, d: flat(f(spark, d))
        if sql:
            SQL[name] = V.oracle(views, sql, recursive) if views else sql.strip()
        return f

    return add


LATIN = r"len(list_filter(regexp_split_to_array(text, '[\s!-/:-@\[-`{-~]+'), lambda w: regexp_matches(w, '[A-Za-z]')))"
LANGUAGE = f"CASE WHEN {LATIN} >= 0 THEN 'English' END"
UNITS = "regexp_extract_all(lower(text), '([0-9a-z''’-]+)', 1)"


def letters(column: str = "text", kind: str = "A-Za-z") -> str:
    return f"(length({column}) - length(regexp_replace({column}, '[{kind}]', '', 'g')))"


# --- sources and sinks -----------------------------------------------------------------------------------------


@query("s1_transcripts", "SELECT video_id, seg_idx, segment_id, start_ms, end_ms, text, CASE video_id % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'checkpoint' ELSE 'raw' END AS source FROM seg", "seg")
def _(spark, d):
    one = F.struct("seg_idx", F.struct(F.col("segment_id").alias("id"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text").alias("s"))
    docs = V.seg(spark, d).groupBy("video_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]).alias("segments"))).alias("body"))
    broken = docs.withColumn("body", F.when(F.col("video_id") % 3 == 2, "{broken").otherwise(F.col("body")))
    return R.resolve_transcripts(docs.where("video_id % 3 = 0"), broken.where("video_id % 3 > 0"), docs)


SRT_CLOCK = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


def _srt_sql(text: str) -> str:
    return f"""SELECT video_id, string_agg(n || chr(10) || {SRT_CLOCK.format('start_ms')} || ' --> ' || {SRT_CLOCK.format('end_ms')} || chr(10) || {text}, chr(10) || chr(10) ORDER BY n) || chr(10) AS body
        FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, seg_idx) AS n FROM seg) GROUP BY 1"""


@query("s2_srt_ingest", "SELECT video_id::VARCHAR AS file, seg_idx AS cue, start_ms, end_ms, trim(text, ' ' || chr(10)) AS text FROM seg", "seg")
def _(spark, d):
    return R.parse_srt(R.srt_text(V.seg(spark, d)).select(F.col("video_id").cast("string").alias("file"), "body"))


@query("s3_asr_json", "SELECT video_id::VARCHAR AS id, seg_idx AS cue, start_ms / 1000 AS start_s, end_ms / 1000 AS end_s, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM seg", "seg")
def _(spark, d):
    shapes = ["segments", "utterances", "results", "chunks"]
    late = F.struct("seg_idx", F.struct((F.col("start_ms") / 1000).alias("start_time"), (F.col("end_ms") / 1000).alias("end_time"), F.col("text").alias("transcript")).alias("s"))
    lists = V.seg(spark, d).groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(late)), lambda x: x["s"]).alias("items"))
    body = None
    for i, name in enumerate(shapes):
        inner = F.struct(F.col("items").alias(name))
        text = F.to_json(F.struct(inner.alias("result")) if i % 2 else inner)
        body = F.when(F.col("video_id") % 4 == i, text) if body is None else body.when(F.col("video_id") % 4 == i, text)
    return R.parse_asr_json(lists.select(F.col("video_id").cast("string").alias("id"), body.alias("body"), F.lit(1e6).alias("duration")))


@query("s4_silence_log", "SELECT video_id::VARCHAR AS file, start_ms / 1000 AS start_s, end_ms / 1000 AS end_s FROM speech WHERE end_ms > start_ms", "speech")
def _(spark, d):
    rows = V.speech(spark, d).select(F.col("video_id").cast("string").alias("file"), (F.col("seg_idx") * 3).alias("k"), (F.col("start_ms") / 1000).cast("string").alias("a"), (F.col("end_ms") / 1000).cast("string").alias("b"))
    lines = rows.select("file", F.posexplode(F.array(F.concat(F.lit("[silence] silence_start: "), "a"), F.concat(F.lit("silence_end: "), "b", F.lit(" | silence_duration: 1")), F.lit("frame=1"))).alias("j", "line"), "k")
    return R.parse_silence_log(lines.select("file", (F.col("k") + F.col("j")).alias("line_no"), "line"))


@query("s5_srt_sink", _srt_sql("trim(text)"), "seg")
def _(spark, d):
    return R.srt_text(V.seg(spark, d))


@query("s5_srt_bilingual", _srt_sql("CASE WHEN trim(coalesce(translated_text, '')) <> '' THEN trim(text) || chr(10) || trim(translated_text) ELSE trim(text) END"), "seg")
def _(spark, d):
    return R.srt_text(V.seg(spark, d), bilingual=True)


@query(
    "s6_markdown",
    """SELECT video_id, '---' || chr(10) || 'title: "Talk ' || video_id || '"' || chr(10) || '---' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || first_text || chr(10) || chr(10)
        || '## Key points' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || body || chr(10) AS body FROM (
        SELECT video_id, max(CASE WHEN seg_idx = 0 THEN text END) AS first_text, string_agg('**[' || printf('%02d:%02d', start_ms // 60000 % 60, start_ms // 1000 % 60) || ']** ' || trim(text)
        || CASE WHEN translated_text IS NOT NULL THEN chr(10) || '> ' || trim(translated_text) ELSE '' END, chr(10) || chr(10) ORDER BY seg_idx) AS body FROM seg GROUP BY 1)""",
    "seg",
)
def _(spark, d):
    seg = V.seg(spark, d)
    notes = seg.where("seg_idx = 0").select("video_id", F.concat(F.lit("Talk "), "video_id").alias("title"), F.col("text").alias("summary"), F.array(F.lit("one"), F.lit("two")).alias("key_points"))
    return R.markdown(seg, notes)


@query("s7_plain_text", "SELECT video_id, string_agg(text, chr(10) ORDER BY start_ms, seg_idx) AS body FROM seg GROUP BY 1", "seg")
def _(spark, d):
    return S.transcript_text(V.seg(spark, d))


@query(
    "s8_search_results",
    """SELECT page_id AS page, 0::BIGINT AS at, 'BV' || lpad(page_id::VARCHAR, 10, '1') AS id, trim(replace(replace(replace(replace(replace(regexp_replace(title, '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39))) AS title, host AS author, 'https://' || host || '/c.jpg' AS cover,
        'https://www.bilibili.com/video/BV' || lpad(page_id::VARCHAR, 10, '1') AS url,
        CASE WHEN n >= 100000000 THEN printf('%.1f', n / 1e8) || '亿' WHEN n >= 10000 THEN printf('%.1f', n / 1e4) || '万' ELSE n::VARCHAR END AS plays, '2024-01-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0') AS published
        FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, page_id * 977 AS n FROM pages) WHERE page_id % 9 <> 0""",
)
def _(spark, d):
    p = V.table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"), F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("host"))
    item = F.struct(
        F.when(F.col("page_id") % 9 != 0, F.concat(F.lit("BV"), F.lpad(F.col("page_id").cast("string"), 10, "1"))).otherwise("").alias("bvid"), F.concat(F.lit("<em class='k'>"), F.col("t"), F.lit("</em> ")).alias("title"),
        F.col("host").alias("author"), F.concat(F.when(F.col("page_id") % 2 == 0, "//").otherwise("http://"), F.col("host"), F.lit("/c.jpg")).alias("pic"), (F.col("page_id") * 977).alias("play"),
        (F.lit(1704067200) + F.col("page_id") % 28 * 86400).alias("pubdate"),
    )
    return R.read_search_results(p.select(F.col("page_id").alias("page"), F.to_json(F.struct(F.struct(F.array(item).alias("result")).alias("data"))).alias("body")))


@query("s9_links", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://www.douyin.com/video/' || page_id ELSE url END AS url, CASE WHEN page_id % 4 = 0 THEN 'douyin' ELSE 'video' END AS platform FROM pages")
def _(spark, d):
    own = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.douyin.com/jingxuan?modal_id="), F.col("page_id"))).otherwise(F.col("url"))
    text = F.concat(F.lit("7.43 copy http://localhost:80/x】 see "), own, F.lit("），now，https://other.org/"))
    return R.extract_links(V.table(spark, d, "pages").select("page_id", text.alias("t")), "page_id", "t")


@query(
    "s11_media_fingerprint",
    """SELECT doc_id, strlen(text) AS n_bytes, sha256(strlen(text) || ':' || upper(substr(h, 1, 131072)) || ':' || upper(substr(h, 2 * (greatest(n - 65536, 0) // 2) + 1, 131072)) || ':' || upper(substr(h, 2 * greatest(n - 65536, 0) + 1, 131072))) AS fingerprint
        FROM (SELECT doc_id, text, hex(encode(text)) AS h, strlen(text) AS n FROM documents)""",
)
def _(spark, d):
    return S.media_fingerprint(V.table(spark, d, "documents"), "doc_id", "text")


@query(
    "s11_same_media",
    """SELECT sha256(n || ':' || upper(substr(h, 1, 131072)) || ':' || upper(substr(h, 2 * (greatest(n - 65536, 0) // 2) + 1, 131072)) || ':' || upper(substr(h, 2 * greatest(n - 65536, 0) + 1, 131072))) AS fingerprint, n AS n_bytes,
        min(doc_id) AS first_id, count(*) AS files FROM (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents) GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(spark, d):
    return S.same_media(S.media_fingerprint(V.table(spark, d, "documents"), "doc_id", "text"), "doc_id")


# --- projections and filters -------------------------------------------------------------------------------------


@query("p1_source_key", r"SELECT video_id, rtrim(regexp_replace(lower(trim(source_url)), '[?#].*$', ''), '/') AS source_key FROM video", "video")
def _(spark, d):
    return J.with_source_key(V.video(spark, d)).select("video_id", "source_key")


@query("p2_platform", "SELECT video_id, ['bilibili', 'douyin', 'youtube', 'youtube', 'twitter', 'video', 'weibo', 'xiaohongshu'][1 + video_id % 8] AS platform FROM video", "video")
def _(spark, d):
    hosts = ["www.bilibili.com", "v.douyin.com", "youtu.be", "m.youtube.com", "x.com", "notx.com", "weibo.cn", "xhslink.com"]
    url = F.concat(F.lit("HTTPS://"), F.element_at(F.array(*map(F.lit, hosts)), (F.col("video_id") % 8 + 1).cast("int")), F.lit("/a?b=1"))
    return V.video(spark, d).select("video_id", X.platform_of(url).alias("platform"))


FILTER = "library_available_at IS NOT NULL AND deleted_at IS NULL AND (contains(lower(title), 'an') OR contains(lower(author), 'an') OR contains(lower(source_url), 'an'))"


@query("p3_library_filter", f"SELECT video_id, title, platform FROM video WHERE {FILTER} AND lower(platform) = 'com'", "video")
def _(spark, d):
    return T.library_filter(V.video(spark, d), "AN", "COM").select("video_id", "title", "platform")


@query("p4_language", f"SELECT doc_id, {LATIN}::BIGINT AS latin_words, 0::BIGINT AS han, 0::BIGINT AS kana, 0::BIGINT AS hangul, 'English' AS language FROM documents")
def _(spark, d):
    return S.with_language(V.table(spark, d, "documents")).select("doc_id", "latin_words", "han", "kana", "hangul", "language")


@query("p5_profile", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Zh' WHEN lang = 'en' THEN 'En' ELSE 'Auto' END AS profile, NOT (doc_id % 3 = 0 OR lang = 'en') AS fallback FROM documents")
def _(spark, d):
    profile = X.language_profile(F.when(F.col("doc_id") % 3 == 0, "zh-Hans").otherwise(F.col("lang")))
    return V.table(spark, d, "documents").select("doc_id", profile.alias("profile"), (profile == "Auto").alias("fallback"))


@query("p6_pending_translation", "SELECT video_id, seg_idx FROM seg WHERE translated_text IS NULL", "seg")
def _(spark, d):
    return S.pending_translation(V.seg(spark, d)).select("video_id", "seg_idx")


@query("p7_valid_ids", "SELECT video_id, regexp_matches(author || CASE WHEN video_id % 2 = 0 THEN '' ELSE '!' END, '^[A-Za-z0-9_-]{1,64}$') AS ok FROM video", "video")
def _(spark, d):
    rows = V.video(spark, d).select("video_id", F.concat("author", F.when(F.col("video_id") % 2 == 0, "").otherwise("!")).alias("id"))
    good, bad = T.split_valid(rows, "id")
    return good.select("video_id", F.lit(True).alias("ok")).unionByName(bad.select("video_id", F.lit(False).alias("ok")))


@query("p8_standard_view", "SELECT s.video_id, s.seg_idx, s.start_ms / 1000 AS start, s.end_ms / 1000 AS end, s.text, round(c, 6) AS avg_confidence FROM seg s LEFT JOIN (SELECT video_id, seg_idx, avg(confidence) AS c FROM tok GROUP BY 1, 2) t USING (video_id, seg_idx)", "tok")
def _(spark, d):
    return S.standard_view(V.seg(spark, d), V.tok(spark, d))


@query("p9_note_text", "SELECT video_id, seg_idx, coalesce(trim(translated_text), trim(text)) AS note_text, trim(text) || coalesce(' (' || trim(translated_text) || ')', '') AS snippet FROM seg", "seg")
def _(spark, d):
    return S.note_text(V.seg(spark, d)).select("video_id", "seg_idx", "note_text", "snippet")


@query("p10_display", "SELECT event_id, CASE WHEN n >= 100000000 THEN printf('%.1f', n / 1e8) || '亿' WHEN n >= 10000 THEN printf('%.1f', n / 1e4) || '万' ELSE n::VARCHAR END AS plays, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS published FROM (SELECT *, event_id * event_id AS n FROM events)")
def _(spark, d):
    epoch = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return V.table(spark, d, "events").select("event_id", X.play_count(F.col("event_id") * F.col("event_id")).alias("plays"), X.china_date(epoch).alias("published"))


@query("p11_violations", "SELECT video_id, seg_idx, 'token_outside' AS error, count(*) AS n FROM tok JOIN (SELECT video_id, seg_idx, end_ms AS e FROM seg) USING (video_id, seg_idx) WHERE tok.end_ms + CASE WHEN tok.pos % 7 = 6 THEN 10000 ELSE 0 END > e GROUP BY 1, 2", "tok")
def _(spark, d):
    late = V.tok(spark, d).withColumn("end_ms", F.col("end_ms") + F.when(F.col("pos") % 7 == 6, 10_000).otherwise(0))
    return S.violations(V.seg(spark, d), late)


@query("p12_queue_list", "SELECT item_id, q.video_id, q.state, title FROM qstate q LEFT JOIN video v USING (video_id) WHERE q.state IN ('queued', 'running', 'paused', 'blocked', 'failed')", "qstate video")
def _(spark, d):
    return T.queue_list(V.qstate(spark, d), V.video(spark, d)).select("item_id", "video_id", "state", "title")


# --- joins -------------------------------------------------------------------------------------------------------


KEYED = "p AS (SELECT page_id, url, rtrim(regexp_replace(lower(url), '[?#].*$', ''), '/') AS source_key FROM pages)"


@query("j1_source_lookup", f"WITH {KEYED} SELECT page_id AS pos, url || '?utm=1#t' AS source_url, source_key, v AS video_id FROM p JOIN (SELECT source_key, min(page_id) AS v FROM p GROUP BY 1) USING (source_key) WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'https://none.org/' || page_id, 'https://none.org/' || page_id, NULL FROM pages WHERE page_id % 2 = 1")
def _(spark, d):
    known = F.col("page_id") % 2 == 0
    url = F.when(known, F.concat("url", F.lit("?utm=1#t"))).otherwise(F.concat(F.lit("https://none.org/"), "page_id"))
    return J.lookup_sources(V.table(spark, d, "pages").select(F.col("page_id").alias("pos"), F.lit("video").alias("platform"), url.alias("source_url")), V.video(spark, d))


@query(
    "j2_hydrate",
    """WITH h AS (SELECT v.video_id, coalesce(max(CASE WHEN artifact_type = 'standard_transcript' THEN a.state END), 'missing') AS transcript_status, coalesce(max(CASE WHEN artifact_type = 'translation' THEN a.state END), 'missing') AS translation_status,
        'missing' AS note_status, any_value(q.item_id) AS queue_item_id FROM video v LEFT JOIN artifact a USING (video_id)
        LEFT JOIN (SELECT video_id, arg_min(item_id, ts) AS item_id FROM qstate WHERE state NOT IN ('cancelled', 'completed') GROUP BY 1) q USING (video_id) GROUP BY 1)
        SELECT video_id, CASE WHEN transcript_status = 'ready' AND (video_id % 11 = 0 OR video_id % 5 = 0) THEN 'failed' ELSE transcript_status END AS transcript_status,
        CASE WHEN translation_status = 'ready' AND (video_id % 11 = 0 OR video_id % 3 = 0) THEN 'missing' ELSE translation_status END AS translation_status, note_status, queue_item_id,
        CASE WHEN video_id % 11 <> 0 AND video_id % 2 = 0 THEN 'available' ELSE 'missing' END AS media_status, CASE WHEN video_id % 11 <> 0 THEN 'en' END AS transcript_language FROM h""",
    "video artifact qstate",
)
def _(spark, d):
    """All videos but each eleventh have files, of which some are not valid."""
    ok = lambda n: (F.col("video_id") % n != 0).alias
    files = V.video(spark, d).where("video_id % 11 <> 0").select(
        "video_id", (F.col("video_id") % 2 == 0).alias("media_ok"), ok(5)("transcript_ok"), ok(3)("translation_ok"), F.lit(False).alias("note_ok"), F.lit("en").alias("language")
    )
    return J.hydrate(V.video(spark, d), V.artifact(spark, d), V.qstate(spark, d), files)


def _points(spark, d, step=1000):
    last = V.seg(spark, d).groupBy("video_id").agg(F.max("end_ms").alias("m"))
    return last.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / step))).alias("k")).select("video_id", (F.col("k") * step).alias("t"))


POINTS = "points AS (SELECT video_id, unnest(generate_series(0, m // 1000)) * 1000 AS t FROM (SELECT video_id, max(end_ms) AS m FROM seg GROUP BY 1))"


@query("j3_asof_segment", f"WITH {POINTS} SELECT p.video_id, t, CASE WHEN t <= s.end_ms + 300 THEN seg_idx END AS seg_idx FROM points p ASOF LEFT JOIN seg s ON p.video_id = s.video_id AND p.t >= s.start_ms", "seg")
def _(spark, d):
    return J.asof_segment(_points(spark, d), V.seg(spark, d), 300)


PAUSES = "pauses AS (SELECT video_id, seg_idx, end_ms AS from_ms, gap AS gap_ms, end_ms + gap // 2 AS mid_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY video_id ORDER BY seg_idx) - end_ms AS gap FROM speech) WHERE gap BETWEEN 200 AND 3000)"


@query(
    "j4_nearest_pause",
    f"""WITH {PAUSES} SELECT video_id, t, m.mid_ms, m.d AS distance FROM (SELECT s.video_id, s.start_ms AS t, min({{'d': abs(s.start_ms - p.mid_ms), 'mid_ms': p.mid_ms}}) AS m
        FROM (SELECT DISTINCT video_id, start_ms FROM speech) s JOIN pauses p ON s.video_id = p.video_id AND p.mid_ms BETWEEN s.start_ms - 750 AND s.start_ms + 750 GROUP BY 1, 2)""",
    "speech",
)
def _(spark, d):
    speech = V.speech(spark, d)
    return J.nearest_pause(speech.select("video_id", F.col("start_ms").alias("t")).distinct(), W.pauses(speech))


@query(
    "j5_nearest_evidence",
    """WITH c AS (SELECT video_id, seg_idx, length(text) // 2 AS char_offset FROM line_seg), e AS (SELECT video_id, seg_idx, unnest([length(text) // 2 - 9, length(text) // 3]) AS o FROM line_seg)
        SELECT video_id, seg_idx, char_offset, m.o AS evidence_offset, m.g AS gap FROM (SELECT video_id, seg_idx, char_offset, min({'g': abs(char_offset - o), 'o': o}) AS m FROM c JOIN e USING (video_id, seg_idx) WHERE abs(char_offset - o) <= 14 GROUP BY 1, 2, 3)""",
    "line_seg",
)
def _(spark, d):
    lines = V.line_seg(spark, d)
    half = F.floor(F.length("text") / 2)
    evidence = lines.select("video_id", "seg_idx", F.explode(F.array(half - 9, F.floor(F.length("text") / 3))).alias("evidence_offset"))
    return J.nearest_evidence(lines.select("video_id", "seg_idx", half.alias("char_offset")), evidence)


SPANS = """t AS (SELECT video_id, seg_idx, trim(text) AS t FROM seg WHERE trim(text) <> ''), sp AS (SELECT *, length(t) AS n, CASE WHEN regexp_matches(lag(t) OVER w, '[\\x21-\\x7E]$') AND regexp_matches(t, '^[0-9A-Za-z]') THEN 1 ELSE 0 END AS space FROM t WINDOW w AS (PARTITION BY video_id ORDER BY seg_idx)),
    spans AS (SELECT video_id, seg_idx, (sum(space + n) OVER w - n)::BIGINT AS span_start, (sum(space + n) OVER w)::BIGINT AS span_end FROM sp WINDOW w AS (PARTITION BY video_id ORDER BY seg_idx))"""


@query("w9_char_spans", f"WITH {SPANS} SELECT * FROM spans", "seg")
def _(spark, d):
    return J.char_spans(V.seg(spark, d))


@query(
    "j6_locate",
    f"WITH {SPANS}, p AS (SELECT video_id, unnest(generate_series(0, m // 50)) * 50 AS t FROM (SELECT video_id, max(span_end) AS m FROM spans GROUP BY 1)) SELECT p.video_id, p.t, m.i AS seg_idx, p.t - m.s AS local FROM (SELECT p.video_id, p.t, min({{'s': span_start, 'i': seg_idx}}) AS m FROM p JOIN spans s ON p.video_id = s.video_id AND p.t BETWEEN span_start AND span_end GROUP BY 1, 2) p",
    "seg",
)
def _(spark, d):
    spans = J.char_spans(V.seg(spark, d))
    ends = spans.groupBy("video_id").agg(F.max("span_end").alias("m"))
    points = ends.select("video_id", (F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 50)))).alias("k")).select("video_id", (F.col("k") * 50).alias("t"))
    return J.locate(points, spans)


@query("j7_drop_known_boundaries", f"WITH {PAUSES} SELECT DISTINCT video_id, mid_ms FROM pauses p WHERE NOT EXISTS (SELECT 1 FROM seg s WHERE s.video_id = p.video_id AND regexp_matches(trim(s.text), '[.?!。？！]$') AND abs(p.mid_ms - s.end_ms) <= 450)", "speech seg")
def _(spark, d):
    return J.drop_known_boundaries(W.pauses(V.speech(spark, d)).select("video_id", "mid_ms").distinct(), V.seg(spark, d))


@query(
    "j8_partition_cues",
    """WITH t AS (SELECT video_id, max(end_ms) // 4 AS t_start, max(end_ms) // 2 AS t_end FROM seg GROUP BY 1), b AS (SELECT s.*, t_start, t_end, (start_ms + end_ms) / 2 AS mid FROM seg s JOIN t USING (video_id))
        SELECT video_id, t_start, t_end, coalesce(string_agg(text, ' ' ORDER BY seg_idx) FILTER (mid < t_start), '') AS before_text, coalesce(string_agg(text, ' ' ORDER BY seg_idx) FILTER (mid BETWEEN t_start AND t_end), '') AS target_text,
        coalesce(string_agg(text, ' ' ORDER BY seg_idx) FILTER (mid > t_end), '') AS after_text, round(least(1.0, sum(greatest(least(end_ms, t_end) - greatest(start_ms, t_start), 0)) / greatest(t_end - t_start, 1)), 6)::DOUBLE AS coverage FROM b GROUP BY 1, 2, 3""",
    "seg",
)
def _(spark, d):
    seg = V.seg(spark, d)
    targets = seg.groupBy("video_id").agg(F.floor(F.max("end_ms") / 4).alias("t_start"), F.floor(F.max("end_ms") / 2).alias("t_end"))
    return J.partition_cues(seg, targets)


@query("j11_cascade", "SELECT * FROM artifact WHERE video_id % 10 <> 0", "artifact")
def _(spark, d):
    ids = V.table(spark, d, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("video_id"))
    return J.delete_cascade(ids, V.artifact(spark, d))


@query("j13_apply_rewrites", "SELECT video_id, seg_idx, CASE WHEN seg_idx = 1 AND n >= 3 THEN 'rewritten ' || video_id ELSE text END AS text FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM seg) WHERE seg_idx <> 2", "seg")
def _(spark, d):
    seg = V.seg(spark, d)
    ids = F.array(F.concat_ws("-", "video_id", F.lit(1)), F.concat_ws("-", "video_id", F.lit(2)))
    rewrites = seg.where("seg_idx = 0").select("video_id", F.lit(1).alias("order"), ids.alias("target_segment_ids"), F.concat(F.lit("rewritten "), "video_id").alias("replacement_text"))
    return D.rewritten(seg, rewrites)[0].select("video_id", "seg_idx", "text")


@query("j13_in_order", """SELECT video_id, seg_idx, CASE WHEN seg_idx = 0 AND n >= 2 THEN 'both ' || video_id WHEN seg_idx = 2 AND n >= 4 THEN 'later' ELSE text END AS text
    FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM seg) WHERE NOT (seg_idx = 1 AND n >= 2) AND NOT (seg_idx = 3 AND n >= 4)""", "seg")
def _(spark, d):
    """Segments 0 and 1 are rewritten to 0, so that what then names 1 does nothing; what names 2 and 3, then 2 again, does both."""
    seg = V.seg(spark, d)
    ids = lambda *k: F.array(*(F.concat_ws("-", "video_id", F.lit(x)) for x in k))
    edits = F.array(
        F.struct(F.lit(0).alias("order"), ids(0, 1).alias("target_segment_ids"), F.concat(F.lit("both "), "video_id").alias("replacement_text")),
        F.struct(F.lit(1).alias("order"), ids(1).alias("target_segment_ids"), F.lit("lost").alias("replacement_text")),
        F.struct(F.lit(2).alias("order"), ids(2, 3).alias("target_segment_ids"), F.lit("first").alias("replacement_text")),
        F.struct(F.lit(3).alias("order"), F.when(F.col("n") >= 4, ids(2)).otherwise(ids(9999)).alias("target_segment_ids"), F.lit("later").alias("replacement_text")),
    )
    heads = seg.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return D.rewritten(seg, heads.select("video_id", F.inline(edits)))[0].select("video_id", "seg_idx", "text")


@query("j14_apply_bridges", "SELECT video_id, seg_idx, CASE seg_idx WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE text END AS text FROM seg WHERE NOT (seg_idx = 1 AND video_id % 2 = 0)", "seg")
def _(spark, d):
    seg = V.seg(spark, d)
    bridges = seg.where("seg_idx = 0").select("video_id", F.col("segment_id").alias("left_segment_id"), F.concat_ws("-", "video_id", F.lit(1)).alias("right_segment_id"), F.lit("left").alias("left_text"), F.lit("right").alias("right_text"), (F.col("video_id") % 2 == 0).alias("drop_right"))
    return D.bridged(seg, bridges)[0].select("video_id", "seg_idx", "text")


# --- aggregates --------------------------------------------------------------------------------------------------


@query(
    "a2_surface_lexicon",
    f"""WITH h AS (SELECT * FROM line_seg WHERE {letters(kind='A-Z')} < 0.9 * {letters()}), w AS (SELECT video_id, seg_idx, i, words[i] AS surface FROM (SELECT *, unnest(generate_series(1, len(words))) AS i FROM (SELECT video_id, seg_idx, regexp_extract_all(text, '([A-Za-z]{{2,}})', 1) AS words FROM h)))
        SELECT video_id, lower(surface) AS word, arg_min(surface, seg_idx * 1000000 + i) AS surface FROM w GROUP BY 1, 2""",
    "line_seg",
)
def _(spark, d):
    return S.surface_lexicon(V.line_seg(spark, d))


@query("a3_degenerate_groups", f"SELECT video_id, base_id, len(regexp_extract_all(lower(j), '([0-9a-z''’-]+)', 1)) >= 4 AND {letters('j')} >= 12 AND {letters('j', 'A-Z')} >= 0.9 * {letters('j')} AS degenerate FROM (SELECT video_id, video_id || '-' || seg_idx // 3 AS base_id, string_agg(text, ' ' ORDER BY seg_idx) AS j FROM line_seg GROUP BY 1, 2)", "line_seg")
def _(spark, d):
    parts = V.line_seg(spark, d).withColumn("segment_id", F.concat(F.concat_ws("-", "video_id", F.floor(F.col("seg_idx") / 3)), F.lit("#s"), F.col("seg_idx") % 3))
    return S.degenerate_groups(parts)


@query(
    "a4_surface_health",
    f"""WITH u AS (SELECT video_id, seg_idx, end_ms - start_ms AS dur, {UNITS} AS units, {letters()} AS letters, {letters(kind='A-Z')} AS caps, {letters(kind='.?!。？！')} AS strong_marks FROM line_seg),
        g AS (SELECT video_id, seg_idx, k, array_to_string(units[i:i + k - 1], chr(31)) AS gram, len(units) AS n FROM (SELECT *, unnest(generate_series(1, len(units) - k + 1)) AS i FROM (SELECT *, unnest([2, 3, 4]) AS k FROM u) WHERE len(units) >= 2 * k AND len(units) >= 6)),
        r AS (SELECT video_id, seg_idx, max(least(c * k, n)) / any_value(n) AS rep FROM (SELECT video_id, seg_idx, k, gram, n, count(*) AS c FROM g GROUP BY ALL) WHERE c >= 2 GROUP BY 1, 2)
        SELECT video_id, seg_idx, len(units)::BIGINT AS words, letters, strong_marks, round(coalesce(rep, 0), 6)::DOUBLE AS repetition, CASE WHEN letters > 0 THEN round(caps / letters, 6) ELSE 0 END::DOUBLE AS upper_ratio,
        len(units) >= 4 AND letters >= 12 AND round(caps / letters, 6) >= 0.9 AS case_degenerated, dur >= 8000 AND len(units) >= 10 AND strong_marks = 0 AS punctuation_degenerated,
        dur >= 10000 AND dur >= 8000 AND len(units) >= 10 AND strong_marks = 0 AND ((len(units) >= 4 AND letters >= 12 AND caps >= 0.9 * letters) OR coalesce(rep, 0) >= 0.24) AS severe FROM u LEFT JOIN r USING (video_id, seg_idx)""",
    "line_seg",
)
def _(spark, d):
    return S.surface_health(V.line_seg(spark, d)).select("video_id", "seg_idx", "words", "letters", "strong_marks", "repetition", "upper_ratio", "case_degenerated", "punctuation_degenerated", "severe")


@query("a8_transcript_hash", "SELECT video_id, sha256(string_agg(start_ms || chr(31) || end_ms || chr(31) || text || chr(31) || coalesce(translated_text, ''), chr(30) ORDER BY seg_idx)) AS hash, count(*) AS segments FROM seg GROUP BY 1", "seg")
def _(spark, d):
    return S.transcript_hash(V.seg(spark, d), translated=True)


@query("a9_translation_coverage", "SELECT video_id, count(*) AS total, count(translated_text) AS translated, count(*) - count(translated_text) AS pending FROM seg GROUP BY 1", "seg")
def _(spark, d):
    return S.translation_coverage(V.seg(spark, d))


# --- windows and folds -------------------------------------------------------------------------------------------

CHUNKS = """sized AS (SELECT *, length(text) + length(coalesce(translated_text, '')) AS size, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS k, count(*) OVER (PARTITION BY video_id) AS n FROM seg),
    pre AS (SELECT *, sum(size) OVER (PARTITION BY video_id ORDER BY k) - size AS before FROM sized),
    ends AS (SELECT a.video_id, a.k, a.n, max(b.k) AS e FROM pre a JOIN pre b ON a.video_id = b.video_id AND b.k BETWEEN a.k AND a.k + 4 AND (b.k = a.k OR b.before - a.before < 420) GROUP BY 1, 2, 3),
    walk AS (SELECT video_id, k, e, n, 0::BIGINT AS chunk_idx FROM ends WHERE k = 1 UNION ALL SELECT w.video_id, x.k, x.e, x.n, chunk_idx + 1 FROM walk w JOIN ends x ON x.video_id = w.video_id AND x.k = CASE WHEN w.e > w.k THEN w.e ELSE w.e + 1 END),
    chunks AS (SELECT w.video_id, chunk_idx, min(s.start_ms) AS start_ms, max(s.end_ms) AS end_ms, string_agg(s.segment_id, ',' ORDER BY s.k) AS segment_ids,
        string_agg(trim(s.text) || CASE WHEN translated_text IS NOT NULL AND trim(translated_text) <> trim(s.text) THEN ' (' || trim(translated_text) || ')' ELSE '' END, ' ' ORDER BY s.k) FILTER (trim(s.text) <> '') AS text
        FROM walk w JOIN sized s ON s.video_id = w.video_id AND s.k BETWEEN w.k AND w.e GROUP BY 1, 2)"""


@query("w1_chunks", f"WITH {CHUNKS} SELECT * FROM chunks", "seg", recursive=True)
def _(spark, d):
    return W.chunk_segments(V.seg(spark, d))


@query(
    "w2_note_batches",
    """WITH r AS (SELECT video_id, seg_idx, length(trim(text)) AS len, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS k FROM line_seg),
        walk AS (SELECT video_id, seg_idx, k, 0::BIGINT AS bin, 1::BIGINT AS number, len + 6 AS size FROM r WHERE k = 1
        UNION ALL SELECT r.video_id, r.seg_idx, r.k, CASE WHEN size + len + 5 + length((number + 1)::VARCHAR) > 6000 THEN bin + 1 ELSE bin END, CASE WHEN size + len + 5 + length((number + 1)::VARCHAR) > 6000 THEN 1 ELSE number + 1 END,
        CASE WHEN size + len + 5 + length((number + 1)::VARCHAR) > 6000 THEN len + 6 ELSE size + len + 5 + length((number + 1)::VARCHAR) END FROM walk w JOIN r ON r.video_id = w.video_id AND r.k = w.k + 1)
        SELECT video_id, seg_idx, bin, number FROM walk""",
    "line_seg",
    recursive=True,
)
def _(spark, d):
    return W.note_batches(V.line_seg(spark, d))


@query(
    "w3_paragraphs",
    """WITH r AS (SELECT video_id, seg_idx, trim(text) AS t, start_ms, end_ms, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS k FROM seg WHERE trim(text) <> ''),
        walk AS (SELECT *, 0::BIGINT AS bin, length(t) AS size FROM r WHERE k = 1 UNION ALL SELECT r.*, CASE WHEN r.start_ms - w.end_ms > 2500 OR size >= 220 THEN bin + 1 ELSE bin END, CASE WHEN r.start_ms - w.end_ms > 2500 OR size >= 220 THEN length(r.t) ELSE size + length(r.t) END
        FROM walk w JOIN r ON r.video_id = w.video_id AND r.k = w.k + 1) SELECT video_id, bin, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CASE WHEN video_id % 3 = 0 THEN string_agg(t, '' ORDER BY k) ELSE string_agg(t, ' ' ORDER BY k) END AS paragraph FROM walk GROUP BY 1, 2""",
    "seg",
    recursive=True,
)
def _(spark, d):
    return W.note_paragraphs(V.seg(spark, d).withColumn("profile", F.when(F.col("video_id") % 3 == 0, "Zh").otherwise("En")))


def _profiled_lines(spark, d):
    return V.line_seg(spark, d).withColumn("profile", F.when(F.col("video_id") % 3 == 0, "Zh").otherwise(X.language_profile(F.col("lang")))).withColumn("segment_id", F.concat_ws("-", "video_id", "seg_idx"))


MERGED = """p AS (SELECT *, CASE WHEN video_id % 3 = 0 THEN 'Zh' WHEN lang = 'en' THEN 'En' ELSE 'Auto' END AS profile FROM line_seg),
    r AS (SELECT video_id, seg_idx, trim(text) AS t, start_ms, end_ms, profile, profile = 'Zh' AS cjk, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS k FROM p),
    walk AS (SELECT *, 0::BIGINT AS bin, length(t) AS size, start_ms AS s0 FROM r WHERE k = 1 UNION ALL SELECT r.*, CASE WHEN j THEN bin ELSE bin + 1 END, CASE WHEN j THEN size + CASE WHEN r.cjk THEN 0 ELSE 1 END + length(r.t) ELSE length(r.t) END, CASE WHEN j THEN s0 ELSE r.start_ms END
    FROM (SELECT w.*, NOT regexp_matches(w.t, '[.?!。？！]["''”’)\\]】》]*$') AS open FROM walk w) w JOIN r ON r.video_id = w.video_id AND r.k = w.k + 1, LATERAL (SELECT w.open AND r.seg_idx % 5 <> 4 AND r.start_ms - w.end_ms BETWEEN 0 AND CASE r.profile WHEN 'En' THEN 420 WHEN 'Zh' THEN 520 ELSE 450 END
        AND w.size + length(r.t) <= CASE WHEN r.cjk THEN 36 ELSE 120 END AND r.end_ms - w.s0 <= CASE WHEN r.cjk THEN 6500 ELSE 8000 END AS j)),
    merged AS (SELECT video_id, min(seg_idx) AS seg_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS merged, CASE WHEN any_value(cjk) THEN string_agg(t, '' ORDER BY k) ELSE string_agg(t, ' ' ORDER BY k) END AS text FROM walk GROUP BY video_id, bin)"""


def _merged(spark, d):
    lines = _profiled_lines(spark, d)
    evidence = lines.select("video_id", F.col("start_ms").alias("time_ms"), F.lit("strong_punctuation").alias("kind"), F.when(F.col("seg_idx") % 5 == 4, 0.9).otherwise(0.4).alias("confidence"))
    return W.merge_adjacent(lines, evidence)


@query("w12_merge_adjacent", f"WITH {MERGED} SELECT * FROM merged", "line_seg", recursive=True)
def _(spark, d):
    return _merged(spark, d).drop("parts", "profile")


@query(
    "w12_merge_log",
    f"""WITH {MERGED}, n AS (SELECT *, min(seg_idx) OVER (PARTITION BY video_id, bin) AS head, row_number() OVER (PARTITION BY video_id, bin ORDER BY k) AS i FROM walk),
        j AS (SELECT b.video_id, b.head AS seg_idx, b.t, b.cjk, CASE WHEN b.cjk THEN string_agg(a.t, '' ORDER BY a.k) ELSE string_agg(a.t, ' ' ORDER BY a.k) END AS l FROM n b JOIN n a ON a.video_id = b.video_id AND a.bin = b.bin AND a.i < b.i GROUP BY b.video_id, b.head, b.k, b.t, b.cjk)
        SELECT video_id, seg_idx, 'boundary' AS stage, 'merge_boundary' AS operation, l || ' | ' || t AS before, l || CASE WHEN cjk THEN '' ELSE ' ' END || t AS after, 'short_gap_without_sentence_terminal' AS rule_id, 0.88::DOUBLE AS confidence FROM j""",
    "line_seg",
    recursive=True,
)
def _(spark, d):
    return W.merge_log(_merged(spark, d))


@query("w4_pauses", f"WITH {PAUSES} SELECT * FROM pauses", "speech")
def _(spark, d):
    return W.pauses(V.speech(spark, d))


THIN = f"""{PAUSES}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY mid_ms, gap_ms, seg_idx) AS k FROM pauses),
    walk AS (SELECT video_id, k, seg_idx, mid_ms, gap_ms, 0 AS slot FROM o WHERE k = 1 UNION ALL SELECT o.video_id, o.k, CASE WHEN keep THEN o.seg_idx ELSE w.seg_idx END, CASE WHEN keep THEN o.mid_ms ELSE w.mid_ms END, CASE WHEN keep THEN o.gap_ms ELSE w.gap_ms END, slot + CASE WHEN far THEN 1 ELSE 0 END
    FROM walk w JOIN o ON o.video_id = w.video_id AND o.k = w.k + 1, LATERAL (SELECT o.mid_ms - w.mid_ms >= 1200 AS far, o.mid_ms - w.mid_ms >= 1200 OR o.gap_ms > w.gap_ms AS keep)),
    thin AS (SELECT video_id, arg_max(seg_idx, k) AS seg_idx, arg_max(mid_ms, k) AS mid_ms, arg_max(gap_ms, k) AS gap_ms FROM walk GROUP BY video_id, slot)"""


@query("w5_thin_pauses", f"WITH {THIN} SELECT * FROM thin", "speech", recursive=True)
def _(spark, d):
    return W.thin_pauses(W.pauses(V.speech(spark, d)))


@query(
    "w5_pause_budget",
    f"""WITH {THIN}, tot AS (SELECT video_id, least(greatest(ceil(max(end_ms) / 10000), 12), 90)::BIGINT AS budget FROM speech GROUP BY 1), r AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY mid_ms) - 1 AS rank FROM thin JOIN tot USING (video_id))
        SELECT video_id, m.mid_ms, m.gap_ms FROM (SELECT video_id, max({{'gap_ms': gap_ms, 'mid_ms': mid_ms}}) AS m FROM r GROUP BY video_id, CASE WHEN n <= budget THEN rank ELSE rank * budget // n END)""",
    "speech",
    recursive=True,
)
def _(spark, d):
    speech = V.speech(spark, d)
    return W.pause_budget(W.thin_pauses(W.pauses(speech)), speech.groupBy("video_id").agg(F.max("end_ms").alias("total_ms")))


@query(
    "w6_local_gap",
    """WITH g AS (SELECT *, greatest(lead(start_ms) OVER w - end_ms, 0) AS gap FROM tok WINDOW w AS (PARTITION BY video_id ORDER BY seg_idx, pos)),
        f AS (SELECT video_id, seg_idx, pos, list_sort(list(CASE WHEN gap <= 1200 THEN gap END) OVER (PARTITION BY video_id ORDER BY seg_idx, pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) AS l FROM g)
        SELECT video_id, seg_idx, pos, greatest(coalesce(list_filter(l, lambda x: x IS NOT NULL)[len(list_filter(l, lambda x: x IS NOT NULL)) // 2 + 1], 60), 30)::BIGINT AS local_gap_ms FROM f""",
    "tok",
)
def _(spark, d):
    return W.local_gap(V.tok(spark, d))


@query("w8_fixed_windows", "SELECT video_id, w AS window, w * 120000 AS start_ms, least((w + 1) * 120000, m) AS end_ms FROM (SELECT video_id, m, unnest(generate_series(0, (m - 1) // 120000)) AS w FROM (SELECT video_id, max(end_ms) AS m FROM speech GROUP BY 1) WHERE m > 0)", "speech")
def _(spark, d):
    return W.fixed_windows(V.speech(spark, d).groupBy("video_id").agg(F.max("end_ms").alias("total_ms")))


@query(
    "w14_token_loops",
    """WITH x AS (SELECT video_id, seg_idx, pos, CASE WHEN pos % 9 < 5 THEN 'la' ELSE token END AS token, start_ms // 10 AS start_ms, end_ms // 10 AS end_ms FROM tok),
        t AS (SELECT *, row_number() OVER (PARTITION BY video_id, seg_idx ORDER BY pos) - row_number() OVER (PARTITION BY video_id, seg_idx, token ORDER BY pos) AS island FROM x),
        r AS (SELECT *, count(*) OVER w AS size, min(start_ms) OVER w AS a, max(end_ms) OVER w AS b, min(pos) OVER w AS head, string_agg(pos::VARCHAR, ',') OVER (w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ids FROM t WINDOW w AS (PARTITION BY video_id, seg_idx, token, island)),
        l AS (SELECT *, size >= 4 AND b - a <= 1500 AS loop FROM r)
        SELECT video_id, seg_idx, pos, token, start_ms, end_ms, CASE WHEN loop THEN b ELSE end_ms END AS span_end_ms, CASE WHEN loop THEN size ELSE 1 END AS n, CASE WHEN loop THEN ids ELSE pos::VARCHAR END AS source_ids FROM l WHERE NOT loop OR pos = head""",
    "tok",
)
def _(spark, d):
    loud = V.tok(spark, d).withColumn("token", F.when(F.col("pos") % 9 < 5, "la").otherwise(F.col("token"))).withColumn("start_ms", F.floor(F.col("start_ms") / 10)).withColumn("end_ms", F.floor(F.col("end_ms") / 10))
    return W.collapse_loops(loud)


@query(
    "w17_bridge_candidates",
    f"""WITH r AS (SELECT video_id, seg_idx, regexp_matches(trim(text), '[.?!。？！]$') AS fin, {UNITS} AS u, lead({UNITS}) OVER w AS v, lead(start_ms) OVER w - end_ms AS gap_ms FROM seg WINDOW w AS (PARTITION BY video_id ORDER BY seg_idx)),
        o AS (SELECT *, coalesce(list_max(list_filter(generate_series(1, least(len(u), len(v), 12)), lambda n: u[len(u) - n + 1:len(u)] = v[1:n])), 0) AS overlap FROM r WHERE v IS NOT NULL)
        SELECT video_id, seg_idx, gap_ms, overlap FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS k FROM o WHERE NOT fin AND abs(gap_ms) <= 850 AND (len(v) <= 8 OR overlap >= 2)) WHERE k <= 4""",
    "seg",
)
def _(spark, d):
    return W.bridge_candidates(V.seg(spark, d))


@query(
    "w18_anchors",
    """WITH b AS (SELECT a.video_id * 1000 + a.seg_idx AS video_id, a.pos AS i, b.pos AS j FROM tok a JOIN tok b ON a.video_id = b.video_id AND b.seg_idx = a.seg_idx + 1 AND a.token = b.token), r AS (SELECT *, i - row_number() OVER (PARTITION BY video_id, i - j ORDER BY i) AS island FROM b)
        SELECT video_id, min(i) AS i, min(j) AS j, count(*) AS n FROM r GROUP BY video_id, i - j, island HAVING count(*) >= 2""",
    "tok",
)
def _(spark, d):
    """Every segment against the next one; a pair's key is the video and the left segment."""
    tok = V.tok(spark, d)
    left = tok.select((F.col("video_id") * 1000 + F.col("seg_idx")).alias("video_id"), "token", "pos")
    return W.anchors(left, tok.where("seg_idx > 0").select((F.col("video_id") * 1000 + F.col("seg_idx") - 1).alias("video_id"), "token", "pos"))


@query(
    "w13_overlap",
    r"""WITH x AS (SELECT *, CASE WHEN seg_idx % 4 = 3 THEN lag(text) OVER v WHEN seg_idx % 2 = 1 THEN coalesce(array_to_string(string_split(lag(text) OVER v, ' ')[-3:], ' '), '') || ' ' || text ELSE text END AS own FROM seg WINDOW v AS (PARTITION BY video_id ORDER BY seg_idx)),
        r AS (SELECT video_id, seg_idx, start_ms, end_ms, own, regexp_extract_all(lower(own), '([0-9a-z_]+|[^\s0-9a-z_!-/:-@\[-`{-~])', 1) AS u, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS k FROM x),
        walk AS (SELECT video_id, seg_idx, k, end_ms, own, u, u AS kept, 0::BIGINT AS cut FROM r WHERE k = 1 UNION ALL SELECT r.video_id, r.seg_idx, r.k, r.end_ms, r.own, r.u, r.u[c + 1:len(r.u)], c FROM walk w JOIN r ON r.video_id = w.video_id AND r.k = w.k + 1,
        LATERAL (SELECT CASE WHEN r.start_ms <= w.end_ms + 300 AND len(w.kept) > 0 AND len(r.u) > 0 THEN coalesce(list_max(list_filter(generate_series(1, least(len(w.kept), len(r.u), 16)), lambda n: w.kept[len(w.kept) - n + 1:len(w.kept)] = r.u[1:n] AND (n > 1 OR length(r.u[1]) >= 4))), 0) ELSE 0 END AS c))
        SELECT video_id, seg_idx, cut, CASE WHEN cut = 0 THEN own ELSE regexp_replace(own[length(regexp_extract(own, '^(?:[\s!-/:-@\[-`{-~]*(?:[0-9A-Za-z_]+|[^\s0-9A-Za-z_!-/:-@\[-`{-~])){' || cut || '}')) + 1:], '^[\s,.;:!?，。！？；：、]+', '') END AS rest FROM walk""",
    "seg",
    recursive=True,
)
def _(spark, d):
    w = Window.partitionBy("video_id").orderBy("seg_idx")
    before = F.array_join(F.slice(F.split(F.lag("text").over(w), " "), F.greatest(-F.size(F.split(F.lag("text").over(w), " ")), F.lit(-3)), F.lit(3)), " ")
    seg = V.seg(spark, d).withColumn("p", before).withColumn("text", F.when(F.col("seg_idx") % 4 == 3, F.lag("text").over(w)).when(F.col("seg_idx") % 2 == 1, F.concat(X.text_of("p"), F.lit(" "), "text")).otherwise(F.col("text")))
    return W.dedupe_overlap(seg)


@query("w21_near_dups", "SELECT video_id, seg_idx, copy FROM seg, (SELECT unnest([0, 1, 2]) AS copy) WHERE copy <> 1 OR seg_idx % 3 <> 1", "seg")
def _(spark, d):
    """A copy at 60 ms goes where it is that near; one at 150 ms stays, measured from the last one kept."""
    copies = V.seg(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("own", F.col("seg_idx"))
    late = F.when(F.col("own") % 3 == 1, F.element_at(F.array(F.lit(0), F.lit(60), F.lit(150)), F.col("copy") + 1)).otherwise(F.col("copy") * 130)
    near = copies.withColumn("start_ms", F.col("start_ms") + late)
    return W.drop_near_duplicates(near.withColumn("seg_idx", F.col("own") * 3 + F.col("copy"))).select("video_id", F.col("own").alias("seg_idx"), "copy")


@query("w22_monotone", "SELECT video_id, seg_idx, pos, max(s) OVER (PARTITION BY video_id ORDER BY seg_idx, pos) AS start_ms FROM (SELECT *, start_ms - CASE WHEN pos % 4 = 3 THEN 900 ELSE 0 END AS s FROM tok)", "tok")
def _(spark, d):
    return W.monotone_starts(V.tok(spark, d).withColumn("start_ms", F.col("start_ms") - F.when(F.col("pos") % 4 == 3, 900).otherwise(0))).select("video_id", "seg_idx", "pos", "start_ms")


@query("w24_positions", "SELECT event_id AS item_id, 17 + row_number() OVER (ORDER BY epoch_ms(ts), event_id) AS position FROM events")
def _(spark, d):
    new = V.table(spark, d, "events").select(F.col("event_id").alias("item_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival"))
    return W.append_positions(new, spark.range(18).select(F.col("id").alias("position")))


@query("w26_context", "SELECT video_id, seg_idx, round(greatest(start_ms / 1000 - p, 0), 6) AS from_s, round(end_ms / 1000 + p, 6) AS to_s, end_ms / 1000 + p - greatest(start_ms / 1000 - p, 0) BETWEEN 2 AND 18.05 AS valid FROM (SELECT *, least(greatest((18 - (end_ms - start_ms) / 1000) / 2, 2.0), 5.5) AS p FROM seg)", "seg")
def _(spark, d):
    return W.context_windows(V.seg(spark, d))


@query("w7_chunk_plan")
def _(spark, d):
    speech = V.speech(spark, d)
    return W.plan_chunks(speech.groupBy("video_id").agg(F.max("end_ms").alias("total_ms")), W.pauses(speech))


@query("w10_sentences")
def _(spark, d):
    return W.split_sentences(V.line_seg(spark, d))


@query("w10_token_sentences")
def _(spark, d):
    """The lines of the canonical chain cut by tokens, pauses and shares."""
    lines, known = _canonical_input(spark, d)
    parts = SE.sentence_parts(lines, known["tokens"], known["boundary"]).where("part is not null")
    return parts.select("video_id", "seg_idx", "part", "segment_id", "start_ms", "end_ms", "text")


@query("w20_suspicions")
def _(spark, d):
    lines = V.line_seg(spark, d)
    found = settled(P.entity_candidates(lines))
    names = found.select("video_id", "seg_idx", "normalized").distinct()
    return W.suspicions(lines, S.surface_health(lines), settled(P.entity_memory(lines, candidates=found)), names)


@query(
    "t5_integrity",
    r"""WITH c AS (SELECT doc_id AS video_id, lang FROM documents), t AS (SELECT l.*, regexp_replace(trim(text), '[\s!-/:-@\[-`{-~]', '', 'g') AS bare FROM line_seg l)
        SELECT video_id, seg_idx, CASE WHEN length(bare) >= 8 AND len(list_filter(generate_series(1, least(4, length(bare) // 4)), lambda n: len(list_filter(generate_series(0, length(bare) // n - 1), lambda i: bare[1:n * (i + 1)] = repeat(bare[1:n], i + 1))) >= 4
        AND len(list_filter(generate_series(0, length(bare) // n - 1), lambda i: bare[1:n * (i + 1)] = repeat(bare[1:n], i + 1))) * n >= length(bare) - n)) > 0 THEN 'probable_decode_loop'
        WHEN bare IN ('uh', 'um', 'erm', 'hmm', 'hm') THEN 'filler_only_segment_preserved' END AS rule_id FROM t""",
    "line_seg",
)
def _(spark, d):
    lines = V.line_seg(spark, d).withColumn("profile", X.language_profile(F.col("lang")))
    none = lines.select("video_id", "seg_idx", F.lit(None).cast("double").alias("avg_confidence"))
    return S.tag_integrity(lines, none).select("video_id", "seg_idx", "rule_id")


# --- search ------------------------------------------------------------------------------------------------------


def _queries(spark, d):
    seg = V.seg(spark, d).where("seg_idx = 1")
    return seg.select(F.col("video_id").alias("query_id"), "video_id", F.array_join(F.slice(F.split("text", " "), 2, 3), " ").alias("query"))


QUERY_SQL = "q AS (SELECT video_id AS query_id, video_id, array_to_string(string_split(text, ' ')[2:4], ' ') AS query FROM seg WHERE seg_idx = 1)"
_RX = X.TOKEN
BM25 = f"""{QUERY_SQL}, words AS (SELECT video_id, chunk_idx, unnest(regexp_extract_all(lower(text), '{_RX}', 1)) AS token FROM chunks), tf AS (SELECT token, video_id, chunk_idx, count(*) AS tf FROM words GROUP BY ALL),
    len AS (SELECT video_id, chunk_idx, count(*) AS length FROM words GROUP BY ALL), df AS (SELECT token, count(*) AS n FROM tf GROUP BY 1), st AS (SELECT count(*) AS docs, avg(length) AS mean FROM len),
    want AS (SELECT DISTINCT query_id, video_id, unnest(regexp_extract_all(lower(query), '{_RX}', 1)) AS token FROM q),
    lex AS (SELECT query_id, video_id, chunk_idx, round(sum(greatest(ln((docs - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM want JOIN tf USING (token, video_id) JOIN len USING (video_id, chunk_idx) JOIN df USING (token), st GROUP BY ALL),
    lexr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_idx) AS rank FROM lex) WHERE rank <= 40)"""


@query("t1_tokens", f"SELECT video_id, seg_idx, i - 1 AS pos, w[i] AS token FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM (SELECT video_id, seg_idx, regexp_extract_all(lower(text), '{_RX}', 1) AS w FROM seg))", "seg")
def _(spark, d):
    return K.tokenize(V.seg(spark, d), "text", "video_id", "seg_idx")


FNV = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(regexp_extract_all(hex(encode(token)), '(..)', 1), lambda h: ('0x' || h)::HUGEINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296)"


@query("t2_hashed_vectors", f"WITH w AS (SELECT video_id, seg_idx, token, count(*) AS n FROM tok GROUP BY ALL), h AS (SELECT token, ({FNV} % 256)::BIGINT AS bucket FROM (SELECT DISTINCT token FROM w)), s AS (SELECT video_id, seg_idx, bucket, sum(n) AS n FROM w JOIN h USING (token) GROUP BY ALL) SELECT video_id, seg_idx, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY video_id, seg_idx)), 6)::DOUBLE AS weight FROM s", "tok")
def _(spark, d):
    out = K.hashed_vectors(V.tok(spark, d).select("video_id", "seg_idx", "token"), "video_id", "seg_idx")
    return out.withColumn("weight", F.round("weight", 6))


@query("k2_vector_topk", "SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE score > 0) WHERE rank <= 40")
def _(spark, d):
    vectors = V.table(spark, d, "embeddings")
    return K.vector_topk(vectors.where("vec_id % 50 = 0"), vectors)


@query("k3_bm25", f"WITH {CHUNKS}, {BM25} SELECT * FROM lexr", "seg", recursive=True)
def _(spark, d):
    return K.bm25_topk(_queries(spark, d), W.chunk_segments(V.seg(spark, d)))


VEC = f"""qt AS (SELECT query_id, video_id, unnest(regexp_extract_all(lower(query), '{_RX}', 1)) AS token FROM q), hb AS (SELECT token, ({FNV} % 256)::BIGINT AS bucket FROM (SELECT token FROM words UNION SELECT token FROM qt)),
    qb AS (SELECT query_id, video_id, bucket, count(*) AS n FROM qt JOIN hb USING (token) GROUP BY ALL), qw AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY query_id, video_id)) AS w FROM qb),
    cb AS (SELECT video_id, chunk_idx, bucket, count(*) AS n FROM words JOIN hb USING (token) GROUP BY ALL), cw AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY video_id, chunk_idx)) AS w FROM cb),
    vec AS (SELECT query_id, qw.video_id, chunk_idx, round(sum(qw.w * cw.w), 6) AS score FROM qw JOIN cw USING (video_id, bucket) GROUP BY ALL),
    vecr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_idx) AS rank FROM vec WHERE score > 0) WHERE rank <= 40),
    fused AS (SELECT query_id, video_id, chunk_idx, round(sum(1 / (rank + 60)), 9) AS score FROM (SELECT query_id, video_id, chunk_idx, rank FROM lexr UNION ALL SELECT query_id, video_id, chunk_idx, rank FROM vecr) GROUP BY ALL),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_idx) AS rank FROM fused) WHERE rank <= 5),
    parts AS (SELECT top.*, c.start_ms AS chunk_start_ms, c.text AS snippet, ids[i] AS segment_id, i AS place, query FROM top JOIN (SELECT *, string_split(segment_ids, ',') AS ids, unnest(generate_series(1, len(string_split(segment_ids, ',')))) AS i FROM chunks) c USING (video_id, chunk_idx) JOIN q USING (query_id)),
    known AS (SELECT p.*, contains(lower(s.text), trim(lower(query))) OR contains(lower(coalesce(s.translated_text, '')), trim(lower(query))) AS whole,
        len(list_intersect(list_distinct(regexp_extract_all(lower(query), '{_RX}', 1)), regexp_extract_all(lower(s.text), '{_RX}', 1))) + len(list_intersect(list_distinct(regexp_extract_all(lower(query), '{_RX}', 1)), regexp_extract_all(lower(coalesce(s.translated_text, '')), '{_RX}', 1))) AS words FROM parts p JOIN seg s USING (segment_id))"""


@query("k6_hybrid_search", f"WITH {CHUNKS}, {BM25}, {VEC} SELECT query_id, video_id, chunk_idx, score, rank, chunk_start_ms, snippet, arg_max(segment_id, (whole::INT, CASE WHEN whole THEN 0 ELSE words END, -place)) AS best_segment_id FROM known GROUP BY ALL", "seg", recursive=True)
def _(spark, d):
    seg = V.seg(spark, d)
    return K.hybrid_search(_queries(spark, d), W.chunk_segments(seg), seg)


@query("k1_library_page", f"SELECT video_id, title, (SELECT count(*) FROM video WHERE {FILTER}) AS total FROM video WHERE {FILTER} ORDER BY updated_at DESC, video_id DESC LIMIT 20 OFFSET 20", "video")
def _(spark, d):
    return T.library_page(V.video(spark, d), "an", page=2).select("video_id", "title", "total")


@query("k7_sort_keys", "SELECT video_id, (video_id % 7200)::DOUBLE AS seconds, CASE WHEN video_id % 2 = 0 THEN round(video_id / 10 * 10000) ELSE video_id END::DOUBLE AS plays FROM video", "video")
def _(spark, d):
    s = F.col("video_id") % 7200
    plays = F.when(F.col("video_id") % 2 == 0, F.concat(F.format_string("%.1f", F.col("video_id") / 10), F.lit("万"))).otherwise(F.col("video_id").cast("string"))
    return V.video(spark, d).select("video_id", T.sort_key_seconds(X.short_clock(s)).alias("seconds"), F.round(T.sort_key_count(plays)).alias("plays"))


# --- merges ------------------------------------------------------------------------------------------------------


@query("i1_new_revisions", "SELECT video_id, sha256(string_agg(start_ms || chr(31) || end_ms || chr(31) || text, chr(30) ORDER BY seg_idx)) AS hash, video_id AS created FROM seg WHERE video_id % 3 <> 0 GROUP BY video_id", "seg")
def _(spark, d):
    new = S.transcript_hash(V.seg(spark, d)).select("video_id", "hash", F.col("video_id").alias("created"))
    return T.new_revisions(new.unionByName(new), new.where("video_id % 3 = 0"))


@query("i2_stale", "SELECT video_id, CASE WHEN video_id % 5 = 0 THEN 'no_manifest' WHEN video_id % 5 = 1 THEN 'version' ELSE 'content' END AS reason FROM (SELECT DISTINCT video_id FROM seg) WHERE video_id % 5 < 3", "seg")
def _(spark, d):
    hashes = S.transcript_hash(V.seg(spark, d)).select("video_id", "hash")
    manifests = hashes.where("video_id % 5 <> 0").select("video_id", F.when(F.col("video_id") % 5 == 1, 1).otherwise(2).alias("version"), F.when(F.col("video_id") % 5 == 2, "old").otherwise(F.col("hash")).alias("hash"))
    return T.stale(hashes, manifests, hashes, 2)


@query(
    "i3_upsert_artifacts",
    """SELECT video_id, artifact_type, CASE WHEN artifact_type <> 'translation' THEN state WHEN video_id % 3 = 0 AND (video_id % 2 = 0 OR state = 'ready') THEN 'stale' WHEN video_id % 2 = 0 THEN 'ready' ELSE state END AS state,
        CASE WHEN video_id % 2 = 0 AND artifact_type = 'translation' THEN 2 ELSE revision END::BIGINT AS revision FROM artifact
        UNION ALL SELECT doc_id, 'note', CASE WHEN doc_id % 3 = 0 THEN 'stale' ELSE 'ready' END, 1 FROM labels WHERE doc_id % 2 = 0""",
    "artifact",
)
def _(spark, d):
    table = V.artifact(spark, d)
    ids = table.select("video_id").distinct()
    even = ids.where("video_id % 2 = 0")
    changes = even.withColumn("artifact_type", F.lit("translation")).unionByName(even.withColumn("artifact_type", F.lit("note")))
    return T.mark_stale(T.upsert_artifacts(table, changes), ids.where("video_id % 3 = 0"))


@query(
    "i4_enqueue",
    f"""WITH {KEYED}, l AS (SELECT source_key, min(page_id) AS lib FROM p WHERE page_id % 7 <> 0 AND page_id % 11 <> 0 GROUP BY 1), u AS (SELECT source_key, min(page_id) AS que FROM p WHERE page_id IN (SELECT video_id FROM qstate WHERE state NOT IN ('cancelled', 'completed')) GROUP BY 1),
        r AS (SELECT page_id * 2 + k AS pos, source_key, row_number() OVER (PARTITION BY source_key ORDER BY page_id * 2 + k) AS turn FROM p, (SELECT unnest([0, 1]) AS k))
        SELECT pos, source_key, CASE WHEN lib IS NOT NULL THEN 'alreadyInLibrary' WHEN que IS NOT NULL OR turn > 1 THEN 'alreadyQueued' ELSE 'queueItem' END AS outcome, coalesce(lib, que) AS video_id FROM r LEFT JOIN l USING (source_key) LEFT JOIN u USING (source_key)""",
    "qstate",
)
def _(spark, d):
    twice = V.table(spark, d, "pages").select("page_id", "url", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    requests = twice.select((F.col("page_id") * 2 + F.col("k")).alias("pos"), F.lit("video").alias("platform"), F.concat("url", F.when(F.col("k") == 1, "#again").otherwise("/")).alias("source_url"))
    return T.enqueue(requests, V.video(spark, d), V.qstate(spark, d))


@query("i5_edits", "SELECT video_id, seg_idx, CASE WHEN seg_idx % 2 = 1 THEN 'edit 2 ' || segment_id ELSE text END AS text, CASE WHEN seg_idx % 2 = 1 THEN start_ms + 2 ELSE start_ms END AS start_ms, end_ms, CASE WHEN seg_idx % 2 = 0 THEN translated_text END AS translated_text FROM seg", "seg")
def _(spark, d):
    seg = V.seg(spark, d)
    odd = seg.where("seg_idx % 2 = 1").select("video_id", "segment_id", "start_ms", "end_ms", F.explode(F.array(F.lit(2), F.lit(1))).alias("seq"))
    edits = odd.select("video_id", "segment_id", "seq", F.concat(F.lit("edit "), "seq", F.lit(" "), "segment_id").alias("text"), (F.col("start_ms") + F.col("seq")).alias("start_ms"), "end_ms")
    return T.apply_edits(seg, edits).select("video_id", "seg_idx", "text", "start_ms", "end_ms", "translated_text")


@query("i6_translations", "SELECT video_id, seg_idx, CASE WHEN seg_idx % 3 = 0 THEN 'neu ' || segment_id WHEN seg_idx % 3 = 1 THEN trim(text) ELSE translated_text END AS translated_text FROM seg", "seg")
def _(spark, d):
    seg = V.seg(spark, d)
    output = F.when(F.col("seg_idx") % 3 == 0, F.concat(F.lit("<|im_start|>assistant\nTranslation: neu "), "segment_id", F.lit("\n\n<|im_end|>"))).otherwise("```\n\n```")
    return T.merge_translations(seg, seg.where("seg_idx % 3 < 2").select("video_id", "segment_id", output.alias("output"))).select("video_id", "seg_idx", "translated_text")


@query("i9_recover", "SELECT item_id, video_id, CASE WHEN state <> 'running' THEN state WHEN video_id % 2 = 0 THEN 'completed' ELSE 'queued' END AS state, stage, CASE WHEN state = 'running' AND video_id % 2 = 0 THEN 100 ELSE progress END::BIGINT AS progress FROM qstate", "qstate")
def _(spark, d):
    q = V.qstate(spark, d)
    return T.recover(q, q.where("video_id % 2 = 0").select("video_id")).drop("ts")


@query(
    "i10_commands",
    """WITH c AS (SELECT user_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, ['start', 'pause', 'resume', 'finish', 'fail', 'retry', 'remove', 'requeue'][1 + event_id % 8] AS c FROM events),
        w AS (SELECT item_id, 0::BIGINT AS k, 'queued' AS state, 0::BIGINT AS applied FROM c WHERE k = 1 UNION ALL SELECT w.item_id, c.k, n, applied + CASE WHEN n <> state THEN 1 ELSE 0 END FROM w JOIN c ON c.item_id = w.item_id AND c.k = w.k + 1, LATERAL (SELECT CASE
        WHEN c = 'pause' AND state IN ('queued', 'running', 'blocked') THEN 'paused' WHEN c = 'resume' AND state = 'paused' THEN 'queued' WHEN c = 'remove' AND state <> 'running' THEN 'cancelled' WHEN c = 'retry' AND state = 'failed' THEN 'queued'
        WHEN c = 'requeue' AND state IN ('completed', 'cancelled', 'failed') THEN 'queued' WHEN c = 'start' AND state = 'queued' THEN 'running' WHEN c = 'finish' AND state = 'running' THEN 'completed' WHEN c = 'fail' AND state = 'running' THEN 'failed' ELSE state END AS n))
        SELECT item_id, arg_max(state, k) AS state, max(applied) AS applied FROM w GROUP BY 1""",
    "qstate",
    recursive=True,
)
def _(spark, d):
    names = ["start", "pause", "resume", "finish", "fail", "retry", "remove", "requeue"]
    command = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 8 + 1).cast("int"))
    return T.fold_commands(V.table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), command.alias("command")))


@query("x2_latest_state", "SELECT video_id, arg_max(state, (ts, item_id)) AS state, CASE WHEN arg_max(state, (ts, item_id)) = 'completed' THEN 100 ELSE least(arg_max(progress, (ts, item_id)), 99) END::BIGINT AS progress FROM qstate GROUP BY 1", "qstate")
def _(spark, d):
    return T.latest_state(V.qstate(spark, d))


# --- repair, verification, memory --------------------------------------------------------------------------------


@query("t6_spoken_numbers", r"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '共12.5元和30% ' WHEN 1 THEN '二百五和 ' || doc_id || '.5 ' ELSE '' END || regexp_replace(text, '(\d+)\s*\.\s*(\d+)', '\1.\2', 'g') AS text FROM documents")
def _(spark, d):
    """Whole texts, two thirds of them behind a phrase of spoken numbers."""
    head = F.when(F.col("doc_id") % 3 == 0, "共十二点五元和百分之三十 ").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("二百五和 "), "doc_id", F.lit(" . 5 "))).otherwise("")
    return P.normalise_numbers(V.table(spark, d, "documents").select("doc_id", F.concat(head, "text").alias("text"))).select("doc_id", "text")


@query(
    "t9_punctuation",
    r"""WITH k AS (SELECT *, length(text) // 2 AS k, length(text) - 1 AS z FROM seg), r AS (SELECT *, CASE WHEN seg_idx % 4 = 0 AND regexp_matches(text, '[.?!。？！,;:，；：、]$') THEN text[1:z] ELSE text END AS cut FROM k),
        l AS (SELECT *, regexp_replace(cut[1:k], '\s+$', '') AS l FROM r), e AS (SELECT *, cut[length(l) + 1:length(cut)] AS e FROM l)
        SELECT video_id, seg_idx, CASE WHEN seg_idx % 2 = 1 THEN text ELSE trim(regexp_replace(CASE WHEN l = '' OR regexp_matches(l, '[.?!。？！]$') THEN cut
        WHEN regexp_matches(l, '[,;:，；：、]$') THEN l[1:length(l) - 1] || '.' || e ELSE l || '.' || CASE WHEN regexp_matches(e, '^[^\s)\]}】》〉”’"'']') THEN ' ' ELSE '' END || e END, '\s+', ' ', 'g')) END AS text FROM e""",
    "seg",
)
def _(spark, d):
    """A stop in the middle of each second text, for which each fourth gives up the mark at its end."""
    seg = V.seg(spark, d)
    evidence = seg.select(
        "video_id", "seg_idx", F.floor(F.length("text") / 2).alias("char_offset"), F.when(F.col("seg_idx") % 2 == 0, 0.9).otherwise(0.3).alias("confidence"),
        F.when(F.col("seg_idx") % 4 == 0, F.col("seg_idx")).alias("remove_seg_idx"), (F.length("text") - 1).alias("remove_char_offset"),
    )
    return P.apply_punctuation(seg, evidence).select("video_id", "seg_idx", "text")


@query("t7_glossary")
def _(spark, d):
    return P.apply_glossary(V.line_seg(spark, d), V.gloss(spark, d)).select("video_id", "seg_idx", "text", "replaced")


@query("t13_translation_cleaning", "SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS clean FROM conversations")
def _(spark, d):
    c = V.table(spark, d, "conversations")
    dirty = F.concat(F.when(F.col("turn") % 2 == 0, "<|im_start|>assistant\nTranslation: ").otherwise("```text\n"), "text", F.lit("\n\n  \n```</s>"))
    return c.select("conv_id", "turn", X.clean_translation(dirty).alias("clean"))


@query("t11_asr_cleaning", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM conversations")
def _(spark, d):
    c = V.table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.clean_asr(F.concat(F.lit("<|zh|>[S01] [0.00] "), "text", F.lit(" [12.5]<|end|>"))).alias("clean"))


@query("t14_json_objects", """SELECT conv_id, turn, '{"a":{"t":' || to_json(text) || '},"n":' || turn || '}' AS json FROM conversations""")
def _(spark, d):
    own = F.to_json(F.struct(F.struct(F.col("text").alias("t")).alias("a"), F.col("turn").alias("n")))
    noisy = F.concat(F.lit("Sure {x} here: ```json\n"), own, F.lit("\n``` end"))
    return P.extract_json(V.table(spark, d, "conversations").select("conv_id", "turn", noisy.alias("raw")), "raw").select("conv_id", "turn", "json")


KEPT = "CASE WHEN seg_idx % 3 = 2 THEN (n + 3) // 4 ELSE n - n // 5 END"


@query("t16_pair_metrics", f"SELECT video_id, seg_idx, round((n - m) / n, 6)::DOUBLE AS edit_ratio, round(m / n, 6)::DOUBLE AS size_ratio, n = m AS equivalent, round(m / n, 6)::DOUBLE AS context FROM (SELECT *, {KEPT} AS m FROM (SELECT video_id, seg_idx, count(*) AS n FROM tok GROUP BY 1, 2))", "tok")
def _(spark, d):
    return A.context_share(P.pair_metrics(_verdict_pairs(spark, d))).select("video_id", "seg_idx", "edit_ratio", "size_ratio", "equivalent", "context")


def _verdict_pairs(spark, d):
    """Every text, and the same without each fifth word, or with each fourth only."""
    words = V.seg(spark, d).withColumn("w", X.tokens(F.col("text"))).where(F.size("w") > 0)
    few = F.col("seg_idx") % 3 == 2
    kept = F.filter("w", lambda x, i: F.when(few, i % 4 == 0).otherwise(i % 5 != 4))
    return words.select("video_id", "seg_idx", F.array_join("w", " ").alias("first_pass"), F.array_join(kept, " ").alias("observed"))


GATE = f"SELECT video_id, seg_idx, CASE WHEN n = m AND safe THEN 'VERIFIED' WHEN safe AND n - m <= 0.55 * n THEN 'CORRECTED' ELSE 'UNCERTAIN' END AS decision FROM (SELECT *, m >= 0.4 * n AND seg_idx % 4 <> 3 AS safe FROM (SELECT *, {KEPT} AS m FROM (SELECT video_id, seg_idx, count(*) AS n FROM tok GROUP BY 1, 2)))"


def _verdicts(spark, d):
    metrics = A.context_share(P.pair_metrics(_verdict_pairs(spark, d)))
    return P.safety_gate(metrics.withColumns({"time_grounded": F.col("seg_idx") % 4 != 3, "text_aligned": F.lit(False), "coverage": F.lit(0.9)}))


@query("t18_safety_gate", GATE, "tok")
def _(spark, d):
    return _verdicts(spark, d).select("video_id", "seg_idx", "decision")


@query("a10_outcomes", f"SELECT video_id, count(*) FILTER (decision = 'CORRECTED') AS corrected, count(*) FILTER (decision = 'VERIFIED') AS verified, count(*) FILTER (decision = 'UNCERTAIN') AS uncertain FROM ({GATE}) GROUP BY 1", "tok")
def _(spark, d):
    return P.outcome_counts(_verdicts(spark, d))


@query(
    "a1_entity_memory",
    r"""WITH w AS (SELECT video_id, unnest(regexp_extract_all(text, '([A-Za-z''-]{2,})', 1)) AS s, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS le, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS ca, len(regexp_extract_all(text, '([A-Za-z''-]{2,})', 1)) AS n FROM line_seg),
        u AS (SELECT *, length(regexp_replace(s, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(s, '[^a-z]', '', 'g')) AS lo FROM w),
        k AS (SELECT video_id, lower(s) AS normalized, s, count(*) AS n FROM u WHERE ((up >= 2 AND lo = 0) OR (length(s) >= 4 AND up >= 2 AND lo >= 1)) AND NOT (le >= 12 AND n >= 3 AND ca >= 0.9 * le AND NOT regexp_matches(s, '[a-z]')) AND lower(s) NOT IN ('an','and','are','as','at','be','been','but','by','for','from','had','has','have','he','her','hers','him','his','if','in','into','is','it','its','me','my','no','not','of','on','or','our','please','she','so','that','the','their','them','there','they','this','to','was','we','were','what','when','where','which','who','will','with','would','you','your') GROUP BY ALL),
        g AS (SELECT video_id, normalized, arg_max(s, (n, lower(s), s)) AS canonical, sum(n)::BIGINT AS occurrences FROM k GROUP BY 1, 2 HAVING sum(n) >= 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY occurrences DESC, canonical) AS rank FROM g) WHERE rank <= 32""",
    "line_seg",
)
def _(spark, d):
    return P.entity_memory(V.line_seg(spark, d))


@query(
    "a12_key_points",
    r"""WITH l AS (SELECT doc_id, i, trim(regexp_replace(parts[i], '^\s*(?:[-*•·]|\d+[.)、])\s*', '')) AS p FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
        f AS (SELECT doc_id, p, min(i) AS i FROM l WHERE p <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f)
        SELECT d.doc_id, coalesce(string_agg(p, '|' ORDER BY k) FILTER (k <= 10), '') AS points FROM documents d LEFT JOIN r USING (doc_id) GROUP BY 1""",
)
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.array_join(P.merge_points(F.split("text", "\n")), "|").alias("points"))


@query("j10_match_results", "WITH k AS (SELECT video_id, source_url, rtrim(regexp_replace(lower(source_url), '[?#].*$', ''), '/') AS key FROM video), r AS (SELECT page_id AS result_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN url || '#z' ELSE 'https://nowhere.org/' END AS url FROM pages) SELECT result_id, coalesce(u, v) AS video_id, CASE WHEN u IS NOT NULL THEN 'url' WHEN v IS NOT NULL THEN 'key' END AS matched_by FROM r LEFT JOIN (SELECT source_url AS url, min(video_id) AS u FROM k GROUP BY 1) USING (url) LEFT JOIN (SELECT key, min(video_id) AS v FROM k GROUP BY 1) x ON x.key = rtrim(regexp_replace(lower(r.url), '[?#].*$', ''), '/')", "video")
def _(spark, d):
    p = F.col("page_id")
    url = F.when(p % 3 == 0, F.col("url")).when(p % 3 == 1, F.concat("url", F.lit("#z"))).otherwise("https://nowhere.org/")
    return J.match_results(V.table(spark, d, "pages").select(p.alias("result_id"), F.lit("video").alias("platform"), url.alias("url")), V.video(spark, d))


@query("j12_hit_segments", f"WITH {CHUNKS} SELECT DISTINCT s.video_id, s.seg_idx FROM chunks c JOIN seg s ON s.video_id = c.video_id AND list_contains(string_split(c.segment_ids, ','), s.segment_id) WHERE chunk_idx % 2 = 0", "seg", recursive=True)
def _(spark, d):
    seg = V.seg(spark, d)
    return J.hit_segments(W.chunk_segments(seg).where("chunk_idx % 2 = 0"), seg).select("video_id", "seg_idx")


@query(
    "w23_chapters",
    """WITH d AS (SELECT video_id, seg_idx AS start_idx, start_ms, 'Part ' || seg_idx // 2 AS title, text AS content FROM seg), o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) AS k FROM d),
        w AS (SELECT video_id, k, start_ms, start_idx, title, content, 0 AS slot FROM o WHERE k = 1 UNION ALL SELECT o.video_id, o.k, CASE WHEN again THEN w.start_ms ELSE o.start_ms END, CASE WHEN again THEN w.start_idx ELSE o.start_idx END, CASE WHEN again THEN w.title ELSE o.title END, CASE WHEN again THEN w.content ELSE o.content END, slot + CASE WHEN again THEN 0 ELSE 1 END
        FROM w JOIN o ON o.video_id = w.video_id AND o.k = w.k + 1, LATERAL (SELECT (w.title = o.title OR trim(w.content) = trim(o.content)) AND o.start_ms - w.start_ms <= 10000 AS again))
        SELECT video_id, slot::BIGINT AS chapter, any_value(start_ms) AS start_ms, any_value(start_idx) AS start_idx, any_value(title) AS title, trim(any_value(content)) AS content FROM w WHERE slot < 8 GROUP BY video_id, slot""",
    "seg",
    recursive=True,
)
def _(spark, d):
    seg = V.seg(spark, d)
    return P.clean_chapters(seg.select("video_id", F.col("seg_idx").alias("start_idx"), F.concat(F.lit("Part "), F.floor(F.col("seg_idx") / 2)).alias("title"), F.col("text").alias("content")), seg)


@query(
    "w15_acronyms",
    """WITH w AS (SELECT video_id, upper(token) AS t, seg_idx * 10000000 + pos * 10000 AS t0 FROM tok WHERE regexp_matches(token, '^[a-z]+$')), p AS (SELECT *, unnest(generate_series(0, (length(t) - 1) // 6)) AS k FROM w)
        SELECT video_id, substr(t, k * 6 + 1, 6) AS acronym, t0 + k * 600 AS start_ms, t0 + (k * 6 + length(substr(t, k * 6 + 1, 6)) - 1) * 100 + 90 AS end_ms FROM p WHERE length(substr(t, k * 6 + 1, 6)) >= 3""",
    "tok",
)
def _(spark, d):
    """Every word of the table spelt letter by letter."""
    words = V.tok(spark, d).where(F.col("token").rlike("^[a-z]+$"))
    rows = words.select("video_id", "seg_idx", F.col("pos").alias("word"), F.posexplode(F.split("token", "")).alias("k", "token"))
    start = F.col("seg_idx") * 10_000_000 + F.col("word") * 10_000 + F.col("k") * 100
    return W.stitch_acronyms(rows.select("video_id", "seg_idx", (F.col("word") * 1000 + F.col("k")).alias("pos"), "token", start.alias("start_ms"), (start + 90).alias("end_ms")))


@query("t19_keep_surface", "SELECT video_id, seg_idx, text AS kept FROM seg WHERE len(regexp_extract_all(lower(text), '([0-9a-z_]+|[^\\s0-9a-z_!-/:-@\\[-`{-~])', 1)) > 0", "seg")
def _(spark, d):
    pairs = V.seg(spark, d).where(F.size(X.tokens(F.col("text"))) > 0)
    return A.keep_surface(pairs.select("video_id", "seg_idx", F.col("text").alias("first_pass"), F.lower("text").alias("observed"))).select("video_id", "seg_idx", "kept")


@query("t10_pause_stops")
def _(spark, d):
    """Whole texts without marks, said in twelve seconds, with pauses at every eleventh character."""
    seg = V.seg(spark, d)
    bare = seg.withColumn("text", F.regexp_replace("text", "[.?!]", "")).withColumn("end_ms", F.col("start_ms") + 12_000)
    at = bare.select("video_id", "seg_idx", F.posexplode(F.sequence(F.lit(0), F.length("text"), F.lit(11))).alias("n", "char_offset"))
    return A.stops_at_pauses(bare, at.select("video_id", "seg_idx", "char_offset", (300 + F.col("n") * 37 % 200).alias("gap_ms"), (0.6 + F.col("n") % 4 / 10).alias("confidence"))).select("video_id", "seg_idx", "text")


def _clauses(spark, d):
    """Lines, some of them behind a word that ties them to the one before, some before one that ties them to the next."""
    n = F.col("seg_idx") % 7
    head = F.when(n == 1, "And ").when(n == 3, "When ").when(n == 5, "Quite useless as ").otherwise("")
    tail = F.when(n == 4, " it had become.").when(n == 6, " because").otherwise("")
    return _profiled_lines(spark, d).withColumn("profile", X.language_profile(F.col("lang"))).withColumn("text", F.concat(head, "text", tail))


@query("w25_clauses")
def _(spark, d):
    return Z.review_clauses(_clauses(spark, d))[0]


@query("w25_log")
def _(spark, d):
    return Z.review_clauses(_clauses(spark, d))[1]


@query("t17_local_rewrites")
def _(spark, d):
    w = Window.partitionBy("video_id").orderBy("seg_idx")
    rows = V.seg(spark, d).select("video_id", "seg_idx", F.lag("text").over(w).alias("left"), F.col("text").alias("target"), F.lead("text").over(w).alias("right"))
    rows = rows.where("left is not null and right is not null")
    return A.extract_rewrites(rows.withColumn("observed", F.concat_ws(" ", "left", F.lit("changed words"), "right"))).select("video_id", "seg_idx", "replacement")


@query("t10_surface_repair")
def _(spark, d):
    seg = V.seg(spark, d)
    bare = seg.withColumn("text", F.trim(F.regexp_replace("text", "[.?!,]", "")))
    return A.surface_repair(bare, seg.select("video_id", "seg_idx", F.col("text").alias("observed"))).select("video_id", "seg_idx", "text")


@query("t20_canonical_names")
def _(spark, d):
    lines = V.line_seg(spark, d)
    return A.canonicalize(lines, P.entity_memory(lines)).select("video_id", "seg_idx", "text")


@query("w16_stitched_chunks")
def _(spark, d):
    seg = V.seg(spark, d)
    cues = seg.select("video_id", (F.col("seg_idx") * 2).alias("cue"), (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "text")
    again = seg.select("video_id", (F.col("seg_idx") * 2 + 1).alias("cue"), (F.col("end_ms") / 1000 - 0.5).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), F.element_at(F.split("text", " "), -1).alias("text"))
    return A.stitch_chunks(cues.unionByName(again))


@query(
    "w11_cuts",
    """WITH e AS (SELECT video_id, seg_idx, o AS char_offset, start_ms + o * 37 AS time_ms FROM (SELECT *, length(text) AS n, unnest(generate_series(0, length(text), 1)) AS o FROM seg) WHERE o % 7 < 3 AND o > 0 AND o < n AND start_ms + o * 37 < end_ms),
        r AS (SELECT *, row_number() OVER (PARTITION BY video_id, seg_idx ORDER BY char_offset) AS k FROM e),
        w AS (SELECT video_id, seg_idx, k, char_offset, time_ms, TRUE AS kept FROM r WHERE k = 1 UNION ALL SELECT r.video_id, r.seg_idx, r.k, CASE WHEN near THEN w.char_offset ELSE r.char_offset END, CASE WHEN near THEN w.time_ms ELSE r.time_ms END, NOT near
        FROM w JOIN r ON r.video_id = w.video_id AND r.seg_idx = w.seg_idx AND r.k = w.k + 1, LATERAL (SELECT r.char_offset - w.char_offset <= 1 OR r.time_ms - w.time_ms <= 80 AS near))
        SELECT video_id, seg_idx, char_offset::BIGINT AS char_offset, time_ms::BIGINT AS time_ms FROM w WHERE kept""",
    "seg",
    recursive=True,
)
def _(spark, d):
    seg = V.seg(spark, d)
    places = seg.select("video_id", "seg_idx", "start_ms", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("char_offset"))
    evidence = places.select("video_id", "seg_idx", "char_offset", (F.col("start_ms") + F.col("char_offset") * 37).alias("time_ms"), F.when(F.col("char_offset") % 7 < 3, 0.7).otherwise(0.4).alias("confidence"))
    return W.thin_cuts(seg, evidence)


@query("t3_embedded", "SELECT doc_id, round(a / n, 6)::DOUBLE AS a, round(e / n, 6)::DOUBLE AS e, round(o / n, 6)::DOUBLE AS o FROM (SELECT *, sqrt(a * a + e * e + o * o) AS n FROM (SELECT doc_id, " + ", ".join(f"1 + length(text) - length(replace(text, '{c}', '')) AS {c}" for c in "aeo") + " FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''))")
def _(spark, d):
    """A batch function that counts three vowels stands for a model."""
    docs = V.table(spark, d, "documents").where(F.col("text").rlike(r"\S")).select("doc_id", "text")
    out = K.embed_corpus(docs, "text", lambda texts: [[1 + t.count(c) for c in "aeo"] for t in texts], 3)
    return out.select("doc_id", *(F.round(F.get("vector", F.lit(i)), 6).alias(c) for i, c in enumerate("aeo")))


@query("t4_postings", f"WITH {CHUNKS}, words AS (SELECT video_id, chunk_idx, unnest(regexp_extract_all(lower(text), '{_RX}', 1)) AS token FROM chunks), len AS (SELECT video_id, chunk_idx, count(*) AS length FROM words GROUP BY ALL) SELECT video_id, chunk_idx, token, count(*) AS tf, any_value(length) AS length FROM words JOIN len USING (video_id, chunk_idx) GROUP BY ALL", "seg", recursive=True)
def _(spark, d):
    return K.build_index(W.chunk_segments(V.seg(spark, d)))[0]


def _shared(spark, name):
    """A new folder in the cluster's shared one; a local session without the setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='spark-shared-')).rstrip('/')}/cuemill-{name}-{uuid.uuid4().hex}"


@query("i7_reindex", f"WITH {CHUNKS} SELECT video_id, chunk_idx, array_to_string(regexp_extract_all(lower(text), '{_RX}', 1), ' ') || CASE WHEN video_id % 3 = 1 THEN ' again' ELSE '' END AS content FROM chunks WHERE video_id % 3 <> 2", "seg", recursive=True)
def _(spark, d):
    """All videos are indexed; then a third of them change and a third lose their transcripts."""
    path, chunks = _shared(spark, "index"), W.chunk_segments(V.seg(spark, d))
    ids = chunks.select("video_id").distinct()
    K.reindex(path, chunks, ids)
    changed = chunks.where("video_id % 3 = 1").withColumn("text", F.concat("text", F.lit(" again")))
    K.reindex(path, changed, ids.where("video_id % 3 <> 0"))
    return K.read_index(spark, path).select("video_id", "chunk_idx", "content")


@query("t8_typography")
def _(spark, d):
    return Y.typography(_loud_lines(spark, d)).select("video_id", "seg_idx", "text", "before", "operation", "rule_id")


def _loud_lines(spark, d):
    """Lines, each third one in capitals, with names and addresses in between."""
    text = F.when(F.col("seg_idx") % 3 == 1, F.upper("text")).otherwise(F.concat(F.lit("we met Gray of CLTC; "), "text"))
    return _profiled_lines(spark, d).withColumn("profile", X.language_profile(F.col("lang"))).withColumn("text", text)


@query(
    "t15_notes",
    """WITH d AS (SELECT video_id, seg_idx, trim(text) AS t, seg_idx // 4 AS part, start_ms FROM seg), p AS (SELECT video_id, part, count(*) AS n FROM d GROUP BY 1, 2), v AS (SELECT video_id, count(*) AS parts FROM p GROUP BY 1)
        SELECT video_id, CASE WHEN parts = 1 THEN (SELECT substr('Part 0 of ' || d.t, 1, 2000) FROM d WHERE d.video_id = v.video_id AND d.seg_idx = 0) ELSE 'All of ' || video_id END AS summary,
        CASE WHEN parts = 1 THEN 'point 0' ELSE 'merged|points' END AS points, (SELECT string_agg(start_ms || ' C' || seg_idx, '|' ORDER BY start_ms) FROM d WHERE d.video_id = v.video_id AND seg_idx % 4 = 0) AS chapters FROM v""",
    "seg",
)
def _(spark, d):
    """One draft for four segments, its chapter given twice by the segment's number, the points with bullets."""
    seg = V.seg(spark, d).withColumn("part", F.floor(F.col("seg_idx") / 4))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "start_ms", F.trim("text").alias("t")))), lambda x: x)
    parts = seg.groupBy("video_id", "part").agg(rows.alias("s"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    first = F.get("s", F.lit(0))
    chapter = F.struct(F.lit(1).cast("long").alias("start_id"), F.lit(None).cast("long").alias("timestamp_ms"), F.concat(F.lit(" C"), first["seg_idx"].cast("string"), F.lit(" ")).alias("title"), F.lit("what it says").alias("content"))
    drafts = parts.select(
        "video_id", "part", F.concat(F.lit("  Part "), F.col("part").cast("string"), F.lit(" of "), first["t"]).alias("summary"),
        F.array(F.concat(F.lit(" - point "), F.col("part").cast("string")), F.concat(F.lit("2) point "), F.col("part").cast("string")), F.lit(" ")).alias("key_points"), F.array(chapter, chapter).alias("chapters"),
    )
    batches = parts.select("video_id", "part", "start_ms", "end_ms", F.transform("s", lambda x: x["start_ms"]).alias("starts"))
    merged = parts.select("video_id").distinct().select("video_id", F.concat(F.lit("All of "), "video_id").alias("summary"), F.array(F.lit("merged"), F.lit("points"), F.lit("merged")).alias("key_points"))
    notes = N.merge_notes(N.normalize_drafts(drafts, batches), merged)
    chapters = F.array_join(F.transform("chapters", lambda c: F.concat(c["timestamp_ms"].cast("string"), F.lit(" "), c["title"])), "|")
    return notes.select("video_id", "summary", F.array_join("key_points", "|").alias("points"), chapters.alias("chapters"))


@query("w19_bridges")
def _(spark, d):
    """Neighbours whose cut is spoilt, and a bridge that has both sides whole."""
    w = Window.partitionBy("video_id").orderBy("seg_idx")
    rows = V.seg(spark, d).select("video_id", "seg_idx", F.col("text").alias("l"), F.lead("text").over(w).alias("r")).where("r is not null")
    pairs = rows.select("video_id", "seg_idx", F.concat("l", F.lit(" zq")).alias("left"), F.concat(F.lit("qz "), "r").alias("right"), F.concat("l", F.lit(". "), "r").alias("bridge"))
    return G.bridge_rewrite(pairs).select("video_id", "seg_idx", "new_left", "new_right", "matched")


@query("t21_word_times")
def _(spark, d):
    """The words of each segment against a table of timed words that misses some and misspells others."""
    tok = V.tok(spark, d)
    word = F.when(F.col("pos") % 4 == 1, F.concat("token", F.lit("x"))).otherwise(F.col("token"))
    timed = tok.where("pos % 6 <> 5").select("video_id", "seg_idx", F.col("pos").alias("at"), word.alias("word"), "start_ms", "end_ms")
    return A.align_words(V.seg(spark, d), timed)


def _paused(spark, d):
    """Segments whose words are heard with one gap, three words before the first mark; every other one is a pause of the detector too."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    units = lambda c: F.size(F.regexp_extract_all(c, F.lit("([0-9A-Za-z']+)"), F.lit(1)))
    seg = V.seg(spark, d).select("video_id", "seg_idx", "start_ms", "end_ms", flat.alias("text"))
    gap_at = F.greatest(units(F.regexp_extract("text", "^([^.?!]*)", 1)) - 3, F.lit(1))
    words = F.regexp_extract_all("text", F.lit("([0-9A-Za-z']+)"), F.lit(1))
    rows = seg.withColumn("gap_at", gap_at).withColumn("words", words).withColumn("n", F.size("words"))
    rows = rows.select("*", F.posexplode("words").alias("at", "word"))
    size = F.col("end_ms") - F.col("start_ms")
    shift = F.when(F.col("at") >= F.col("gap_at"), F.floor(size * 0.3)).otherwise(0)
    at = lambda k: (F.col("start_ms") + F.floor(size * 0.7 * k / F.col("n")) + shift).cast("long")
    heard = rows.withColumn("s", at(F.col("at"))).withColumn("e", (at(F.col("at") + 1) - 20).cast("long"))
    heard = heard.select("video_id", "seg_idx", "at", F.when(F.col("at") % 5 == 2, F.concat("word", F.lit("x"))).otherwise(F.col("word")).alias("word"), "s", "e", "gap_at")
    pauses = heard.where("seg_idx % 2 = 0").groupBy("video_id", "seg_idx").agg(F.max(F.when(F.col("at") == F.col("gap_at") - 1, F.col("e"))).alias("gap_start"), F.max(F.when(F.col("at") == F.col("gap_at"), F.col("s"))).alias("gap_end"))
    pauses = settled(pauses.where("gap_end > gap_start").select("video_id", "gap_start", "gap_end"))
    windows = settled(B.pause_windows(seg, pauses))
    cell = lambda c: F.floor(F.col(c) / 10_000)
    reach = windows.select("video_id", "window", "kind", "from_ms", "to_ms", F.explode(F.sequence(cell("from_ms"), cell("to_ms"))).alias("cell"))
    inside = heard.withColumn("cell", cell("s")).join(reach, ["video_id", "cell"]).where((F.col("s") >= F.col("from_ms")) & (F.col("e") <= F.col("to_ms")))
    timed = settled(inside.select("video_id", "window", (F.col("seg_idx") * 10_000 + F.col("at")).alias("at"), "word", F.col("s").alias("start_ms"), F.col("e").alias("end_ms")))
    stopped = F.concat(F.col("word"), F.when(F.col("at") % 3 == 0, ". ").otherwise(" "))
    spoken = timed.where("window % 3 = 0").withColumn("said", stopped)
    hints = spoken.groupBy("video_id", "window").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), "").alias("hint"))
    return seg, timed, pauses, windows, hints


@query("t22_pause_repairs")
def _(spark, d):
    out = B.pause_repairs(*_paused(spark, d))
    return out.withColumn("confidence", F.round("confidence", 6))


def _canonical_input(spark, d):
    """Loud lines, some beginning with the end of the one before, some with a loop or a spelt name; and evidence of six kinds for them."""
    w = Window.partitionBy("video_id").orderBy("seg_idx")
    lines = _loud_lines(spark, d)
    before = F.split(F.trim(F.lag("text").over(w)), " ")
    again = F.array_join(F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), 3), " ")
    spoken = F.when(F.col("seg_idx") % 6 == 3, F.replace("text", F.lit("CLTC"), F.lit("C L T C"))).when(F.col("seg_idx") % 11 == 5, F.concat(F.lit("well well well, well "), "text"))
    lines = lines.withColumn("text", F.when((F.col("seg_idx") % 4 == 1) & F.lag("text").over(w).isNotNull(), F.concat(again, F.lit(" "), F.trim("text"))).otherwise(F.coalesce(spoken, F.col("text"))))
    lines = settled(lines.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))))  # six tables are made of them
    half = F.floor(F.length("text") / 2)
    words = F.regexp_extract_all(F.lower("text"), F.lit("([0-9a-z']+)"), F.lit(1))
    tokens = lines.where("seg_idx % 11 = 5 or seg_idx % 3 = 0").withColumn("n", F.size(words)).select("video_id", "seg_idx", "start_ms", "end_ms", "n", F.posexplode(words).alias("pos", "token"))
    at = lambda k: (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / F.col("n"))).cast("long")
    tokens = tokens.select("video_id", "seg_idx", F.col("pos").cast("long").alias("pos"), "token", at(F.col("pos")).alias("start_ms"), at(F.col("pos") + 1).alias("end_ms"), F.lit(0.8).alias("confidence"))
    pauses = lines.where("seg_idx % 5 = 2").select(
        "video_id", "seg_idx", half.alias("char_offset"), F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("time_ms"), F.lit(400).cast("long").alias("gap_ms"), F.lit(0.8).alias("confidence"), F.lit("acoustic_pause").alias("kind"),
    )
    return lines, {
        "confidence": lines.where("seg_idx % 2 = 0").select("video_id", "seg_idx", F.lit(0.4).alias("avg_confidence")),
        "punctuation": lines.where("seg_idx % 7 = 3").select("video_id", "seg_idx", half.alias("char_offset"), F.lit(0.9).alias("confidence")),
        "tokens": tokens, "boundary": pauses, "pauses": pauses, "glossary": V.gloss(spark, d),
    }


def _canonical(spark, d):
    return C.canonicalize_corpus(*_canonical_input(spark, d))


@query("t23_canonical")
def _(spark, d):
    return _canonical(spark, d)[0]


@query("t23_log")
def _(spark, d):
    return _canonical(spark, d)[1]
