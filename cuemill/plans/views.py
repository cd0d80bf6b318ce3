"""Views that give the test tables the shapes of transcripts, videos, queues and speech.

Each has a DataFrame form, and a DuckDB form in ``SQL`` for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.functions import text as X

PRIOR = (Window.unboundedPreceding, -1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timed(df: DataFrame) -> DataFrame:
    """Start and end of rows (video_id, seg_idx, text): lengths and gaps follow the text and the place."""
    size = F.length(F.trim("text")).cast("long") * 40 + 200
    gap = F.when(F.col("seg_idx") % 4 == 0, 100).when(F.col("seg_idx") % 4 == 1, 350).when(F.col("seg_idx") % 4 == 2, 700).otherwise(2600)
    before = Window.partitionBy("video_id").orderBy("seg_idx").rowsBetween(*PRIOR)
    start = F.coalesce(F.sum(size + gap).over(before), F.lit(0)).cast("long")
    return df.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + size)


def seg(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seg_idx"), F.concat_ws("-", "conv_id", "turn").alias("segment_id"), "role", "text")
    return _timed(c).withColumn("translated_text", F.when(F.col("seg_idx") % 2 == 1, F.concat(F.lit("[t] "), "text")))


def line_seg(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), "lang", F.posexplode(F.split("text", "\n")).alias("seg_idx", "text"))
    return _timed(lines.where(F.trim("text") != "").withColumn("seg_idx", F.col("seg_idx").cast("long")))


def tok(spark: SparkSession, d: str) -> DataFrame:
    words = seg(spark, d).withColumn("words", X.tokens(F.col("text")))
    rows = words.select("video_id", "seg_idx", "start_ms", "end_ms", F.size("words").alias("n"), F.posexplode("words").alias("pos", "token"))
    at = lambda p: F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * p / F.col("n"))
    return rows.select(
        "video_id", "seg_idx", F.col("pos").cast("long").alias("pos"), "token", at(F.col("pos")).alias("start_ms"), at(F.col("pos") + 1).alias("end_ms"),
        F.round(1 - (F.col("pos") % 5) / 10, 1).alias("confidence"),
    )


def speech(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us")
    start = F.expr("us - first_us").alias("x")
    e = e.withColumn("first_us", F.min("us").over(Window.partitionBy("user_id"))).withColumn("start_ms", F.floor(start / 10_000_000))
    e = e.withColumn("next_ms", F.coalesce(F.lead("start_ms").over(w), F.col("start_ms") + 2000)).withColumn("seg_idx", F.row_number().over(w).cast("long") - 1)
    return e.select(F.col("user_id").alias("video_id"), "seg_idx", "start_ms", F.least(F.col("start_ms") + F.floor(3 * F.col("value")), "next_ms").alias("end_ms"))


def video(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/?#:]+)", 1))
    base = p.select(
        F.col("page_id").alias("video_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.element_at(F.split("host", "[.]"), -1).alias("platform"),
        F.col("url").alias("source_url"), F.col("host").alias("author"), (F.col("page_id") * 3600).alias("updated_at"),
        F.when(F.col("page_id") % 7 != 0, F.col("page_id")).alias("library_available_at"), F.when(F.col("page_id") % 11 == 0, F.col("page_id")).alias("deleted_at"),
    )
    again = base.where("video_id % 5 = 0").select(
        (F.col("video_id") + 1_000_000).alias("video_id"), "title", "platform", F.concat("source_url", F.lit("#x")).alias("source_url"), "author", "updated_at",
        F.lit(None).cast("long").alias("library_available_at"), "deleted_at",
    )
    return base.unionByName(again)


def qstate(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "signup", "queued").when(kind.isin("view", "click"), "running").when(kind == "error", "failed").otherwise("completed")
    return table(spark, d, "events").select(
        F.col("event_id").alias("item_id"), F.col("user_id").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), state.alias("state"),
        F.when(kind == "view", "download").otherwise("transcribe").alias("stage"), F.least(F.lit(100), F.floor("value")).cast("int").alias("progress"),
    )


def artifact(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    one = lambda kind, state: labels.select(F.col("doc_id").alias("video_id"), F.lit(kind).alias("artifact_type"), state.alias("state"), F.lit(1).cast("long").alias("revision"))
    return one("standard_transcript", F.when(F.col("quality") == 1, "ready").otherwise("failed")).unionByName(one("translation", F.when(F.col("toxic") == 1, "stale").otherwise("ready")))


def gloss(spark: SparkSession, d: str) -> DataFrame:
    words = F.slice(F.split("text", " "), 1, 3)
    return table(spark, d, "benchmark").select(F.array_join(words, "-").alias("canonical"), F.array_join(words, " ").alias("alias"))


_TOKEN = X.TOKEN.replace("'", "''")
_TIMED = """coalesce(sum(40 * length(trim(text)) + 200 + CASE seg_idx % 4 WHEN 0 THEN 100 WHEN 1 THEN 350 WHEN 2 THEN 700 ELSE 2600 END)
    OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms"""

#: The same views for DuckDB; a view may use those before it.
SQL = {
    "seg": f"""seg AS (SELECT *, start_ms + 40 * length(trim(text)) + 200 AS end_ms, CASE WHEN seg_idx % 2 = 1 THEN '[t] ' || text END AS translated_text
        FROM (SELECT *, {_TIMED} FROM (SELECT conv_id AS video_id, turn AS seg_idx, conv_id || '-' || turn AS segment_id, role, text FROM conversations)))""",
    "line_seg": f"""line_seg AS (SELECT *, start_ms + 40 * length(trim(text)) + 200 AS end_ms FROM (SELECT *, {_TIMED} FROM (
        SELECT doc_id AS video_id, lang, i - 1 AS seg_idx, parts[i] AS text FROM (SELECT doc_id, lang, parts, unnest(generate_series(1, len(parts))) AS i
        FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents))) WHERE trim(text) <> ''))""",
    "tok": f"""tok AS (SELECT video_id, seg_idx, i - 1 AS pos, words[i] AS token, start_ms + (end_ms - start_ms) * (i - 1) // len(words) AS start_ms,
        start_ms + (end_ms - start_ms) * i // len(words) AS end_ms, round(1 - ((i - 1) % 5) / 10, 1)::DOUBLE AS confidence
        FROM (SELECT *, unnest(generate_series(1, len(words))) AS i FROM (SELECT *, regexp_extract_all(lower(text), '{_TOKEN}', 1) AS words FROM seg)))""",
    "speech": """speech AS (SELECT user_id AS video_id, row_number() OVER w - 1 AS seg_idx, start_ms, least(start_ms + floor(3 * value)::BIGINT, coalesce(lead(start_ms) OVER w, start_ms + 2000)) AS end_ms
        FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 10000000 AS start_ms FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts))""",
    "video": """base AS (SELECT page_id AS video_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, string_split(host, '.')[-1] AS platform, url AS source_url, host AS author,
        page_id * 3600 AS updated_at, CASE WHEN page_id % 7 <> 0 THEN page_id END AS library_available_at, CASE WHEN page_id % 11 = 0 THEN page_id END AS deleted_at
        FROM (SELECT *, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages)),
        video AS (SELECT * FROM base UNION ALL SELECT video_id + 1000000, title, platform, source_url || '#x', author, updated_at, NULL, deleted_at FROM base WHERE video_id % 5 = 0)""",
    "qstate": """qstate AS (SELECT event_id AS item_id, user_id AS video_id, ts, CASE WHEN event_type = 'signup' THEN 'queued' WHEN event_type IN ('view', 'click') THEN 'running'
        WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS state, CASE WHEN event_type = 'view' THEN 'download' ELSE 'transcribe' END AS stage, least(100, floor(value))::INT AS progress FROM events)""",
    "artifact": """artifact AS (SELECT doc_id AS video_id, 'standard_transcript' AS artifact_type, CASE WHEN quality = 1 THEN 'ready' ELSE 'failed' END AS state, 1::BIGINT AS revision FROM labels
        UNION ALL SELECT doc_id, 'translation', CASE WHEN toxic = 1 THEN 'stale' ELSE 'ready' END, 1 FROM labels)""",
    "gloss": """gloss AS (SELECT array_to_string(string_split(text, ' ')[1:3], '-') AS canonical, array_to_string(string_split(text, ' ')[1:3], ' ') AS alias FROM benchmark)""",
}
_NEEDS = {"tok": ["seg"]}


def oracle(views: str, body: str, recursive: bool = False) -> str:
    """SQL with the named views in front; ``body`` may begin with further common tables."""
    names = []
    for v in views.split():
        names += [x for x in [*_NEEDS.get(v, []), v] if x not in names]
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    join = ", " if body.upper().startswith("WITH ") else " "
    return head + ", ".join(SQL[v] for v in names) + join + (body[5:] if join == ", " else body)
