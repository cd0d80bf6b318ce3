"""Library, queue and artifact tables: pages, merges, staleness, command logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.sources.versions import Versions

#: States of the queue list's filters.
STATE_FILTERS = {"active": ["queued", "running", "paused", "blocked", "failed"], "completed": ["completed"], "failed": ["failed"]}


def library_filter(videos: DataFrame, query: str = "", platform: str = "") -> DataFrame:
    """Available, not deleted videos with the query in title, author or URL, whatever the case, and the platform."""
    out = videos.where(F.col("library_available_at").isNotNull() & F.col("deleted_at").isNull())
    if query:
        q = F.lower(F.lit(query))
        out = out.where(F.contains(F.lower("title"), q) | F.contains(F.lower(X.text_of("author")), q) | F.contains(F.lower("source_url"), q))
    return out.where(F.lower("platform") == platform.lower()) if platform else out


def library_page(videos: DataFrame, query: str = "", platform: str = "", page: int = 1, size: int = 20) -> DataFrame:
    """One page, newest first, with the number of all that match."""
    found = library_filter(videos, query, platform)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    size = min(100, max(1, size))
    rows = found.orderBy(F.desc("updated_at"), F.desc("video_id")).offset((max(1, page) - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total))


def library_after(videos: DataFrame, updated_at: int, video_id: int, size: int = 20) -> DataFrame:
    """The page after a known last row: a key-set filter instead of an offset, for deep pages (K1)."""
    older = (F.col("updated_at") < updated_at) | ((F.col("updated_at") == updated_at) & (F.col("video_id") < video_id))
    return videos.where(older).orderBy(F.desc("updated_at"), F.desc("video_id")).limit(size)


def split_valid(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id has 1 to 64 letters, digits, underscores or hyphens, and the others."""
    ok = F.coalesce(F.col(column).rlike("^[A-Za-z0-9_-]{1,64}$"), F.lit(False))
    return df.where(ok), df.where(~ok)


def queue_list(queue: DataFrame, videos: DataFrame, state: str = "active") -> DataFrame:
    """Queue items of a filter with their videos' titles."""
    rows = queue.where(F.col("state").isin(STATE_FILTERS[state])) if state in STATE_FILTERS else queue
    return rows.join(videos.select("video_id", "title", "platform"), "video_id", "left")


def upsert_artifacts(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Artifacts made ready: new ones at revision 1, known ones one revision on."""
    c = changes.select("video_id", "artifact_type").distinct().withColumn("changed", F.lit(True))
    out = table.join(c, ["video_id", "artifact_type"], "full_outer")
    return out.select(
        "video_id", "artifact_type", F.when(F.col("changed"), "ready").otherwise(F.col("state")).alias("state"),
        F.when(F.col("changed"), F.coalesce(F.col("revision"), F.lit(0)) + 1).otherwise(F.col("revision")).alias("revision"),
    )


def mark_stale(table: DataFrame, edited: DataFrame) -> DataFrame:
    """Ready translations and notes of edited videos become stale."""
    e = edited.select("video_id").distinct().withColumn("edited", F.lit(True))
    hit = F.coalesce("edited", F.lit(False)) & F.col("artifact_type").isin("translation", "note") & (F.col("state") == "ready")
    return table.join(e, "video_id", "left").withColumn("state", F.when(hit, "stale").otherwise(F.col("state"))).drop("edited")


def enqueue(requests: DataFrame, videos: DataFrame, queue: DataFrame) -> DataFrame:
    """Requests (pos, platform, source_url): already in the library, already queued, or a new queue item (I4).

    A key that came earlier in the same request counts as queued.
    """
    key = X.source_key(F.col("platform"), F.col("source_url"))
    keyed = videos.withColumn("source_key", key)
    library = keyed.where("library_available_at is not null and deleted_at is null").groupBy("source_key").agg(F.min("video_id").alias("library_video"))
    queued = keyed.join(queue.where(~F.col("state").isin("cancelled", "completed")).select("video_id").distinct(), "video_id", "left_semi").groupBy("source_key").agg(F.min("video_id").alias("queued_video"))
    rows = requests.withColumn("source_key", key).withColumn("turn", F.row_number().over(Window.partitionBy("source_key").orderBy("pos")))
    out = rows.join(library, "source_key", "left").join(queued, "source_key", "left")
    outcome = F.when(F.col("library_video").isNotNull(), "alreadyInLibrary").when(F.col("queued_video").isNotNull() | (F.col("turn") > 1), "alreadyQueued").otherwise("queueItem")
    return out.select("pos", "source_key", outcome.alias("outcome"), F.coalesce("library_video", "queued_video").alias("video_id"))


def apply_edits(seg: DataFrame, edits: DataFrame) -> DataFrame:
    """The latest edit (video_id, segment_id, seq, text, start_ms, end_ms) of each segment; its translation is cleared."""
    last = edits.groupBy("video_id", "segment_id").agg(F.max_by(F.struct("text", "start_ms", "end_ms"), "seq").alias("e"))
    out = seg.join(last, ["video_id", "segment_id"], "left")
    edited = F.col("e").isNotNull()
    return out.select(*(
        F.coalesce(F.col(f"e.{c}"), F.col(c)).alias(c) if c in ("text", "start_ms", "end_ms") else F.when(~edited, F.col(c)).alias(c) if c == "translated_text" else F.col(c)
        for c in seg.columns
    ))


def merge_translations(seg: DataFrame, translations: DataFrame) -> DataFrame:
    """Translations (video_id, segment_id, output) cleaned and merged; an empty one falls back to the text."""
    t = translations.select("video_id", "segment_id", X.clean_translation(F.col("output")).alias("clean"))
    out = seg.join(t, ["video_id", "segment_id"], "left")
    new = F.when(F.col("clean").isNull(), F.col("translated_text")).when(F.col("clean") == "", F.trim("text")).otherwise(F.col("clean"))
    return out.withColumn("translated_text", new).select(*seg.columns)


def new_revisions(new: DataFrame, store: DataFrame) -> DataFrame:
    """Revisions (video_id, hash, created) that the store does not have; repeated content is no new one."""
    first = new.groupBy("video_id", "hash").agg(F.min("created").alias("created"))
    return first.join(store.select("video_id", "hash"), ["video_id", "hash"], "left_anti")


def current_revisions(store: DataFrame) -> DataFrame:
    """The pointer table: each video's latest revision."""
    return store.groupBy("video_id").agg(F.max_by("hash", F.struct("created", "hash")).alias("hash"))


def stale(videos: DataFrame, manifests: DataFrame, hashes: DataFrame, version: int) -> DataFrame:
    """Videos to process again and why: no manifest, another version, another content hash."""
    out = videos.select("video_id").join(manifests.select("video_id", "version", F.col("hash").alias("known")), "video_id", "left").join(hashes.select("video_id", "hash"), "video_id", "left")
    reason = F.when(F.col("version").isNull(), "no_manifest").when(F.col("version") != version, "version").when(~F.col("known").eqNullSafe(F.col("hash")), "content")
    return out.select("video_id", reason.alias("reason")).where("reason is not null")


def recover(queue: DataFrame, valid: DataFrame) -> DataFrame:
    """Items that ran when the process ended: completed if their transcript is valid, else queued at their stage."""
    v = valid.select("video_id").distinct().withColumn("valid", F.lit(True))
    out = queue.join(v, "video_id", "left")
    was = F.col("state") == "running"
    done = was & F.coalesce("valid", F.lit(False))
    return out.select(*(
        F.when(done, "completed").when(was, "queued").otherwise(F.col("state")).alias("state") if c == "state" else F.when(done, 100).otherwise(F.col(c)).cast("int").alias(c) if c == "progress" else F.col(c)
        for c in queue.columns
    ))


def _next_state(state: Column, command: Column) -> Column:
    return (
        F.when((command == "pause") & state.isin("queued", "running", "blocked"), "paused")
        .when((command == "resume") & (state == "paused"), "queued")
        .when((command == "remove") & (state != "running"), "cancelled")
        .when((command == "retry") & (state == "failed"), "queued")
        .when((command == "requeue") & state.isin("completed", "cancelled", "failed"), "queued")
        .when((command == "start") & (state == "queued"), "running")
        .when((command == "finish") & (state == "running"), "completed")
        .when((command == "fail") & (state == "running"), "failed")
        .otherwise(state)
    )


def fold_commands(commands: DataFrame, start: str = "queued") -> DataFrame:
    """Guarded transitions of each item's commands (item_id, seq, command) in order: last state, commands that applied."""
    rows = commands.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("seq", "command"))).alias("c"))
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("applied"))

    def step(a: Column, x: Column) -> Column:
        new = _next_state(a["state"], x["command"])
        return F.struct(new.alias("state"), (a["applied"] + (new != a["state"]).cast("long")).alias("applied"))

    return rows.select("item_id", F.aggregate("c", zero, step).alias("a")).select("item_id", "a.state", "a.applied")


def migrate_jobs(jobs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legacy jobs (id, title, status, progress) as (videos, queue items); demo rows go, known rows stay as they are (I8)."""
    rows = jobs.where(~F.col("id").startswith("demo")).join(known.select("id"), "id", "left_anti")
    state = F.when(F.col("status") == "completed", "completed").when(F.col("status").isin("failed", "error"), "failed").when(F.col("status") == "cancelled", "cancelled").otherwise("queued")
    videos = rows.select("id", "title", F.when(F.col("status") == "completed", F.col("updated_at")).alias("library_available_at"))
    return videos, rows.select("id", state.alias("state"), F.when(state == "completed", 100).otherwise(F.least(F.col("progress"), F.lit(99))).alias("progress"))


def migrated_artifacts(jobs: DataFrame, known: DataFrame) -> DataFrame:
    """Artifact rows (id, artifact_type, state, revision) of the completed jobs that ``migrate_jobs`` takes over (I8)."""
    done = jobs.where(~F.col("id").startswith("demo") & (F.col("status") == "completed")).join(known.select("id"), "id", "left_anti")
    kinds = F.explode(F.array(F.lit("source_media"), F.lit("standard_transcript"))).alias("artifact_type")
    return done.select("id", kinds, F.lit("ready").alias("state"), F.lit(1).cast("long").alias("revision"))


def migrate_store(store: Versions, jobs: DataFrame) -> int:
    """Legacy jobs into the ``videos``, ``queue`` and ``artifacts`` tables of a store in one commit; its version (I8).

    What is known stays as it is, so a second run changes nothing; a run that stops leaves the version before.
    """
    base = store.current()
    held = {name: store.read(name, base) for name in ("videos", "queue", "artifacts")}
    known = held["videos"].select("id") if held["videos"] is not None else jobs.select("id").limit(0)
    videos, queue = migrate_jobs(jobs, known)
    new = {"videos": videos, "queue": queue, "artifacts": migrated_artifacts(jobs, known)}
    return store.commit({k: v if held[k] is None else held[k].unionByName(v) for k, v in new.items()}, base).version


def latest_state(events: DataFrame) -> DataFrame:
    """The latest state of each item; progress is at most 99 until it is completed."""
    best = events.groupBy("video_id").agg(F.max(F.struct("ts", "item_id", "state", "progress")).alias("e"))
    return best.select("video_id", "e.state", F.when(F.col("e.state") == "completed", 100).otherwise(F.least("e.progress", F.lit(99))).cast("int").alias("progress"))


def sort_key_seconds(text: Column) -> Column:
    """Seconds of ``H:MM:SS``, ``MM:SS`` or plain numbers; null for anything else (K7)."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)


def sort_key_count(text: Column) -> Column:
    """Number of a play count with or without unit (K7)."""
    number = F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("double")
    return F.when(text.endswith("亿"), number * 1e8).when(text.endswith("万"), number * 1e4).otherwise(number)
