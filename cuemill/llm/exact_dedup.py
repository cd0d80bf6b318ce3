"""Exact deduplication as a stateful stream over disk-backed keyed state.

The stream reads (digest, identifier, size, locator) rows and folds them into one state row per digest, kept in
RocksDB without expiry: the number of copies and the best copy so far, with its stable identifier and the locator
of its content. Spark combines the rows of a digest inside each task before they travel, so a digest that a third
of all rows share costs one row per task. Rows that hit an existing digest are then compared byte for byte with the
content that the locator names; should two different texts share a digest, that digest is grouped again by the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import join_small, pin, row_key, session_conf, shared_dir

#: Copies of a text that are compared in one part.
PART_ROWS = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: str = "text") -> Column:
    """The text without the six ASCII white-space characters; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _best() -> Column:
    """Order of copies, the smallest best: most code points, then the smallest identifier (null last), then the locator."""
    return F.struct((-F.col("_n")).alias("less"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_at").alias("at"))


def fold_digests(staged: DataFrame, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream the staged Parquet folder ``path`` through the keyed state; the state as (digest, copies, best).

    The checkpoint lies beside the folder, so a stopped run goes on from its last committed batch.
    """
    spark = staged.sparkSession
    reader = spark.readStream.schema(staged.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(path).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(_best()).alias("best"))
    checkpoint = f"{path}-state"
    prefix = "spark__sql__streaming__stateStore__"
    conf = {
        f"{prefix}providerClass": ROCKSDB,
        f"{prefix}rocksdb__boundedMemoryUsage": "true",
        f"{prefix}rocksdb__maxMemoryUsageMB": "200",
        f"{prefix}rocksdb__changelogCheckpointing__enabled": "true",
        f"{prefix}rocksdb__allowFAllocate": "false",  # many small stores: no space set aside for their logs
        f"{prefix}unloadOnCommit": "true",
    }
    with session_conf(spark, **conf):
        query = (
            state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        kept = spark.read.format("statestore").load(checkpoint)
        fields = kept.schema["value"].dataType.names
        return pin(kept.select("key.digest", F.col(f"value.{fields[0]}").alias("copies"), F.col(f"value.{fields[1]}").alias("best")))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per document: (id, _digest, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical without ASCII white space. The copy with the most code points stays, then the one
    with the smallest identifier, of any type that has an order. Null and empty texts are one group; a null identifier comes last in ties;
    rows that repeat both identifier and text share a decision (``drop_exact_duplicates`` leaves one of them). Other
    columns are neither read nor returned, whatever their names. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    path = shared_dir(spark)
    keyed = source.select(
        "_id", digest(normalised("_text")).alias("digest"), F.length(F.coalesce("_text", F.lit(""))).alias("_n"),
        F.input_file_name().alias("_at"), F.sha2(normalised("_text").cast("binary"), 256).alias("text_sha256"),
    )
    staged = pin(keyed, path)
    state = fold_digests(staged.select("_id", "digest", "_n", "_at"), path)
    hits = state.where("copies > 1")
    found = staged.join(state, "digest").select(
        F.col("_id").alias(id_col), F.hex("digest").alias("_digest"), F.col("best.id").alias("keep_id"),
        F.col("copies").alias("group_size"), F.col("_id").eqNullSafe(F.col("best.id")).alias("kept"), "text_sha256",
    )
    clashes = _clashes(source.withColumn("digest", digest(normalised("_text"))), hits)
    if clashes.isEmpty():
        return found
    return _by_text(source, found, clashes, id_col, digest)


def _clashes(source: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests whose rows do not all have the bytes of the kept copy's content.

    Only rows that hit a stored digest are read again; each is compared in full with the content at the locator. Many
    copies of one text are compared in parts, each with the stored content beside it.
    """
    again = source.withColumn("_at", F.input_file_name())
    parts = F.ceil(F.col("copies") / PART_ROWS)
    members = join_small(again, hits.select("digest", "best", parts.alias("parts")), ["digest"], "inner")
    part = F.pmod(F.xxhash64("_id", "_at"), "parts")
    members = members.select("digest", "_id", "_at", "best", "parts", part.alias("part"), normalised("_text").cast("binary").alias("content"))
    located = F.col("_id").eqNullSafe(F.col("best.id")) & (F.col("_at") == F.col("best.at"))
    kept = members.where(located).groupBy("digest").agg(F.min("content").alias("stored"), F.first("parts").alias("parts"))
    kept = kept.select("digest", "stored", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return pin(members.join(kept, ["digest", "part"]).where("content <> stored").select("digest").distinct())


def _by_text(source: DataFrame, found: DataFrame, clashes: DataFrame, id_col: str, digest: Callable) -> DataFrame:
    """The documents of clashing digests grouped by their whole text instead."""
    rows = join_small(source.withColumn("digest", digest(normalised("_text"))), clashes, ["digest"], "left_semi")
    rows = rows.select("_id", "digest", normalised("_text").alias("content"), F.length(F.coalesce("_text", F.lit(""))).alias("_n"), F.lit("").alias("_at"))
    groups = rows.groupBy("content").agg(F.count(F.lit(1)).alias("copies"), F.min(_best()).alias("best"))
    apart = rows.join(groups, "content").select(
        F.col("_id").alias(id_col), F.concat_ws("-", F.hex("digest"), F.md5(F.col("content").cast("binary"))).alias("_digest"),
        F.col("best.id").alias("keep_id"), F.col("copies").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("best.id")).alias("kept"), F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"),
    )
    rest = found.join(clashes.select(F.hex("digest").alias("_digest")), "_digest", "left_anti")
    return rest.unionByName(apart)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Only the identifiers of dropped copies are joined back, so clean documents are never shuffled while those fit a
    size-checked broadcast. Of rows that repeat identifier and text one stays. Columns may have any names.
    """
    marked = pin(exact_duplicates(docs, id_col, text_col))
    lost = marked.select(row_key(marked, id_col).alias("_key"), F.col("text_sha256").alias("_sha"), "kept")
    twins = pin(lost.where("kept").groupBy("_key", "_sha").count().where("count > 1").select("_key", "_sha"))
    lost = pin(lost.where("not kept").select("_key", "_sha").distinct())
    sha = F.sha2(normalised(text_col).cast("binary"), 256)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), row_key(docs, id_col).alias("_key"), sha.alias("_sha"))
    rows = join_small(rows, lost, ["_key", "_sha"], "left_anti")
    if not twins.isEmpty():
        once = rows.join(twins, ["_key", "_sha"], "left_semi").dropDuplicates(["_key", "_sha"])
        rows = rows.join(twins, ["_key", "_sha"], "left_anti").unionByName(once)
    return rows.select("_row.*")
