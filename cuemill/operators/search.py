"""Hybrid search: tokens, hashed vectors, inverted index, BM25, rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.functions.settle import session_conf, settled
from cuemill.sources.versions import Change, Versions

K1, B = 1.2, 0.75
BUCKETS = 256
CANDIDATES, RESULTS, RANK_SHIFT = 40, 5, 60
#: Words of queries whose counts may be broadcast.
FREQUENT = 100_000
#: Blocks of queries that a task holds the best of.
BLOCKS_HELD = 16


def tokenize(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, pos, token) of a text column."""
    return df.select(*keys, F.posexplode(X.tokens(F.col(column))).alias("pos", "token"))


def token_bucket(token) -> "Column":  # noqa: F821
    """FNV-1a of a token's bytes, modulo 256, as a fold over its hexadecimal form."""
    pairs = F.regexp_extract_all(F.hex(token.cast("binary")), F.lit("(..)"), F.lit(1))
    byte = lambda p: F.conv(p, 16, 10).cast("long")
    start = F.lit(2166136261).cast("long")
    hashed = F.aggregate(pairs, start, lambda h, p: (h.bitwiseXOR(byte(p)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return hashed % BUCKETS


def hashed_vectors(tokens: DataFrame, *keys: str) -> DataFrame:
    """Sparse unit vectors (keys, bucket, weight) of token counts (T2). A token is hashed once for each text it is in."""
    counts = tokens.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", token_bucket(F.col("token")))
    counts = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*keys)))
    return counts.select(*keys, "bucket", (F.col("n") / norm).alias("weight"))


def embed_corpus(df: DataFrame, column: str, embed: Callable[[list[str]], list], dim: int) -> DataFrame:
    """``df`` with ``vector array<double>`` from a batch function of texts: unit norm, ``dim`` long, zeros for blank texts.

    ``embed`` runs in the Python workers, on batches; where it needs a model it should load it once and keep it. A vector of
    another length is an error. ``hashed_vectors`` is what to use without a model.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", vector array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf[column]]
            full = [i for i, t in enumerate(texts) if t.strip()]
            out = np.zeros((len(texts), dim))
            if full:
                out[full] = np.asarray(embed([texts[i] for i in full]), np.float64).reshape(len(full), dim)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
            yield pdf.assign(vector=list(out))

    return df.mapInPandas(run, schema)


def build_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (token, video_id, chunk_idx, tf, length) and their document counts (T4)."""
    words = tokenize(chunks, "text", "video_id", "chunk_idx")
    postings = words.groupBy("token", "video_id", "chunk_idx").agg(F.count(F.lit(1)).alias("tf"))
    lengths = words.groupBy("video_id", "chunk_idx").agg(F.count(F.lit(1)).alias("length"))
    return postings.join(lengths, ["video_id", "chunk_idx"]), words.select("token", "video_id", "chunk_idx").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, video_id, chunk_idx, score, rank): BM25 over any of the query's words, statistics over the whole index (K3).

    With ``video_id`` in the queries only that video's chunks are ranked.
    """
    # read for the statistics, for the postings and for their counts: split into words once
    listed = chunks.select("video_id", "chunk_idx", "words") if "words" in chunks.columns else settled(chunks.select("video_id", "chunk_idx", X.tokens(F.col("text")).alias("words")))
    stats = listed.select(F.size("words").alias("length")).where("length > 0").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    wanted = tokenize(queries, "query", "query_id", "video_id").select("query_id", "video_id", "token").distinct()
    # a text's words are looked up by video; of the whole corpus only counts travel, one a word and task, so no frequent word has a task of its own
    counts = listed.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    frequency = settled(counts.join(wanted.select("token").distinct(), "token", "left_semi"))
    tf = F.size(F.filter("words", lambda w: w == F.col("token")))
    found = listed.join(wanted, "video_id").select("query_id", "video_id", "chunk_idx", "token", F.size("words").alias("length"), tf.alias("tf")).where("tf > 0")
    hits = found.join(F.broadcast(frequency) if frequency.count() <= FREQUENT else frequency, "token").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.ln((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.groupBy("query_id", "video_id", "chunk_idx").agg(F.round(F.sum(part), 6).alias("score"))
    return _top(scored, k)


def _top(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_idx"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The same over cosines of hashed vectors, above zero only (K2 over T2): a sparse join on buckets."""
    q = hashed_vectors(tokenize(queries, "query", "query_id", "video_id"), "query_id", "video_id")
    words = chunks.select("video_id", "chunk_idx", F.explode("words").alias("token")) if "words" in chunks.columns else tokenize(chunks, "text", "video_id", "chunk_idx")
    c = hashed_vectors(words, "video_id", "chunk_idx").withColumnRenamed("weight", "other")
    scored = q.join(c, ["video_id", "bucket"]).groupBy("query_id", "video_id", "chunk_idx").agg(F.round(F.sum(F.col("weight") * F.col("other")), 6).alias("score"))
    return _top(scored.where("score > 0"), k)


_NO_ID = np.iinfo(np.int64).min


def _packed(vectors: DataFrame, block: int) -> DataFrame:
    """Rows (no, members) of about ``block`` vectors (id, v) each; those with a null in them are left out, since their product is null."""
    whole = vectors.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    size = max(1, -(-whole.count() // block))
    return whole.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(size)).alias("no")).agg(F.collect_list(F.struct("id", "v")).alias("members"))


def _matrices(members: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The vectors of one block by their length: (identifiers, one row each)."""
    ids, v = members.field("id").fill_null(_NO_ID).to_numpy(), members.field("v")
    starts, sizes, values = v.offsets.to_numpy()[:-1], v.value_lengths().to_numpy(), v.values.to_numpy()
    out = {}
    for n in np.unique(sizes[sizes > 0]):
        mine = np.flatnonzero(sizes == n)
        out[int(n)] = ids[mine], values[starts[mine][:, None] + np.arange(n)].astype(np.float64)
    return out


class Best:
    """The candidates for the k best of each row of ``queries``, whichever blocks of vectors come.

    A matrix product in single precision, and a margin above its error, say which pairs can matter; these are summed entry by entry in double
    precision. Scores are rounded later, so all within a rounding step of the k-th stay; of equal ones the k smallest identifiers do.
    """

    STEP = 1.1e-6

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.least = np.zeros(len(ids))
        self.row, self.score, self.vec = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            near = self.queries.astype(np.float32) @ vectors.astype(np.float32).T
            norm = np.linalg.norm(self.queries, axis=1) * np.linalg.norm(vectors, axis=1).max()
            margin = self.STEP + 1e-7 * vectors.shape[1] * norm
            bound = self.least - margin
            if len(ids) > self.k:
                kth = np.partition(near, -self.k, axis=1)[:, -self.k]
                bound = np.fmax(bound, kth - 2 * margin)
            row, at = np.nonzero(~(near < bound.astype(np.float32)[:, None] - np.float32(1e-7)))
            score = np.zeros(len(row))
            for d in range(vectors.shape[1]):
                score += self.queries[row, d] * vectors[at, d]
        row, score, vec = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.vec, ids[at])))
        order = np.lexsort((vec, np.where(np.isnan(score), -np.inf, -score), row))
        row, score, vec = row[order], score[order], vec[order]
        self._keep(row, score, vec)

    def _keep(self, row: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        new = np.diff(row, prepend=-1) != 0
        rank = _places(new)
        again = _places(new | (np.diff(score, prepend=np.nan) != 0))
        kth = rank == self.k - 1
        self.least[row[kth]] = np.fmax(self.least[row[kth]], score[kth])
        stay = (again < self.k) & ((rank < self.k) | ~(score < self.least[row] - self.STEP))
        self.row, self.score, self.vec = row[stay], score[stay], vec[stay]


def _places(starts: np.ndarray) -> np.ndarray:
    """Place of each row in its run, from 0."""
    n = np.arange(len(starts))
    return n - np.maximum.accumulate(np.where(starts, n, 0)) if len(n) else n


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, block: int = 2048) -> DataFrame:
    """(query_id, vec_id, score, rank) by dot product of dense vectors; other lengths score 0 and go (K2).

    Each block of the stated queries meets each block of vectors once, as two matrices; identifiers are integers. A task passes on what it
    found best for a query, not what every block gave.
    """
    mine = _packed(queries.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")), block)
    others = _packed(vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")), block)
    pairs = others.select(F.col("members").alias("theirs")).crossJoin(mine.select("no", F.col("members").alias("mine")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[int, Best]] = {}
        for b in batches:
            for i in range(b.num_rows):
                no = b.column("no")[i].as_py()
                if no not in found:
                    if len(found) >= BLOCKS_HELD:
                        yield from _chosen(found)
                        found = {}
                    found[no] = {n: Best(*x, k) for n, x in _matrices(b.column("mine")[i].values).items()}
                for n, x in _matrices(b.column("theirs")[i].values).items():
                    if n in found[no]:
                        found[no][n].add(*x)
        yield from _chosen(found)

    with session_conf(vectors.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="8"):
        best = settled(pairs.mapInArrow(run, "query_id long, vec_id long, score double"))
    scored = best.withColumn("score", F.round("score", 6)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _chosen(found: dict[int, dict[int, Best]]) -> Iterator[pa.RecordBatch]:
    for one in found.values():
        for best in one.values():
            ids = [pa.array(x, pa.int64(), mask=x == _NO_ID) for x in (best.ids[best.row], best.vec)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(best.score)], names=["query_id", "vec_id", "score"])


def rrf(*ranked: DataFrame, shift: int = RANK_SHIFT, n: int = RESULTS) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the sum of 1 / (60 + rank), the first five."""
    rows = ranked[0].select("query_id", "video_id", "chunk_idx", "rank")
    for other in ranked[1:]:
        rows = rows.unionByName(other.select("query_id", "video_id", "chunk_idx", "rank"))
    scored = rows.groupBy("query_id", "video_id", "chunk_idx").agg(F.round(F.sum(1 / (F.col("rank") + shift)), 9).alias("score"))
    return _top(scored, n)


def best_segment(hits: DataFrame, chunks: DataFrame, seg: DataFrame, queries: DataFrame) -> DataFrame:
    """Of a hit's segments the first that holds the whole query, else the one with most of its words, else the first (K5)."""
    parts = hits.join(chunks.select("video_id", "chunk_idx", "segment_ids", F.col("start_ms").alias("chunk_start_ms"), F.col("text").alias("snippet")), ["video_id", "chunk_idx"])
    parts = parts.join(queries.select("query_id", "query"), "query_id").select("*", F.posexplode("segment_ids").alias("at", "segment_id"))
    parts = parts.join(seg.select("video_id", "segment_id", F.col("text").alias("t"), X.text_of("translated_text").alias("tr")), ["video_id", "segment_id"])
    fold = lambda c: F.lower(X.fold_width(F.col(c)))
    q = F.trim(fold("query"))
    whole = (q != "") & (F.contains(fold("t"), q) | F.contains(fold("tr"), q))
    mine = F.array_distinct(X.tokens(F.col("query")))
    words = F.size(F.array_intersect(mine, X.tokens(F.col("t")))) + F.size(F.array_intersect(mine, X.tokens(F.col("tr"))))
    order = F.struct(whole.cast("int").alias("whole"), F.when(whole, 0).otherwise(words).alias("words"), (-F.col("at")).alias("at"))
    return parts.groupBy("query_id", "video_id", "chunk_idx", "score", "rank", "chunk_start_ms", "snippet").agg(F.max_by("segment_id", order).alias("best_segment_id"))


def hybrid_search(queries: DataFrame, chunks: DataFrame, seg: DataFrame) -> DataFrame:
    """The five best chunks of each query in its video by words and by vectors, with their best segments (K6).

    ``queries`` is (query_id, video_id, query). A query without tokens has no rows. Chunks are made and split into words once, in
    a checkpointed table; nothing stays cached.
    """
    chunks = settled(chunks.withColumn("words", X.tokens(F.col("text"))))
    asked = chunks.join(queries.select("video_id").distinct(), "video_id", "left_semi")
    hits = rrf(bm25_topk(queries, chunks), vector_search(queries, asked))
    return best_segment(hits, asked, seg, queries)


PARTS = 64


def _indexed(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "video_id", "chunk_idx", "start_ms", "end_ms", "segment_ids", "text", F.array_join(X.tokens(F.col("text")), " ").alias("content"),
        F.pmod(F.xxhash64("video_id"), F.lit(PARTS)).alias("part"),
    )


def reindex(path: str, chunks: DataFrame, videos: DataFrame) -> None:
    """The index at ``path`` with the rows of ``videos`` (video_id) replaced by those of ``chunks``.

    The index is a versioned table by hash part; only the parts of these videos are read and written again, and all of them
    change in one commit, which a stopped run leaves undone. Folders of versions before the last one go.
    """
    store = Versions(chunks.sparkSession, path)
    ids = videos.select("video_id").distinct()
    rows = _indexed(chunks.join(ids, "video_id", "left_semi"))
    base = store.current()
    touched = [r[0] for r in ids.select(F.pmod(F.xxhash64("video_id"), F.lit(PARTS)).alias("part")).distinct().collect()]  # at most 64
    old = store.read("index", base)
    if old is not None:
        rows = rows.unionByName(old.where(F.col("part").isin(touched)).join(ids, "video_id", "left_anti"))
    store.commit({"index": Change(rows, "part", tuple(map(str, touched)))}, base)
    store.vacuum(keep=2)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks, for ``hybrid_search`` and ``bm25_topk``, of the version that is the last one now."""
    return Versions(spark, path).read("index").drop("part")
