"""Language-model scores: cross-entropy difference between a target and a background model (Moore and Lewis, 2010).

Both models are interpolated bigram models over one vocabulary, all words of all documents; nothing is cut. They are
matched: the background model is counted over a sample of the documents outside the target, chosen by a hash of the
identifier at the rate that gives it the target's bytes (all of them where they have fewer), counts are discounted by
the same number, and what a model leaves to words that it has not seen is one share of all probability, spread evenly
over the vocabulary, the same in both. So a
word that neither has seen says nothing, and what the score tells does not come from the models' sizes. A document that a
model was counted over is scored by that model without the document's own counts, so that no document has seen itself.

Counts never meet in one place. Documents travel in chunks of about two megabytes; a chunk sends the words and bigrams
it holds, once each with their counts, to buckets by hash, a bucket adds them up and answers each chunk with the totals
of what it asked for, and the chunk scores its documents. A word that every document has is one number a chunk. The
number of buckets follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import blocks, mix, pin, scratch, shuffle_partitions, small_batches, words_of
from cuemill.llm.suffix import by_bucket, chunk_rows, chunked, pack, unpack

#: Weight of the bigram estimate, and what single words leave to the whole vocabulary alike.
WEIGHT = 0.7
UNSEEN = 0.1
#: Occurrences of a word or bigram that say nothing, since a few copies of a document in either corpus have them too.
DISCOUNT = 3
#: Text bytes of one chunk and of one bucket.
CHUNK_BYTES = 1 << 21
BUCKET_BYTES = 1 << 23
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(1)
#: Stand for the place before the first word and after the last; words have even keys, bigrams odd ones.
START, END = mix(np.array([1, 2], np.uint64)) & ~_ODD


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _STEP + second) | _ODD


class Words:
    """The words of a chunk: key, key of the bigram that ends in it, and document of each; and what the chunk counts."""

    def __init__(self, row: dict, sizes: list[int], flags: np.ndarray):
        body = zstandard.ZstdDecompressor().decompress(row["body"])
        ends = np.cumsum(sizes)
        words, docs = [], []
        for buf, starts, owner in blocks([body[e - s : e] for s, e in zip(sizes, ends.tolist(), strict=True)]):
            h, d = words_of(buf, starts, owner, marks=True)
            words.append(h & ~_ODD)
            docs.append(d)
        self.word = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        n = len(self.word)
        self.first = np.concatenate((np.ones(min(1, n), bool), self.doc[1:] != self.doc[:-1]))
        before = np.concatenate((np.full(min(1, n), START), self.word[:-1]))
        before[self.first] = START
        heads = np.flatnonzero(self.first)
        last = np.append(heads[1:], n)[: len(heads)] - 1
        every = np.concatenate((self.word, _pair(before, self.word), _pair(self.word[last], np.full(len(last), END)), np.full(len(last), START)))
        owner = np.concatenate((self.doc, self.doc, self.doc[last], self.doc[last]))
        self.key, at = np.unique(every, return_inverse=True)
        self.at_word, self.at_pair = at[:n], at[n : 2 * n]
        self.counts = np.stack([np.bincount(at, f[owner], len(self.key)) for f in flags]).astype(np.int64)

    def own(self, at: np.ndarray) -> np.ndarray:
        """How often the key of each word's place occurs in the word's document."""
        _, back, count = np.unique(self.doc * max(1, len(self.key)) + at, return_inverse=True, return_counts=True)
        return count[back]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _short(key: np.ndarray) -> np.ndarray:
    """Keys in 48 bits, the lowest as it was. In a bucket, which holds about a million keys, two alike are rare."""
    return (key >> np.uint64(17)) << np.uint64(1) | (key & _ODD)


def _planes(short: np.ndarray) -> np.ndarray:
    """The six bytes of ascending short keys, highest first, each byte of all keys together, which compresses better."""
    return np.ascontiguousarray(short.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T).ravel()


def _from_planes(planes: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(planes) // 6, 8), np.uint8)
    wide[:, 2:] = planes.reshape(6, -1).T
    return wide.view(">u8").ravel().astype(np.uint64)


def _chunk_words(row: dict) -> tuple[Words, np.ndarray]:
    """The words of a chunk, and which documents the background and the target model are counted over."""
    flags = np.array([[r["background"], r["target"]] for r in row["rest"]], np.float64).reshape(-1, 2).T
    return Words(row, row["sizes"], flags), flags


def totals(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, blob of both models' counts), and a row a bucket without chunk: words of each model, distinct words of all."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            w, _ = _chunk_words(row)
            b, t = w.counts
            short = _short(w.key)
            got = [(k, pack(b[i].astype("<u4"), t[i].astype("<u4"), _planes(short[i]))) for k, i in by_bucket(_bucket(w.key, buckets))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in got], pa.int64()), pa.array([row["chunk"]] * len(got), pa.int64()), pa.array([v for _, v in got], pa.binary())],
                names=["bucket", "chunk", "blob"],
            )

    def answer(table: pa.Table) -> pa.Table:
        bucket, chunk = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        got = [unpack(x, "<u4", "<u4", "V6") for x in table.column("blob").to_pylist()]
        key, at = np.unique(np.concatenate([_from_planes(g[2].view(np.uint8)) for g in got]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([g[i] for g in got]), len(key)).astype(np.int64) for i in (0, 1)]
        word = (key & _ODD == 0) & (key != _short(START))
        stop = np.cumsum([len(g[0]) for g in got])
        blobs = [pack(sums[0][at[e - len(g[0]) : e]], sums[1][at[e - len(g[0]) : e]]) for g, e in zip(got, stop.tolist(), strict=True)]
        stats = [int(sums[0][word].sum()), int(sums[1][word].sum()), int(word.sum())]
        n = len(chunk)
        return pa.table({
            "chunk": pa.array([*chunk, None], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int64()), "blob": pa.array([*blobs, None], pa.binary()),
            **{c: pa.array([0] * n + [x], pa.int64()) for c, x in zip(("background_words", "target_words", "distinct"), stats, strict=True)},
        })

    sent = chunks.select("chunk", "sizes", "body", "rest").mapInArrow(send, "bucket long, chunk long, blob binary")
    return pin(sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, blob binary, background_words long, target_words long, distinct long"))


def losses(w: Words, flags: np.ndarray, found: np.ndarray, all_words: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each document of a chunk, and the sum of its losses in nats under (background, target).

    ``found`` holds the (background, target) counts of the chunk's keys. A document's own counts are taken off the model
    that was counted over it. A first word unseen elsewhere leaves the whole weight to single words, a model without words
    all to the vocabulary.
    """
    docs = flags.shape[1]
    n = np.bincount(w.doc, minlength=docs)
    total = np.zeros((docs, 2))
    if not len(w.word):
        return n, total
    own_word, own_pair = w.own(w.at_word), w.own(w.at_pair)
    before = np.concatenate(([0], w.at_word[:-1]))
    before[w.first] = np.searchsorted(w.key, START)
    own_before = np.where(w.first, 1, np.concatenate(([0], own_word[:-1])))
    for k in (0, 1):
        mine = flags[k][w.doc]
        size = all_words[k] - mine * n[w.doc]
        known = size > 0
        single = np.where(known, UNSEEN, 1) / distinct + (1 - UNSEEN) * np.maximum(found[k][w.at_word] - mine * own_word - DISCOUNT, 0) / np.maximum(size, 1)
        context = found[k][before] - mine * own_before
        seen = context > DISCOUNT
        given = np.where(seen, np.maximum(found[k][w.at_pair] - mine * own_pair - DISCOUNT, 0) / np.maximum(context, 1), 0)
        total[:, k] = np.bincount(w.doc, -np.log(WEIGHT * given + np.where(seen, 1 - WEIGHT, 1) * single), docs)
    return n, total


def score_documents(docs: DataFrame, target: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_words, target_loss, background_loss, score), losses in nats per word.

    ``score`` is the target's loss less the background's: the lower, the more a document resembles the target. Words
    are lower-cased runs of letters and digits, and runs of marks; only texts over a megabyte may be cut within marks. A text without words, or null, has losses and score 0. A null ``target``
    counts as not in the target. Rows that repeat an identifier are scored each, and identifiers of any type come back
    as they were; rows that share one are in the background sample together. Without any target, or nothing but target, the
    model without words takes all words of the vocabulary for equally likely. An empty table gives an empty table; other columns are not read.
    """
    with scratch(docs.sparkSession) as kept:
        return _scored(docs, target, id_col, text_col, kept).withColumnRenamed("id", id_col)


def sampled(id_col: str, rate: float) -> Column:
    """Whether the hash of an identifier falls into the first ``rate`` of all hashes; a null identifier has one too."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 30)) < int(rate * (1 << 30))


def _scored(docs: DataFrame, target: Column, id_col: str, text_col: str, path: str) -> DataFrame:
    """The rows of ``score_documents``, written to ``path``."""
    source = docs.select(F.lit(0).alias("place"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.coalesce(target, F.lit(False)).alias("target"))
    kind = dict(source.dtypes)["id"]
    weights = source.groupBy("target").agg(F.sum(F.octet_length("text"))).collect()  # two rows
    weight = {r[0]: r[1] or 0 for r in weights}
    rate = min(1.0, weight.get(True, 0) / max(1, weight.get(False, 0)))
    source = source.withColumn("background", ~F.col("target") & sampled("id", rate))
    chunks = chunked(source, "place", "text", ["id", "background", "target"], CHUNK_BYTES)
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = min(1 << 24, max(shuffle_partitions(docs.sparkSession), size // BUCKET_BYTES))
    with small_batches(docs.sparkSession, 1):
        answers = totals(chunks, buckets)
    stats = answers.where("chunk is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("background_words", "target_words", "distinct"))).first()
    all_words, distinct = np.array(stats[:2], np.float64), stats[2]
    parts = answers.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("rest").flatten().field("id")
            (row,) = b.to_pylist()
            w, flags = _chunk_words(row)
            found, blobs = np.zeros((2, len(w.key))), {p["bucket"]: p["blob"] for p in row["parts"] or []}
            for k, i in by_bucket(_bucket(w.key, buckets)):
                found[:, i] = unpack(blobs[k], "<i8", "<i8")
            n, total = losses(w, flags, found, all_words, distinct)
            mean = np.round(total / np.maximum(n, 1)[:, None], 9)
            arrays = [ids, pa.array(n), pa.array(mean[:, 1]), pa.array(mean[:, 0]), pa.array(np.round(mean[:, 1] - mean[:, 0], 6))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "target_loss", "background_loss", "score"])

    joined = chunks.join(parts, "chunk", "left").select("chunk", "sizes", "body", "rest", "parts")
    with small_batches(docs.sparkSession, 1):
        return pin(joined.mapInArrow(run, f"id {kind}, n_words long, target_loss double, background_loss double, score double"), path)
