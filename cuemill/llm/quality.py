"""Quality scores from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. How often each combination of votes occurs
is counted over all documents; expectation-maximisation on those counts (at most 3 to the number of labellers, however
many documents) estimates how accurate each labeller is, in both classes, without any label. The posterior of a
document's votes is then the soft label for a hashed linear scorer, which sees words and their shapes, not the votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import IS_WORD, blocks, pin, small_batches, utf8, words_of
from cuemill.llm.toxicity import FUNCTION_WORDS

#: Bounds of the scorer's training sample: documents, and characters of one.
SAMPLE_DOCS, SAMPLE_CHARS = 6000, 200_000
BUCKETS = 1 << 16
KEEP = 0.5
#: Words below which the share of function words gets no vote.
SHORT = 20
#: Labellers: figure, bad up to / from, good from / up to; between the two they abstain.
LABELLERS = [
    ("symbols per word", "high", 0.5, 0.2),
    ("upper-case share of letters", "high", 0.5, 0.25),
    ("share of words equal to the one before", "high", 0.3, 0.05),
    ("share of function words", "low", 0.02, 0.06),
    ("sentence ends per word", "low", 0.005, 0.02),
    ("mean bytes of a word", "high", 14.0, 9.0),
    ("words", "low", 2.0, 40.0),
    ("share of lines that occur before", "high", 0.4, 0.1),
]
_FUNCTION = np.unique(np.concatenate([words_of(*b)[0] for b in blocks([" ".join(FUNCTION_WORDS.values()).encode()])]))
_UPPER, _LOWER = np.zeros(256, np.int64), np.zeros(256, np.int64)
_UPPER[65:91], _LOWER[97:123] = 1, 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#$%&*+<=>@[]^_`{|}~\\/!")] = 1
_END = np.zeros(256, np.int64)
_END[list(b".?")] = 1


def figures(texts: list[bytes]) -> np.ndarray:
    """The labellers' figures, one row per text."""
    n = len(texts)
    sums = {k: np.zeros(n) for k in ("words", "symbols", "upper", "letters", "same", "function", "ends", "bytes")}
    last, last_doc = np.uint64(0), -1
    for buf, starts, docs in blocks(texts):
        of = docs[np.searchsorted(starts, np.arange(len(buf)), "right") - 1] if len(starts) > 1 else np.full(len(buf), docs[0])
        for key, table in (("symbols", _SYMBOL), ("upper", _UPPER), ("ends", _END)):
            sums[key] += np.bincount(of[table[buf] > 0], minlength=n)
        sums["letters"] += np.bincount(of[(_UPPER + _LOWER)[buf] > 0], minlength=n)
        sums["bytes"] += np.bincount(of[IS_WORD[buf] > 0], minlength=n)
        h, doc = words_of(buf, starts, docs)
        if not len(h):
            continue
        sums["words"] += np.bincount(doc, minlength=n)
        before = np.concatenate(([last], h[:-1]))
        same = (before == h) & (np.concatenate(([last_doc], doc[:-1])) == doc)
        sums["same"] += np.bincount(doc[same], minlength=n)
        hit = _FUNCTION[np.minimum(np.searchsorted(_FUNCTION, h), len(_FUNCTION) - 1)] == h
        sums["function"] += np.bincount(doc[hit], minlength=n)
        last, last_doc = h[-1], doc[-1]
    again = np.zeros(n)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        again[i] = 1 - len(set(lines)) / len(lines) if lines else 0
    words = np.maximum(sums["words"], 1)
    function = np.where(words < SHORT, np.nan, sums["function"] / words)  # a few words say little about it: no vote
    return np.stack(
        [sums["symbols"] / words, sums["upper"] / np.maximum(sums["letters"], 1), sums["same"] / words, function, sums["ends"] / words, sums["bytes"] / words, sums["words"], again],
        axis=1,
    )


def votes(texts: list[bytes]) -> np.ndarray:
    """One number per text: a base-3 digit for each labeller, 0 for no vote, 1 for bad, 2 for good."""
    code = np.zeros(len(texts), np.int64)
    for j, (column, (_, side, bad, good)) in enumerate(zip(figures(texts).T, LABELLERS, strict=True)):
        is_bad, is_good = (column >= bad, column <= good) if side == "high" else (column <= bad, column >= good)
        code += np.where(is_bad, 1, np.where(is_good, 2, 0)) * 3**j
    return code


def _digits(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class Labellers:
    """P(vote | class) for each labeller (labellers x 2 classes x 3 votes), and the share of good documents."""

    table: np.ndarray
    good: float

    def posterior(self, code: np.ndarray) -> np.ndarray:
        """P(good | votes)."""
        digit = _digits(np.asarray(code, np.int64))
        logs = np.log([1 - self.good, self.good])[None] + sum(np.log(self.table[j])[:, digit[:, j]].T for j in range(digit.shape[1]))
        top = logs.max(1, keepdims=True)
        p = np.exp(logs - top)
        return p[:, 1] / p.sum(1)

    @property
    def accuracy(self) -> np.ndarray:
        """P(the vote is right | it votes), over both classes."""
        share = np.array([1 - self.good, self.good])
        right = self.table[:, 0, 1] * share[0] + self.table[:, 1, 2] * share[1]
        return right / np.maximum(right + self.table[:, 0, 2] * share[0] + self.table[:, 1, 1] * share[1], 1e-12)


def estimate(code: np.ndarray, count: np.ndarray, rounds: int = 200) -> Labellers:
    """Expectation-maximisation over counts of vote combinations.

    It starts from what heuristics are like: each sees one kind of fault, so it often calls a bad document good, and
    seldom calls a good one bad.
    """
    digit, count = _digits(np.asarray(code, np.int64)), np.asarray(count, float)
    start = np.array([[0.1, 0.3, 0.6], [0.1, 0.005, 0.895]])
    model = Labellers(np.repeat(start[None], digit.shape[1], 0), 0.8)
    if not count.sum():
        return model
    for _ in range(rounds):
        p = model.posterior(code)
        weight = np.stack([count * (1 - p), count * p])
        table = np.stack([[[weight[c][digit[:, j] == v].sum() + 1.0 for v in range(3)] for c in (0, 1)] for j in range(digit.shape[1])])
        new = Labellers(table / table.sum(2, keepdims=True), float(np.clip(weight[1].sum() / count.sum(), 0.01, 0.99)))
        moved = np.abs(new.table - model.table).max()
        model = new
        if moved < 1e-7:
            break
    return model


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (bucket, document): of each word, its hash, and the shape of it with the bytes around it."""
    for buf, starts, docs in blocks(texts):
        inside = IS_WORD[buf]
        edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
        first, last = edges[::2], edges[1::2]
        if not len(first):
            continue
        h, doc = words_of(buf, starts, docs)
        upper = np.concatenate(([0], np.cumsum(_UPPER[buf])))
        capitals = np.minimum(upper[last] - upper[first], 2) + 3 * (_UPPER[buf[first]] > 0)
        size = np.minimum(last - first, 15)
        after = buf[np.minimum(last, len(buf) - 1)].astype(np.int64)
        again = np.concatenate(([False], h[1:] == h[:-1]))
        shape = ((capitals * 16 + size) * 2 + again) * 128 + np.minimum(after, 127)
        yield (h >> np.uint64(40)).astype(np.int64) % (BUCKETS // 2), doc
        yield BUCKETS // 2 + shape * 2654435761 % (BUCKETS // 2), doc


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (document, bucket, value) of unit length over each half of the buckets: square roots of shares."""
    keys, doc_count = [], len(texts)
    counts = []
    for bucket, doc in features(texts):
        key, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
        keys.append(key)
        counts.append(n)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, np.concatenate(counts))
    doc, bucket = key // BUCKETS, key % BUCKETS
    half = doc * 2 + (bucket >= BUCKETS // 2)
    return doc, bucket, np.sqrt(n / np.bincount(half, n, 2 * doc_count)[half])


@dataclass
class Scorer:
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        doc, bucket, value = vectors(texts)
        return 1 / (1 + np.exp(-np.clip(np.bincount(doc, value * self.weights[bucket], len(texts)) + self.intercept, -30, 30)))


def train(texts: list[str], soft: np.ndarray, epochs: int = 12, seed: int = 3, rate: float = 0.5) -> Scorer:
    """Logistic regression on soft labels by AdaGrad; any sample, even an empty one, gives a scorer."""
    rng, data = np.random.default_rng(seed), utf8(texts)
    model = Scorer(np.zeros(BUCKETS), 0.0)
    if not len(data):
        return model
    rows = [vectors(data[a : a + 32]) for a in range(0, len(data), 32)]
    seen, seen_intercept = np.full(BUCKETS, 1e-2), 1e-2
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            doc, bucket, value = rows[k]
            y = soft[32 * k : 32 * k + 32]
            p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, value * model.weights[bucket], len(y)) + model.intercept, -30, 30)))
            error = (p - y) / len(y)
            some, at = np.unique(bucket, return_inverse=True)
            g = np.bincount(at, error[doc] * value, len(some)) + 1e-5 * model.weights[some]
            seen[some] += g * g
            model.weights[some] -= rate * g / np.sqrt(seen[some])
            seen_intercept += error.sum() ** 2
            model.intercept -= rate * error.sum() / np.sqrt(seen_intercept)
    return model


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, weak_label, score, kept); no label is read.

    ``weak_label`` is P(good | the document's votes), ``score`` the scorer's estimate from 0 to 1, ``kept`` whether it is
    0.5 or more. Labeller accuracies come from the votes of all documents; the scorer is fitted on a sample bounded by
    ``SAMPLE_DOCS`` and ``SAMPLE_CHARS``. A null text counts as empty: it has no word and is not kept unless the votes of
    the corpus say otherwise. Rows that repeat an identifier are scored each. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = votes(utf8(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(code)], names=["id", "votes"])

    with small_batches(spark, 256):
        ballots = pin(source.mapInArrow(vote, f"id {kind}, votes long"))
    counts = ballots.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).toPandas()
    labellers = estimate(counts["votes"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    hashed = source.where(F.length("text") <= SAMPLE_CHARS).select("text", F.xxhash64("id").alias("a"), F.xxhash64("text").alias("b"))
    keys = pin(hashed.select("a", "b").orderBy("a", "b").limit(SAMPLE_DOCS))  # hashes first: no texts are sorted
    chosen = hashed.join(F.broadcast(keys.distinct()), ["a", "b"]).dropDuplicates(["a", "b"]).orderBy("a", "b").select("text").toPandas()
    texts = chosen["text"].tolist()
    soft = np.concatenate([labellers.posterior(votes(utf8(texts[a : a + 64]))) for a in range(0, len(texts), 64)] or [np.zeros(0)])
    model = spark.sparkContext.broadcast((labellers, train(texts, soft)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = utf8(b.column("text").to_pylist())
            score = model.value[1].scores(data)
            arrays = [b.column("id"), pa.array(np.round(model.value[0].posterior(votes(data)), 9)), pa.array(np.round(score, 9)), pa.array(score >= KEEP)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "weak_label", "score", "kept"])

    with small_batches(spark, 256):
        out = pin(source.mapInArrow(run, f"id {kind}, weak_label double, score double, kept boolean"))
    return out.withColumnRenamed("id", id_col)
