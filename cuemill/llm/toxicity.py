"""Toxicity scores by a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are lower-cased runs of letters and digits. A word's embedding is the mean of hashed rows for the word and for
its first four, five and six bytes, so that inflected forms share what was learnt. Filters over one, two and three
neighbouring words, rectified and max-pooled over the whole text, feed a logistic output. Rows start from the log-odds
of their bucket in the training documents; all weights are then fitted by Adam. All labelled training rows count: log-odds
are sums over partitions, and an epoch is one pass of learners over their share of the documents, whose changes are averaged.

A cut-off is calibrated for each language on a fifth of the training rows, which the weights did not see. The language is guessed
from function words of the text itself, and scores are shifted so that 0.7 is the cut-off in every language.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import blocks, join_small, pin, small_batches, utf8, words_of

BUCKETS = 1 << 19
WIDTH = 8
PREFIXES = (4, 5, 6)
SPANS = (1, 2, 3)
FILTERS = 4
CUT = 0.7
#: Documents of a learner, of a step and of an Arrow batch; passes over the documents.
LEARNER_DOCS, STEP_DOCS, EPOCHS = 6000, 32, 4
#: Changes are summed as whole numbers of this part, so that their order does not matter; bins of logits a unit, and bounds.
PART, BINS, LOGIT = float(1 << 24), 256, 64
#: Frequent function words of the languages that get a cut-off of their own.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine den dem von zu mit für auf sich im auch",
    "en": "the of and to in is that it was for on with as are be this by from",
    "es": "el la los las que y en un una por con para del se su al es como",
    "fr": "le la les des et est une un du que dans pour sur au avec par ne qui",
}


def _hashes(texts: list[bytes], prefixes: tuple[int, ...] = PREFIXES):
    """Blocks of (hashes of the words, document of each word)."""
    for buf, starts, docs in blocks(texts):
        yield words_of(buf, starts, docs, prefixes)


_LANGUAGES = sorted(FUNCTION_WORDS)
_FUNCTION = [np.unique(next(_hashes([FUNCTION_WORDS[k].encode()], ()))[0]) for k in _LANGUAGES]

_MAYBE = np.zeros(1 << 16, bool)
_MAYBE[(np.concatenate(_FUNCTION) & np.uint64(0xFFFF)).astype(np.int64)] = True


def languages(texts: list[bytes]) -> np.ndarray:
    """Index of the language whose function words are the largest share; one past the last where there are none."""
    counts = np.zeros((len(texts), len(_LANGUAGES)))
    for words, doc in _hashes(texts, ()):
        maybe = np.flatnonzero(_MAYBE[(words & np.uint64(0xFFFF)).astype(np.int64)])
        words, doc = words[maybe], doc[maybe]
        for j, known in enumerate(_FUNCTION):
            hit = known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words
            counts[:, j] += np.bincount(doc[hit], minlength=len(texts))
    return np.where(counts.max(1) > 0, counts.argmax(1), len(_LANGUAGES))


@dataclass
class Model:
    rows: np.ndarray  # BUCKETS x WIDTH
    filters: list[np.ndarray]  # per span: FILTERS x span x WIDTH
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    cuts: np.ndarray  # logit at which a language is cut, and the slope behind the score
    slope: float

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Max-pooled filter outputs of whole texts."""
        out = np.zeros((len(texts), len(self.bias)), np.float32)
        for hashes, doc in _hashes(texts):
            embedded, _, lead, stop, owner = _padded(_embed(self.rows, _bucket(hashes)), doc)
            at = 0
            for filters in self.filters:
                values = _convolve(embedded, filters)
                top = np.maximum.reduceat(values, np.stack((lead, stop), axis=1).ravel(), axis=0)[::2]
                np.maximum.at(out[:, at : at + FILTERS], owner, top + self.bias[at : at + FILTERS])
                at += FILTERS
        return np.maximum(out, np.maximum(self.bias, 0))

    def logits(self, texts: list[bytes]) -> np.ndarray:
        return self.pooled(texts) @ self.weights + self.intercept

    def scores(self, texts: list[bytes]) -> np.ndarray:
        shifted = self.slope * (self.logits(texts) - self.cuts[languages(texts)]) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _embed(rows: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Mean of the hashed rows of each word."""
    out = rows.take(bucket[:, 0], 0)
    for j in range(1, bucket.shape[1]):
        out += rows.take(bucket[:, j], 0)
    out *= np.float32(1 / bucket.shape[1])
    return out


def _padded(embedded: np.ndarray, doc: np.ndarray):
    """Word rows with two rows of zeros after each document: rows, place of each word; per document first row, end, number."""
    if not len(doc):
        one = np.zeros(1, np.int64)
        return np.zeros((3, embedded.shape[1]), np.float32), doc, one, one + 1, one
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    gap = np.zeros(len(doc), np.int64)
    gap[new[1:]] = 2
    place = np.arange(len(doc)) + np.cumsum(gap)
    out = np.zeros((place[-1] + 3, embedded.shape[1]), np.float32)
    out[place] = embedded
    return out, place, place[new], np.append(place[new[1:] - 1], place[-1]) + 1, doc[new]


def _convolve(embedded: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Filter outputs at every row; a window past the end sees zeros."""
    values = embedded @ filters[:, 0].T
    for o in range(1, filters.shape[1]):
        values[:-o] += embedded[o:] @ filters[:, o].T
    return values


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A model of texts at hand: fit on four fifths of them, cut-offs set on the rest. Any list, even an empty one, gives a model."""
    rng = np.random.default_rng(seed)
    data, labels = utf8(texts), np.asarray(labels, np.float32)
    order = rng.permutation(len(data))
    n_cut = len(data) // 5
    held, fit = order[:n_cut], order[n_cut:]
    texts, known = [data[i] for i in fit], labels[fit]
    model = _first_model(_seen(texts, known), [(known < 0.5).sum(), (known > 0.5).sum()], rng)
    moments = _moments(model)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), STEP_DOCS):
            part = order[at : at + STEP_DOCS]
            _step(model, moments, [texts[i] for i in part], known[part])
    _calibrate(model, _binned(model, [data[i] for i in held], labels[held]))
    return model


def _seen(texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Clean and toxic documents by bucket."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for at in range(0, len(texts), 64):
        part = texts[at : at + 64]
        for hashes, doc in _hashes(part):
            bucket = _bucket(hashes)
            pair = np.unique(np.repeat(doc, bucket.shape[1]) * BUCKETS + bucket.ravel())
            toxic = labels[at + pair // BUCKETS] > 0.5
            for k in (0, 1):
                seen[k] += np.bincount(pair[toxic == bool(k)] % BUCKETS, minlength=BUCKETS)
    return seen


def _first_model(seen: np.ndarray, docs: list[int], rng: np.random.Generator) -> Model:
    """Small random rows; the first column is the bucket's log-odds over documents, shrunk where there are few."""
    odds = np.log((seen[1] + 0.5) / max(1, docs[1])) - np.log((seen[0] + 0.5) / max(1, docs[0]))
    known = seen.sum(0)
    rows = np.zeros((BUCKETS, WIDTH), np.float32)
    rows[known > 0] = rng.normal(0, 0.01, (int((known > 0).sum()), WIDTH))
    rows[:, 0] = np.where(known > 0, odds * known / (known + 8), 0)
    filters = [rng.normal(0, 0.3, (FILTERS, s, WIDTH)).astype(np.float32) for s in SPANS]
    for f in filters:
        f[:, :, 0] = 0.3 + 0.2 * rng.random(f.shape[:2])
    n = len(SPANS) * FILTERS
    return Model(rows, filters, np.zeros(n, np.float32), np.full(n, 0.5, np.float32), -2.0, np.zeros(len(_LANGUAGES) + 1), 1.0)


def _dense(model: Model) -> list[np.ndarray]:
    return [*model.filters, model.bias, model.weights]


def _moments(model: Model) -> list:
    """Of Adam: steps so far, and the moments of each dense weight."""
    return [0, [(np.zeros_like(p), np.zeros_like(p)) for p in _dense(model)]]


def _step(model: Model, moments: list, texts: list[bytes], labels: np.ndarray, rate: float = 0.01) -> None:
    moments[0] += 1
    grads, row_grads = _gradients(model, texts, labels)
    for p, g, (m, v) in zip(_dense(model), grads[:-1], moments[1], strict=True):
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p -= rate * (m / (1 - 0.9 ** moments[0])) / (np.sqrt(v / (1 - 0.99 ** moments[0])) + 1e-6)
    model.intercept -= rate * float(np.sign(grads[-1])) * min(1.0, abs(float(grads[-1])) * 10)
    for bucket, g in row_grads:
        np.subtract.at(model.rows, bucket, rate * g)


def _gradients(model: Model, texts: list[bytes], labels: np.ndarray):
    """Gradients of the mean logistic loss; of the embeddings only the rows under a maximum have one."""
    pooled = np.zeros((len(texts), len(model.bias)), np.float32)
    windows: list[list] = [[None] * len(texts) for _ in range(len(SPANS))]
    for hashes, doc in _hashes(texts):
        bucket = _bucket(hashes)
        embedded, place, lead, stop, owner = _padded(_embed(model.rows, bucket), doc)
        if not len(doc):
            continue
        back = np.full(len(embedded), -1, np.int64)
        back[place] = np.arange(len(place))
        for s, filters in enumerate(model.filters):
            values = _convolve(embedded, filters)
            for a, z, d in zip(lead, stop, owner, strict=True):
                top = values[a:z].argmax(0)
                best = np.maximum(values[a:z][top, np.arange(FILTERS)] + model.bias[s * FILTERS : (s + 1) * FILTERS], 0)
                old = pooled[d, s * FILTERS : (s + 1) * FILTERS]
                if windows[s][d] is None or (best > old).any():
                    at = a + top[:, None] + np.arange(SPANS[s])
                    inside = at < len(embedded)
                    word = np.where(inside, back[np.minimum(at, len(back) - 1)], -1)
                    windows[s][d] = (embedded[np.minimum(at, len(back) - 1)] * inside[..., None], bucket[word] * (word >= 0)[..., None] + (word < 0)[..., None] * -1)
                    pooled[d, s * FILTERS : (s + 1) * FILTERS] = best
    logit = pooled @ model.weights + model.intercept
    error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(texts)
    inner = error[:, None] * model.weights[None] * (pooled > 0)
    grads = [np.zeros_like(f) for f in model.filters]
    rows = []
    for s, filters in enumerate(model.filters):
        for d in range(len(texts)):
            if windows[s][d] is None:
                continue
            seen, bucket = windows[s][d]
            g = inner[d, s * FILTERS : (s + 1) * FILTERS]
            grads[s] += g[:, None, None] * seen
            each = (g[:, None, None] * filters)[:, :, None, :] / bucket.shape[-1]
            ok = bucket >= 0
            rows.append((bucket[ok], np.broadcast_to(each, (*bucket.shape, WIDTH))[ok]))
    return [*grads, inner.sum(0), (error[:, None] * pooled).sum(0), error.sum()], rows


def _best_cut(low: np.ndarray, high: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best F1 between bins of logits with so many documents; it lies halfway to the next bin."""
    order = np.argsort(-high, kind="stable")
    hits = np.cumsum(toxic[order])
    best = int((2 * hits / (np.cumsum((clean + toxic)[order]) + toxic.sum())).argmax())
    return float((low[order[best]] + high[order[min(best + 1, len(order) - 1)]]) / 2)


def _binned(model: Model, texts: list[bytes], labels: np.ndarray) -> dict[tuple[int, int], list]:
    """Lowest and highest logit, clean and toxic documents by language and bin of logits."""
    found: dict[tuple[int, int], list] = {}
    for at in range(0, len(texts), 64):
        part = texts[at : at + 64]
        for k, x, y in zip(languages(part).tolist(), model.logits(part).tolist(), labels[at : at + 64], strict=True):
            one = found.setdefault((k, int(np.floor(np.clip(x, -LOGIT, LOGIT) * BINS))), [x, x, 0, 0])
            one[0], one[1] = min(one[0], x), max(one[1], x)
            one[3 if y > 0.5 else 2] += 1
    return found


def _calibrate(model: Model, bins: dict[tuple[int, int], list]) -> None:
    language = np.array([k for k, _ in bins], np.int64)
    low, high, clean, toxic = np.array(list(bins.values()), float).reshape(-1, 4).T
    if not clean.sum() or not toxic.sum():
        return
    model.cuts[:] = _best_cut(low, high, clean, toxic)
    for k in range(len(model.cuts)):
        own = language == k
        if toxic[own].sum() >= 10 and clean[own].sum() >= 10:
            model.cuts[k] = _best_cut(low[own], high[own], clean[own], toxic[own])


def in_training(id_col: str):
    """Rows whose labels may be learnt from: crc32 of the identifier as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(learner, held, place, text, toxic) of every labelled training row, written to shared storage.

    A fifth is ``held`` for the cut-offs. Learners take about ``LEARNER_DOCS`` rows each, in the order of ``place``.
    """
    mine = labels.where(in_training(id_col) & F.col("toxic").isin(0, 1)).groupBy(id_col).agg(F.max("toxic").alias("_toxic"))
    mine = pin(mine.select(F.col(id_col).alias("_id"), "_toxic"))
    keys = mine.count()
    place = F.xxhash64(F.coalesce(F.col("_text"), F.lit("")), F.col("_id"))
    texts = docs.where(in_training(id_col)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    learners = -(-keys // LEARNER_DOCS) or 1
    rows = join_small(texts, mine, ["_id"], "inner", keys).select(
        F.pmod(F.xxhash64(place, F.lit(1)), F.lit(learners)).cast("int").alias("learner"), (F.pmod(place, F.lit(5)) == 0).alias("held"), place.alias("place"),
        F.coalesce("_text", F.lit("")).alias("text"), F.col("_toxic").cast("int").alias("toxic"),
    )
    return pin(rows.repartitionById(learners, F.col("learner")).sortWithinPartitions("learner", "place", "text", "toxic"))


def _read(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    return utf8(batch.column("text").to_pylist()), batch.column("toxic").to_numpy().astype(np.float32)


def _sums(rows: DataFrame, run, kind: str, keys: list[str], **how) -> pa.Table:
    """What tasks yield, added up by key. Keys are buckets, weights or bins, so the table is bounded by the model."""
    with small_batches(rows.sparkSession, STEP_DOCS):
        return rows.mapInArrow(run, kind).groupBy(*keys).agg(*(how.get(c, F.sum)(c).alias(c) for c in [x.split()[0] for x in kind.split(", ")] if c not in keys)).toArrow()


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Model:
    """A model of all labelled training rows, without a bound on rows or texts.

    Counts and cut-offs are sums over all rows. In an epoch each learner makes steps over its rows from the model so far; a
    weight moves by the mean of the learners' changes by rows, an embedding by the mean of those that changed it.
    """
    rows = training_rows(docs, labels, id_col, text_col)
    fit, spark = rows.where("not held").select("learner", "text", "toxic"), docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            texts, toxic = _read(b)
            seen += _seen(texts, toxic)
            total += np.bincount((toxic > 0.5).astype(int), minlength=2)
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_pydict({"key": np.append(at, -1), "clean": np.append(seen[0, at], total[0]), "toxic": np.append(seen[1, at], total[1])})

    got = _sums(fit, count, "key long, clean long, toxic long", ["key"])
    key, both = got["key"].to_numpy(), np.stack([got["clean"].to_numpy(), got["toxic"].to_numpy()])
    seen, total = np.zeros((2, BUCKETS), np.int64), both[:, key < 0].sum(1)
    seen[:, key[key >= 0]] = both[:, key >= 0]
    model = _first_model(seen, total, np.random.default_rng(seed))
    for _ in range(EPOCHS if total.sum() else 0):
        _epoch(model, fit)

    shared = spark.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _binned(shared.value, *_read(b))
            parts = [*zip(*found), *zip(*found.values())] if found else [[]] * 6
            kinds = [pa.int64()] * 2 + [pa.float64()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, kinds, strict=True)], names=["language", "bin", "low", "high", "clean", "toxic"])

    got = _sums(rows.where("held").select("text", "toxic"), bins, "language long, bin long, low double, high double, clean long, toxic long", ["language", "bin"], low=F.min, high=F.max)
    _calibrate(model, {(r["language"], r["bin"]): [r["low"], r["high"], r["clean"], r["toxic"]] for r in got.to_pylist()})
    return model


def _epoch(model: Model, fit: DataFrame) -> None:
    """One pass over all rows by learners; then the model is moved by their mean changes."""
    shared = fit.sparkSession.sparkContext.broadcast(model)
    n = sum(p.size for p in _dense(model)) + 1

    def changes(before: Model, after: Model, docs: int) -> pa.RecordBatch:
        flat = [np.concatenate([*(p.ravel() for p in _dense(m)), [m.intercept]]) for m in (before, after)]
        dense = np.zeros((-(-n // WIDTH), WIDTH))
        dense.ravel()[:n] = flat[1] - flat[0]
        moved = np.flatnonzero((before.rows != after.rows).any(1))
        values = np.concatenate([dense, after.rows[moved].astype(float) - before.rows[moved]])
        key = np.concatenate([-1 - np.arange(len(dense)), moved])
        whole = np.rint(values * (docs * PART)).astype(np.int64)
        return pa.RecordBatch.from_pydict({"key": key, "docs": np.full(len(key), docs), **{f"v{i}": np.ascontiguousarray(whole[:, i]) for i in range(WIDTH)}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, after, moments, docs = None, None, None, 0
        for b in batches:
            texts, toxic = _read(b)
            own = b.column("learner").to_numpy()
            for at in np.flatnonzero(np.diff(own, prepend=-1)) if len(own) else ():
                if own[at] != learner:
                    if docs:
                        yield changes(shared.value, after, docs)
                    learner, after, docs = own[at], copy.deepcopy(shared.value), 0
                    moments = _moments(after)
                same = own == learner
                _step(after, moments, [t for t, s in zip(texts, same, strict=True) if s], toxic[same])
                docs += int(same.sum())
        if docs:
            yield changes(shared.value, after, docs)

    got = _sums(fit, run, "key long, docs long, " + ", ".join(f"v{i} long" for i in range(WIDTH)), ["key"])
    key = got["key"].to_numpy()
    mean = np.stack([got[f"v{i}"].to_numpy() for i in range(WIDTH)], axis=1) / (got["docs"].to_numpy()[:, None] * PART)
    model.rows[key[key >= 0]] += mean[key >= 0].astype(np.float32)
    flat = mean[key < 0][np.argsort(-key[key < 0])].ravel()[:n]
    at = 0
    for p in _dense(model):
        p += flat[at : at + p.size].reshape(p.shape).astype(np.float32)
        at += p.size
    model.intercept += float(flat[-1])
    shared.unpersist()


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """(row struct of the columns, held_out, score, predicted)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train_on(docs, labels, id_col, text_col))
    held = F.coalesce(~in_training(id_col), F.lit(False)).alias("held_out")
    source = docs.select(F.struct(*columns).alias("row"), held, F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.value.scores(utf8(b.column("text").to_pylist())) if b.num_rows else np.zeros(0)
            arrays = [b.column("row"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "held_out", "score", "predicted"])

    with small_batches(spark, 256):
        return pin(source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, held_out boolean, score double, predicted int"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, held_out, score from 0 to 1, predicted, which is 1 from a score of 0.7 up).

    Labels are learnt from training rows only, and from all of them; scores see nothing but the text, and all of it. A null text scores as the empty text. Rows
    without identifier are not held out and never learnt from. Without labels of both kinds scores carry no meaning but
    stay within bounds. An empty table gives an empty table.
    """
    return _scored(docs, labels, id_col, text_col, [id_col]).select("row.*", "held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those predicted toxic; columns as they were."""
    return _scored(docs, labels, id_col, text_col, docs.columns).where("predicted = 0").select("row.*")
