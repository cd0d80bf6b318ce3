"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most three bits differ in
at most one bit of one segment, so every fingerprint is filed under both of its segments and looks up the Hamming
ball of radius one around each (33 values); the complete distance decides. Equal fingerprints meet first, as one
row with their smallest identifier, so copies never multiply.

The rows of one segment value are put together by a shuffle, sorted, and compared in bounded blocks. Of the links
inside a value only a spanning forest leaves the task: components stay the same, and a group of n near copies gives
n - 1 rows, not n * n. A segment value that many fingerprints share is cut by one more level: the other segment then
differs in at most three bits, so one of its four bytes is equal, and the rows meet under those bytes instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import join_small, pin, session_conf, small_batches, utf8
from cuemill.llm.components import connected_components

SEED = 42
DISTANCE = 3
#: A segment value with more fingerprints than this is cut by the bytes of the other segment.
CROWDED = 4096
#: Pairs that a task compares at once.
PAIRS = 1 << 21


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """64-bit SimHash of each text: A-Z lower-cased, words between ASCII white space, shingles with repeats.

    A bit is 1 if it is set in over half the XXH64 hashes. Fewer words than a shingle make one shingle of them all;
    a text without words (or null) has fingerprint zero.
    """
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(utf8(texts)):
        parts = text.lower().split()
        if not parts:
            continue
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        n = max(1, len(parts) - words + 1)
        first = np.concatenate(([0], ends[: n - 1] + 1))
        spans = zip(first.tolist(), ends[-n:].tolist(), strict=True)
        ones = np.zeros(64, np.int64)
        while len(hashes := np.fromiter((digest(line[a:b], SEED) for a, b in islice(spans, 4096)), np.uint64)):
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.uint16)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long) for every document, written to shared storage; whole texts in small Arrow batches."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    with small_batches(docs.sparkSession):
        return pin(source.mapInArrow(run, f"id {kind}, fp long"))


def _filed(classes: DataFrame) -> DataFrame:
    """Each fingerprint under its two segment values (``own``) and under the balls around them: (k, own, other, fp)."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    j = F.col("j")
    at_high = j >= 33
    bit = F.when(at_high, j - 33).otherwise(j)
    mask = F.when(bit == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, cast(if(j >= 33, j - 33, j) - 1 as int))"))
    value = F.when(at_high, high).otherwise(low).bitwiseXOR(mask)
    rows = classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("j"))
    return rows.select(
        (value + F.when(at_high, F.lit(1 << 32)).otherwise(F.lit(0).cast("long"))).alias("k"), (bit == 0).alias("own"),
        F.when(at_high, low).otherwise(high).alias("other"), "fp",
    )


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of each pair; a label is the smallest index of its class."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(labels, up := labels[labels]):
            labels = up
    return labels


def forest(key: np.ndarray, own: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among rows sorted by key: an ``own`` row and any row of its key link within the distance."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    lead = np.repeat(start, size)
    width = np.repeat(size, size)
    mine = np.flatnonzero(own & (width > 1))
    labels = np.arange(len(key))
    edge = np.searchsorted(np.cumsum(width[mine]), np.arange(PAIRS, width[mine].sum() + PAIRS, PAIRS), "left") + 1
    at = 0
    for stop in edge:
        part = mine[at:stop]
        if len(part):
            n = width[part]
            left = np.repeat(part, n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lead[part], n)
            near = (np.bitwise_count(fp[left] ^ fp[right]) <= distance) & (left != right)
            labels = merge_labels(labels, left[near], right[near])
        at = max(at, stop)
    child = np.flatnonzero(labels != np.arange(len(key)))
    return fp[child], fp[labels[child]]


def near_links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) of fingerprints that connect exactly the fingerprints reachable over distances up to ``distance``, at most three."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("two segments with balls of radius one find distances up to three")
    rows = _filed(classes)
    crowded = pin(rows.where("own").groupBy("k").count().where(F.col("count") > CROWDED).select("k"))
    if not crowded.isEmpty():
        cut = join_small(rows, crowded, ["k"], "left_semi").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(3))))
        byte = F.expr("shiftright(other, cast(8 * b as int)) & 255")
        cut = cut.withColumn("k", F.col("k") + (F.col("b") + 1) * F.lit(1 << 41) + byte * F.lit(1 << 33))
        rows = join_small(rows, crowded, ["k"], "left_anti").unionByName(cut.drop("b"))
    sorted_rows = rows.select("k", "own", "fp").repartition("k").sortWithinPartitions("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)]
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column("k").to_numpy(), b.column("own").to_numpy(zero_copy_only=False), b.column("fp").to_numpy().view(np.uint64)]
            rest = [np.concatenate(x) for x in zip(rest, new, strict=True)]
            whole = np.searchsorted(rest[0], rest[0][-1])  # the last key may go on in the next batch
            if whole:
                yield _links(*forest(*(x[:whole] for x in rest), distance))
                rest = [x[whole:] for x in rest]
        if len(rest[0]):
            yield _links(*forest(*rest, distance))

    with session_conf(classes.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="200000"):
        return pin(sorted_rows.mapInArrow(run, "a long, b long").distinct())


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: (id, fingerprint of 16 hex digits, component_id, the smallest identifier reachable).

    Null and blank texts have fingerprint zero and link like any other. Rows that repeat an identifier are one node.
    A null identifier takes part through its fingerprint and gets the component of it (null if no row of the
    component has an identifier). An empty table gives an empty table; other columns are not read.
    """
    keyed = with_fingerprint(docs, id_col, text_col, words)
    classes = pin(keyed.groupBy("fp").agg(F.min("id").alias("rep")))
    links = near_links(classes.select("fp"))
    ends = links.join(classes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a")
    ends = ends.join(classes.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    found = connected_components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("fp", F.coalesce("component", "rep").alias("component_id"))
    return keyed.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with the smallest identifier of each component; rows that repeat it, and rows without one, stay."""
    marked = near_duplicates(docs, id_col, text_col, words)
    lost = pin(marked.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_lost")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_lost"))
    return join_small(rows, lost, ["_lost"], "left_anti").select("_row.*")
