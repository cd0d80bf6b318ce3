"""Near-duplicate documents for the pipeline: five-word shingles, Jaccard similarity of 0.8 or more.

First come SimHash fingerprints by multi-index hashing (``simhash``): texts with fingerprints at most three bits apart are
candidates, and those whose shingle sets have a Jaccard similarity of 0.8 or more are joined. A pair at 0.8 is 10 bits
apart on average and often 17, and a radius of 17 takes in one random pair in ten thousand, which grows with the square
of the corpus. The pairs beyond three bits are therefore found by 80 minima, cut into sixteen bands of five (99.8 % of
the pairs at 0.8 share a band), among texts that SimHash did not join. The same exact similarity decides, and components
go by links as in ``lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import join_small, pin, scratch, small_batches, utf8
from cuemill.llm.lines import SIGNED, near_components, signed, verified
from cuemill.llm.simhash import near_links, with_fingerprint

WORDS = 5


def words_line(text: str | None) -> bytes:
    """A-Z lower-cased, words between ASCII white space, one blank between two."""
    return b" ".join(utf8([text])[0].lower().split())


def shingle_set(line: bytes) -> set[bytes]:
    """Distinct shingles of five words; fewer words make one shingle of them all, no words make none."""
    parts = line.split()
    return {b" ".join(parts[i : i + WORDS]) for i in range(max(1, len(parts) - WORDS + 1))} if parts else set()


def simhash_links(texts: DataFrame) -> DataFrame:
    """Links (a, b) of distinct texts (lid, norm): SimHash fingerprints up to three bits apart, similarity of 0.8 or more.

    Texts of one fingerprint are held against its first, and the first ones of linked fingerprints against each other.
    """
    keyed = with_fingerprint(texts.withColumn("norm", F.col("norm").cast("string")), "lid", "norm", WORDS)
    classes = pin(keyed.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("texts")))
    ends = near_links(classes.select("fp")).join(classes.select(F.col("fp").alias("a"), F.col("first").alias("fa")), "a")
    ends = ends.join(classes.select(F.col("fp").alias("b"), F.col("first").alias("fb")), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    shared = classes.where("texts > 1").select("fp", "first")
    equal = keyed.join(shared, "fp").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    return verified(ends.unionByName(equal), texts, shingle_set)


def sign_documents(distinct: DataFrame) -> DataFrame:
    """(lid, n shingles, segments, sketch) of distinct texts (lid, norm), written to shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(x) for x in b.column("norm").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            h = np.fromiter((xxhash.xxh64_intdigest(x) for one in found for x in one), np.uint64, len(row))
            yield signed(b.column("lid"), row, h)

    with small_batches(distinct.sparkSession, 256):
        return pin(distinct.select("lid", "norm").mapInArrow(run, SIGNED))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, norm) of every document, written to shared storage."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm = [words_line(x) for x in b.column("text").to_pylist()]
            key = [xxhash.xxh128_digest(x) for x in norm]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(key, pa.binary()), pa.array(norm, pa.binary())], names=["id", "key", "norm"])

    with small_batches(docs.sparkSession):
        return pin(source.mapInArrow(run, f"id {kind}, key binary, norm binary"))


def drop_near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest identifier of each component; rows that repeat it stay together.

    Null and blank texts are equal. A null identifier takes part through its text, and its row stays.
    """
    with scratch(docs.sparkSession) as kept:
        keyed = _keyed(docs, id_col, text_col)
        distinct = pin(keyed.groupBy("key").agg(F.first("norm").alias("norm")).withColumn("lid", F.monotonically_increasing_id()))
        texts = distinct.select("lid", "norm")
        found = near_components(sign_documents(texts), texts, shingle_set, simhash_links(texts)).withColumnRenamed("node", "lid")
        named = distinct.select("key", "lid").join(found, "lid", "left").select("key", F.coalesce("component", "lid").alias("component"))
        placed = pin(keyed.select("id", "key").join(named, "key").select("id", "component"))
        first = placed.groupBy("component").agg(F.min("id").alias("first"))
        lost = placed.join(first, "component").where(F.col("id") != F.col("first")).select(F.col("id").alias("_lost")).distinct()
        # an identifier that comes first in one component stays, wherever else it occurs
        lost = pin(lost.join(first.select(F.col("first").alias("_lost")), "_lost", "left_anti"), kept)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_lost"))
    return join_small(rows, lost, ["_lost"], "left_anti").select("row.*")
