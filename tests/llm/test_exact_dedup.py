import re

import pytest
from pyspark.sql import functions as F

from cuemill.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, _id string"
ROWS = [
    (1, "a b", "x", "y"), (2, "a  b", None, "y"), (3, "ab", "x", None), (4, None, "x", "y"), (5, "", "x", "y"),
    (6, " \t", "x", "y"), (7, "ü" * 50_000, "x", "y"), (8, "ü" * 50_000 + "\n", "x", "y"), (9, "a b", "x", "y"), (None, "q", "", ""),
    (11, "q", "", ""),
]


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = {}
    for doc, text, *_ in rows:
        group = [(-len(t or ""), i is None, i or 0) for i, t, *_ in rows if norm(t) == norm(text)]
        keep = min(group)
        out[doc] = (None if keep[1] else keep[2], len(group))
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.unhex(F.lit("00"))])
def test_matches_brute_force(spark, digest):
    """Also with a digest that is the same for all texts: the full bytes then decide."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs, digest=digest).collect()}
    assert got == brute(ROWS)


@pytest.mark.parametrize("size", [256, 1])
def test_many_copies_are_compared_in_parts(spark, monkeypatch, size):
    """Text identifiers, columns named as the operator's own, and a digest that two different texts share."""
    monkeypatch.setattr(exact_dedup, "PART_ROWS", size)
    rows = [(f"d{i:03}", "same text" if i % 4 else f"own {i}", i, str(i), "r") for i in range(120)] + [(None, "same text", 0, "", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _key long, _sha string, _row string").repartition(5)
    clash = lambda c: F.when(F.length(c) > 6, F.lit(b"1")).otherwise(F.lit(b"2"))
    for digest in (exact_dedup.sha256, clash):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs, digest=digest).collect()}
        assert got == {d: (("d001", 91) if t == "same text" else (d, 1)) for d, t, *_ in rows}
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[1] != "same text" or r[0] == "d001")


def test_filter_keeps_one_row_each(spark):
    rows = [*ROWS, ROWS[0], ROWS[2]]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 6, 8, 9, 11]


def test_repeated_winner_leaves_one_row(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab")], "doc_id long, text string")
    assert [tuple(r) for r in exact_dedup.drop_exact_duplicates(docs).collect()] == [(1, "a b")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == 0


def test_state_goes_on_from_its_checkpoint(spark):
    """A second run over more files folds them into the state that the first one left."""
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    path = exact_dedup.shared_dir(spark)
    keyed = docs.select(F.col("doc_id").alias("_id"), exact_dedup.sha256(F.col("text")).alias("digest"), F.length("text").alias("_n"), F.lit("f").alias("_at"))
    staged = exact_dedup.pin(keyed, path)
    assert exact_dedup.fold_digests(staged, path).count() == 2
    keyed.where("_id = 2").withColumn("_id", F.lit(7).cast("long")).write.mode("append").parquet(path)
    state = {r.copies: r.best.id for r in exact_dedup.fold_digests(staged, path).collect()}
    assert state == {1: 1, 2: 2}
