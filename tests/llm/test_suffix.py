import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.llm import suffix


def brute(rows, t):
    """(id -> set of removed bytes) by comparing every window of every document."""
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - t + 1):
            first.setdefault(b[i : i + t], set()).add(float("inf") if doc is None else doc)
    out = []
    for doc, text in rows:
        b, gone = (text or "").encode(), set()
        for i in range(len(b) - t + 1):
            if min(first[b[i : i + t]]) < (float("inf") if doc is None else doc):
                gone.update(range(i, i + t))
        runs = sum(1 for i in gone if i - 1 not in gone)
        out.append((doc, len(b), len(gone), runs, bytes(x for i, x in enumerate(b) if i not in gone)))
    return sorted(out, key=repr)


def got(spark, rows, t):
    found = suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), threshold=t)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found.collect()), key=repr)


@pytest.mark.parametrize("t", [50, 12, 2])
@pytest.mark.parametrize("chunk,crowded", [(1 << 20, 1 << 16), (400, 1 << 16), (400, 3), (1 << 20, 0)])
def test_matches_brute_force(spark, monkeypatch, t, chunk, crowded):
    """In one chunk or many, with no gram, some grams or all grams keyed by whole windows."""
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix, "CROWDED", crowded)
    rng = np.random.default_rng(t)
    words = ["ab", "é", "the", "of", "xyz", "\n", "q r"]
    text = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    shared = [text(40) for _ in range(4)]
    rows = [(None, shared[0]), (100, None), (101, ""), (102, "a" * 300), (103, "a" * 200 + "b"), (104, shared[1]), (104, shared[1] + "!")]
    for i in range(40):
        parts = [text(rng.integers(0, 30)), shared[rng.integers(0, 4)][int(rng.integers(0, 40)) :], text(rng.integers(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[10][1]) for i in range(5)]
    assert got(spark, rows, t) == brute(rows, t)


def test_long_document_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    long = "".join(map(chr, rng.integers(97, 123, 2_300_000)))
    cut = (1 << 20) - 30
    rows = [(1, long), (2, "##" + long[cut : cut + 80] + "##"), (3, long[:49]), (4, long[-50:])]
    found = {r[0]: r[2:] for r in got(spark, rows, 50)}
    assert found == {1: (0, 0, long.encode()), 2: (80, 1, b"####"), 3: (0, 0, long[:49].encode()), 4: (50, 1, b"")}


def test_a_run_of_blanks_in_all_documents(spark, monkeypatch):
    """Documents that share but a run of blanks: their suffixes stay out of the buckets and results are the literal ones."""
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 1 << 14)
    monkeypatch.setattr(suffix, "CROWDED", 500)
    rng = np.random.default_rng(2)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 40)))
    rows = [(i, word() + " " * 60 + word()) for i in range(600)]
    assert got(spark, rows, 50) == brute(rows, 50)
    depth = suffix.Depth(50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = suffix.chunked(docs, "doc_id", "text", [], 1 << 14)
    alive = suffix.first_digit(chunks, depth, 8)
    crowd = {n for r in alive.collect() for n in suffix._names([r.blob])[1].tolist()}
    assert 0 < len(crowd) < 5  # the gram of blanks, and none of a single document


def test_filter_keeps_columns_and_characters(spark):
    same = "x" * 49 + "é"
    docs = spark.createDataFrame([("en", 1, same, 5), ("fr", 2, "ab" + "x" * 49 + "ét", 6), ("de", 3, None, 7), ("en", 4, "x" * 49 + "è" * 3 + "x" * 49 + "è", 8)], "lang string, doc_id int, text string, size int")
    kept = suffix.drop_repeated_passages(docs)
    assert kept.columns == docs.columns and kept.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    rows = {r.doc_id: (r.lang, r.text, r.size) for r in kept.collect()}
    want = {d: bytes(b).decode("utf-8", "ignore") for d, *_, b in brute([(1, same), (2, "ab" + "x" * 49 + "ét"), (3, None), (4, "x" * 49 + "è" * 3 + "x" * 49 + "è")], 50)}
    assert rows == {1: ("en", want[1], 5), 2: ("fr", "abt", 6), 3: ("de", "", 7), 4: ("en", want[4], 8)} and want[1] == same


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, other string")
    assert suffix.repeated_passages(docs).count() == 0
    assert suffix.drop_repeated_passages(docs).count() == 0


def test_identifiers_of_other_types(spark):
    """Text identifiers are compared as text, dates as dates; they come back as they were."""
    rng = np.random.default_rng(9)
    words = ["ab", "é", "the", "of", "xyz"]
    text = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    shared = [text(30) for _ in range(3)]
    texts = [shared[i % 3][i % 7 :] + text(5) for i in range(40)] + [None, shared[0]]
    names = [f"d{i}" for i in rng.permutation(40)] + ["", None]
    frame = spark.createDataFrame(list(zip(names, texts, texts)), "doc_id string, text string, _id string").repartition(3)
    order = {n: k for k, n in enumerate(sorted(n for n in names if n is not None))} | {None: None}
    back = {k: n for n, k in order.items()}
    want = sorted(((back[r[0]], *r[1:]) for r in brute([(order[n], t) for n, t in zip(names, texts)], 12)), key=repr)
    found = suffix.repeated_passages(frame, threshold=12)
    assert found.schema["doc_id"].dataType == frame.schema["doc_id"].dataType
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found.collect()), key=repr) == want
    kept = suffix.drop_repeated_passages(frame, threshold=12)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(names)
    days = frame.withColumn("doc_id", F.expr("date_add(DATE'2020-01-01', try_cast(substring(doc_id, 2) AS int))")).where("doc_id is not null")
    assert suffix.repeated_passages(days, threshold=12).agg(F.sum("n_removed")).first()[0] > 100
