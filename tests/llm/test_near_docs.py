import numpy as np

import corpus_pipeline
from cuemill.llm import near_docs

from .test_simhash import slow_components, slow_fingerprint


def shingles(text):
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def test_pipeline_stage_matches_brute_force_jaccard(spark):
    """Planted copies with 1 to 12 changed words of 300, similarity on both sides of 0.8; short, blank and null texts."""
    rng = np.random.default_rng(9)
    texts = [None, " \n", "a b c", "A  b c", "a b d", "one two three four five six"]
    for i in range(60):
        words = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        texts.append(" ".join(words))
        for k in (1 + i % 4, 4 + i % 9):
            copy = list(words)
            for at in rng.choice(300, k, replace=False):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    sets = [shingles(t) for t in texts]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = set(slow_components(range(len(texts)), near).values())
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert 60 < len(want) < len(texts) - 60
    assert {r.doc_id for r in kept.collect()} == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 0


def test_simhash_joins_what_is_three_bits_apart(spark, monkeypatch):
    """Without any minima the stage still finds copies by their fingerprints; a near fingerprint alone does not make a copy."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(30):
        words = [f"w{k}" for k in rng.integers(0, 5000, 1500)]
        texts.append(" ".join(words))
        for at in rng.choice(1500, 2, replace=False):
            words[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    prints = [slow_fingerprint(t, 5) for t in texts]
    close = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3
    near = lambda a, b: close(a, b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = set(slow_components(range(len(texts)), near).values())
    real = near_docs.sign_documents
    monkeypatch.setattr(near_docs, "sign_documents", lambda d: real(d).where("false"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want
    assert 30 <= len(want) < 60
