import numpy as np
import pytest
import xxhash

from cuemill.llm import simhash
from cuemill.llm.components import connected_components


def slow_fingerprint(text, words=3):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, near):
    parent = {i: i for i in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                low = min(parent[a], parent[b])
                if near(a, b) and (parent[a] != low or parent[b] != low):
                    parent[a] = parent[b] = low
                    changed = True
    return parent


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "A b", "a B c", "x " * 9000, "Ünï cödé\x0btext é", "a b c d e"])
def test_fingerprint(text):
    assert int(simhash.fingerprints([text])[0]) == slow_fingerprint(text)


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 3])
def test_components_match_brute_force(spark, monkeypatch, crowded):
    """Also where every shared segment value is cut by the bytes of the other segment."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    for base in fps[:12]:
        for _ in range(10):
            fp = base
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                fp ^= 1 << int(bit)
            fps.append(fp)
    fps = list(dict.fromkeys(fps))
    want = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    rows = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long"))
    found = {r.node: r.component for r in connected_components(links).collect()}
    classes = {}
    for (signed,), fp in zip(rows, fps, strict=True):
        classes.setdefault(want[fp], set()).add(found.get(signed, signed))
    assert all(len(c) == 1 for c in classes.values())
    assert len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, "a b c d", 5), (2, "A  b\nc d", 6), (3, None, 7), (4, "", 8), (None, "z", 9), (6, long, 1), (7, long + " w0", 1), (8, long, 1), (8, long, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {k[0]: v for k, v in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, None: None, 6: 6, 7: 6, 8: 6}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "None"]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_long_path_is_one_component(spark):
    links = spark.range(300).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(900, 901), (None, 3), (7, 7)], "a long, b long"))
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {**dict.fromkeys(range(301), 0), 900: 900, 901: 900}
