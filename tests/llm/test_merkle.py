import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cuemill.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_tree(nodes):
    """(root, proof of each leaf as text) by walking up one leaf at a time."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    proofs = []
    for at in range(len(nodes)):
        text = ""
        for level in levels[:-1]:
            first = at // 8 * 8
            text += "".join(level[i] for i in range(first, min(first + 8, len(level))) if i != at)
            at //= 8
        proofs.append(text)
    return levels[-1][0], proofs


@pytest.mark.parametrize("size", [1, 2, 8, 9, 64, 65, 200])
@pytest.mark.parametrize("cut", [1, 3, 8, 50, 1000])
def test_blocks_miss_only_what_they_cannot_derive(size, cut):
    """Fetched nodes are exactly the siblings without an own leaf, others hand all of them up, and the proofs lead to the root."""
    leaves = [sha(str(i)) for i in range(size)]
    root, _ = slow_tree(leaves)
    levels = {(0, i): h for i, h in enumerate(leaves)}
    sizes = merkle.level_sizes(size)
    for k in range(1, len(sizes)):
        for i in range(sizes[k]):
            levels[k, i] = sha("".join(levels[k - 1, j] for j in range(8 * i, min(8 * i + 8, sizes[k - 1]))))
    for first in range(0, size, cut):
        own = leaves[first : first + cut]
        need = merkle.missing(first, len(own), size)
        assert len(set(need)) == len(need)
        assert all((i + 1) * 8**k <= first or i * 8**k >= first + len(own) for k, i in need), "a leaf of the block lies below"
        got, proof = merkle.expand(own, first, size, {x: levels[x] for x in need})
        assert got == root and len(proof) == len(own)
        for h, steps in zip(own, proof.to_pylist(), strict=True):
            for s in steps:
                h = sha("".join(s["before"]) + h + "".join(s["after"]))
            assert h == root
    up = [x for first in range(0, size, cut) for x in merkle.climb(leaves[first : first + cut], first, size)]
    assert all(levels[k, i] == h for k, i, h in up) and len({x[:2] for x in up}) == len(up)


def test_manifest_matches_brute_force(spark, monkeypatch):
    """Null trees and order values, ties, repeated rows, trees of one leaf, blocks that cut runs, clashing names."""
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", 21)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(300)]), rng.choice(["a", "a", "a", "b", None, ""]), rng.choice(["x", "Y", None]), "t") for _ in range(500)]
    rows += [(7, "lone", None, None), *[(1, "b", "same", "t")] * 30, *((i, f"l{i}", "", "") for i in range(70))]
    frame = spark.createDataFrame(rows, "n long, lang string, text string, _tree string").repartition(7)
    leaves = frame.withColumn("leaf", merkle.leaf("n", "lang", "text"))
    found = merkle.manifest(leaves, order=("n",)).select("*", merkle.siblings().alias("joined"), merkle.fold("leaf").alias("folded")).collect()

    trees = {}
    for n, lang, text, _ in rows:
        field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        h = sha(field(n) + field(lang) + field(text))
        trees.setdefault(lang, []).append(((n is not None, n or 0, h), h))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    lows = {k: (sorted(trees[k]), slow_tree([h for _, h in sorted(trees[k])])) for k in names}
    root, highs = slow_tree([lows[k][1][0] for k in names])
    want = sorted((h, lows[k][1][0], root, p + high) for k, high in zip(names, highs, strict=True) for (_, h), p in zip(lows[k][0], lows[k][1][1], strict=True))
    assert sorted((r.leaf, r.subroot, r.root, r.joined) for r in found) == want
    assert all(r.folded == root for r in found) and {r._tree for r in found} == {"t", None, ""}


def test_altered_leaf_and_empty_table(spark):
    rows = spark.createDataFrame([(i, "x", f"Text {i}") for i in range(40)], "doc_id long, lang string, text string")
    leaves = rows.withColumn("leaf", merkle.leaf("doc_id", "text")).withColumn("other", merkle.leaf("doc_id", F.lower("text")))
    found = merkle.manifest(leaves).select("root", merkle.fold("leaf").alias("same"), merkle.fold("other").alias("changed")).collect()
    assert len(found) == 40 and all(r.same == r.root != r.changed for r in found)
    assert merkle.manifest(leaves.limit(0)).collect() == []
