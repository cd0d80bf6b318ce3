"""Merkle manifest of a dataset, with one proof per row.

Every row is a leaf; each tree (a language, say) joins runs of eight neighbouring nodes level by level until one
subroot is left, and the subroots make one more tree with the root. Leaves are placed by a range partitioning and
prefix sums, so no tree is ever sorted by one task, and then dealt out in blocks of neighbours.

Proofs are octopus multiproofs. A block first names the smallest set of nodes that it cannot derive from its own
leaves, level by level (``missing``), and hands up the nodes it completes but whose parents it does not (``climb``).
What blocks hand up is joined to whole levels by grouped sums over ever fewer rows. Each block then fetches its
missing nodes once, derives the interior that its leaves share, and expands the proof of each leaf on its own
(``expand``).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import BROADCAST_ROWS, join_small, pin, shuffle_partitions

#: Nodes that one node of the next level joins.
ARITY = 8
#: Neighbouring leaves whose proofs one task makes together.
BLOCK_LEAVES = 1000
HEX = 64
PROOF = "array<struct<before: array<string>, after: array<string>>>"


def digest(*texts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the texts put together."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def leaf(*fields: str | Column) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and its value, or ``-`` where it is null."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return digest(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def siblings(proof: str = "proof") -> Column:
    """All digests of a proof in order, as one text."""
    return F.array_join(F.flatten(F.transform(proof, lambda s: F.concat(s["before"], s["after"]))), "")


def fold(node: str | Column, proof: str = "proof") -> Column:
    """The root that a leaf and a proof lead to; the leaf itself where the proof is empty."""
    start = F.col(node) if isinstance(node, str) else node
    return F.aggregate(proof, start, lambda acc, s: digest(F.array_join(s["before"], ""), acc, F.array_join(s["after"], "")))


# --- one block -------------------------------------------------------------------------------------------------


def level_sizes(size: int) -> list[int]:
    """Nodes of each level of a tree of so many leaves, from the leaves to the root."""
    sizes = [size]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def join_runs(nodes: list[str], first: int) -> list[str]:
    """Parents of a stretch of whole runs that starts at place ``first``."""
    assert first % ARITY == 0
    return [hashlib.sha256("".join(nodes[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(nodes), ARITY)]


def climb(leaves: list[str], first: int, size: int) -> list[tuple[int, int, str]]:
    """(level, place, digest) of the nodes that these neighbouring leaves complete while the parent stays incomplete."""
    up: list[tuple[int, int, str]] = []
    low, nodes = first, leaves
    for level, total in enumerate(level_sizes(size)):
        high = low + len(nodes)
        above = -(-low // ARITY)
        end = -(-total // ARITY) if high == total else high // ARITY
        if total == 1 or end <= above:
            up += [(level, low + i, h) for i, h in enumerate(nodes)]
            break
        a, z = above * ARITY - low, min(end * ARITY, total) - low
        up += [(level, low + i, nodes[i]) for i in (*range(a), *range(z, len(nodes)))]
        low, nodes = above, join_runs(nodes[a:z], above * ARITY)
    return up


def missing(first: int, count: int, size: int) -> list[tuple[int, int]]:
    """(level, place) of the fewest nodes that, with these leaves, give all their proofs: siblings without a leaf below them."""
    need: list[tuple[int, int]] = []
    low, high = first, first + count
    for level, total in enumerate(level_sizes(size)[:-1]):
        above, end = low // ARITY, -(-high // ARITY)
        need += [(level, i) for i in (*range(above * ARITY, low), *range(high, min(end * ARITY, total)))]
        low, high = above, end
    return need


def expand(leaves: list[str], first: int, size: int, fetched: dict[tuple[int, int], str]) -> tuple[str, pa.Array]:
    """(root, proof of each leaf): interiors are derived once, then every proof gathers its siblings from the levels."""
    sizes = level_sizes(size)
    low, nodes = first, leaves
    place = first + np.arange(len(leaves))
    own, begin, stop, table = [], [], [], []
    offset = 0
    for level, total in enumerate(sizes[:-1]):
        start = low // ARITY * ARITY
        end = min(-(-(low + len(nodes)) // ARITY) * ARITY, total)
        whole = [fetched[level, i] for i in range(start, low)] + nodes + [fetched[level, i] for i in range(low + len(nodes), end)]
        table += whole
        own.append(place - start + offset)
        begin.append(place // ARITY * ARITY - start + offset)
        stop.append(np.minimum(place // ARITY * ARITY + ARITY, total) - start + offset)
        offset += len(whole)
        low, nodes, place = start // ARITY, join_runs(whole, start), place // ARITY
    digests = np.frombuffer("".join(table).encode(), np.uint8).reshape(-1, HEX)
    shape = (len(leaves) * len(own),)
    at, a, z = (np.stack(x, axis=1).reshape(shape) if own else np.zeros(0, np.int64) for x in (own, begin, stop))
    steps = pa.StructArray.from_arrays([_gather(digests, a, at), _gather(digests, at + 1, z)], names=["before", "after"])
    return nodes[0], pa.ListArray.from_arrays(np.arange(len(leaves) + 1, dtype=np.int32) * len(own), steps)


def _gather(digests: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.ListArray:
    """A list of digests for each range of rows."""
    counts = end - start
    ends = np.concatenate(([0], np.cumsum(counts)))
    rows = np.arange(ends[-1]) + np.repeat(start - ends[:-1], counts)
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * HEX)
    values = pa.StringArray.from_buffers(len(rows), offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(digests[rows]).tobytes()))
    return pa.ListArray.from_arrays(ends.astype(np.int32), values)


# --- all blocks ------------------------------------------------------------------------------------------------


def _placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``_at``, the place in their tree, and ``_size``, the leaves of the tree.

    Rows are dealt out by ranges of (tree, order, digest); equal ones are parted by their stored position, so no key is
    too large for one range. The place is the one in the range plus the counts of earlier ranges of the tree.
    """
    columns = leaves.columns
    keyed = leaves.withColumn("_tie", F.monotonically_increasing_id())
    sort = ["_tree", *order, "_leaf", "_tie"]
    ranged = keyed.repartitionByRange(shuffle_partitions(leaves.sparkSession), *sort).sortWithinPartitions(*sort)
    row = F.col("_row")
    stored = pin(
        ranged.withColumn("_row", F.monotonically_increasing_id())
        .select(*columns, F.shiftright(row, 33).alias("_part"), row.bitwiseAND((1 << 33) - 1).alias("_in"))
    )
    tree = Window.partitionBy("_tree")
    parts = stored.groupBy("_tree", "_part").agg(F.min("_in").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("_size"))
    placed = join_small(stored, pin(parts), ["_tree", "_part"], "inner")
    return placed.select(*columns, (F.col("_in") + F.col("_shift")).alias("_at"), "_size")


def _handed_up(placed: DataFrame) -> DataFrame:
    """For each block what it hands up (with a digest) and what it misses (without): (_tree, _block, level, place, digest).

    One row more, of level -1, holds the level of the tree's root as its place.
    """

    def run(key: tuple, block: pa.Table) -> pa.Table:
        tree, number = (k.as_py() for k in key)
        block = block.sort_by("_at")
        first, size = block.column("_at")[0].as_py(), block.column("_size")[0].as_py()
        rows = climb(block.column("_leaf").to_pylist(), first, size) + [(*x, None) for x in missing(first, block.num_rows, size)]
        rows.append((-1, len(level_sizes(size)) - 1, None))
        level, place, digests = zip(*rows, strict=True)
        n = len(rows)
        arrays = [pa.array([tree] * n, pa.string()), pa.array([number] * n, pa.int64()), pa.array(level, pa.int32()), pa.array(place, pa.int64())]
        return pa.Table.from_arrays([*arrays, pa.array(digests, pa.string())], names=["_tree", "_block", "level", "place", "digest"])

    source = placed.select("_tree", "_block", "_leaf", "_at", "_size")
    return source.groupBy("_tree", "_block").applyInArrow(run, "_tree string, _block long, level int, place long, digest string")


def _joined_levels(up: DataFrame, levels: int) -> list[DataFrame]:
    """All nodes that blocks may miss, by level: what they hand up and what those nodes make together."""
    found = []
    made = None
    for level in range(levels):
        nodes = up.where(F.col("level") == level).select("_tree", "place", "digest")
        if made is not None:
            nodes = nodes.unionByName(made)
        found.append(pin(nodes))
        run = F.array_sort(F.collect_list(F.struct("place", "digest")))["digest"]  # at most eight nodes
        parent = F.floor(F.col("place") / ARITY).cast("long").alias("place")
        made = found[-1].groupBy("_tree", parent).agg(digest(F.array_join(run, "")).alias("digest"))
    return found


def _fetched(need: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The missing nodes of each block. The upper levels, which all blocks ask for, are broadcast while they are small."""
    small, large, rows = [], [], 0
    for level in range(len(levels) - 1, -1, -1):
        rows += levels[level].count() if rows <= BROADCAST_ROWS else 0
        (small if rows <= BROADCAST_ROWS else large).append(levels[level].withColumn("level", F.lit(level)))
    found = []
    for nodes, hint in ((small, F.broadcast), (large, lambda x: x)):
        if nodes:
            some = nodes[0]
            for other in nodes[1:]:
                some = some.unionByName(other)
            found.append(need.join(hint(some), ["_tree", "level", "place"]).select("_tree", "_block", "level", "place", "digest"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


@dataclass
class Forest:
    """Placed leaves and what their proofs need: the missing nodes of each block, all nodes by level, the roots."""

    placed: DataFrame
    need: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def plant(leaves: DataFrame, order: list[str]) -> Forest:
    """The trees over ``leaves`` (_tree, _leaf, order columns, others)."""
    placed = pin(_placed(leaves, order).withColumn("_block", F.floor(F.col("_at") / BLOCK_LEAVES).cast("long")))
    largest = placed.agg(F.max("_size")).first()[0] or 1
    told = pin(_handed_up(placed))
    levels = _joined_levels(told.where("digest is not null"), len(level_sizes(largest)))
    heights = told.where("level = -1").groupBy("_tree").agg(F.max("place").alias("height"))
    tops = levels[0].withColumn("height", F.lit(0))
    for k, nodes in enumerate(levels[1:], 1):
        tops = tops.unionByName(nodes.withColumn("height", F.lit(k)))
    roots = tops.where("place = 0").join(heights, ["_tree", "height"]).select("_tree", F.col("digest").alias("_root"))
    return Forest(placed, told.where("level >= 0 and digest is null").drop("digest"), levels, pin(roots))


def proofs(forest: Forest, columns: list[str]) -> DataFrame:
    """``columns`` of the leaves with ``_root``, the root of the row's tree, and ``proof``.

    The proof has a step for each level: the digests before and after the row's node in its run.
    """

    def run(block: pa.Table, nodes: pa.Table) -> pa.Table:
        block = block.sort_by("_at")
        names = ("level", "place", "digest")
        fetched = {(a, b): d for a, b, d in zip(*(nodes.column(c).to_pylist() for c in names), strict=True)}
        first, size = block.column("_at")[0].as_py(), block.column("_size")[0].as_py()
        root, proof = expand(block.column("_leaf").to_pylist(), first, size, fetched)
        return block.select(columns).append_column("_root", pa.array([root] * block.num_rows, pa.string())).append_column("proof", proof)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in forest.placed.select(columns).schema)
    fetched = pin(_fetched(forest.need, forest.levels))
    both = forest.placed.groupBy("_tree", "_block").cogroup(fetched.groupBy("_tree", "_block"))
    return both.applyInArrow(run, f"{kinds}, _root string, proof {PROOF}")


def manifest(rows: DataFrame, leaf_col: str = "leaf", tree_col: str = "lang", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``rows`` with subroot, root and proof: a tree for each value of ``tree_col``, leaves in ascending ``order``.

    ``rows`` holds the digests of :func:`leaf`, the tree and order columns and whatever else is to be kept. Trees are
    ordered by their name as UTF-8 bytes; a null tree is a tree of its own and comes first. Null order values come first;
    rows with equal order values stand in the order of their digests, and repeated rows next to each other, each a leaf with a proof of its own.
    ``proof`` leads from the leaf over the subroot to the root: :func:`fold` gives the root again, :func:`siblings` its
    text. A lone leaf is its subroot, a lone subroot the root. An empty table gives an empty table. Columns may have any
    name but ``subroot``, ``root`` and ``proof``.

    Intermediate tables go to shared storage; call it inside ``common.scratch`` and write the result there to have them deleted.
    """
    ranks = [f"_o{i}" for i in range(len(order))]
    tree = F.when(F.col(tree_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(tree_col).cast("string")))
    source = rows.select(F.struct(*rows.columns).alias("_kept"), tree.alias("_tree"), F.col(leaf_col).alias("_leaf"), *(F.col(c).alias(r) for c, r in zip(order, ranks, strict=True)))
    forest = plant(pin(source), ranks)
    subroots = forest.roots.select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), F.col("_root").alias("_leaf"))
    top = proofs(plant(pin(subroots), ["_name"]), ["_name"])
    upper = pin(top.select(F.col("_name").alias("_tree"), F.col("_root").alias("root"), F.col("proof").alias("_high")))
    low = proofs(forest, ["_kept", "_tree"]).withColumnRenamed("proof", "_low")
    joined = join_small(low, upper, ["_tree"], "inner")
    return joined.select("_kept.*", F.col("_root").alias("subroot"), "root", F.concat("_low", "_high").alias("proof"))
