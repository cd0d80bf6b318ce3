"""Connected components by large-star and small-star contraction (Kiveris et al., 2014), as DataFrame jobs.

Edges stay distributed: every round is two grouped minima and two joins, and its edges are written to shared
storage, which cuts the lineage. Rounds end when a round leaves the set of edges as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import pin


def connected_components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``links`` (a, b) of one orderable type -> (node, component): the smallest node reachable.

    Only nodes with a link to another node are returned. Null ends and self links are left out; repeated and
    reversed links count once. An empty table gives an empty table.
    """
    edges = pin(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        edges = pin(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on its smallest neighbour or itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # only pairs with a larger neighbour are moved, and those are the edges as stored, (larger, smaller)
    return edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its smaller neighbours, and itself, on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
