"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step on distinct edges (u, v) with u > v.

    Large: every larger neighbour of a node is linked to the smallest of the
    node and its neighbours.  Small: a node and its smaller neighbours are
    linked to the smallest of them.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node that links reach.

    Links may repeat, stand in either direction or join a node with itself
    (ignored); rows with a null end are ignored.  Nodes are long.  No links
    give no rows.  Every round is written to the shared folder, so a lost
    executor costs one round at most.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND u > v").distinct()
    edges = staged(edges)
    state = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"))
    before = edges.agg(state.alias("x")).first()["x"]
    for _ in range(rounds):
        if before["n"] == 0:
            break
        edges = staged(_star(_star(edges, True), False))
        after = edges.agg(state.alias("x")).first()["x"]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
