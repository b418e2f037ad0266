"""Connected components of an edge table, by contraction: no vertex or edge list ever leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): of links(a, b), each node's least reachable node; nodes without links are not in it.

    A round maps each node to the one of least hash among itself and its neighbours and contracts the edges by that. The
    hashes order nodes at random, so a round leaves a fraction of them even of a long chain. When no edge is left, the
    maps are put one after another, and a component takes its least node's name.
    """
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = written(links.select("a", "b").filter("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        best = edges.groupBy("a").agg(F.min(ranked("b")).alias("m"))
        step = written(best.select(F.col("a").alias("node"), F.least(ranked("a"), F.col("m"))["v"].alias("to")), "least")
        maps.append(step)
        at_a = edges.join(step, edges["a"] == step["node"]).select(F.col("to").alias("a"), "b")
        at_b = at_a.join(step, at_a["b"] == step["node"]).select("a", F.col("to").alias("b"))
        edges = written(at_b.filter("a <> b").distinct(), "edges")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    out = maps[0].select("node", F.col("to").alias("root"))
    for step in maps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    least = out.groupBy("root").agg(F.min("node").alias("component"))
    return out.join(least, "root").select("node", "component")
