"""Iterative dataflow: components, belief propagation, conjugate gradients. Rounds are cut by checkpoints in the shared
folder; nothing but a counter comes to the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, an own one if driver and
    executors are one process (tests); on a cluster there is no such folder then, and that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = f"file://{found}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links(a, b): the least node that can be reached. Edges are contracted along the map to the
    neighbour of least hash until none is left, which takes few rounds even for long chains."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, maps = checkpointed(both.filter("a <> b").distinct()), []
    out = both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    while not edges.isEmpty():
        best = edges.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = checkpointed(best.select(F.col("a").alias("from"), F.least(rank("a"), F.col("m"))["v"].alias("to")))
        maps.append(step)
        half = edges.join(step, edges["a"] == step["from"]).select(F.col("to").alias("a"), "b")
        edges = checkpointed(half.join(step, half["b"] == step["from"]).select("a", F.col("to").alias("b")).filter("a <> b").distinct())
    for step in maps:
        out = out.join(step.withColumnRenamed("from", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out.join(out.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def belief_propagation(costs: DataFrame, edges: DataFrame, smoothness: float = 1.0, rounds: int = 10) -> DataFrame:
    """(node, label) of low energy: costs(node, label, cost) plus smoothness per edge(a, b) between different labels.
    Min-sum messages over directed edges, all at once; with Potts costs a message is the belief cut at its least plus
    smoothness. A message is one row with all its labels; a round brings each node's costs and messages together once, so
    nothing is joined, and a node's neighbours are one list."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = costs.select("label").distinct().agg(F.collect_list(F.struct("label", F.lit(0.0).alias("m"))).alias("m"))  # one row
    own = checkpointed(costs.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("label", F.col("cost").cast("double").alias("cost")))).alias("costs")))
    messages = checkpointed(both.join(F.broadcast(labels)).select(F.col("a").alias("src"), F.col("b").alias("dst"), "m"))
    said = lambda one, label: F.filter(one["m"], lambda e: e["label"] == label)

    def met() -> DataFrame:
        """(node, into, belief): a node's messages by sender, and its labels with what they cost and the messages add."""
        message = F.struct("src", "m")
        rows = own.select("node", "costs", F.lit(None).cast(messages.select(message.alias("x")).schema["x"].dataType).alias("one"))
        rows = rows.unionByName(messages.select(F.col("dst").alias("node"), F.lit(None).cast(own.schema["costs"].dataType).alias("costs"), message.alias("one")))
        rows = rows.groupBy("node").agg(F.any_value("costs", True).alias("costs"), F.array_sort(F.collect_list("one")).alias("into")).filter("costs is not null")
        total = lambda label: F.aggregate("into", F.lit(0.0), lambda s, x: s + F.coalesce(F.get(said(x, label), F.lit(0))["m"], F.lit(0.0)))
        return rows.select("node", "into", F.transform("costs", lambda c: F.struct(c["label"].alias("label"), (c["cost"] + total(c["label"])).alias("belief"))).alias("belief"))

    for _ in range(rounds):
        out = met().select(F.col("node").alias("src"), "belief", F.explode("into").alias("back")).select("src", F.col("back.src").alias("dst"), "belief", F.col("back.m").alias("m"))
        known = F.filter("belief", lambda c: F.exists("m", lambda e: e["label"] == c["label"]))
        out = out.select("src", "dst", F.transform(known, lambda c: F.struct(c["label"].alias("label"), (c["belief"] - F.get(F.filter("m", lambda e: e["label"] == c["label"]), F.lit(0))["m"]).alias("h"))).alias("h"))
        out = out.withColumn("low", F.array_min(F.transform("h", lambda x: x["h"]))).filter("low is not null")
        messages = checkpointed(out.select("src", "dst", F.transform("h", lambda x: F.struct(x["label"].alias("label"), (F.least(x["h"], F.col("low") + smoothness) - F.col("low")).alias("m"))).alias("m")))
    best = F.array_min(F.transform("belief", lambda c: F.struct(F.round(c["belief"], 9).alias("belief"), c["label"].alias("label"))))
    return met().select("node", best.alias("best")).select("node", "best.label")


def energy(costs: DataFrame, edges: DataFrame, labelling: DataFrame, smoothness: float = 1.0) -> float:
    data = costs.join(labelling, ["node", "label"]).agg(F.sum("cost")).collect()[0][0] or 0.0
    a = edges.join(labelling.toDF("a", "la"), "a").join(labelling.toDF("b", "lb"), "b")
    return data + smoothness * a.filter("la <> lb").count()


def conjugate_gradients(matrix: DataFrame, right: DataFrame, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """(i, value) with matrix(i, j, value) x = right(i, value), for a symmetric positive matrix."""
    state = checkpointed(right.select("i", F.lit(0.0).alias("x"), F.col("value").alias("r"), F.col("value").alias("p")))
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).collect()[0][0] or 0.0
    first = rr
    for _ in range(rounds):
        if not rr or rr <= tolerance * tolerance * first:
            break
        ap = matrix.join(state.select(F.col("i").alias("j"), "p"), "j").groupBy("i").agg(F.sum(F.col("value") * F.col("p")).alias("ap"))
        both = checkpointed(state.join(ap, "i", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))))
        alpha = rr / both.agg(F.sum(F.col("p") * F.col("ap"))).collect()[0][0]
        moved = both.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        new = moved.agg(F.sum(F.col("r") * F.col("r"))).collect()[0][0]
        state = checkpointed(moved.select("i", "x", "r", (F.col("r") + new / rr * F.col("p")).alias("p")))
        rr = new
    return state.select("i", F.col("x").alias("value"))
