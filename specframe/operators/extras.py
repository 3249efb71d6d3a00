"""Review queue, completeness, call resolution, neighborhoods, module clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialize
from .graph import P


def review_queue(elements: DataFrame, status: str | None = None, confidence: str | None = None,
                 assignee: str | None = None, level: str | None = None, facet: str | None = None) -> DataFrame:
    """Elements to review; every given criterion must hold.  ``facet`` is ``contract`` or
    ``data_model``, which must be filled in."""
    out = elements
    for column, value in (("metadata.status", status), ("metadata.confidence", confidence),
                          ("metadata.assigned_to", assignee), ("hierarchy_level", level)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out if facet is None else out.filter(F.col(facet).isNotNull())


def completeness(elements: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Shares of elements with a contract and of confirmed elements; ready when the
    confirmed share reaches ``threshold``."""
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    confirmed = F.col("metadata.status") == "confirmed"
    return elements.groupBy(P).agg(
        F.count(F.lit(1)).alias("elements"), share(F.col("contract").isNotNull()).alias("with_contract"),
        share(confirmed).alias("confirmed")).withColumn("ready", F.col("confirmed") >= threshold)


def call_resolution(edges: DataFrame, nodes: DataFrame, kind: str = "calls") -> DataFrame:
    """Percentage of call edges whose target is a known node."""
    known = nodes.select(P, F.col("id").alias("dst"), F.lit(True).alias("known"))
    calls = edges.filter(F.col("kind") == kind).groupBy(P, "dst").agg(F.count(F.lit(1)).alias("n"))
    return calls.join(known, [P, "dst"], "left").groupBy(P).agg(
        F.sum("n").alias("calls"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("resolved")
    ).withColumn("call_resolution_pct", F.col("resolved") / F.col("calls") * 100)


def k_hop(edges: DataFrame, seeds: DataFrame, k: int, direction: str = "out") -> DataFrame:
    """Nodes within ``k`` steps of each seed, ``(project_id, seed, id, hops)``, the seed at 0.

    Breadth first: each round joins only the newest frontier with the edges, drops what
    was reached before, and is written out.  ``direction``: ``out``, ``in`` or ``both``.

    Repeated edges are not dropped by a shuffle of their own, as each round keeps a pair of seed
    and node once.  Keys begin with the node: sorts compare the first bytes of the first key,
    and those of the project are the same in most rows."""
    out = edges.select(P, F.col("src").alias("id"), F.col("dst").alias("to"))
    back = edges.select(P, F.col("dst").alias("id"), F.col("src").alias("to"))
    steps = materialize({"out": out, "in": back, "both": out.unionByName(back)}[direction], "steps")
    frontier = seeds.select("id", F.col("id").alias("seed"), P).distinct()
    reached = materialize(frontier.withColumn("hops", F.lit(0)), "hops")
    frontier = reached.drop("hops")
    for hop in range(1, k + 1):
        new = steps.join(broadcast_if_small(frontier), ["id", P]).select(F.col("to").alias("id"), "seed", P).distinct()
        fresh = materialize(new.join(reached, ["id", "seed", P], "left_anti").withColumn("hops", F.lit(hop)), "hops")
        if fresh.isEmpty():
            break
        reached = reached.unionByName(fresh)
        frontier = fresh.drop("hops")
    return reached.select(P, "seed", "id", "hops")


def cluster_modules(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Cluster proposal by label propagation on weighted undirected edges,
    ``(project_id, id, cluster)``.

    In every round each node takes the label with the largest total weight among its
    neighbours and itself (weight one), ties to the smallest label.  Messages are summed
    per (node, label) before anything is compared, so hubs do not gather their
    neighbours in one task."""
    pair = F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    merged = materialize(
        edges.filter("src != dst").select(P, pair.alias("p"), weight.cast("bigint").alias("weight"))
        .groupBy(P, "p").agg(F.sum("weight").alias("weight"))
        .select(P, "weight", F.explode(F.array(
            F.struct(F.col("p.a").alias("id"), F.col("p.b").alias("other")),
            F.struct(F.col("p.b").alias("id"), F.col("p.a").alias("other")))).alias("e"))
        .select(P, "e.id", "e.other", "weight"), "cluster-edges")
    everyone = edges.select(P, F.explode(F.array("src", "dst")).alias("id")).distinct()
    labels = materialize(everyone.select(P, "id", F.col("id").alias("cluster")), "cluster-labels")
    for _ in range(rounds):
        votes = merged.join(labels.withColumnRenamed("id", "other"), [P, "other"]).select(P, "id", "cluster", "weight")
        votes = votes.unionByName(labels.withColumn("weight", F.lit(1).cast("bigint")))
        new = votes.groupBy(P, "id", "cluster").agg(F.sum("weight").alias("w")).groupBy(P, "id").agg(
            F.min(F.struct((-F.col("w")).alias("w"), "cluster")).alias("best")).select(P, "id", F.col("best.cluster").alias("cluster"))
        new = materialize(new, "cluster-labels")
        same = new.join(labels, [P, "id", "cluster"], "left_anti").isEmpty()
        labels = new
        if same:
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of a clustering per project, from edge and degree sums per cluster."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    e = edges.filter("src != dst").select(P, "src", "dst", weight.cast("bigint").alias("weight"))
    a = labels.select(P, F.col("id").alias("src"), F.col("cluster").alias("cs"))
    b = labels.select(P, F.col("id").alias("dst"), F.col("cluster").alias("cd"))
    both = e.join(a, [P, "src"]).join(b, [P, "dst"]).select(P, "cs", "cd", "weight")
    per_cluster = both.select(P, "weight", (F.col("cs") == F.col("cd")).alias("inside"),
                              F.explode(F.array("cs", "cd")).alias("cluster")).groupBy(P, "cluster").agg(
        F.sum("weight").alias("degree"), F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0)).alias("inner2"))
    total = per_cluster.groupBy(P).agg(F.sum("degree").alias("m2"))
    return per_cluster.join(total, P).groupBy(P).agg(F.sum(
        F.col("inner2") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), F.lit(2))).alias("modularity"))
