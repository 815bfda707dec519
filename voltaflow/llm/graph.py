"""Connected components by minimum labels with pointer jumping, on tables in the shared folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remove, shared_path


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not at some later collection of garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def collapse(edges: DataFrame) -> DataFrame:
    """Fewer edges (u, v) that connect the same nodes: a node keeps its least neighbour, its others are linked to that one.

    For nodes that point to few neighbours of many (bands, blocks), so that the set of one node's is small: what
    is left is one edge a node, and distinct links between the neighbours pointed to.
    """
    least = edges.where("u <> v").groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs"))
    ends = F.transform(F.filter("vs", lambda v: v != F.col("m")), lambda v: F.struct(v.alias("u"), F.col("m").alias("v")))
    own = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    return least.select(F.explode(F.concat(own, ends)).alias("e")).select("e.u", "e.v").distinct()


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, comp (the component's least node) for every node of edges (u, v).

    Each round takes the least label among a node and its neighbours, then the label of that label, so
    long chains halve. Every round is a written table: no lineage grows, and nothing comes to the driver
    but whether a label has changed.
    """
    edge_path, path = shared_path(spark, "edges"), shared_path(spark, "labels")
    both = edges.select("u", "v").where("u <> v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(spark, both, "edges", edge_path)
    labels = materialize(spark, both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "labels", path)
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        new = least.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("above", "comp")).alias("comp"))
        new_path = shared_path(spark, "labels")
        written = materialize(spark, new, "labels", new_path)
        changed = not written.where("comp <> old").isEmpty()
        remove(spark, path)
        labels, path = written.select("node", "comp"), new_path
        if not changed:
            remove(spark, edge_path)
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
