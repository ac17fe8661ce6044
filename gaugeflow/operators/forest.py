"""A fitted forest as a table of nodes, and scores and importances computed from that table.

This is a second way to the numbers of the model, for checking it: the rows walk down all trees by joins with the nodes. The
table has at most ``trees * 2 ** (depth + 1)`` rows whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gaugeflow.session import scratch_dir

LEAF = -1


def forest_nodes(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``(tree, node, left, right, feature, threshold, gain, rows, shares)``; a leaf has no children and no feature.

    ``shares``: the classes' parts of the training weight at the node, ``rows`` that weight.
    """
    path = scratch_dir(spark, "forest")
    model.stages[-1].write().save(path)
    stored = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    weight = F.aggregate("impurityStats", F.lit(0.0), lambda total, x: total + x)
    return stored.select(
        "tree",
        F.col("id").alias("node"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        "gain",
        weight.alias("rows"),
        F.transform("impurityStats", lambda x: F.try_divide(x, weight)).alias("shares"),
    )


def walk_forest(rows: DataFrame, nodes: DataFrame, keys: Sequence[str], features: Sequence[str], classes: int, trees: int, depth: int) -> DataFrame:
    """``(keys, walked)``: each row's class probabilities, the mean of the shares at the leaves that it reaches.

    One narrow join per level; the node table is broadcast, as its size is that of the model.
    """
    nodes = F.broadcast(nodes.select("tree", "node", "left", "right", "feature", "threshold", "shares"))
    values = F.array(*[F.col(c).cast("double") for c in features])
    each_tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    at = rows.select(*keys, values.alias("_values"), each_tree.alias("tree")).withColumn("node", F.lit(0))
    for _ in range(depth):
        step = at.join(nodes.drop("shares"), ["tree", "node"])
        goes_left = F.get("_values", F.col("feature")) <= F.col("threshold")
        child: Column = F.when(F.col("left") == LEAF, F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        at = step.select(*keys, "_values", "tree", child.alias("node"))
    leaves = at.join(nodes.select("tree", "node", "shares"), ["tree", "node"])
    means = [F.avg(F.get("shares", F.lit(i))) for i in range(classes)]
    return leaves.groupBy(*keys).agg(F.array(*means).alias("walked"))


def node_importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, importance)``: gain times rows of a feature's splits, as shares of each tree, as a share of all."""
    splits = nodes.filter(F.col("left") != LEAF).select("tree", "feature", (F.col("gain") * F.col("rows")).alias("worth"))
    sums = splits.groupBy("tree", "feature").agg(F.sum("worth").alias("worth"))
    totals = splits.groupBy("tree").agg(F.sum("worth").alias("total"))
    shares = sums.join(totals, "tree").groupBy("feature").agg(F.sum(F.try_divide("worth", "total")).alias("share"))
    named = F.get(F.array(*[F.lit(c) for c in features]), F.col("feature"))
    whole = F.sum("share").over(Window.partitionBy(F.lit(1)))  # one row per feature of the model
    return shares.select(named.alias("feature"), F.try_divide(F.col("share"), whole).alias("importance"))
