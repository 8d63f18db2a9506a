"""Decision trees and forests as tables: their nodes as rows, and rows walked down them by joins."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.local import shared_folder


def node_table(model) -> DataFrame:
    """(tree, node, feature, cut, left, right, prediction, impurity, gain, stats, rows) of a fitted tree or forest.

    ``feature`` is null at leaves; rows with value <= ``cut`` go left.  ``stats`` are the weighted class counts of the
    training rows that reached the node (for regression count, sum and sum of squares), ``rows`` their number.  The
    model's own saved form is read, so no node passes through the driver.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    folder = shared_folder(spark, "model")
    model.write().save(folder)
    data = spark.read.parquet(f"{folder}/data")
    if "treeID" not in data.columns:
        data = data.select(F.lit(0).alias("treeID"), F.struct(*data.columns).alias("nodeData")) if "nodeData" not in data.columns else data.withColumn("treeID", F.lit(0))
    at = lambda name: F.col(f"nodeData.{name}")
    leaf = at("leftChild") < 0
    return data.select(
        F.col("treeID").alias("tree"), at("id").alias("node"), F.when(~leaf, at("split.featureIndex")).alias("feature"),
        F.when(~leaf, F.get(at("split.leftCategoriesOrThreshold"), F.lit(0))).alias("cut"),
        F.when(~leaf, at("leftChild")).alias("left"), F.when(~leaf, at("rightChild")).alias("right"), at("prediction").alias("prediction"),
        at("impurity").alias("impurity"), F.when(~leaf, at("gain")).alias("gain"), at("impurityStats").alias("stats"), at("rawCount").alias("rows"))


def walk(rows: DataFrame, nodes: DataFrame, depth: int, features: str = "features") -> DataFrame:
    """The rows once per tree, with ``tree`` and the ``node`` (a leaf) they reach.

    One join a level, on tree and node.  The node table is bounded by trees * 2 ** (depth + 1), so Spark broadcasts it
    unless it is larger than the broadcast limit.  Rows at a leaf stay.
    """
    trees = nodes.select("tree").distinct()
    here = rows.withColumn("_x", vector_to_array(features)).join(trees).withColumn("node", F.lit(0))
    cuts = nodes.where("feature IS NOT NULL").select("tree", "node", "feature", "cut", "left", "right")
    for _ in range(depth):
        step = F.when(F.get("_x", "feature") <= F.col("cut"), F.col("left")).otherwise(F.col("right"))
        here = here.join(cuts, ["tree", "node"], "left").withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(step)).drop("feature", "cut", "left", "right")
    return here.drop("_x")


def class_shares(walked: DataFrame, nodes: DataFrame, key: str, classes: int) -> DataFrame:
    """(key, probability): the mean over trees of the reached leaf's class shares."""
    leaves = nodes.where("feature IS NULL").select("tree", "node", F.transform("stats", lambda s: s / F.aggregate("stats", F.lit(0.0), lambda a, b: a + b)).alias("share"))
    joined = walked.select(key, "tree", "node").join(leaves, ["tree", "node"])
    return joined.groupBy(key).agg(F.array(*[F.avg(F.get("share", F.lit(c))) for c in range(classes)]).alias("probability"))


def gains(nodes: DataFrame, impurity: str = "gini") -> DataFrame:
    """(tree, node, gain, again): the recorded gain of every split beside the one worked out from its children's class counts."""
    total = F.aggregate("stats", F.lit(0.0), lambda a, b: a + b)
    squares = F.aggregate("stats", F.lit(0.0), lambda a, b: a + b * b)
    if impurity == "gini":
        value = 1 - squares / (total * total)
    else:  # variance, of count, sum and sum of squares
        n, s, q = (F.get("stats", F.lit(i)) for i in range(3))
        value, total = (q - s * s / n) / n, n
    own = nodes.select("tree", "node", total.alias("w"), value.alias("i"))
    splits = nodes.where("feature IS NOT NULL").select("tree", "node", "left", "right", "gain")
    side = lambda name: own.select("tree", F.col("node").alias(name), F.col("w").alias(f"{name}_w"), F.col("i").alias(f"{name}_i"))
    joined = splits.join(own, ["tree", "node"]).join(side("left"), ["tree", "left"]).join(side("right"), ["tree", "right"])
    again = F.col("i") - (F.col("left_w") * F.col("left_i") + F.col("right_w") * F.col("right_i")) / F.col("w")
    return joined.select("tree", "node", "gain", again.alias("again"))
