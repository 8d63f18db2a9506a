"""Exact area under the ROC curve as a distributed rank sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.local import durable


def running_counts(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """(score, pos, neg, below): per distinct score its rows of either class and all negative rows with a lower score.

    Equal scores are combined before the shuffle, distinct ones are range-partitioned, each partition adds up its own and
    the totals of earlier partitions (one row a partition) are added.
    """
    hit = F.col(positive)
    points = scored.where(F.col(score).isNotNull() & hit.isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    points = durable(points.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = points.groupBy("part").agg(F.sum("neg").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    points = points.withColumn("lower", F.coalesce(F.sum("neg").over(within), F.lit(0)))
    return points.join(earlier, "part").select("score", "pos", "neg", (F.col("earlier") + F.col("lower")).alias("below"))


def roc_auc(scored: DataFrame, score: str = "score", positive: str = "positive") -> float:
    """Share of (positive, negative) pairs in which the positive row scores higher; ties count half; 0.5 if a class is missing.

    Rows without a score or class are left out; NaN is the highest score.
    """
    won = F.col("pos") * (F.col("below") + F.col("neg") / 2)
    row = running_counts(scored, score, positive).agg(F.sum(won), F.sum("pos"), F.sum("neg")).first()
    won, pos, neg = row
    return float(won) / (float(pos) * float(neg)) if pos and neg else 0.5
