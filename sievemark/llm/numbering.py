"""Numbers 0, 1, 2 ... for the rows of each group, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.common import staged


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``rank`` (0-based place in the group by ``order``) and ``total`` (rows of the group); ``group`` isn't null.

    Rows are range-partitioned by group and order, numbered where they lie, and the counts of earlier partitions are
    added: one row for each group and partition it reaches.  A hot group spreads over many partitions, and so do equal
    rows, as their place in the input comes last in the order.  The numbered rows are written once, so that both uses
    see the same partitions.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_tie")
    at = staged(spread.sortWithinPartitions(group, *order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_part", F.shiftright("_at", 33))
    parts = at.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_add"), F.sum("_n").over(whole).alias("total"))
    return at.join(parts, [group, "_part"]).withColumn("rank", F.col("_at") + F.col("_add")).drop("_at", "_part", "_add")
