"""Alphabetical codes 0, 1, 2 ... for the values of a column of any cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .local import durable


def dense_codes(values: DataFrame) -> DataFrame:
    """(value) -> (value, code): a distributed dense rank.

    A global window would sort everything in one task.  Here the distinct values
    are range-partitioned, each partition numbers its own, and the offsets (one
    row per partition) are added.  The partitioned frame is checkpointed because
    both uses must see the same partition ids.
    """
    spread = values.select("value").filter("value IS NOT NULL").distinct().repartitionByRange("value")
    spread = durable(spread.withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("value")
    return (
        spread.withColumn("place", F.row_number().over(within))
        .join(offsets, "part")
        .select("value", (F.col("offset") + F.col("place") - 1).cast("double").alias("code"))
    )
