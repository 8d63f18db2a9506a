"""Input tables and the defective table derived from ``orders``.

The given tables hold no nulls, repeats or sentinels, so most operators are
exercised on a view of the whole ``orders`` table with planted defects.  The
view's text is valid in Spark and, with two words exchanged, in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = "target"

_DIRTY = """
SELECT o_orderkey AS k,
  CASE WHEN o_orderkey % 97 = 0 THEN -999 WHEN o_orderkey % 101 = 0 THEN -o_totalprice
       WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 499 = 0 THEN o_totalprice * 50
       ELSE o_totalprice END AS total_price,
  CASE WHEN o_orderkey % 53 = 0 THEN 'N/A' WHEN o_orderkey % 59 = 0 THEN ' ? ' WHEN o_orderkey % 61 = 0 THEN ''
       ELSE o_orderstatus END AS status,
  concat('$', cast(cast(floor(o_totalprice) AS bigint) {div} 1000 AS {str}), ',',
         lpad(cast(cast(floor(o_totalprice) AS bigint) % 1000 AS {str}), 3, '0')) AS amount_txt,
  concat(cast(year(o_orderdate) AS {str}), '/', lpad(cast(month(o_orderdate) AS {str}), 2, '0'), '/',
         lpad(cast(day(o_orderdate) AS {str}), 2, '0')) AS date_txt,
  CASE WHEN (o_orderstatus = 'F') <> (o_orderkey % 997 = 0) THEN 1 ELSE 0 END AS leak_flag,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
  'X' AS const_col,
  CASE WHEN o_orderkey % 250 = 0 THEN 'Y' ELSE 'X' END AS quasi,
  CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS sparse_col,
  o_totalprice AS base_price, o_totalprice + o_orderkey % 5 AS principal,
  CASE WHEN o_orderkey % 25 = 0 THEN 1 ELSE 0 END AS rare_target
FROM {orders}
"""


def dirty_sql(div: str, text: str, orders: str = "orders") -> str:
    """The view's rows, those with k divisible by 80 twice (exact duplicates)."""
    once = _DIRTY.format(div=div, str=text, orders=orders)
    return f"SELECT * FROM ({once}) b1 UNION ALL SELECT * FROM ({once}) b2 WHERE k % 80 = 0"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(dirty_sql("div", "string", "{orders}"), orders=table(spark, folder, "orders"))


def drift_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and from 1998-06-01; the later side costs 30% more and renames a priority."""
    orders = table(spark, folder, "orders").withColumn("n_items", (F.col("o_orderkey") % 4).cast("int"))
    split = F.lit("1998-06-01").cast("timestamp")
    later = orders.filter(F.col("o_orderdate") >= split).withColumn(
        "o_totalprice", F.col("o_totalprice") * 1.3
    ).withColumn(
        "o_orderpriority",
        F.when(F.col("o_orderpriority") == "1-URGENT", "0-NOW").otherwise(F.col("o_orderpriority")),
    )
    return orders.filter(F.col("o_orderdate") < split).drop("o_orderdate"), later.drop("o_orderdate")
