"""Counting and finding repeated rows.

Counting first groups two 64-bit hashes of each row: a narrow shuffle, combined
map-side, which ends the matter for a table without repeats.  Otherwise whole
rows are grouped, which shuffles no more than dropDuplicates() does; there is no
join, so a row repeated a billion times stays one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import quoted


def comparable(frame: DataFrame, name: str) -> Column:
    """A form of the column that can be grouped on (maps and variants as JSON)."""
    dtype = frame.schema[name].dataType
    column = quoted(name)
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return F.to_json(column)
    return column


def row_hash(columns: Sequence[Column]) -> Column:
    """Hash of values and of the positions of nulls."""
    return F.xxhash64(*[part for c in columns for part in (c, c.isNull())])


def surplus_rows(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row ``surplus``: rows beyond the first of each group of equal rows."""
    keys = [f"k{i}" for i in range(len(names))]
    rows = frame.select(*[comparable(frame, n).alias(k) for n, k in zip(names, keys)])
    hashes = [row_hash([F.col(k) for k in keys]).alias("g"), row_hash([F.lit("second"), *[F.col(k) for k in keys]]).alias("h")]
    repeats = rows.select(*hashes).groupBy("g", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeats.isEmpty():
        return frame.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("surplus"))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("surplus"))
