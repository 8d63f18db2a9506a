"""Distinct counts that merge: stored sketches in place of another pass over old data.

Exact counts stay the default everywhere.  Where a table grows by days or files and an error of about
1.04 / sqrt(2 ** bits) will do, one sketch per column and part is kept; parts merge without their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import fold_missing, kind_of, quoted

BITS = 14


def distinct_sketches(frame: DataFrame, names: Sequence[str] | None = None, part: Column | None = None, bits: int = BITS) -> DataFrame:
    """(part, column, non_null, sketch): one HyperLogLog sketch per column and part; nulls and NaN count for nothing.

    ``part`` is a text such as a day; without it all rows are one part.  Map tasks hand on one sketch per part and
    column, not values.  Columns of nested types are left out.
    """
    names = [c for c in (names or frame.columns) if kind_of(frame.schema[c].dataType) != "other"]
    cells = [F.struct(F.lit(c).alias("column"), fold_missing(quoted(c), frame.schema[c].dataType).cast("string").alias("value")) for c in names]
    parts = (F.lit("all") if part is None else part).cast("string").alias("part")
    if not cells:
        return frame.select(parts).select("part", F.lit("").alias("column"), F.lit(0).cast("bigint").alias("non_null"), F.lit(None).cast("binary").alias("sketch")).limit(0)
    long = frame.select(parts, F.explode(F.array(*cells)).alias("c")).select("part", "c.*")
    return long.groupBy("part", "column").agg(F.count("value").alias("non_null"), F.hll_sketch_agg("value", bits).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Sketches of several parts, or of several stored tables of parts, as one; the same as a sketch of all their rows."""
    return sketches.groupBy(*by).agg(F.sum("non_null").alias("non_null"), F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    """Distinct counts told by sketches, in place of the sketches."""
    return sketches.withColumn("distinct", F.hll_sketch_estimate("sketch")).drop("sketch")


def largest_error(bits: int = BITS, deviations: float = 4.0) -> float:
    """The relative error that an estimate stays below except with the chance of so many standard deviations."""
    return deviations * 1.04 / (1 << bits) ** 0.5
