"""Frequent values from sketches and one count of candidates, against a plain count."""

from collections import Counter

from pyspark.sql import functions as F

from sievemark.operators.profile import frequent_values
from sievemark.plans.context import TableContext, most_frequent
from sievemark.plans.heavy import heavy_values

ROWS = 60_000


def made(spark):
    n = F.col("id")
    return spark.range(ROWS).select(
        F.when(n % 10 < 3, "hot").when(n % 10 == 3, F.concat(F.lit("w"), n % 40)).when(n % 10 > 3, F.concat(F.lit("u"), n)).alias("skewed"),
        F.when(n % 3 == 0, F.lit(None)).otherwise(n % 7).alias("few"), n.cast("string").alias("unique"),
        F.lit(None).cast("string").alias("none"), F.when(n % 2 == 0, "").otherwise("x" * 3000).alias("long"), (n % 20_000).cast("string").alias("threes"))


def plain(values, k):
    return sorted(Counter(str(v) for v in values if v is not None).items(), key=lambda p: (-p[1], p[0]))[:k]


def test_heavy_values_equal_a_full_count(spark):
    frame = made(spark)
    found = heavy_values(frame, {c: F.col(c) for c in frame.columns}, 3)
    rows = frame.collect()
    # nothing can be proven of values that are all rare; those are left to the full count
    assert set(found) == {"skewed", "few", "none", "long"}
    assert found["none"] == []
    assert found == {c: plain([r[c] for r in rows], 3) for c in found}


def test_ties_at_the_last_place_are_settled_by_value(spark):
    frame = spark.range(1000).select((F.col("id") % 500).alias("v"))
    found = heavy_values(frame, {"v": F.col("v")}, 2, candidates=100)
    assert found == {}  # 100 candidates of 500 equally frequent values prove nothing
    assert heavy_values(frame, {"v": F.col("v")}, 2, candidates=500)["v"] == [("0", 2), ("1", 2)]


def test_no_rows_and_no_columns(spark):
    frame = made(spark).where("false")
    assert heavy_values(frame, {"few": F.col("few")}, 3) == {"few": []} and heavy_values(frame, {}, 3) == {}


def test_callers_fall_back_to_full_counts(spark):
    frame = made(spark)
    rows = frame.collect()
    assert most_frequent(TableContext(frame), ["skewed", "unique", "none", "threes"]) == {"skewed": "hot", "unique": "0", "threes": "0"}
    names = ("skewed", "unique", "long", "threes")
    shown = frequent_values(TableContext(frame.select(*names)), 3, ("string",)).collect()
    for c in names:
        assert [(r["value"], r["cnt"]) for r in sorted(shown, key=lambda r: r["place"]) if r["column"] == c] == plain([r[c] for r in rows], 3)


def test_a_hot_value_is_proven_among_very_many(spark):
    """A value of 30 % of the rows beside 36,000 rare ones stands out of four candidates already."""
    skewed = made(spark).select("skewed")
    found = heavy_values(skewed, {"skewed": F.col("skewed")}, 1, candidates=4)
    assert found == {"skewed": [("hot", ROWS * 3 // 10)]}
