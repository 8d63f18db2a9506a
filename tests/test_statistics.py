"""Shared plans against brute force: quantiles, correlation, duplicates, KS, ranking."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemark.functions import expr, fixed
from sievemark.operators import drift, missing
from sievemark.plans.context import MANY, TableContext
from sievemark.plans.ks import ks_statistics
from sievemark.plans.pairs import correlate
from sievemark.plans.quantiles import exact_quantiles
from sievemark.plans.ranking import dense_codes
from sievemark.plans.repeats import surplus_rows

NAN = float("nan")


def skewed(seed, n=4000):
    """A third of the rows share one value; the rest spread over a wide range."""
    rng = np.random.default_rng(seed)
    x = rng.lognormal(3, 2, n)
    x[rng.random(n) < 0.34] = 7.25
    return x


@pytest.mark.parametrize("limit", [100_000, 150])
def test_quantiles_equal_numpy(spark, limit):
    x = skewed(1)
    frame = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.round(x)}))
    grid = [0.0, 0.01, 0.25, 0.5, 0.75, 0.97, 1.0]
    found = exact_quantiles(frame, {"x": F.col("x"), "y": F.col("y")}, grid, limit=limit)
    assert np.allclose(found["x"], np.quantile(x, grid), rtol=1e-12)
    assert np.allclose(found["y"], np.quantile(np.round(x), grid), rtol=1e-12)


def test_quantiles_of_nothing_and_of_one_value(spark):
    frame = spark.createDataFrame([(None, 3.0), (None, 3.0)], "a double, b double")
    found = exact_quantiles(frame, {"a": F.col("a"), "b": F.col("b")}, [0.5], limit=1)
    assert found == {"a": [None], "b": [3.0]}


@pytest.mark.parametrize("limit,cuts", [(10_000_000, 63), (300, 7)])
def test_ks_equals_brute_force(spark, limit, cuts):
    a, b = skewed(2, 2500), skewed(3, 1500) * 1.2
    rows = [(0, float(v)) for v in a] + [(1, float(v)) for v in b]
    frame = spark.createDataFrame(rows, "side int, v double")
    everything = np.concatenate([a, b])
    wanted = max(abs((a <= v).mean() - (b <= v).mean()) for v in everything)
    found = ks_statistics(frame, F.col("side"), {"v": F.col("v")}, {"v": (len(a), len(b))}, limit=limit, cuts=cuts)
    assert found["v"] == pytest.approx(wanted, abs=1e-12)


def test_correlation_with_nulls_constants_and_far_subsets(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    frame = pd.DataFrame({"x": x, "y": x * 2 + rng.normal(size=300), "c": 4.0, "far": x * 1e-3})
    frame.loc[::3, "y"] = np.nan
    frame.loc[frame.y.isna(), "far"] = 1e9  # the common rows of (y, far) lie far from far's mean
    ctx = TableContext(spark.createDataFrame(frame))
    found = correlate(ctx, ["x", "y", "c", "far"])
    wanted = frame.corr()
    for (a, b), r in found.items():
        expected = 0.0 if np.isnan(wanted.loc[a, b]) else wanted.loc[a, b]
        assert r == pytest.approx(expected, abs=1e-6), (a, b)


def test_surplus_rows_counts_nulls_as_equal(spark):
    rows = [(1, None), (1, None), (None, 1), (2, "x"), (2, "x"), (2, "x"), (3, "y")]
    frame = spark.createDataFrame([(a, str(b) if b else None) for a, b in rows], "a int, b string")
    assert surplus_rows(frame, ["a", "b"]).collect()[0][0] == 3
    nested = frame.withColumn("m", F.create_map(F.lit("k"), F.col("a")))
    assert surplus_rows(nested, ["a", "b", "m"]).collect()[0][0] == 3


def test_dense_codes(spark):
    values = spark.createDataFrame([(w,) for w in "pear fig apple fig kiwi".split()] + [(None,)], "value string")
    found = {r["value"]: r["code"] for r in dense_codes(values.repartition(3)).collect()}
    assert found == {"apple": 0.0, "fig": 1.0, "kiwi": 2.0, "pear": 3.0}


def test_nan_counts_as_missing_and_blanks_are_exact(spark):
    frame = spark.createDataFrame(
        [(1.0, " "), (NAN, ""), (None, None), (4.0, "a ")], "x double, s string")
    found = {r["column"]: r for r in missing.missing_breakdown(TableContext(frame)).collect()}
    assert (found["x"]["nulls"], found["x"]["missing_pct"]) == (2, 50.0)
    assert (found["s"]["nulls"], found["s"]["blanks"], found["s"]["missing"]) == (1, 2, 3)


def test_large_domains_are_not_counted_exactly(spark):
    ctx = TableContext(spark.range(5000).withColumn("few", F.col("id") % 3))
    ctx.small_domain(ctx.names)
    assert ctx.stats["id"]["ndv"] == MANY and ctx.stats["few"]["ndv"] == 3


def test_top_values_prune_before_the_shuffle(spark):
    from sievemark.plans.context import top_values

    ctx = TableContext(spark.range(100).select((F.col("id") % 9).alias("a"), (F.col("id") % 4).alias("b")))
    plan = top_values(ctx.frequencies(["a", "b"]), "position", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_counts_and_top_values_share_one_shuffle(spark, sf_dir):
    ctx = TableContext(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_orderpriority"))
    frame = ctx._value_counts(ctx.names, tops=True)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == 1


@pytest.mark.parametrize("parts", [1, 17])
def test_results_do_not_depend_on_partitioning(spark, sf_dir, parts):
    from sievemark.operators.outliers import outlier_stats

    frame = spark.read.parquet(f"{sf_dir}/events.parquet")
    plain = outlier_stats(TableContext(frame)).collect()
    moved = outlier_stats(TableContext(frame.repartition(parts))).collect()
    keep = ("column", "q25", "median", "q75", "mad", "outliers", "extremes", "z_outliers")
    assert [[r[k] for k in keep] for r in plain] == [[r[k] for k in keep] for r in moved]


def test_drift_of_a_shifted_column_and_a_new_word(spark):
    rng = np.random.default_rng(17)
    old = pd.DataFrame({"pulse": rng.gamma(9.0, 8.0, 260), "steps": rng.uniform(0, 9000, 260), "shoe": rng.choice(["trail", "road", "track", "road"], 260)})
    new = pd.DataFrame({"pulse": rng.gamma(16.0, 8.0, 310), "steps": rng.uniform(0, 9100, 310), "shoe": rng.choice(["trail", "road", "sandal"], 310)})
    found = drift.compare(spark.createDataFrame(old), spark.createDataFrame(new))
    rows = {r["column"]: r for r in found.columns_report.collect()}
    assert len(rows) == 3 and rows["pulse"]["status"] == "CRITICAL_DRIFT" and rows["shoe"]["novel"] == ["sandal"]
    edges = np.concatenate([[-np.inf], np.quantile(old.pulse, np.arange(1, 10) / 10), [np.inf]])
    shares = [np.maximum(np.histogram(v, edges)[0] / len(v), 0) for v in (old.pulse, new.pulse)]
    shares = [np.where(x == 0, 1e-4, x) for x in shares]
    e, a = (x / x.sum() for x in shares)
    assert rows["pulse"]["psi"] == pytest.approx(np.sum((a - e) * np.log(a / e)), abs=1e-4)
    assert found.alerts.count() >= 2
    same = drift.compare(spark.createDataFrame(old), spark.createDataFrame(old))
    assert same.report.collect()[0]["overall_status"] == "STABLE" and same.alerts.count() == 1


def test_int_and_float_categories_compare_by_value(spark):
    ints = spark.createDataFrame([(1,), (2,), (2,)], "v int")
    floats = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "v double")
    row = drift.compare(ints, floats).columns_report.collect()[0]
    assert (row["column_type"], row["tvd"], row["novel_count"]) == ("categorical", 0.0, 0)


def test_no_shared_column_is_an_error(spark):
    with pytest.raises(ValueError):
        drift.compare(spark.range(1), spark.range(1).toDF("other"))


def test_many_columns_are_correlated_in_one_scan(spark, monkeypatch):
    from sievemark.plans import pairs

    rng = np.random.default_rng(31)
    data = rng.normal(size=(400, 25)) + rng.normal(size=(400, 1))
    data[rng.random(data.shape) < 0.1] = np.nan
    frame = pd.DataFrame(data, columns=[f"m{i}" for i in range(25)])
    frame["m3"], frame["m7"] = 2.0, frame["m8"] * -3 + 1e6
    ctx = TableContext(spark.createDataFrame(frame))
    tiled = []
    plain = pairs.correlations
    monkeypatch.setattr(pairs, "correlations", lambda rows, todo: tiled.extend(todo) or plain(rows, todo))
    found = pairs.correlate(ctx, list(frame.columns))
    want = frame.corr().fillna(0)
    assert all(abs(r - want.loc[a, b]) < 1e-9 for (a, b), r in found.items()) and len(found) == 300
    assert not tiled  # nothing was left to the tiles


def test_values_are_placed_between_any_number_of_cuts(spark):
    """One value a column and row, whatever the cuts: a CASE per cell multiplied rows by cells and outgrew a method."""
    import bisect
    import random

    from sievemark.plans.ks import _long, _placed

    rng = random.Random(4)
    marks = sorted({rng.choice([rng.gauss(0, 9), float(rng.randint(-50, 50))]) for _ in range(5000)})
    values = [*marks[::7], *[rng.gauss(0, 12) for _ in range(700)], float("inf"), float("-inf"), -0.0, None]
    frame = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "x double, side int").withColumn("y", F.col("x"))
    for known in (marks, marks[:1], marks[:64], []):
        for r in _placed(frame, {"x": known}).select("x", "x_at").collect():
            left = None if r["x"] is None else bisect.bisect_left(known, r["x"])
            assert r["x_at"] == (None if left is None else 2 * left + (left < len(known) and known[left] == r["x"]))
    assert _long(frame, {"x": marks, "y": marks[:3]}, True).count() == 2 * (len(values) - 1)
    rows = [(0, rng.choice([1.0, rng.gauss(0, 1)]), rng.gauss(0, 1)) for _ in range(900)] + [(1, rng.choice([1.0, rng.gauss(0.1, 1)]), rng.gauss(0, 1.4)) for _ in range(700)]
    both = spark.createDataFrame(rows, "side int, a double, b double")
    found = ks_statistics(both, F.col("side"), {"a": F.col("a"), "b": F.col("b")}, {"a": (900, 700), "b": (900, 700)}, limit=5, cuts=7)
    for k, name in ((1, "a"), (2, "b")):
        sides = [sorted(r[k] for r in rows if r[0] == s) for s in (0, 1)]
        gaps = [abs(bisect.bisect_right(sides[0], v) / 900 - bisect.bisect_right(sides[1], v) / 700) for v in {r[k] for r in rows}]
        assert abs(found[name] - max(gaps)) < 1e-12


def test_scans_keep_sketches_and_sets_apart(spark, monkeypatch):
    """one sketch or set beside a hundred other measures took all of them out of generated code."""
    columns = [f"string(id % {i + 2}) AS t{i}" for i in range(6)] + [f"double(id % {i + 3}) AS x{i}" for i in range(6)]
    frame = spark.range(200).selectExpr(*columns)
    plans, collect = [], type(frame).collect
    monkeypatch.setattr(type(frame), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    ctx = TableContext(frame).scan("nulls", "domain", "moments", "whole", "shapes", "sentinels")
    measured = [plan for plan in plans if "approx_count_distinct" not in plan]
    assert len(measured) == 2 and all(" HashAggregate" in p and "ObjectHashAggregate" not in p for p in measured)
    assert not any("approx_count_distinct" in p and "stddev" in p for p in plans)
    assert ctx.count == 200 and ctx.stats["t3"]["numbers"] == 200 and ctx.stats["x2"]["max"] == 4.0
    assert ctx.stats["x0"]["mean"] == np.mean(np.arange(200) % 3)


ODD_TEXTS = [
    None, "", " ", "\x85", " a ", "a ", " a", "é", "é ", "~", "\x7f", "1", "+1", "-.5", ".5e3", "1.", "/1", ":", "2024-1-2", "1/2/2024",
    " 2024/01/02 ", "$1,234.5", "€ 5", "₹5%", "¥-12", "-12", "12%", "N/A", " NaN ", "UNDEFINED", "undefinedx", "İ", "-", "??", "xxx\n", "\t7\n", "१",
]


def test_guards_change_no_text_verdict(spark):
    """cheap first looks at text must agree with the searches that they save."""
    rows = spark.createDataFrame([(t,) for t in ODD_TEXTS], "t string")
    plain = F.btrim("t", F.lit(fixed.WHITESPACE))
    s = expr.strip(F.col("t"))
    pairs = [
        (s, plain), (expr.looks_number(s), plain.rlike(fixed.NUMBER_PATTERN)), (expr.looks_date(s), plain.rlike(fixed.DATE_PATTERN)),
        (expr.looks_currency(s), plain.rlike(fixed.CURRENCY_PATTERN)), (expr.is_sentinel_word(s), F.lower(plain).isin(*fixed.TEXT_SENTINELS)),
    ]
    for mine, theirs in pairs:
        assert rows.where(~mine.eqNullSafe(theirs)).collect() == []


def test_separators_change_no_date(spark):
    """a layout is only tried on text that holds its separator."""
    texts = [*ODD_TEXTS, "31/1/2024", "1-31-2024", "2024-13-1", "2024/1-2", "20240102", "2024-01-02 03:04:05", "2024-1"]
    layouts = fixed.DATE_LAYOUTS + fixed.MONTH_FIRST_LAYOUTS + fixed.DAY_FIRST_LAYOUTS
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    mine = expr.as_timestamp(F.col("t"), rows.schema["t"].dataType, layouts)
    assert "contains" in str(mine)
    s = F.btrim("t", F.lit(fixed.WHITESPACE))
    full = F.when(~s.rlike(fixed.DATE_PATTERN) & s.rlike(r"^\d{4}-\d"), s.try_cast("timestamp"))
    plain = F.coalesce(*[F.try_to_timestamp(s, F.lit(layout)) for layout in layouts], full)
    assert rows.where(~mine.eqNullSafe(plain)).collect() == []
