"""Audit, repair, rules, readers and the benchmark on small tables with planted defects."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemark import audit
from sievemark.operators import scoring
from sievemark.operators.iforest import anomaly_scores
from sievemark.operators.mlbench import benchmark, detect_task
from sievemark.operators.repair import repair
from sievemark.operators.rules import Rule, run_rules, suite_summary, template_rules, violations
from sievemark.plans.context import TableContext
from sievemark.sources.readers import EmptyInput, read_csv, read_rules, read_table
from sievemark.sources.writers import write_report, write_table


def rides(n=640, seed=7) -> pd.DataFrame:
    """Bicycle hires: empty cells, sentinels, fares as text, a flag that gives the target away, one depot, repeats."""
    rng = np.random.default_rng(seed)
    paid = (np.arange(n) % 6 != 5).astype(int)
    km = np.round(rng.gamma(4.0, 2.5, n) + 0.5, 3)
    days = pd.Timestamp("2019-03-01") + pd.to_timedelta(rng.integers(0, 900, n), unit="D")
    frame = pd.DataFrame({
        "ride_id": [f"H{7000 + 3 * i}" for i in range(n)], "age": 20 + (np.arange(n) * 7) % 50,
        "distance_km": km, "distance_mi": np.round(km * 0.621 + rng.normal(0, 0.01, n), 3),
        "battery": rng.integers(300, 420, n), "fare": [f"${v:,.2f}" for v in 900 + 37 * km],
        "wheel": rng.choice(["small", "medium", "large"], n), "day": days.strftime("%Y/%m/%d"),
        "depot": "north", "voided": 1 - paid, "paid": paid,
    })
    frame.loc[np.arange(n) % 7 == 2, "distance_mi"] = np.nan
    frame.loc[np.arange(n) % 11 == 4, "wheel"] = None
    frame.loc[100:119, "battery"] = -999
    frame.loc[200, "age"], frame.loc[201, "age"] = -9, 888
    frame.loc[300, "distance_km"], frame.loc[301, "distance_km"] = 4.0e5, 7.5e5
    return pd.concat([frame, frame.iloc[40:52]], ignore_index=True)


@pytest.fixture(scope="module")
def ride_report(spark):
    frame = spark.createDataFrame(rides())
    return frame, audit(frame, "paid", name="rides")


def test_audit_then_repair(spark, ride_report, tmp_path):
    frame, report = ride_report
    assert 40 <= report.score() <= 85
    assert report.checker_scores.count() == 9 and report.alerts.count() > 3
    ids = {r["issue_id"] for r in report.issues.select("issue_id").collect()}
    assert {"data_leakage_direct_target_leakage_voided", "constant_columns_constant_column_depot",
            "data_types_currency_as_string_fare", "data_types_date_as_string_day",
            "suspicious_values_numeric_sentinel_battery_-999", "suspicious_values_invalid_age_range_age",
            "duplicate_rows_exact_duplicates_found", "duplicate_rows_duplicate_key_ride_id",
            "outliers_outliers_distance_km", "outliers_multivariate_anomalies"} <= ids
    done = repair(frame, target="paid", report=report)
    after = audit(done.frame, "paid")
    assert after.score() > report.score()
    assert done.stats().collect()[0]["rows_removed"] == 12
    assert done.stage_rows().collect()[0]["rows_after"] == 640
    assert any("skipped" in (r["detail"] or "") for r in done.log_table().collect())
    write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "issues")).count() == report.issues.count()
    assert spark.read.json(str(tmp_path / "report" / "profile")).count() == 11
    row = report.diagnosis.collect()[0]
    assert row["target_leakage"] and row["risk_level"] in ("MODERATE", "HIGH")


def test_empty_table(spark):
    report = audit(spark.createDataFrame([], "a int, b string, c double"))
    assert report.score() == 75.0 and report.ctx.count == 0


def test_awkward_column_names(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], ["<b>x.y`z</b>", "safe col"])
    report = audit(frame)
    assert report.profile.count() == 2
    assert "missing_values_high_missing_safe col" in {r[0] for r in report.issues.select("issue_id").collect()}


def test_all_null_target_and_boolean_columns(spark):
    frame = spark.createDataFrame([(None, True, 1.0), (None, False, 2.0), (None, None, 3.0)], "t int, flag boolean, x double")
    report = audit(frame, "t")
    scores = {r["checker_id"]: r["score"] for r in report.checker_scores.collect()}
    assert scores["class_imbalance"] == 50.0
    assert {r["column"]: r["inferred_type"] for r in report.profile.collect()}["flag"] == "boolean / binary"


def test_isolation_forest_ranks_planted_anomalies_first(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(0, 1, (2000, 3))
    data[:20] = rng.normal(0, 1, (20, 3)) + 9
    frame = pd.DataFrame(data, columns=["a", "b", "c"])
    frame["rid"] = [f"r{i}" for i in range(2000)]
    ctx = TableContext(spark.createDataFrame(frame))
    top = anomaly_scores(ctx, ["a", "b", "c"], keep=["rid"]).orderBy(F.desc("anomaly")).limit(20)
    hits = sum(int(r["rid"][1:]) < 20 for r in top.collect())
    assert hits >= 18
    again = anomaly_scores(TableContext(spark.createDataFrame(frame).repartition(5)), ["a", "b", "c"], keep=["rid"])
    best = again.orderBy(F.desc("anomaly")).limit(20).collect()
    assert sum(int(r["rid"][1:]) < 20 for r in best) == hits


def test_currency_text(spark):
    toll = spark.createDataFrame([("£ 3,300",), ("7.25",), ("$1,000,001.5",), ("free",)], "toll string")
    found = [r[0] for r in repair(toll, ["clean_numeric_string:toll"]).frame.collect()]
    assert found == [3300.0, 7.25, 1000001.5, None]


def test_dates_and_keys(spark):
    frame = spark.createDataFrame(
        [("2024-1-5", 1, 1), ("2024/02/03", 1, 2), ("25-12-2023", None, 3), ("bad", None, 4)], "d string, k int, o int")
    dates = [str(r[0])[:10] for r in repair(frame, ["convert_to_datetime:d"]).frame.select("d").collect()]
    assert dates == ["2024-01-05", "2024-02-03", "2023-12-25", "None"]
    kept = repair(frame, ["drop_duplicates_by_key:k"], order_by=["o"]).frame
    assert sorted(r["o"] for r in kept.collect()) == [1, 3]
    with pytest.raises(ValueError):
        repair(frame, ["drop_duplicates_by_key:k"])


def test_first_by_key_limits_before_the_shuffle(spark):
    frame = spark.range(100).withColumn("k", F.col("id") % 2)
    out = repair(frame, ["drop_duplicates_by_key:k"], order_by=["id"]).frame
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_impute_mode_tie_and_empty_column(spark):
    frame = spark.createDataFrame([("b", None, 1), ("a", None, None), (None, None, 4)], "s string, e string, n int")
    rows = repair(frame, ["impute:s", "impute:e", "impute:n"]).frame.collect()
    assert [r["s"] for r in rows] == ["b", "a", "a"]
    assert {r["e"] for r in rows} == {"Missing"} and [r["n"] for r in rows] == [1.0, 2.5, 4.0]


def test_rules(spark):
    frame = spark.createDataFrame(
        [(-3, "A-1", "open"), (4, "B-22", "shut"), (9, "b22", "ajar"), (11, "C-7", "open")], "depth int, code string, lid string")
    results = run_rules(frame, [
        Rule("deep", "range", "depth", min_value=0, max_value=10),
        Rule("code", "regex", "code", regex_pattern=r"^[A-Z]-\d+$"),
        Rule("lid", "allowed_values", "lid", allowed_values=["open", "shut"]),
        Rule("bad", "regex", "code", regex_pattern="(["),
        Rule("once", "unique", "lid"),
    ]).collect()
    assert [r["failed_count"] for r in results] == [2, 1, 1, 4, 2]
    assert "Invalid regular expression" in results[3]["message"]
    assert sorted(r["depth"] for r in violations(frame, Rule("once", "unique", "lid"), ["depth"]).collect()) == [-3, 11]
    assert [r["depth"] for r in violations(frame, Rule("once", "unique", "lid"), ["depth"], keep=1).collect()] == [-3]
    empty = run_rules(frame.limit(0), [Rule("e", "not_null", "depth")])
    assert empty.collect()[0]["pass_rate_pct"] == 100.0
    assert suite_summary(empty).collect()[0]["status"] == "PASSED"
    assert [r.rule_id for r in template_rules("ecommerce", ["unit_price", "rating", "weight"])] == ["ecom_price_positive", "ecom_rating_bounds"]


def test_repeated_nulls_violate_unique(spark):
    frame = spark.createDataFrame([(1, None), (2, None), (3, "a")], "k int, v string")
    rule = Rule("u", "unique", "v")
    assert run_rules(frame, [rule]).collect()[0]["failed_count"] == 2
    assert sorted(r["k"] for r in violations(frame, rule, ["k"]).collect()) == [1, 2]


def test_readers_and_writers(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,name,price,ok\n1,"a, b",1.5,True\n2,N/A,,False\n3," x ",2,True\n')
    frame = read_table(spark, str(path))
    assert dict(frame.dtypes) == {"id": "bigint", "name": "string", "price": "double", "ok": "boolean"}
    assert [r["name"] for r in frame.orderBy("id").collect()] == ["a, b", None, " x "]
    assert read_csv(spark, str(path), schema="id int, price double").dtypes == [("id", "int"), ("price", "double")]
    latin = tmp_path / "latin.txt"
    latin.write_bytes("name\ncaf\xe9\n".encode("latin-1"))
    assert read_csv(spark, str(latin)).collect()[0]["name"] == "café"
    for name in ("out.parquet", "out.csv"):
        write_table(frame, str(tmp_path / name))
        assert sorted(map(tuple, read_table(spark, str(tmp_path / name)).collect()), key=str) == sorted(map(tuple, frame.collect()), key=str)
    (tmp_path / "rules.json").write_text('[{"rule_id": "a", "rule_type": "range", "column": "id", "description": "d", "min_value": 1}]')
    assert read_rules(spark, str(tmp_path / "rules.json")) == [Rule("a", "range", "id", "d", min_value=1.0)]
    (tmp_path / "rows.json").write_text('[{"a": 1}, {"a": 2}]')
    assert read_table(spark, str(tmp_path / "rows.json")).count() == 2
    (tmp_path / "lines.json").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3}\n')
    assert read_table(spark, str(tmp_path / "lines.json")).count() == 3
    (tmp_path / "one.json").write_text('{\n  "a": 1,\n  "b": [1,\n 2]\n}\n')
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "one.json")).collect()] == [(1, [1, 2])]
    (tmp_path / "two.json").write_text('{\n "a": 1\n}\n{\n "a": 2\n}\n')
    assert sorted(r["a"] for r in read_table(spark, str(tmp_path / "two.json")).collect()) == [1, 2]
    (tmp_path / "breaks.csv").write_text('id,note\n1,"two\nlines"\n2,plain\n')
    assert sorted(tuple(r) for r in read_table(spark, str(tmp_path / "breaks.csv")).collect()) == [(1, "two\nlines"), (2, "plain")]
    mixed = tmp_path / "mixed.csv"
    mixed.mkdir()
    (mixed / "a b.csv").write_bytes("name\ncaf\xe9\n".encode("latin-1"))
    (mixed / "b.csv").write_text("name\nthé\n", encoding="utf-8")
    assert sorted(r["name"] for r in read_table(spark, str(mixed)).collect()) == ["café", "thé"]
    (tmp_path / "none.csv").write_text("a,b\n")
    with pytest.raises(EmptyInput):
        read_table(spark, str(tmp_path / "none.csv"))


def test_benchmark_before_and_after(spark):
    raw = spark.createDataFrame(rides(320)).drop("voided", "ride_id", "fare")
    raw = raw.withColumn("paid", (F.col("distance_km") > 9).cast("int"))
    clean = repair(raw, ["drop_exact_duplicates", "impute:distance_mi", "impute:wheel"], "paid").frame
    found = benchmark(raw, clean, "paid", "decision_tree")
    rows = {r["metric"]: r for r in found.table().collect()}
    assert found.task == "classification" and found.binary and rows["accuracy"]["clean"] > 0.9
    assert found.top_features().count() > 0
    assert detect_task(raw, "distance_mi") == ("regression", False)
    assert benchmark(raw, clean, "distance_mi", "ridge").task == "regression"


def test_forest_counts_repeated_rows(spark):
    """300 distinct rows many times over, and 6 far-off rows: the far-off ones score highest."""
    frame = spark.range(60000).select(
        *[F.when(F.col("id") % 10000 == 1, 500.0 + i).otherwise((F.xxhash64(F.col("id") % 300, F.lit(i)) % 50).cast("double")).alias(f"v{i}") for i in range(3)],
        (F.col("id") % 10000 == 1).alias("far"))
    scores = anomaly_scores(TableContext(frame), ["v0", "v1", "v2"], keep=["far"]).toPandas()
    assert scores[scores["far"]]["anomaly"].min() > scores[~scores["far"]]["anomaly"].max()


def test_duplicates_take_one_shuffle(spark):
    from sievemark.operators.repair import drop_exact_duplicates

    frame = spark.range(1000).select((F.col("id") % 7).alias("a"), F.lit("x").alias("b"))
    plan = drop_exact_duplicates(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and plan.count("Range (") <= 1
    assert drop_exact_duplicates(frame).count() == 7
    assert TableContext(frame).repeated_rows() == 993


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from sievemark.plans import local

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        local.shared_folder(Session())


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4), (4, 3, 2, 1, 0), (2, 0, 4, 1, 3), (3, 4, 0, 2, 1), (1, 4, 2, 0, 3)])
def test_overall_score_does_not_depend_on_the_order_of_its_parts(spark, order):
    parts = (16.75, 14.26, 14.66, 11.4, 19.38)
    rows = spark.createDataFrame([(parts[i],) for i in order], "weighted_score double").coalesce(1)
    assert scoring.overall_score(rows).first()["overall_score"] == 76.5


def test_repair_keeps_rows_in_columns_between_passes(spark):
    """the passes after a repair read the columns they need from Parquet, not whole rows from a checkpoint."""
    frame = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (2.0, "b"), (None, "c")], "x double, t string")
    done = repair(frame, ["drop_exact_duplicates", "impute:x"])
    assert done.frame.inputFiles() and all(f.endswith(".parquet") for f in done.frame.inputFiles())
    assert sorted(done.frame.collect()) == [(1.0, "a"), (1.5, "c"), (2.0, "b")]
