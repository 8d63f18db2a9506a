"""Scores, grades, alerts, recommendations and gates.

Inputs are the issue table and one row per checker, both bounded by column
count, so the unpartitioned windows below run over small local relations.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import grade_of
from ..plans.local import local_frame
from .issues import Check

ALERT_KEYS = (
    "missing_values", "duplicate_rows", "class_imbalance", "data_leakage", "outliers",
    "suspicious_values", "high_correlation", "data_types", "constant_columns",
)


def checker_table(checks: Sequence[Check]) -> DataFrame:
    rows = [
        {"checker_no": i, "checker_id": c.checker_id, "dimension": c.dimension, "cap": float(c.cap),
         "base_penalty": float(c.base_penalty), "metrics": {k: str(v) for k, v in c.metrics.items()}}
        for i, c in enumerate(checks)
    ]
    return local_frame(
        checks[0].issues.sparkSession, rows,
        "checker_no int, checker_id string, dimension string, cap double, base_penalty double, "
        "metrics map<string,string>",
    )


def checker_scores(checkers: DataFrame, issues: DataFrame) -> DataFrame:
    """Score = 100 - base - min(cap, sum of issue penalties), clamped, one decimal."""
    totals = issues.groupBy("checker_id").agg(
        F.count(F.lit(1)).alias("n_issues"), F.sum("penalty").alias("penalty"),
        F.bool_or("fails").alias("failed"),
    )
    lost = F.least(F.coalesce("penalty", F.lit(0.0)), F.col("cap")) + F.col("base_penalty")
    return checkers.join(totals, "checker_id", "left").select(
        "checker_no", "checker_id", "dimension", (~F.coalesce("failed", F.lit(False))).alias("passed"),
        F.round(F.greatest(F.lit(0.0), F.lit(100.0) - lost), 1).alias("score"),
        F.coalesce("n_issues", F.lit(0)).cast("bigint").alias("n_issues"), "metrics",
    )


def dimension_scores(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """Mean checker score per dimension, its weight, grade and issues by severity."""
    spark = scores.sparkSession
    rows = [{"dimension_no": i, "dimension": d, "weight": w} for i, (d, (w, _)) in enumerate(fixed.DIMENSIONS.items())]
    weights = local_frame(spark, rows, "dimension_no int, dimension string, weight double")
    means = scores.groupBy("dimension").agg(F.avg("score").alias("mean"))
    by_severity = issues.groupBy("dimension").pivot("severity", list(fixed.SEVERITIES)).count()
    score = F.round(F.coalesce("mean", F.lit(100.0)), 1)
    counts = [F.coalesce(s, F.lit(0)).alias(s.lower()) for s in fixed.SEVERITIES]
    return (
        weights.join(means, "dimension", "left").join(by_severity, "dimension", "left")
        .select("dimension_no", "dimension", score.alias("score"), "weight",
                F.round(score * F.col("weight"), 2).alias("weighted_score"), *counts)
        .withColumn("grade", grade_of(F.col("score")))
    )


def overall_score(dimensions: DataFrame) -> DataFrame:
    """One row: weighted total (0-100, one decimal, half up) and grade.

    The parts have two decimals and are added as such: doubles would give 76.45 or 76.44999... by the order they arrive in.
    """
    exact = F.sum(F.col("weighted_score").cast("decimal(9,2)"))
    total = F.round(F.greatest(F.lit(0), F.least(F.lit(100), exact)), 1).cast("double")
    return dimensions.agg(total.alias("overall_score")).withColumn("grade", grade_of(F.col("overall_score")))


def severity_counts(issues: DataFrame) -> DataFrame:
    """Issues per severity, all five severities present."""
    rows = [{"rank": i, "severity": s} for i, s in enumerate(fixed.SEVERITIES)]
    every = local_frame(issues.sparkSession, rows, "rank int, severity string")
    counted = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("cnt"))
    return every.join(counted, "severity", "left").select(
        "rank", "severity", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")
    )


def severity_rank(severity):
    return F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), severity)


def recommendations(issues: DataFrame, checkers: DataFrame) -> DataFrame:
    """Issues in order of severity (then checker, then finding), numbered; INFO dropped."""
    order = Window.orderBy(severity_rank(F.col("severity")), "checker_no", "seq", "issue_id")
    numbered = issues.join(checkers.select("checker_id", "checker_no"), "checker_id").withColumn(
        "step", F.row_number().over(order)
    )
    return numbered.filter("severity <> 'INFO'").select(
        "step", "issue_id", "title", "dimension", "severity", "affected_columns",
        F.col("remediation").alias("action"), "auto_fixable", "fix_action",
    )


def alerts(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """Headline findings in fixed order: alert_no, code, amount, message."""
    first = F.get("affected_columns", F.lit(0))
    fix = F.coalesce("fix_action", F.lit(""))
    facts = issues.groupBy("checker_id").agg(
        F.max(F.col("severity").isin("CRITICAL", "HIGH")).alias("severe"),
        F.count_if(F.col("penalty") >= 45).alias("leaks"),
        F.array_join(F.slice(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("penalty") >= 45, F.struct("seq", first.alias("c"))))),
            lambda e: e["c"]), 1, 2), ", ").alias("leak_names"),
        F.count_if(F.col("details")["extreme_count"].try_cast("bigint") > 0).alias("extremes"),
        F.count_distinct(first).alias("touched"),
        F.count_if(F.startswith(fix, F.lit("clean_numeric_string:")) | F.startswith(fix, F.lit("convert_to_datetime:")))
        .alias("mistyped"),
        F.count_if(F.col("details")["state"].isin("constant", "all_null")).alias("constants"),
        F.count(F.lit(1)).alias("found"),
    )
    rows = scores.join(facts, "checker_id", "left")
    metric = F.col("metrics")
    is_ = lambda c: F.col("checker_id") == c
    missing_pct = metric["overall_missing_percentage"].try_cast("double")
    repeats = metric["exact_duplicates_count"].try_cast("bigint")
    cases = [
        ("missing_values", missing_pct > 0, missing_pct,
         F.format_string("%s%% of all cells are empty; %s columns have gaps", missing_pct, metric["columns_with_missing"])),
        ("duplicate_rows", repeats > 0, repeats.cast("double"),
         F.format_string("%s rows repeat earlier ones exactly (%s%%)", repeats, metric["exact_duplicates_percentage"])),
        ("class_imbalance", F.col("severe"), metric["minority_pct"].try_cast("double"),
         F.format_string("The classes differ in size by %s, the smallest holds %s%% of the rows", metric["imbalance_ratio"], metric["minority_pct"])),
        ("data_leakage", F.col("leaks") > 0, F.col("leaks").cast("double"),
         F.format_string("The target can be read off %s", F.col("leak_names"))),
        ("outliers", F.col("extremes") > 0, F.col("extremes").cast("double"),
         F.format_string("%s columns hold values far from all others", F.col("extremes"))),
        ("suspicious_values", F.col("touched") > 0, F.col("touched").cast("double"),
         F.format_string("%s columns hold sentinels or impossible values", F.col("touched"))),
        ("high_correlation", F.col("found") > 0, F.col("found").cast("double"),
         F.format_string("%s pairs of columns say nearly the same", F.col("found"))),
        ("data_types", F.col("mistyped") > 0, F.col("mistyped").cast("double"),
         F.format_string("%s columns store amounts or dates as text", F.col("mistyped"))),
        ("constant_columns", F.col("constants") > 0, F.col("constants").cast("double"),
         F.format_string("%s constant columns", F.col("constants"))),
    ]

    def choose(pick):
        return reduce(lambda acc, case: acc.when(is_(case[0]) & case[1], pick(case)), cases[1:],
                      F.when(is_(cases[0][0]) & cases[0][1], pick(cases[0])))

    order = F.array_position(F.array(*[F.lit(k) for k in ALERT_KEYS]), F.col("checker_id"))
    raised = rows.select(
        order.cast("int").alias("alert_no"), F.col("checker_id").alias("code"),
        choose(lambda c: c[2]).alias("amount"), choose(lambda c: c[3]).alias("message"),
    ).filter("message IS NOT NULL")
    clear = raised.agg(F.count(F.lit(1)).alias("k")).filter("k = 0").select(
        F.lit(0).alias("alert_no"), F.lit("clear").alias("code"), F.lit(0.0).alias("amount"),
        F.lit("No check raised an alert").alias("message"),
    )
    return raised.unionByName(clear)


def compare_dimensions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per dimension: score before, after, and the difference."""
    left = before.select("dimension_no", "dimension", F.col("score").alias("score_before"))
    right = after.select("dimension", F.col("score").alias("score_after"))
    return left.join(right, "dimension").withColumn("delta", F.round(F.col("score_after") - F.col("score_before"), 1))


def gate(spark, name: str, passed: bool, value: float | None, threshold: float | None) -> DataFrame:
    return local_frame(
        spark, [{"gate": name, "passed": passed, "value": value, "threshold": threshold}],
        "gate string, passed boolean, value double, threshold double",
    )


def score_gate(overall: DataFrame, threshold: float) -> DataFrame:
    """Passes when the overall score reaches the threshold."""
    value = F.col("overall_score")
    return overall.select(F.lit("min_score").alias("gate"), (value >= threshold).alias("passed"),
                          value.alias("value"), F.lit(float(threshold)).alias("threshold"))


def leakage_gate(alert_rows: DataFrame) -> DataFrame:
    """Passes when no leakage alert was raised."""
    hits = F.count_if(F.col("code") == "data_leakage")
    return alert_rows.agg(hits.cast("double").alias("value")).select(
        F.lit("no_leakage").alias("gate"), (F.col("value") == 0).alias("passed"), "value",
        F.lit(0.0).alias("threshold"))


def psi_gate(drift_columns: DataFrame, threshold: float) -> DataFrame:
    """Passes when no column's PSI exceeds the threshold."""
    worst = F.coalesce(F.max("psi"), F.lit(0.0))
    return drift_columns.agg(worst.alias("value")).select(
        F.lit("max_psi").alias("gate"), (F.col("value") <= threshold).alias("passed"), "value",
        F.lit(float(threshold)).alias("threshold"))


def pass_rate_gate(suite: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Passes when the share of passed rules reaches the threshold."""
    value = F.col("overall_pass_rate")
    return suite.select(F.lit("min_pass_rate").alias("gate"), (value >= threshold).alias("passed"),
                        value.alias("value"), F.lit(float(threshold)).alias("threshold"))


def diagnosis(overall: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """One row: risk tier and score, and which kinds of harm the alerts point to."""
    flags = alert_rows.agg(*[
        F.max(F.col("code") == code).alias(flag) for code, flag in (
            ("data_leakage", "target_leakage"), ("class_imbalance", "class_imbalance"),
            ("missing_values", "missing_data"), ("suspicious_values", "sentinel_codes"),
            ("duplicate_rows", "duplicate_records"))
    ])
    score, leak = F.col("overall_score"), F.col("target_leakage")
    tier = (
        F.when((score >= 85) & ~leak, "LOW").when(score >= 70, "MODERATE")
        .when((score >= 50) | leak, "HIGH").otherwise("CRITICAL")
    )
    risk = (
        F.when(F.col("risk_level") == "LOW", 15).when(F.col("risk_level") == "MODERATE", 45)
        .when(F.col("risk_level") == "HIGH", 75).otherwise(95)
    )
    return overall.crossJoin(F.broadcast(flags)).withColumn("risk_level", tier).withColumn("risk_score", risk)


def root_causes(scores: DataFrame, k: int = 5) -> DataFrame:
    """The first k checkers (in run order) that failed or score under 95."""
    weak = scores.filter(~F.col("passed") | (F.col("score") < 95))
    return weak.orderBy("checker_no").limit(k).select("checker_no", "checker_id", "passed", "score", "n_issues")


def first_actions(actions: DataFrame, k: int = 4) -> DataFrame:
    return actions.orderBy("step").limit(k)


