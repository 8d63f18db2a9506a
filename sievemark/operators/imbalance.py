"""ML readiness: how evenly the target's classes are represented."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import percent
from ..plans.context import MANY, TableContext
from ..plans.local import local_frame, settle
from .issues import Check, make_issues, no_issues

CHECKER = "class_imbalance"
MAX_CLASSES = 25


def balance_target(ctx: TableContext) -> str | None:
    """The given target, else a column named like one with 2-10 values, else the last binary column."""
    if ctx.target:
        return ctx.target
    named = [n for n in ctx.names if n.lower().endswith(fixed.BALANCE_TARGET_ENDINGS)]
    ctx.small_domain(named)
    for n in named:
        if 2 <= ctx.stats[n].get("ndv", 0) <= 10:
            return n
    ctx.small_domain(ctx.names)
    binary = [n for n in ctx.names if ctx.stats[n].get("ndv", 0) == 2]
    return binary[-1] if binary else None


def class_distribution(ctx: TableContext, target: str) -> DataFrame:
    """(label, cnt, pct) of the target's non-null values."""
    counted = ctx.frequencies([target]).select(F.col("value").alias("label"), "cnt")
    ctx.scan("nulls", names=[target])
    return counted.withColumn("pct", percent(F.col("cnt"), F.lit(ctx.stats[target]["non_null"])))


def class_balance(distribution: DataFrame) -> DataFrame:
    """One row: majority, minority, ratio, shares, entropy, verdict and score."""
    order = F.struct(-F.col("cnt"), F.col("label"))
    total = distribution.agg(F.sum("cnt").alias("total"))
    share = F.round(F.col("cnt") / F.col("total"), 4)
    best, worst = F.col("majority_count"), F.col("minority_count")
    facts = (
        distribution.crossJoin(F.broadcast(total))  # one row beside at most 25 classes
        .groupBy("total")
        .agg(
            F.count(F.lit(1)).alias("classes"),
            F.min_by("label", order).alias("majority_class"),
            F.max_by("label", order).alias("minority_class"),
            F.max("cnt").alias("majority_count"),
            F.min("cnt").alias("minority_count"),
            (-F.sum(share * F.log2(share + 1e-12))).alias("raw_entropy"),
        )
    )
    ratio, low = F.col("imbalance_ratio"), F.col("minority_pct")
    widest = F.when(F.col("classes") > 1, F.log2(F.col("classes").cast("double"))).otherwise(1.0)
    severe = (ratio < 0.15) | (low < 10)
    severity = (
        F.when(severe & ((low < 5) | (ratio < 0.08)), "CRITICAL")
        .when(severe, "HIGH").when(ratio < 0.35, "MEDIUM")
    )
    return (
        facts.withColumn("imbalance_ratio", F.round(worst / best, 3))
        .withColumn("minority_pct", percent(worst, F.col("total")))
        .withColumn("majority_pct", percent(best, F.col("total")))
        .withColumn("entropy", F.round("raw_entropy", 3))
        .withColumn("normalized_entropy", F.round(F.col("raw_entropy") / widest, 3))
        .withColumn("severity", severity)
        .withColumn(
            "score",
            F.when(F.col("severity") == "CRITICAL", 45.0).when(F.col("severity") == "HIGH", 60.0)
            .when(F.col("severity") == "MEDIUM", 80.0).otherwise(100.0),
        )
        .drop("raw_entropy")
    )


def check_imbalance(ctx: TableContext) -> Check:
    if ctx.count == 0:
        return Check(CHECKER, no_issues(ctx.spark))
    target = balance_target(ctx)
    one = local_frame(ctx.spark, [{"x": 1}], "x int")
    if target is None:
        note = make_issues(
            one, CHECKER, issue_id=F.lit("no_target_specified"), severity="INFO",
            title=F.lit("No target column given or found"), remediation="Name the target column", fails=False,
        )
        return Check(CHECKER, note)
    ctx.small_domain([target])
    classes = ctx.stats[target].get("ndv", 0)
    metrics = {"target_column": target, "classes_count": None if classes == MANY else classes}
    if classes > MAX_CLASSES:
        return Check(CHECKER, no_issues(ctx.spark), metrics)
    if classes == 0:
        broken = make_issues(
            one, CHECKER, issue_id=F.lit("error"), severity="MEDIUM",
            title=F.format_string("Target %s has no values", F.lit(target)),
            remediation="Inspect the target column", penalty=50.0,
        )
        return Check(CHECKER, broken, metrics)
    facts = settle(class_balance(settle(class_distribution(ctx, target))))
    row = facts.collect()[0].asDict()
    metrics.update({k: row[k] for k in ("imbalance_ratio", "minority_pct", "majority_pct", "entropy", "normalized_entropy")})
    severe = F.col("severity").isin("CRITICAL", "HIGH")
    issues = make_issues(
        facts.filter("severity IS NOT NULL"), CHECKER,
        issue_id=F.when(severe, "severe_class_imbalance").otherwise("moderate_class_imbalance"),
        severity=F.col("severity"),
        title=F.format_string(
            "%s: class '%s' holds %s%% of the rows", F.lit(target), F.col("minority_class"), F.col("minority_pct")
        ),
        remediation=F.when(severe, "Resample or weight the classes; judge by F1 or PR-AUC")
        .otherwise("Use stratified validation"),
        columns=F.array(F.lit(target)), rows=F.col("minority_count"), pct=F.col("minority_pct"),
        details={k: F.col(k) for k in (
            "imbalance_ratio", "minority_class", "minority_count", "majority_class", "majority_count",
            "majority_pct", "normalized_entropy")},
        penalty=F.lit(100.0) - F.col("score"),
    )
    return Check(CHECKER, issues, metrics)
