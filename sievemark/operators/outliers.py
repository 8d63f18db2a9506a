"""Validity: Tukey fences, extreme points, modified z-scores, joint anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import percent
from ..plans.context import TableContext
from ..plans.local import local_frame
from ..plans.quantiles import exact_quantiles
from .iforest import joint_anomalies
from .issues import Check, make_issues, no_issues

CHECKER = "outliers"
STATS = {
    "non_null": "bigint", "q25": "double", "median": "double", "q75": "double", "min": "double",
    "max": "double", "mad": "double", "outliers": "bigint", "extremes": "bigint", "z_outliers": "bigint",
}


def candidates(ctx: TableContext) -> list[str]:
    """Numeric columns other than the target with more than five distinct values."""
    names = [n for n in ctx.of_kind("numeric") if n != ctx.target]
    ctx.small_domain(names)
    return [n for n in names if ctx.stats[n]["ndv"] > 5]


def outlier_stats(ctx: TableContext) -> DataFrame:
    """Per evaluated column: quartiles, fences, counts outside them."""
    names = candidates(ctx)
    ctx.scan("nulls", "moments", names=names).quantiles(names)
    names = [
        n for n in names
        if ctx.stats[n]["non_null"] >= 10 and ctx.stats[n]["q75"] - ctx.stats[n]["q25"] != 0
    ]
    if names and "outliers" not in ctx.stats[names[0]].values:
        _dependent_scan(ctx, names)
    q1, q3 = F.col("q25"), F.col("q75")
    return (
        ctx.table(names, STATS)
        .withColumn("iqr", q3 - q1)
        .withColumn("lower_bound", q1 - 1.5 * F.col("iqr"))
        .withColumn("upper_bound", q3 + 1.5 * F.col("iqr"))
        .withColumn("outlier_pct", percent(F.col("outliers"), F.col("non_null")))
        .withColumn("extreme_pct", percent(F.col("extremes"), F.col("non_null")))
    )


def _dependent_scan(ctx: TableContext, names: list[str]) -> None:
    """Counts that need the quantiles of the previous pass as literals."""
    counts = {n: ctx.stats[n]["non_null"] for n in names}
    away = {n: F.abs(ctx.number(n) - F.lit(ctx.stats[n]["median"])) for n in names}
    mads = exact_quantiles(ctx.rows, away, [0.5], counts, ctx.buffer_limit)
    measures = []
    for n in names:
        s, x = ctx.stats[n].values, ctx.number(n)
        s["mad"] = mads[n][0]
        spread = s["q75"] - s["q25"]
        for fence in (1.5, 3.0):
            measures.append(F.count(F.when((x < s["q25"] - fence * spread) | (x > s["q75"] + fence * spread), 1)))
        measures.append(F.count(F.when(F.lit(0.6745) * away[n] / F.lit(s["mad"]) > 3.5, 1)) if s["mad"] > 0 else F.lit(0))
    row = ctx.rows.agg(*[m.alias(f"m{i}") for i, m in enumerate(measures)]).collect()[0]
    for i, n in enumerate(names):
        ctx.stats[n].values.update(outliers=row[3 * i], extremes=row[3 * i + 1], z_outliers=row[3 * i + 2])


def check_outliers(ctx: TableContext, forest: bool = True) -> Check:
    if ctx.count == 0:
        return Check(CHECKER, no_issues(ctx.spark), cap=50.0)
    names = candidates(ctx)
    if not names:
        return Check(CHECKER, no_issues(ctx.spark), {"features_evaluated": 0}, cap=50.0)
    stats = outlier_stats(ctx)
    name, extremes, pct = F.col("column"), F.col("extremes"), F.col("outlier_pct")
    fenced = make_issues(
        stats.filter((extremes > 0) | (pct > 8)), CHECKER,
        issue_id=F.concat(F.lit("outliers_"), name),
        severity=F.when((F.col("extreme_pct") > 2) | (pct > 15), "HIGH").otherwise("MEDIUM"),
        title=F.format_string("%s: %s values outside the fences (%s%%)", name, F.col("outliers"), pct),
        remediation="Clip to the 1st and 99th percentile, or transform the scale",
        columns=F.array(name), rows=F.col("outliers"), pct=pct,
        details={"iqr_lower": F.col("lower_bound"), "iqr_upper": F.col("upper_bound"),
                 "extreme_count": extremes, "z_outlier_count": F.col("z_outliers"),
                 "min_value": F.col("min"), "max_value": F.col("max")},
        fix_action=F.concat(F.lit("clip_outliers:"), name), seq=F.col("position"),
        penalty=F.lit(4.0) + F.when(extremes > 0, 8.0).otherwise(0.0),
    )
    parts = [fenced]
    metrics = {"features_evaluated": len(names)}
    if forest and len(names) >= 2 and ctx.count >= 50:
        found = joint_anomalies(ctx, names)
        metrics["joint_anomalies"] = found
        one = local_frame(ctx.spark, [{"found": found, "n": ctx.count}], "found bigint, n bigint")
        parts.append(make_issues(
            one.filter("found > 0"), CHECKER,
            issue_id=F.lit("multivariate_anomalies"), severity="LOW",
            title=F.format_string("%s rows stand apart across several columns", F.col("found")),
            remediation="Review these rows for errors or rare groups",
            columns=F.array(*[F.lit(c) for c in names[:4]]),
            rows=F.col("found"), pct=percent(F.col("found"), F.col("n")), seq=1_000_000, penalty=4.0,
        ))
    return Check(CHECKER, parts, metrics, cap=50.0)
