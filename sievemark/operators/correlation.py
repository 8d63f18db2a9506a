"""Consistency: pairs of numeric columns that say the same thing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.context import TableContext
from ..plans.local import local_frame
from ..plans.pairs import correlate
from .issues import Check, make_issues, no_issues

CHECKER = "high_correlation"
FLAG_FROM, HIGH_FROM = 0.85, 0.95


def _features(ctx: TableContext) -> list[str]:
    return [n for n in ctx.of_kind("numeric") if n != ctx.target]


def correlation_pairs(ctx: TableContext, names: list[str] | None = None) -> DataFrame:
    """Upper triangle in long form: col_a, col_b, r."""
    names = _features(ctx) if names is None else names
    found = correlate(ctx, names) if len(names) >= 2 else {}
    rows = [
        {"pos_a": ctx.stats[a].position, "pos_b": ctx.stats[b].position, "col_a": a, "col_b": b, "r": r}
        for (a, b), r in found.items()
    ]
    return local_frame(ctx.spark, rows, "pos_a bigint, pos_b bigint, col_a string, col_b string, r double")


def correlation_matrix(ctx: TableContext, first: int | None = None) -> DataFrame:
    """Square matrix of the numeric columns in long form, r rounded to 2; of the first few only, if asked."""
    names = _features(ctx)[:first]
    kept = correlation_pairs(ctx, names)
    upper = kept.select("col_a", "col_b", "r")
    lower = kept.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")
    ctx.scan("moments", names=names)
    own = local_frame(
        ctx.spark,
        [{"col_a": n, "col_b": n, "r": 1.0 if (ctx.stats[n].get("std", 0.0) or 0.0) > 0 else 0.0} for n in names],
        "col_a string, col_b string, r double",
    )
    return upper.union(lower).union(own).withColumn("r", F.round("r", 2))


def collinear_pairs(ctx: TableContext) -> DataFrame:
    size = F.abs("r")
    return (
        correlation_pairs(ctx).filter(size >= FLAG_FROM)
        .withColumn("abs_r", size)
        .withColumn("severity", F.when(size >= HIGH_FROM, "HIGH").otherwise("MEDIUM"))
    )


def check_correlation(ctx: TableContext) -> Check:
    if ctx.count == 0:
        return Check(CHECKER, no_issues(ctx.spark), cap=50.0)
    a, b = F.col("col_a"), F.col("col_b")
    issues = make_issues(
        collinear_pairs(ctx), CHECKER,
        issue_id=F.concat(F.lit("collinear_"), a, F.lit("_"), b), severity=F.col("severity"),
        title=F.format_string("%s and %s move together (|r| = %.3f)", a, b, F.col("abs_r")),
        remediation=F.format_string("Keep one of the two; %s is redundant", b),
        columns=F.array(a, b),
        details={"correlation": F.round("r", 4), "abs_correlation": F.round("abs_r", 4)},
        fix_action=F.concat(F.lit("drop_column:"), b),
        seq=F.col("pos_a") * 100_000 + F.col("pos_b"), penalty=12.0,
    )
    return Check(CHECKER, issues, {"features_evaluated": len(_features(ctx))}, cap=50.0)
