"""Completeness: nulls, blank text, sparse rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import percent, percent_of
from ..plans.context import TableContext
from ..plans.local import local_frame
from .issues import Check, make_issues

CHECKER = "missing_values"
DROP_ABOVE, HIGH_FROM = 60.0, 20.0


def missing_breakdown(ctx: TableContext) -> DataFrame:
    """Per column: nulls, blanks, missing (both) and their share of the rows."""
    ctx.scan("nulls")
    stats = ctx.table(ctx.names, {"nulls": "bigint", "blanks": "bigint", "missing": "bigint"})
    return stats.withColumn("missing_pct", percent(F.col("missing"), F.col("n")))


def band(pct: Column) -> Column:
    return F.when(pct > DROP_ABOVE, "excessive").when(pct >= HIGH_FROM, "high").when(pct > 0, "moderate")


def severity(band_: Column, target: Column) -> Column:
    return (
        F.when(band_ == "excessive", F.when(target, "CRITICAL").otherwise("HIGH"))
        .when(band_ == "high", F.when(target, "HIGH").otherwise("MEDIUM"))
        .when(band_ == "moderate", F.lit("LOW"))
    )


def totals(ctx: TableContext) -> dict:
    ctx.scan("nulls")
    n, k = ctx.count, len(ctx.names)
    missing = sum(ctx.stats[c]["missing"] for c in ctx.names)
    shares = [percent_of(ctx.stats[c]["missing"], n) for c in ctx.names]
    return {
        "total_cells": n * k,
        "total_missing_cells": missing,
        "overall_missing_percentage": percent_of(missing, n * k),
        "columns_with_missing": sum(ctx.stats[c]["missing"] > 0 for c in ctx.names),
        "columns_to_impute": sum(0 < p <= DROP_ABOVE for p in shares),
        "columns_to_drop_count": sum(p > DROP_ABOVE for p in shares),
        "whitespace_only_detected": sum(ctx.stats[c]["blanks"] for c in ctx.names),
    }


def check_missing(ctx: TableContext) -> Check:
    if ctx.count == 0 or not ctx.names:
        one = local_frame(ctx.spark, [{"x": 1}], "x int")
        empty = make_issues(
            one, CHECKER, issue_id=F.lit("empty_dataset"), severity="CRITICAL",
            title=F.lit("Table has no rows"), remediation="Load a table that holds rows", penalty=100.0,
        )
        return Check(CHECKER, empty, {"overall_missing_percentage": 0.0})

    metrics = totals(ctx)
    overall = metrics["overall_missing_percentage"]
    fails = overall > 0
    stats = missing_breakdown(ctx).withColumn("band", band(F.col("missing_pct"))).filter("band IS NOT NULL")
    name, kind = F.col("column"), F.col("band")
    verb = F.when(kind == "excessive", "drop_column:").otherwise("impute:")
    per_column = make_issues(
        stats, CHECKER,
        issue_id=F.concat(kind, F.lit("_missing_"), name),
        severity=severity(kind, F.col("is_target")),
        title=F.format_string("%s: %s%% of values missing", name, F.col("missing_pct")),
        remediation=F.when(kind == "excessive", "Too little signal left: drop the column or collect it again")
        .otherwise("Fill with the median (numbers) or the mode (text)"),
        columns=F.array(name), rows=F.col("missing"), pct=F.col("missing_pct"),
        details={"missing_count": F.col("missing"), "missing_percentage": F.col("missing_pct"),
                 "whitespace_count": F.col("blanks")},
        fix_action=F.concat(verb, name), seq=F.col("position"),
        penalty=F.when(kind == "excessive", 10.0).otherwise(0.0), fails=fails,
    )
    target = make_issues(
        missing_breakdown(ctx).filter("is_target AND missing > 0"), CHECKER,
        issue_id=F.lit("target_missing_values"), severity="CRITICAL",
        title=F.format_string("Target %s: %s rows without a label", name, F.col("missing")),
        remediation="Drop rows without a target value",
        columns=F.array(name), rows=F.col("missing"), pct=F.col("missing_pct"),
        details={"target_missing_count": F.col("missing")},
        fix_action=F.concat(F.lit("drop_target_na:"), name), seq=-1, fails=fails,
    )
    sparse_rows = ctx.sparse_rows
    one = local_frame(ctx.spark, [{"sparse": sparse_rows, "n": ctx.count}], "sparse bigint, n bigint")
    sparse = make_issues(
        one.filter("sparse > 0"), CHECKER,
        issue_id=F.lit("sparse_rows_detected"), severity="MEDIUM",
        title=F.format_string("%s rows with over half of their cells empty", F.col("sparse")),
        remediation="Drop rows that are mostly empty",
        rows=F.col("sparse"), pct=percent(F.col("sparse"), F.col("n")),
        details={"sparse_rows_count": F.col("sparse")},
        fix_action=F.lit("drop_sparse_rows"), seq=1_000_000, fails=fails,
    )
    metrics["sparse_rows"] = sparse_rows
    return Check(CHECKER, [target, per_column, sparse], metrics, base_penalty=3.5 * overall)
