"""Validity: columns that are empty, constant or nearly constant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import percent
from ..plans.context import TableContext
from .issues import Check, make_issues, no_issues

CHECKER = "constant_columns"


def constant_stats(ctx: TableContext) -> DataFrame:
    """Per column: distinct count, most frequent value and its share of the non-nulls."""
    names = [n for n in ctx.names if n != ctx.target]
    ctx.scan("nulls", names=names).small_domain(names, tops=True)
    plain = [n for n in names if ctx.stats[n].kind != "other"]
    for n in plain:
        best = (ctx.stats[n].get("tops") or [(None, None)])[0]
        ctx.stats[n].values.update(top_value=best[0], top_count=best[1])
    stats = ctx.table(names, {"non_null": "bigint", "ndv": "bigint", "top_value": "string", "top_count": "bigint"})
    top_pct = percent(F.col("top_count"), F.col("non_null"))
    state = (
        F.when(F.col("non_null") == 0, "all_null")
        .when(F.col("ndv") == 1, "constant")
        .when((F.col("n") >= 50) & (top_pct >= 99.0) & (F.col("ndv") <= 5), "quasi_constant")
    )
    return stats.withColumn("top_pct", top_pct).withColumn("state", state)


def check_constant(ctx: TableContext) -> Check:
    if ctx.count == 0:
        return Check(CHECKER, no_issues(ctx.spark), cap=50.0)
    name, state = F.col("column"), F.col("state")
    quasi = state == "quasi_constant"
    issues = make_issues(
        constant_stats(ctx).filter("state IS NOT NULL"), CHECKER,
        issue_id=F.concat(
            F.when(state == "all_null", "all_null_column_").when(quasi, "quasi_constant_").otherwise("constant_column_"),
            name,
        ),
        severity=F.when(state == "all_null", "HIGH").when(quasi, "LOW").otherwise("MEDIUM"),
        title=F.when(state == "all_null", F.format_string("%s holds no values", name))
        .when(quasi, F.format_string("%s is %s%% one value", name, F.col("top_pct")))
        .otherwise(F.format_string("%s holds a single value", name)),
        remediation="Drop the column",
        columns=F.array(name),
        rows=F.when(quasi, F.col("top_count")).otherwise(F.col("n")),
        pct=F.when(quasi, F.col("top_pct")).otherwise(100.0),
        details={"dominant_value": F.col("top_value"), "state": state},
        fix_action=F.concat(F.lit("drop_column:"), name), seq=F.col("position"),
        penalty=F.when(quasi, 4.0).otherwise(10.0),
    )
    return Check(CHECKER, issues, {"columns_audited": len(ctx.names)}, cap=50.0)
