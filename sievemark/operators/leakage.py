"""ML readiness: features that give the target away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans.context import SMALL_DOMAIN, TableContext
from ..plans.local import local_frame
from ..plans.pairs import Variable, correlations, variable
from ..plans.ranking import dense_codes
from .issues import Check, make_issues, no_issues

CHECKER = "data_leakage"
LEAK_FROM, SUSPECT_FROM, MIN_PAIRS, PURITY, MAX_LEVELS = 0.95, 0.88, 20, 0.99, 10
FEATURES_PER_JOB = 40


def leakage_target(ctx: TableContext) -> str | None:
    if ctx.target:
        return ctx.target
    named = [n for n in ctx.names if n.lower().endswith(fixed.LEAKAGE_TARGET_ENDINGS)]
    return named[0] if named else None


def _feature_number(ctx: TableContext, name: str) -> Column:
    if ctx.stats[name].kind == "datetime":
        return F.unix_micros(ctx.column(name).cast("timestamp")).cast("double")
    return ctx.number(name)


def with_target_number(ctx: TableContext, target: str) -> tuple[DataFrame, Variable]:
    """The table plus ``y``: the target as a number, or alphabetical class codes."""
    y = _feature_number(ctx, target)
    low, high, mean, filled = ctx.rows.agg(F.min(y), F.max(y), F.avg(y), F.count(y)).collect()[0]
    if low is not None and low != high:
        frame = ctx.rows.withColumn("y", y)
        return frame, Variable("y", F.col("y"), mean, filled == ctx.count)
    ctx.scan("domain", names=[target])
    text = ctx.column(target).cast("string")
    codes = dense_codes(ctx.rows.select(text.alias("value")))
    if ctx.stats[target]["sketch_ndv"] <= SMALL_DOMAIN:
        codes = F.broadcast(codes)  # at most about a thousand rows
    joined = ctx.rows.join(codes, text == codes["value"], "left")
    frame = joined.withColumn("y", F.coalesce("code", F.lit(-1.0))).drop("value", "code")
    return frame, Variable("y", F.col("y"), None, True)


def target_correlations(ctx: TableContext) -> DataFrame:
    """(column, abs_r, pairs) of every feature that reads as a number."""
    target = leakage_target(ctx)
    rows = []
    if target is not None and ctx.stats[target].kind != "other":
        features = [n for n in ctx.names if n != target and ctx.stats[n].kind != "other"]
        ctx.scan("nulls", "moments", "sentinels", names=features)
        features = [
            n for n in features
            if ctx.stats[n].get("numeric_view" if ctx.stats[n].kind == "string" else "non_null", 0) > MIN_PAIRS
        ]
        frame, y = with_target_number(ctx, target) if features else (None, None)
        for start in range(0, len(features), FEATURES_PER_JOB):
            part = features[start:start + FEATURES_PER_JOB]
            pairs = []
            for n in part:
                x = variable(ctx, n) if ctx.stats[n].kind != "datetime" else Variable(
                    n, _feature_number(ctx, n), None, ctx.stats[n]["nulls"] == 0)
                pairs.append((x, y))
            rows += [
                {"position": ctx.stats[n].position, "column": n, "target": target, "abs_r": abs(r), "pairs": common}
                for n, (r, common) in zip(part, correlations(frame, pairs))
            ]
    frame = local_frame(
        ctx.spark, rows, "position bigint, `column` string, target string, abs_r double, pairs bigint"
    )
    return frame.filter(F.col("pairs") > MIN_PAIRS)


def proxy_purity(ctx: TableContext) -> DataFrame:
    """(column, purity): text features with 2-10 values; purity of their least pure value."""
    target = leakage_target(ctx)
    names = [n for n in ctx.of_kind("string") if n != target] if target else []
    ctx.small_domain(names)
    names = [n for n in names if 2 <= ctx.stats[n]["ndv"] <= MAX_LEVELS]
    schema = "position bigint, `column` string, target string, purity double"
    if not names or ctx.stats[target].kind == "other":
        return local_frame(ctx.spark, [], schema)
    wide = ctx.rows.select(
        ctx.column(target).cast("string").alias("y"),
        *[ctx.column(n).alias(str(ctx.stats[n].position)) for n in names],
    ).filter("y IS NOT NULL")
    long = wide.unpivot("y", [str(ctx.stats[n].position) for n in names], "position", "value")
    cells = long.filter("value IS NOT NULL").groupBy("position", "value", "y").agg(F.count(F.lit(1)).alias("cnt"))
    purity = (
        cells.groupBy("position", "value").agg((F.max("cnt") / F.sum("cnt")).alias("share"))
        .groupBy("position").agg(F.min("share").alias("purity"))
    )
    rows = [
        {"position": int(r["position"]), "column": ctx.names[int(r["position"])], "target": target,
         "purity": r["purity"]}
        for r in purity.collect()
    ]
    return local_frame(ctx.spark, rows, schema)


def check_leakage(ctx: TableContext) -> Check:
    target = leakage_target(ctx) if ctx.count else None
    if target is None:
        return Check(CHECKER, no_issues(ctx.spark))
    name, r = F.col("column"), F.col("abs_r")
    certain = r >= LEAK_FROM
    linear = target_correlations(ctx).filter(r >= SUSPECT_FROM)
    direct = make_issues(
        linear, CHECKER,
        issue_id=F.concat(F.when(certain, "direct_target_leakage_").otherwise("suspicious_target_correlation_"), name),
        severity=F.when(certain, "CRITICAL").otherwise("HIGH"),
        title=F.format_string("%s tracks the target (|r| = %.3f)", name, r),
        remediation=F.when(certain, "Drop the feature before training")
        .otherwise("Make sure the feature is known before the target is"),
        columns=F.array(name, F.col("target")), details={"correlation": F.round(r, 4)},
        fix_action=F.when(certain, F.concat(F.lit("drop_column:"), name)),
        seq=F.col("position") * 10, penalty=F.when(certain, 45.0).otherwise(10.0), fails=certain,
    )
    sure = linear.filter(certain).select("column")
    proxies = proxy_purity(ctx).filter(F.col("purity") > PURITY).join(F.broadcast(sure), "column", "left_anti")
    proxy = make_issues(
        proxies, CHECKER, issue_id=F.concat(F.lit("categorical_leakage_"), name), severity="CRITICAL",
        title=F.format_string("%s determines the target", name),
        remediation="Drop the feature before training",
        columns=F.array(name, F.col("target")), details={"lowest_purity": F.col("purity")},
        fix_action=F.concat(F.lit("drop_column:"), name), seq=F.col("position") * 10 + 1, penalty=45.0,
    )
    return Check(CHECKER, [direct, proxy], {
        "target_column": target, "features_evaluated": len(ctx.names) - 1,
    })
