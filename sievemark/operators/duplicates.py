"""Uniqueness: repeated rows, repeated keys, same features under different keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import percent
from ..plans.context import TableContext
from ..plans.local import local_frame
from .issues import Check, make_issues, no_issues

CHECKER = "duplicate_rows"


def key_columns(names: Sequence[str]) -> list[str]:
    """Columns whose name looks like an identifier."""
    return [
        n for n in names
        if n.lower() in fixed.KEY_NAMES or any(part in n.lower() for part in fixed.KEY_FRAGMENTS)
    ]


def exact_duplicates(ctx: TableContext) -> DataFrame:
    """One row: duplicates beyond the first and their share."""
    rows = [{"n": ctx.count, "duplicates": ctx.repeated_rows()}]
    frame = local_frame(ctx.spark, rows, "n bigint, duplicates bigint")
    return frame.withColumn("duplicate_pct", percent(F.col("duplicates"), F.col("n")))


def key_violations(ctx: TableContext) -> DataFrame:
    """Identifier-like columns with their repeated non-null values."""
    keys = [n for n in key_columns(ctx.names) if ctx.stats[n].kind != "other"]
    ctx.scan("nulls", names=keys).distinct([n for n in keys if ctx.stats[n].get("ndv", 1 << 62) == 1 << 62])
    stats = ctx.table(keys, {"non_null": "bigint", "ndv": "bigint"})
    return stats.withColumn("repeated", F.col("non_null") - F.col("ndv")).withColumn(
        "repeated_pct", percent(F.col("repeated"), F.col("non_null"))
    )


def feature_duplicates(ctx: TableContext) -> DataFrame:
    """One row: rows equal in everything but the key columns, beyond exact duplicates."""
    keys = key_columns(ctx.names)
    features = [n for n in ctx.names if n not in keys]
    applies = len(features) >= 3 and bool(keys)
    found = ctx.repeated_rows(features) if applies else 0
    rows = [{"n": ctx.count, "repeats": found, "extra": max(0, found - ctx.repeated_rows()) if applies else 0}]
    frame = local_frame(ctx.spark, rows, "n bigint, repeats bigint, extra bigint")
    return frame.withColumn("extra_pct", percent(F.col("extra"), F.col("n")))


def check_duplicates(ctx: TableContext) -> Check:
    if ctx.count == 0:
        return Check(CHECKER, no_issues(ctx.spark))
    n, pct = F.col("duplicates"), F.col("duplicate_pct")
    exact = make_issues(
        exact_duplicates(ctx).filter("duplicates > 0"), CHECKER,
        issue_id=F.lit("exact_duplicates_found"),
        severity=F.when(pct > 5, "HIGH").otherwise("MEDIUM"),
        title=F.format_string("%s exact duplicate rows (%s%%)", n, pct),
        remediation="Keep one copy of each row", rows=n, pct=pct,
        details={"duplicate_count": n, "duplicate_percentage": pct},
        fix_action=F.lit("drop_exact_duplicates"), seq=-1, penalty=pct * 4,
    )
    name = F.col("column")
    keyed = make_issues(
        key_violations(ctx).filter("repeated > 0"), CHECKER,
        issue_id=F.concat(F.lit("duplicate_key_"), name), severity="HIGH",
        title=F.format_string("Key column %s repeats %s values", name, F.col("repeated")),
        remediation="Check the load, or keep one row per key",
        columns=F.array(name), rows=F.col("repeated"), pct=F.col("repeated_pct"),
        details={"unique_keys": F.col("ndv"), "total_keys": F.col("non_null")},
        fix_action=F.concat(F.lit("drop_duplicates_by_key:"), name), seq=F.col("position"), penalty=12.0,
    )
    features = [c for c in ctx.names if c not in key_columns(ctx.names)]
    same = make_issues(
        feature_duplicates(ctx).filter("extra > 0 AND extra_pct > 2"), CHECKER,
        issue_id=F.lit("feature_subset_duplicates"), severity="LOW",
        title=F.format_string("%s rows differ only in their key", F.col("extra")),
        remediation="Decide whether these are repeated records",
        columns=F.array(*[F.lit(c) for c in features[:5]]).cast("array<string>"),
        rows=F.col("extra"), pct=F.col("extra_pct"),
        details={"subset_duplicate_count": F.col("repeats")}, seq=1_000_000, fails=False,
    )
    from ..functions.expr import percent_of

    found = ctx.repeated_rows()
    metrics = {
        "exact_duplicates_count": found,
        "exact_duplicates_percentage": percent_of(found, ctx.count),
        "id_columns_inspected": len(key_columns(ctx.names)),
    }
    return Check(CHECKER, [exact, keyed, same], metrics)
