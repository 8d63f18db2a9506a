"""Validity: placeholder values and numbers that cannot be true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import percent
from ..plans.context import TableContext
from .issues import Check, make_issues, name_has, no_issues

CHECKER = "suspicious_values"


def numeric_views(ctx: TableContext) -> list[str]:
    """Numeric columns, and text columns of which over 70% reads as numbers."""
    ctx.scan("nulls", "sentinels", names=ctx.of_kind("numeric", "string"))
    return [
        n for n in ctx.of_kind("numeric", "string")
        if ctx.stats[n]["numeric_view"] > 0
        and (ctx.stats[n].kind == "numeric" or ctx.stats[n]["numeric_view"] * 10 > ctx.stats[n]["non_null"] * 7)
    ]


def text_sentinels(ctx: TableContext) -> DataFrame:
    """Text columns with their placeholder words."""
    names = ctx.of_kind("string")
    ctx.scan("nulls", "sentinels", names=names)
    names = [n for n in names if ctx.stats[n]["text_hits"]]
    ctx.scan("examples", names=names)
    stats = ctx.table(names, {"non_null": "bigint", "text_hits": "bigint", "text_examples": "array<string>"})
    return stats.withColumn("hit_pct", percent(F.col("text_hits"), F.col("non_null"))).filter("text_hits > 0")


def numeric_sentinels(ctx: TableContext) -> DataFrame:
    """(column, sentinel) pairs that occur and lie far from the column's median."""
    names = [n for n in numeric_views(ctx) if ctx.stats[n]["code_hits"]]
    ctx.scan("codes", names=names).quantiles(names)
    stats = ctx.table(names, {"numeric_view": "bigint", "median": "double", "number_hits": "array<bigint>"})
    codes = F.array(*[F.lit(s) for s in fixed.NUMERIC_SENTINELS])
    long = stats.select("*", F.posexplode("number_hits").alias("code_no", "hits"))
    long = long.withColumn("sentinel", F.element_at(codes, F.col("code_no") + 1).cast("bigint"))
    s = F.col("sentinel")
    far = (F.abs(s - F.col("median")) > 20) & ((s < 0) | (s >= 999))
    return (
        long.filter((F.col("hits") > 0) & far)
        .withColumn("hit_pct", percent(F.col("hits"), F.col("numeric_view")))
        .drop("number_hits")
    )


def impossible_values(ctx: TableContext) -> DataFrame:
    """(column, rule) with counts of impossible ages, negative amounts, negative readings."""
    stats = ctx.table(
        numeric_views(ctx), {"numeric_view": "bigint", "negatives": "bigint", "over_125": "bigint"}
    )
    name = F.col("column")

    def rule(label: str, fragments, bad: Column) -> Column:
        return F.when(name_has(name, fragments) & (bad > 0), F.struct(F.lit(label).alias("rule"), bad.alias("bad")))

    found = F.array(
        rule("age", fixed.AGE_FRAGMENTS, F.col("negatives") + F.col("over_125")),
        rule("money", fixed.MONEY_FRAGMENTS, F.col("negatives")),
        rule("biometric", fixed.BIOMETRIC_FRAGMENTS, F.col("negatives")),
    )
    long = stats.select("*", F.posexplode(found).alias("rule_no", "hit")).filter("hit IS NOT NULL")
    return (
        long.withColumn("rule", F.col("hit.rule")).withColumn("bad", F.col("hit.bad")).drop("hit")
        .withColumn("bad_pct", percent(F.col("bad"), F.col("numeric_view")))
    )


def check_suspicious(ctx: TableContext) -> Check:
    if ctx.count == 0:
        return Check(CHECKER, no_issues(ctx.spark), cap=50.0)
    name, place = F.col("column"), F.col("position") * 100
    words = make_issues(
        text_sentinels(ctx), CHECKER,
        issue_id=F.concat(F.lit("text_sentinels_"), name),
        severity=F.when(F.col("hit_pct") > 5, "HIGH").otherwise("MEDIUM"),
        title=F.format_string("%s: %s placeholder words", name, F.col("text_hits")),
        remediation="Replace placeholders with null",
        columns=F.array(name), rows=F.col("text_hits"), pct=F.col("hit_pct"),
        details={"sentinels_found": F.array_join("text_examples", ", "), "count": F.col("text_hits")},
        fix_action=F.concat(F.lit("replace_sentinels_with_nan:"), name), seq=place, penalty=10.0,
    )
    codes = make_issues(
        numeric_sentinels(ctx), CHECKER,
        issue_id=F.concat(F.lit("numeric_sentinel_"), name, F.lit("_"), F.col("sentinel").cast("string")),
        severity="HIGH",
        title=F.format_string("%s: code %s stands in for %s values", name, F.col("sentinel"), F.col("hits")),
        remediation="Replace the code with null",
        columns=F.array(name), rows=F.col("hits"), pct=F.col("hit_pct"),
        details={"sentinel_value": F.col("sentinel"), "count": F.col("hits")},
        fix_action=F.concat(F.lit("replace_sentinels_with_nan:"), name),
        seq=place + 1 + F.col("code_no"), penalty=10.0,
    )
    rule = F.col("rule")
    ranges = make_issues(
        impossible_values(ctx), CHECKER,
        issue_id=F.concat(
            F.when(rule == "age", "invalid_age_range_").when(rule == "money", "negative_financial_")
            .otherwise("negative_medical_"), name,
        ),
        severity=F.when(rule == "biometric", "CRITICAL").otherwise("HIGH"),
        title=F.format_string("%s: %s impossible values (%s)", name, F.col("bad"), rule),
        remediation=F.when(rule == "age", "Null ages outside the human range")
        .otherwise("Take the absolute value, or null it"),
        columns=F.array(name), rows=F.col("bad"),
        pct=F.when(rule != "biometric", F.col("bad_pct")),
        details={"negative_count": F.col("negatives"), "excessive_count": F.when(rule == "age", F.col("over_125"))},
        fix_action=F.concat(F.when(rule == "age", "sanitize_age_bounds:").otherwise("abs_or_nan:"), name),
        seq=place + 20 + F.col("rule_no"), penalty=10.0,
    )
    return Check(CHECKER, [words, codes, ranges], {"columns_audited": len(ctx.names)}, cap=50.0)
