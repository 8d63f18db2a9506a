"""Consistency: text that is really numbers or dates, mixed text, whole-number floats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import percent
from ..plans.context import TableContext
from .issues import Check, make_issues, no_issues

CHECKER = "data_types"
SHAPES = ("numbers", "dates", "booleans", "words")
VARIANT_SHAPES = (*SHAPES, "objects", "arrays")


def text_shapes(ctx: TableContext) -> DataFrame:
    """Text columns: how many values look like currency, dates, numbers, booleans, words.

    ``verdict`` is currency (> 75% of non-nulls), date (> 80%) or mixed (at least
    two lexical classes), tested in this order.
    """
    names = ctx.of_kind("string")
    ctx.scan("nulls", "shapes", names=names)
    fields = {"non_null": "bigint", "currency": "bigint", **{s: "bigint" for s in SHAPES}}
    classes = sum((F.when(F.col(s) > 0, 1).otherwise(0) for s in SHAPES), F.lit(0))
    verdict = (
        F.when(F.col("currency") > F.col("non_null") * 0.75, "currency")
        .when(F.col("dates") > F.col("non_null") * 0.8, "date")
        .when(classes > 1, "mixed")
    )
    return ctx.table(names, fields).withColumn("classes", classes).withColumn(
        "verdict", F.when(F.col("non_null") > 0, verdict)
    )


def variant_shapes(ctx: TableContext) -> DataFrame:
    """Variant columns, as JSON gives them: how many values are of each type; ``verdict`` is mixed with two or more.

    Every value is asked for its own type, so 1 and "1" differ.  JSON nulls (``voids``) and nulls are of no type.
    """
    names = [n for n in ctx.names if ctx.stats[n].physical_type == "variant"]
    ctx.scan("nulls", "variants", names=names)
    fields = {"non_null": "bigint", "voids": "bigint", **{s: "bigint" for s in VARIANT_SHAPES}}
    classes = sum((F.when(F.col(s) > 0, 1).otherwise(0) for s in VARIANT_SHAPES), F.lit(0))
    return ctx.table(names, fields).withColumn("classes", classes).withColumn("verdict", F.when(F.col("classes") > 1, "mixed"))


def whole_floats(ctx: TableContext) -> DataFrame:
    """Floating columns that hold at most five distinct whole numbers."""
    names = [n for n in ctx.names if ctx.stats[n].floating]
    ctx.scan("nulls", "whole", names=names).small_domain(names)
    stats = ctx.table(names, {"non_null": "bigint", "whole": "boolean", "ndv": "bigint"})
    return stats.withColumn(
        "as_integer",
        (F.col("non_null") > 0) & F.coalesce("whole", F.lit(False)) & (F.col("ndv") <= 5) & (F.col("n") > 50),
    )


def check_types(ctx: TableContext) -> Check:
    if ctx.count == 0:
        return Check(CHECKER, no_issues(ctx.spark), cap=50.0)
    name, verdict = F.col("column"), F.col("verdict")
    hits = F.when(verdict == "currency", F.col("currency")).when(verdict == "date", F.col("dates"))
    text = make_issues(
        text_shapes(ctx).filter("verdict IS NOT NULL"), CHECKER,
        issue_id=F.concat(
            F.when(verdict == "currency", "currency_as_string_").when(verdict == "date", "date_as_string_")
            .otherwise("mixed_types_"), name,
        ),
        severity=F.when(verdict == "date", "MEDIUM").otherwise("HIGH"),
        title=F.when(verdict == "currency", F.format_string("%s stores amounts as text", name))
        .when(verdict == "date", F.format_string("%s stores dates as text", name))
        .otherwise(F.format_string("%s mixes kinds of values", name)),
        remediation=F.when(verdict == "currency", "Strip the symbols and cast to double")
        .when(verdict == "date", "Parse into a timestamp").otherwise("Settle on one representation"),
        columns=F.array(name), rows=hits,
        pct=F.when(verdict == "currency", percent(F.col("currency"), F.col("n"))),
        details={"verdict": verdict, **{s: F.col(s) for s in SHAPES}},
        fix_action=F.concat(
            F.when(verdict == "currency", "clean_numeric_string:").when(verdict == "date", "convert_to_datetime:")
            .otherwise("standardize_types:"), name,
        ),
        seq=F.col("position"), penalty=F.when(verdict == "mixed", 6.0).otherwise(18.0),
    )
    whole = make_issues(
        whole_floats(ctx).filter("as_integer"), CHECKER,
        issue_id=F.concat(F.lit("float_should_be_int_"), name), severity="LOW",
        title=F.format_string("%s holds only %s whole numbers", name, F.col("ndv")),
        remediation="Cast to a nullable integer", columns=F.array(name),
        details={"distinct_values": F.col("ndv")},
        fix_action=F.concat(F.lit("cast_to_int:"), name), seq=F.col("position"), penalty=6.0,
    )
    variants = make_issues(
        variant_shapes(ctx).filter("verdict IS NOT NULL"), CHECKER,
        issue_id=F.concat(F.lit("mixed_types_"), name), severity="HIGH",
        title=F.format_string("%s mixes kinds of values", name), remediation="Settle on one representation", columns=F.array(name),
        details={"verdict": verdict, **{s: F.col(s) for s in VARIANT_SHAPES}},
        fix_action=F.concat(F.lit("standardize_types:"), name), seq=F.col("position"), penalty=6.0,
    )
    return Check(CHECKER, [text, variants, whole], {"columns_audited": len(ctx.names)}, cap=50.0)
