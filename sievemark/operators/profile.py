"""Column profiles: counts, inferred type, moments, quantiles, frequent values, histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import percent
from ..plans.context import TableContext
from ..plans.heavy import heavy_values
from ..plans.local import local_frame

SAMPLES, TOP_SHOWN, BINS = 5, 3, 30
COUNTS = {"nulls": "bigint", "non_null": "bigint", "ndv": "bigint"}
NUMBERS = {
    "min": "double", "max": "double", "mean": "double", "median": "double", "std": "double",
    "q25": "double", "q75": "double",
}


def inferred_type(kind: Column, ndv: Column, n: Column) -> Column:
    numeric = kind.isin("numeric", "boolean")
    return (
        F.when(numeric & (ndv <= 2), "boolean / binary")
        .when(numeric & (ndv < 10), "discrete numeric")
        .when(numeric, "continuous numeric")
        .when(kind == "datetime", "datetime")
        .when((ndv == n) & (n > 10), "identifier / key")
        .when((percent(ndv, n) < 5) | (ndv <= 20), "categorical")
        .otherwise("text / object")
    )


def column_counts(ctx: TableContext) -> DataFrame:
    """Nulls, distinct values, their shares, and the inferred type."""
    ctx.scan("nulls").distinct(ctx.names)
    stats = ctx.table(ctx.names, COUNTS)
    ndv, n = F.coalesce("ndv", F.lit(0)), F.col("n")
    return (
        stats.withColumn("ndv", ndv)
        .withColumn("null_pct", percent(F.col("nulls"), n))
        .withColumn("distinct_pct", percent(ndv, n))
        .withColumn("inferred_type", F.when(F.col("kind") != "other", inferred_type(F.col("kind"), ndv, n)).otherwise("nested"))
    )


def numeric_summary(ctx: TableContext) -> DataFrame:
    """Min, max, mean, median, std and quartiles of numeric columns, rounded to 2.

    Rounding to 6 digits first keeps the noise of float sums and of interpolation
    from deciding a tie.
    """
    names = ctx.of_kind("numeric", "boolean")
    ctx.scan("moments", names=names).quantiles(names)
    stats = ctx.table(names, NUMBERS).filter(F.col("min").isNotNull())
    plain = {k: F.coalesce(F.col(k), F.lit(0.0)) if k == "std" else F.col(k) for k in NUMBERS}
    rounded = {k: F.round(F.round(c, 6), 2) for k, c in plain.items()}
    return stats.withColumns(rounded)


def frequent_values(ctx: TableContext, k: int = TOP_SHOWN, kinds=("string", "datetime")) -> DataFrame:
    """The k most frequent values per column, ties by value: column, place, value, cnt."""
    names = ctx.of_kind(*kinds)
    unknown = [n for n in names if "tops" not in ctx.stats[n].values]
    found = heavy_values(ctx.rows, {n: ctx.column(n) for n in unknown}, k)
    ctx.distinct([n for n in unknown if n not in found], tops=True)
    found |= {n: ctx.stats[n]["tops"][:k] for n in names if n not in found}
    rows = [
        {"position": ctx.stats[n].position, "column": n, "place": i + 1, "value": v, "cnt": c}
        for n in names for i, (v, c) in enumerate(found[n])
    ]
    return local_frame(ctx.spark, rows, "position bigint, `column` string, place int, value string, cnt bigint")


def histogram(ctx: TableContext, name: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins between min and max (the maximum falls into the last bin)."""
    ctx.scan("moments", names=[name])
    low, high = ctx.stats[name].get("min"), ctx.stats[name].get("max")
    empty = local_frame(ctx.spark, [], "bin int, bin_start double, bin_end double, cnt bigint")
    if low is None:
        return empty
    width = (high - low) / bins or 1.0
    x = ctx.number(name)
    slot = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counted = ctx.rows.filter(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    every = ctx.spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("bin_start"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"),
    )


def box_summary(ctx: TableContext, names: list[str] | None = None) -> DataFrame:
    """Five-number summary per numeric column."""
    names = names or ctx.of_kind("numeric")
    ctx.scan("moments", names=names).quantiles(names)
    return ctx.table(names, {k: "double" for k in ("min", "q25", "median", "q75", "max")})


def preview(ctx: TableContext, rows: int = 5) -> DataFrame:
    return ctx.frame.limit(rows)


def type_counts(profile: DataFrame) -> DataFrame:
    """One row: how many columns were inferred numeric and categorical."""
    return profile.agg(
        F.count_if(F.contains("inferred_type", F.lit("numeric"))).alias("numeric_columns"),
        F.count_if(F.contains("inferred_type", F.lit("categorical"))).alias("categorical_columns"),
        F.count(F.lit(1)).alias("columns"),
    )


def shape(ctx: TableContext) -> DataFrame:
    return local_frame(
        ctx.spark, [{"total_rows": ctx.count, "total_columns": len(ctx.names)}],
        "total_rows bigint, total_columns bigint",
    )


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Per column: number of issues touching it and their titles."""
    touched = issues.select(F.explode("affected_columns").alias("column"), "severity", "title", "checker_id", "seq")
    label = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("title"))
    listed = F.array_sort(F.collect_list(F.struct("checker_id", "seq", label.alias("label"))))
    return touched.groupBy("column").agg(
        F.count(F.lit(1)).alias("issues_count"), F.transform(listed, lambda e: e["label"]).alias("issues")
    )


def profile(ctx: TableContext, issues: DataFrame | None = None) -> DataFrame:
    """One row per column with everything above."""
    ctx.distinct(ctx.names, tops=True)
    facts = column_counts(ctx)
    for n in ctx.names:
        tops = ctx.stats[n].get("tops") or []
        numeric = ctx.stats[n].kind in ("numeric", "boolean")
        ctx.stats[n].values["samples"] = [v for v, _ in tops[:SAMPLES]]
        ctx.stats[n].values["top_values"] = {} if numeric else {v: str(c) for v, c in tops[:TOP_SHOWN]}
        ctx.stats[n].values["dtype"] = ctx.stats[n].physical_type
    extra = ctx.table(
        ctx.names, {"dtype": "string", "samples": "array<string>", "top_values": "map<string,string>"}
    ).select("position", F.col("dtype").alias("physical_type"), "samples", "top_values")
    wide = facts.join(extra, "position").join(numeric_summary(ctx).select("position", *NUMBERS), "position", "left")
    if issues is None:
        return wide.withColumn("issues_count", F.lit(0).cast("bigint")).withColumn(
            "issues", F.array().cast("array<string>")
        )
    joined = wide.join(issue_rollup(issues), "column", "left")
    return joined.withColumn("issues_count", F.coalesce("issues_count", F.lit(0))).withColumn(
        "issues", F.coalesce("issues", F.array().cast("array<string>"))
    )


def distribution(ctx: TableContext, name: str) -> DataFrame:
    """Histogram of a numeric column or the ten most frequent values of another."""
    if ctx.stats[name].kind in ("numeric", "boolean"):
        return histogram(ctx, name)
    kind = ctx.stats[name].kind
    return frequent_values(ctx, 10, (kind,)).filter(F.col("column") == name)

