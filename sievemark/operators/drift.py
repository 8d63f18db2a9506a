"""Drift between two tables: PSI, KS, means, total variation, unseen categories."""

from __future__ import annotations


from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bucket_sql, fold_missing, kind_of, quoted
from ..plans.ks import ks_statistics
from ..plans.local import local_frame, settle
from ..plans.quantiles import BUFFER_LIMIT, exact_quantiles

PSI_BINS, EPSILON, NOVEL_SHOWN, SERIES_TERMS = 10, 1e-4, 10, 9
NUMERIC_ABOVE = 5  # more distinct reference values than this makes a column numeric
SURELY_MANY = 50


def shared_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Common columns in the reference's order."""
    names = [c for c in reference.columns if c in current.columns]
    if not names:
        raise ValueError("the two tables have no column in common")
    return names


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample p-value, first nine terms of the Kolmogorov series."""
    root = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (root + 0.12 + F.lit(0.11) / root) * d
    series = sum(
        (F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam) for k in range(1, SERIES_TERMS + 1)),
        F.lit(0.0),
    )
    return F.when(lam <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


@dataclass
class Drift:
    """Comparison of ``current`` with ``reference``; results are bounded by column count."""

    reference: DataFrame
    current: DataFrame
    buffer_limit: int = BUFFER_LIMIT
    cell_limit: int = 1_000_000

    def __post_init__(self):
        self.names = shared_columns(self.reference, self.current)
        self.spark = self.reference.sparkSession
        self.columns = {n: f"c{i}" for i, n in enumerate(self.names)}

    # ---- one tagged union of both tables, NaN folded to null -----------------
    @cached_property
    def both(self) -> DataFrame:
        def side(frame: DataFrame, tag: int) -> DataFrame:
            parts = []
            for n, safe in self.columns.items():
                c = fold_missing(quoted(n), frame.schema[n].dataType)
                kinds = {kind_of(t.schema[n].dataType) for t in (self.reference, self.current)}
                if kinds <= {"numeric", "boolean"}:
                    c = c.cast("double") if self._common_numeric(n) == "double" else c.cast(self._common_numeric(n))
                elif len({t.schema[n].dataType for t in (self.reference, self.current)}) > 1:
                    c = c.cast("string")
                parts.append(c.alias(safe))
            return frame.select(F.lit(tag).alias("side"), *parts)

        return side(self.reference, 0).unionAll(side(self.current, 1))

    def _common_numeric(self, name: str) -> str:
        """Type both sides share, so that 1 and 1.0 give the same text."""
        kinds = [t.schema[name].dataType for t in (self.reference, self.current)]
        if kinds[0] == kinds[1]:
            return kinds[0].simpleString()
        whole = {"tinyint", "smallint", "int", "bigint"}
        return "bigint" if all(k.simpleString() in whole for k in kinds) else "double"

    @cached_property
    def sizes(self) -> dict[str, tuple[int, int]]:
        """Non-null rows per column and side; also settles row counts, means and numeric routing."""
        numeric = [
            n for n in self.names
            if all(kind_of(t.schema[n].dataType) in ("numeric", "boolean") for t in (self.reference, self.current))
        ]
        measures: dict[tuple, Column] = {("rows", 0): F.count_if(F.col("side") == 0),
                                         ("rows", 1): F.count_if(F.col("side") == 1)}
        for n in self.names:
            for s in (0, 1):
                measures[("n", n, s)] = F.count(F.when(F.col("side") == s, F.col(self.columns[n])))
        for n in numeric:
            x = F.col(self.columns[n]).cast("double")
            for s in (0, 1):
                measures[("mean", n, s)] = F.avg(F.when(F.col("side") == s, x))
            measures[("ndv", n)] = F.approx_count_distinct(F.when(F.col("side") == 0, x))
        row = self.both.agg(*[m.alias(f"m{i}") for i, m in enumerate(measures.values())]).collect()[0]
        self._facts = dict(zip(measures, row))
        unsure = [n for n in numeric if self._facts[("ndv", n)] <= SURELY_MANY]
        # Few sketch registers used: count these exactly, the shuffle is a handful of values.
        if unsure:
            exact = self.both.filter("side = 0").agg(*[
                F.count_distinct(F.col(self.columns[n])).alias(f"d{i}") for i, n in enumerate(unsure)
            ]).collect()[0]
            for i, n in enumerate(unsure):
                self._facts[("ndv", n)] = exact[i]
        self._numeric = [n for n in numeric if self._facts[("ndv", n)] > NUMERIC_ABOVE]
        return {n: (self._facts[("n", n, 0)], self._facts[("n", n, 1)]) for n in self.names}

    @property
    def numeric(self) -> list[str]:
        self.sizes
        return self._numeric

    @property
    def categorical(self) -> list[str]:
        self.sizes
        return [
            n for n in self.names
            if n not in self._numeric and kind_of(self.reference.schema[n].dataType) != "other"
        ]

    @property
    def rows(self) -> tuple[int, int]:
        self.sizes
        return self._facts[("rows", 0)], self._facts[("rows", 1)]

    def _value(self, name: str) -> Column:
        return F.col(self.columns[name]).cast("double")

    # ---- numeric family ------------------------------------------------------
    @cached_property
    def edges(self) -> dict[str, list[float]]:
        """Distinct decile edges of the reference side."""
        grid = [i / PSI_BINS for i in range(PSI_BINS + 1)]
        counts = {n: self.sizes[n][0] for n in self.numeric}
        found = exact_quantiles(
            self.both.filter("side = 0"), {n: self._value(n) for n in self.numeric}, grid, counts, self.buffer_limit
        )
        return {n: sorted({v for v in found[n] if v is not None}) for n in self.numeric}

    @cached_property
    def bins(self) -> DataFrame:
        """(column, bin, expected, actual): rows per decile bin and side, empty bins included."""
        usable = [n for n in self.numeric if len(self.edges[n]) > 1 and min(self.sizes[n]) > 0]
        schema = "`column` string, bin int, expected bigint, actual bigint"
        if not usable:
            return local_frame(self.spark, [], schema)
        slots = {str(i): bucket_sql(f"v{i}", self.edges[n][1:-1]) for i, n in enumerate(usable)}
        values = self.both.select("side", *[self._value(n).alias(f"v{i}") for i, n in enumerate(usable)])
        wide = values.selectExpr("side", *[f"{e} AS `{k}`" for k, e in slots.items()])
        if len(usable) > 1:
            long = wide.unpivot("side", list(slots), "label", "bin")
        else:
            long = wide.select("side", F.lit("0").alias("label"), F.col("0").alias("bin"))
        counted = long.filter("bin IS NOT NULL").groupBy("label", "bin").agg(
            F.count_if(F.col("side") == 0).alias("expected"), F.count_if(F.col("side") == 1).alias("actual")
        )
        found = {(int(r["label"]), r["bin"]): (r["expected"], r["actual"]) for r in counted.collect()}
        rows = [
            {"column": n, "bin": b, "expected": found.get((i, b), (0, 0))[0], "actual": found.get((i, b), (0, 0))[1]}
            for i, n in enumerate(usable) for b in range(len(self.edges[n]) - 1)
        ]
        return local_frame(self.spark, rows, schema)

    @property
    def psi(self) -> DataFrame:
        """(column, psi) rounded to 4."""
        whole = Window.partitionBy("column")

        def share(c: str) -> Column:
            raw = F.col(c) / F.sum(c).over(whole)
            return F.when(raw == 0, EPSILON).otherwise(raw)

        shares = self.bins.withColumn("e", share("expected")).withColumn("a", share("actual"))
        scaled = shares.withColumn("e", F.col("e") / F.sum("e").over(whole)).withColumn(
            "a", F.col("a") / F.sum("a").over(whole)
        )
        term = (F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))
        return scaled.groupBy("column").agg(F.greatest(F.lit(0.0), F.round(F.sum(term), 4)).alias("psi"))

    @cached_property
    def ks(self) -> DataFrame:
        """(column, n_ref, n_cur, ks, p_value), both rounded to 4."""
        sizes = {n: self.sizes[n] for n in self.numeric}
        found = ks_statistics(
            self.both, F.col("side"), {n: self._value(n) for n in self.numeric}, sizes, self.cell_limit
        )
        rows = [
            {"column": n, "n_ref": sizes[n][0], "n_cur": sizes[n][1], "d": found[n]} for n in self.numeric
        ]
        frame = local_frame(self.spark, rows, "`column` string, n_ref bigint, n_cur bigint, d double")
        n1, n2 = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
        empty = (F.col("n_ref") == 0) | (F.col("n_cur") == 0)
        p = F.when(empty, 1.0).otherwise(ks_p_value(F.col("d"), n1, n2))
        return frame.select("column", "n_ref", "n_cur", F.round("d", 4).alias("ks"), F.round(p, 4).alias("p_value"))

    @property
    def means(self) -> DataFrame:
        """(column, mean_ref, mean_cur, mean_diff_pct), unrounded."""
        self.sizes
        rows = [
            {"column": n, "mean_ref": self._facts[("mean", n, 0)] or 0.0,
             "mean_cur": self._facts[("mean", n, 1)] or 0.0} for n in self.numeric
        ]
        frame = local_frame(self.spark, rows, "`column` string, mean_ref double, mean_cur double")
        base = F.abs("mean_ref") + 1e-6
        return frame.withColumn("mean_diff_pct", (F.col("mean_cur") - F.col("mean_ref")) / base * 100)

    @cached_property
    def numeric_columns(self) -> DataFrame:
        ks, psi = F.col("ks"), F.coalesce("psi", F.lit(0.0))
        status = (
            F.when((psi >= 0.25) | ((ks > 0.35) & (F.col("p_value") < 0.01)), "CRITICAL_DRIFT")
            .when((psi >= 0.10) | ((ks > 0.20) & (F.col("p_value") < 0.05)), "MODERATE_DRIFT")
            .otherwise("STABLE")
        )
        joined = self.means.join(self.ks, "column").join(self.psi, "column", "left")
        return settle(joined.select(
            "column", F.lit("numeric").alias("column_type"), status.alias("status"), psi.alias("psi"), "ks", "p_value",
            F.round("mean_ref", 3).alias("mean_ref"), F.round("mean_cur", 3).alias("mean_cur"),
            F.round("mean_diff_pct", 1).alias("mean_diff_pct"),
        ))

    # ---- categorical family --------------------------------------------------
    @property
    def category_counts(self) -> DataFrame:
        """(position, value, a, b): rows per category text and side, one shuffle for all columns."""
        entries = F.array(*[
            F.struct(F.lit(str(self.names.index(n))).alias("position"), F.col(self.columns[n]).cast("string").alias("value"))
            for n in self.categorical
        ])
        long = self.both.select("side", F.inline(entries))
        # Plain counts: count_if is rewritten per use, and then Spark would not share the shuffle.
        return long.filter("value IS NOT NULL").groupBy("position", "value").agg(
            F.count(F.when(F.col("side") == 0, 1)).alias("a"), F.count(F.when(F.col("side") == 1, 1)).alias("b")
        )

    @cached_property
    def categorical_columns(self) -> DataFrame:
        """(column, tvd, novel_count, novel, status); novel lists the first ten unseen values."""
        names = self.categorical
        schema = "`column` string, tvd double, novel_count bigint, novel array<string>"
        rows = []
        if names:
            totals = local_frame(
                self.spark,
                [{"position": str(self.names.index(n)), "n1": self.sizes[n][0], "n2": self.sizes[n][1]} for n in names],
                "position string, n1 bigint, n2 bigint",
            )
            share = lambda c, n: F.coalesce(F.try_divide(F.col(c), F.col(n)), F.lit(0.0))
            counts = self.category_counts
            gaps = counts.join(F.broadcast(totals), "position").groupBy("position").agg(
                (F.sum(F.abs(share("a", "n1") - share("b", "n2"))) * 0.5).alias("tvd"),
                F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("novel_count"),
            )
            order = Window.partitionBy("position").orderBy("value")
            shown = (
                counts.filter("a = 0 AND b > 0").withColumn("place", F.row_number().over(order))
                .filter(F.col("place") <= NOVEL_SHOWN)
                .groupBy("position").agg(F.array_sort(F.collect_list("value")).alias("novel"))
            )
            found = {int(r["position"]): r for r in gaps.join(shown, "position", "left").collect()}
            for n in names:
                r = found.get(self.names.index(n))
                rows.append({
                    "column": n, "tvd": r["tvd"] if r else 0.0, "novel_count": r["novel_count"] if r else 0,
                    "novel": (r["novel"] if r else None) or [],
                })
        tvd, novel = F.col("tvd"), F.col("novel_count")
        status = (
            F.when(((novel > 0) | (tvd > 0.35)) & ((novel >= 3) | (tvd > 0.5)), "CRITICAL_DRIFT")
            .when((novel > 0) | (tvd > 0.35), "MODERATE_DRIFT").otherwise("STABLE")
        )
        return local_frame(self.spark, rows, schema).withColumn("tvd", F.round("tvd", 4)).withColumn("status", status)

    # ---- whole report --------------------------------------------------------
    @cached_property
    def columns_report(self) -> DataFrame:
        """One row per compared column, numeric and categorical."""
        order = local_frame(
            self.spark, [{"position": i, "column": n} for i, n in enumerate(self.names)], "position int, `column` string"
        )
        cats = self.categorical_columns.withColumn("column_type", F.lit("categorical"))
        rows = self.numeric_columns.unionByName(cats, allowMissingColumns=True)
        return settle(order.join(rows, "column"))

    @property
    def report(self) -> DataFrame:
        """One row: sizes, counts per status, overall score and status."""
        points = F.when(F.col("status") == "CRITICAL_DRIFT", 100.0).when(F.col("status") == "MODERATE_DRIFT", 50.0).otherwise(0.0)
        score, worst, middling = F.col("drift_score"), F.col("critical_columns"), F.col("moderate_columns")
        overall = (
            F.when((worst > 0) | (score >= 40), "CRITICAL_DRIFT")
            .when((middling > 0) | (score >= 15), "MODERATE_DRIFT").otherwise("STABLE")
        )
        n1, n2 = self.rows
        return self.columns_report.agg(
            F.count(F.lit(1)).alias("shared_columns"),
            F.round(F.coalesce(F.avg(points), F.lit(0.0)), 1).alias("drift_score"),
            F.count_if(F.col("status") == "CRITICAL_DRIFT").alias("critical_columns"),
            F.count_if(F.col("status") == "MODERATE_DRIFT").alias("moderate_columns"),
            F.count_if(F.col("status") == "STABLE").alias("stable_columns"),
        ).select(F.lit(n1).cast("bigint").alias("reference_rows"), F.lit(n2).cast("bigint").alias("current_rows"), "*",
                 overall.alias("overall_status"))

    @property
    def alerts(self) -> DataFrame:
        """One message per drifting column, in column order; one all-clear row otherwise."""
        numeric = F.format_string("%s: PSI %.3f, KS %.3f, mean %+.1f%%", "column", "psi", "ks", "mean_diff_pct")
        text = F.format_string("%s: total variation %.2f, %d unseen values", "column", "tvd", "novel_count")
        drifting = self.columns_report.filter("status <> 'STABLE'").select(
            "position", "column", "status",
            F.when(F.col("column_type") == "numeric", numeric).otherwise(text).alias("message"),
        )
        clear = drifting.agg(F.count(F.lit(1)).alias("k")).filter("k = 0").select(
            F.lit(-1).alias("position"), F.lit(None).cast("string").alias("column"),
            F.lit("STABLE").alias("status"), F.lit("No column drifts").alias("message"),
        )
        return drifting.unionByName(clear)


def compare(reference: DataFrame, current: DataFrame, **limits) -> Drift:
    """Compare two tables column by column."""
    return Drift(reference, current, **limits)


