"""Repair: ten fixed stages driven by ``verb[:column]`` actions.

Stages that only need the row itself are fused into one projection.  Later
stages look at the outcome of earlier ones (the median after sentinels are gone),
so statistics are gathered at two barriers only: before clipping and before
imputing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.expr import as_number, as_timestamp, fold_missing, is_blank, kind_of, normal_word, quoted
from ..plans.context import TableContext, most_frequent
from ..plans.local import local_frame, stored
from ..plans.quantiles import BUFFER_LIMIT, exact_quantiles
from ..plans.repeats import comparable
from .audit import Report, audit


def split_action(action: str) -> tuple[str, str | None]:
    verb, _, column = action.partition(":")
    return verb, column or None


def plan_actions(
    frame: DataFrame,
    actions: Sequence[str] | None = None,
    target: str | None = None,
    report: Report | None = None,
) -> list[str]:
    """Explicit actions, else the auto-fixable ones of a report, else of a fresh audit."""
    if actions is None:
        report = report or audit(frame, target)
        rows = report.recommendations.filter("auto_fixable AND fix_action IS NOT NULL").orderBy("step")
        actions = [r["fix_action"] for r in rows.select("fix_action").collect()]
    return [a for a in dict.fromkeys(actions) if a]


@dataclass
class Repair:
    """The repaired table, what was done, and the row counts around each row stage."""

    frame: DataFrame
    before: DataFrame
    actions: list[str]
    log: list[dict] = field(default_factory=list)
    #: Row stages: name, column and effect, see ``lost_rows``.
    stages: list[tuple[str, str | None, tuple]] = field(default_factory=list)

    def stats(self) -> DataFrame:
        """One row: shapes before and after.  Runs the repair once."""
        rows_in, rows_out = self.before.count(), self.frame.count()
        row = {
            "initial_rows": rows_in, "initial_columns": len(self.before.columns),
            "cleaned_rows": rows_out, "cleaned_columns": len(self.frame.columns),
            "rows_removed": rows_in - rows_out,
            "columns_removed": len(self.before.columns) - len(self.frame.columns),
            "actions_executed": len(self.log),
        }
        return local_frame(self.frame.sparkSession, [row], ", ".join(f"{k} bigint" for k in row))

    def stage_rows(self) -> DataFrame:
        """Rows left after each row stage, of one pass over the table before the repair.

        Counts instead of an ``Observation``: once a session has used one, Spark
        cannot serialise the summaries of binary ML models in that session.
        """
        schema = "step int, stage string, `column` string, rows_after bigint"
        if not self.stages:
            return local_frame(self.frame.sparkSession, [], schema)
        gone = lost_rows(self.before, [effect for _, _, effect in self.stages]).collect()[0]
        left, rows = gone["n"], []
        for i, (stage, column, _) in enumerate(self.stages):
            left -= gone["lost"][i]
            rows.append({"step": i + 1, "stage": stage, "column": column, "rows_after": left})
        return local_frame(self.frame.sparkSession, rows, schema)

    def log_table(self) -> DataFrame:
        """Stage log: step, stage, column, detail."""
        rows = [{"step": i + 1, **entry} for i, entry in enumerate(self.log)]
        return local_frame(self.frame.sparkSession, rows, "step int, stage string, `column` string, detail string")


def drop_exact_duplicates(frame: DataFrame) -> DataFrame:
    """One copy per distinct row: one shuffle, with repeats combined before it."""
    names = frame.columns
    nested = [n for n in names if kind_of(frame.schema[n].dataType) == "other"]
    if not nested:
        return frame.dropDuplicates() if names else frame
    plain = [n for n in names if n not in nested]
    temp = {f"__k{i}": comparable(frame, n) for i, n in enumerate(nested)}
    reduced = frame.withColumns(temp).dropDuplicates([*plain, *temp])
    return reduced.select(*[quoted(n) for n in names])


def lost_rows(frame: DataFrame, effects: Sequence[tuple]) -> DataFrame:
    """One row: ``n`` and ``lost``, how many rows each stage takes away.

    An effect is ("repeats",), ("filter", condition) or ("first", key, order columns).  Every row carries how many input
    rows it stands for and at which stage those went, so that the stages follow each other in one plan: a filter marks
    rows and shuffles nothing, the others are aggregates combined before their shuffle, whatever the key's skew.
    """
    none = F.array(*[F.lit(0).cast("bigint")] * len(effects))
    rows = frame.select(F.struct(*[quoted(c) for c in frame.columns]).alias("row"), none.alias("lost"), F.lit(True).alias("alive"))
    cell = lambda c: F.col("row").getField(c)

    def at(i: int, n: Column) -> Column:
        return F.array(*[F.lit(0).cast("bigint") if k != i else n for k in range(len(effects))])

    def added(one: Column, other: Column) -> Column:
        return F.zip_with(one, other, lambda x, y: x + y)

    totals = F.array(*[F.sum(F.col("lost")[k]) for k in range(len(effects))])
    for i, (kind, *what) in enumerate(effects):
        if kind == "filter":
            kept = F.coalesce(what[0](cell), F.lit(False))
            rows = rows.select("row", added(F.col("lost"), at(i, (F.col("alive") & ~kept).cast("bigint"))).alias("lost"), (F.col("alive") & kept).alias("alive"))
            continue
        if kind == "repeats":
            flat = rows.select("row.*")
            keys = [(F.to_json(cell(c)) if isinstance(flat.schema[c].dataType, (T.MapType, T.VariantType)) else cell(c)).alias(f"k{j}") for j, c in enumerate(frame.columns)]
            pick = F.first("row")
        else:
            key, order = what
            keys = [cell(key).alias("k0")]
            pick = F.min_by("row", F.struct(*[c for o in order for c in (cell(o).isNotNull(), cell(o))]))
        # rows that are gone already are no repeats of anything; each stays by itself
        lone = F.when(~F.col("alive"), F.monotonically_increasing_id()).alias("lone")
        keys = [F.when(F.col("alive"), k).alias(f"k{j}") for j, k in enumerate(keys)]
        grouped = rows.select("*", *keys, lone).groupBy("alive", "lone", *[f"k{j}" for j in range(len(keys))]).agg(
            pick.alias("row"), totals.alias("lost"), (F.count(F.lit(1)) - 1).alias("more"))
        rows = grouped.select("row", added(F.col("lost"), at(i, F.col("more"))).alias("lost"), "alive")
    left = F.count_if("alive")
    return rows.agg(totals.alias("lost"), left.alias("left")).select(
        (F.aggregate(F.coalesce(F.col("lost"), none), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("bigint"))) + F.col("left")).alias("n"),
        F.transform(F.coalesce(F.col("lost"), none), lambda x: F.coalesce(x, F.lit(0).cast("bigint"))).alias("lost"))


def filled_cells(schema: T.StructType, cell) -> Column:
    return sum((fold_missing(cell(f.name), f.dataType).isNotNull().cast("int") for f in schema.fields), F.lit(0))


def drop_sparse(frame: DataFrame) -> DataFrame:
    """Rows with at least int(half of the columns) non-null cells."""
    need = int(len(frame.columns) * 0.5)
    return frame.filter(filled_cells(frame.schema, quoted) >= need)


def keep_first_by_key(frame: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """The first row per key in the given order; null keys form one group.

    The rank filter is pushed below the shuffle, so a key that holds a third of
    all rows sends one row per map task, not all of them.
    """
    order = Window.partitionBy(quoted(key)).orderBy(*[quoted(c) for c in order_by])
    return frame.withColumn("__place", F.row_number().over(order)).filter("__place = 1").drop("__place")


def null_sentinels(column: Column, dtype, detected: bool = False) -> Column:
    words = fixed.TEXT_SENTINELS if detected else fixed.REPAIR_TEXT_SENTINELS
    codes = fixed.NUMERIC_SENTINELS if detected else fixed.REPAIR_NUMERIC_SENTINELS
    kind = kind_of(dtype)
    if kind == "string":
        bad = normal_word(column).isin(*words)
        return F.when(~(bad | is_blank(column)) if detected else ~bad, column)
    if kind == "numeric":
        return F.when(~column.cast("double").isin(*[float(c) for c in codes]), column)
    return column


def clean_number(column: Column, dtype) -> Column:
    """Drop currency signs, spaces, % and commas, then read as a double."""
    if kind_of(dtype) != "string":
        return as_number(column, dtype)
    bare = F.regexp_replace(column, fixed.CURRENCY_NOISE, "")
    return as_number(bare, dtype)


def clip(column: Column, low: float, high: float) -> Column:
    return F.when(column.isNotNull(), F.greatest(F.least(column, F.lit(high)), F.lit(low)))


def repair(
    frame: DataFrame,
    actions: Sequence[str] | None = None,
    target: str | None = None,
    report: Report | None = None,
    *,
    order_by: Sequence[str] | None = None,
    primary_keys: Sequence[str] = (),
    detected: bool = False,
    day_first: bool = False,
    buffer_limit: int = BUFFER_LIMIT,
) -> Repair:
    """Apply actions in the fixed stage order whatever order they come in.

    ``drop_duplicates_by_key`` found by an audit runs only for ``primary_keys``:
    a name such as ``l_orderkey`` looks like a key but may be a foreign key.  It
    needs ``order_by``, because "first" has no meaning in an unordered table.
    ``detected`` repairs everything the checks detect instead of the default,
    smaller sets.
    """
    explicit = actions is not None
    todo = plan_actions(frame, actions, target, report)
    done = Repair(frame, frame, todo)
    by_verb: dict[str, list[str]] = {}
    for action in todo:
        verb, column = split_action(action)
        by_verb.setdefault(verb, [])
        if column is not None:
            by_verb[verb].append(column)

    def columns_for(verb: str, table: DataFrame) -> list[str]:
        return [c for c in by_verb.get(verb, []) if c in table.columns]

    def note(stage: str, column: str | None = None, detail: str = "") -> None:
        done.log.append({"stage": stage, "column": column, "detail": detail})

    def rows_left(table: DataFrame, effect: tuple, stage: str, column: str | None = None) -> DataFrame:
        done.stages.append((stage, column, effect))
        note(stage, column)
        return table

    out = frame
    # 1-4: rows
    if "drop_exact_duplicates" in by_verb:
        out = rows_left(drop_exact_duplicates(out), ("repeats",), "drop_exact_duplicates")
    for c in columns_for("drop_target_na", out):
        filled = lambda cell, c=c: fold_missing(cell(c), frame.schema[c].dataType).isNotNull()
        out = rows_left(out.filter(filled(quoted)), ("filter", filled), "drop_target_na", c)
    if "drop_sparse_rows" in by_verb:
        dense = lambda cell: filled_cells(frame.schema, cell) >= int(len(frame.columns) * 0.5)
        out = rows_left(drop_sparse(out), ("filter", dense), "drop_sparse_rows")
    for c in columns_for("drop_duplicates_by_key", out):
        if not explicit and c not in primary_keys:
            note("drop_duplicates_by_key", c, "skipped: not named in primary_keys")
            continue
        if not order_by:
            raise ValueError(f"drop_duplicates_by_key:{c} needs order_by to tell which row is first")
        out = rows_left(keep_first_by_key(out, c, order_by), ("first", c, list(order_by)), "drop_duplicates_by_key", c)

    # 5-7: values, each fused into the same projection
    for c in columns_for("replace_sentinels_with_nan", out):
        out = out.withColumn(c, null_sentinels(quoted(c), out.schema[c].dataType, detected))
        note("replace_sentinels_with_nan", c)
    for c in columns_for("sanitize_age_bounds", out):
        x = as_number(quoted(c), out.schema[c].dataType)
        top = 125 if detected else 120
        out = out.withColumn(c, F.when(F.coalesce((x >= 0) & (x <= top), F.lit(True)), quoted(c)))
        note("sanitize_age_bounds", c)
    for c in columns_for("abs_or_nan", out):
        out = out.withColumn(c, F.abs(as_number(quoted(c), out.schema[c].dataType)))
        note("abs_or_nan", c)
    for c in columns_for("clean_numeric_string", out):
        out = out.withColumn(c, clean_number(quoted(c), out.schema[c].dataType))
        note("clean_numeric_string", c)
    layouts = fixed.DATE_LAYOUTS + (
        fixed.DAY_FIRST_LAYOUTS + fixed.MONTH_FIRST_LAYOUTS if day_first
        else fixed.MONTH_FIRST_LAYOUTS + fixed.DAY_FIRST_LAYOUTS
    )
    for c in columns_for("convert_to_datetime", out):
        out = out.withColumn(c, as_timestamp(quoted(c), out.schema[c].dataType, layouts))
        note("convert_to_datetime", c)
    for c in columns_for("cast_to_int", out):
        out = out.withColumn(c, as_number(quoted(c), out.schema[c].dataType).try_cast("bigint"))
        note("cast_to_int", c)

    # 8: clip to the 1st and 99th percentile
    if columns_for("clip_outliers", out) or columns_for("impute", out):
        out = _barrier(out, todo)
    clips = [c for c in columns_for("clip_outliers", out) if kind_of(out.schema[c].dataType) in ("numeric", "string")]
    if clips:
        values = {c: fold_missing_double(out, c) for c in clips}
        counts = dict(zip(clips, out.agg(*[F.count(values[c]) for c in clips]).collect()[0]))
        bounds = exact_quantiles(out, values, [0.01, 0.99], counts, buffer_limit)
        for c in clips:
            if counts[c] > 10:
                low, high = bounds[c]
                out = out.withColumn(c, clip(fold_missing_double(out, c), low, high))
                note("clip_outliers", c, f"[{low:.2f}, {high:.2f}]")

    # 9: impute
    out = _impute(out, columns_for("impute", out), note, detected, buffer_limit)

    # 10: drop columns, never the target
    gone = [c for c in dict.fromkeys(columns_for("drop_column", out)) if c != target]
    if gone:
        out = out.drop(*gone)
        note("drop_column", None, ", ".join(gone))
    done.frame = out
    return done


def fold_missing_double(frame: DataFrame, name: str) -> Column:
    dtype = frame.schema[name].dataType
    return as_number(fold_missing(quoted(name), dtype), dtype)


def _barrier(frame: DataFrame, actions: Sequence[str]) -> DataFrame:
    """Before statistics: keep the result of shuffling row stages instead of redoing them."""
    shuffled = any(split_action(a)[0] in ("drop_exact_duplicates", "drop_duplicates_by_key") for a in actions)
    return stored(frame) if shuffled else frame


def _impute(frame: DataFrame, names: Sequence[str], note, detected: bool, buffer_limit: int) -> DataFrame:
    names = [n for n in names if kind_of(frame.schema[n].dataType) != "other"]
    if not names:
        return frame
    folded = frame.withColumns({n: fold_missing(quoted(n), frame.schema[n].dataType) for n in names})
    if detected:  # blanks were counted as missing, so they are filled as well
        folded = folded.withColumns({
            n: F.when(~is_blank(quoted(n)), quoted(n)) for n in names if kind_of(frame.schema[n].dataType) == "string"
        })
    ctx = TableContext(folded.select(*[quoted(n) for n in names]), buffer_limit=buffer_limit)
    ctx.scan("nulls")
    holes = [n for n in names if ctx.stats[n]["nulls"] > 0]
    numbers = [n for n in holes if ctx.stats[n].kind in ("numeric",)]
    others = [n for n in holes if n not in numbers]
    ctx.quantiles(numbers)
    modes = most_frequent(ctx, others)
    out = folded
    for n in numbers:
        median = ctx.stats[n].get("median")
        if median is None:
            continue
        whole = isinstance(frame.schema[n].dataType.typeName(), str) and frame.schema[n].dataType.typeName() in (
            "byte", "short", "integer", "long")
        value = quoted(n) if not whole or median == int(median) else quoted(n).cast("double")
        fill = F.lit(median) if not whole or median != int(median) else F.lit(int(median)).cast(frame.schema[n].dataType)
        out = out.withColumn(n, F.coalesce(value, fill))
        note("impute", n, f"median {median:.2f}")
    for n in others:
        dtype = frame.schema[n].dataType
        mode = modes.get(n)
        if mode is None:
            if kind_of(dtype) != "string":
                continue
            mode = "Missing"
        out = out.withColumn(n, F.coalesce(quoted(n), F.lit(mode).cast(dtype)))
        note("impute", n, f"mode {mode}")
    return out


def compare_reports(before: Report, after: Report) -> DataFrame:
    from .scoring import compare_dimensions

    return compare_dimensions(before.dimension_scores, after.dimension_scores)
