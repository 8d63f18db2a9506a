"""One table under audit and the statistics its checks share.

Passes are lazy and run at most once: a scan without shuffle for counts, moments
and text shapes; a frequency aggregate for distinct counts and top values; exact
quantiles; and dependent scans that use the quantiles as literals.  Only numbers
per column reach the driver, never rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import as_number, fold_missing, is_floating, is_sentinel_word, kind_of, looks_currency, looks_date, looks_number, quoted, strip
from .heavy import heavy_values
from .local import local_frame
from .quantiles import BUFFER_LIMIT, exact_quantiles
from .repeats import surplus_rows

# A column whose distinct-count sketch exceeds this has more than 25 distinct
# values for certain: k values fill at most k of the sketch's registers.
SMALL_DOMAIN = 1000
MANY = 1 << 62
TOP_VALUES = 10
COLUMNS_PER_SCAN = 30
#: Measures that generated code doesn't cover: they have a scan of their own, so as not to slow the others.
APART = ("sketch_ndv", "text_examples")
QUARTILES = (0.01, 0.25, 0.5, 0.75, 0.99)
NO_NUMBER = (None, None, None, None, None)


@dataclass
class ColumnStats:
    name: str
    position: int
    kind: str
    floating: bool
    physical_type: str
    values: dict[str, Any] = field(default_factory=dict)

    def __getitem__(self, key: str):
        return self.values[key]

    def get(self, key: str, default=None):
        found = self.values.get(key)
        return default if found is None else found


class TableContext:
    """``frame`` with lazily computed, shared statistics."""

    def __init__(self, frame: DataFrame, target: str | None = None, buffer_limit: int = BUFFER_LIMIT):
        self.frame = frame
        self.spark = frame.sparkSession
        self.target = target if target in frame.columns else None
        self.buffer_limit = buffer_limit
        self.names = list(frame.columns)
        self.stats: dict[str, ColumnStats] = {}
        parts = []
        for i, f in enumerate(frame.schema.fields):
            self.stats[f.name] = ColumnStats(
                f.name, i, kind_of(f.dataType), is_floating(f.dataType), f.dataType.simpleString()
            )
            parts.append(fold_missing(quoted(f.name), f.dataType).alias(f"c{i}"))
        self.rows = frame.select(*parts)  # safe names c0, c1, ...; NaN folded to null
        self._done: set[tuple[str, str]] = set()
        self._count: int | None = None
        self._sparse: int | None = None
        self._repeats: dict[tuple[str, ...], int] = {}

    # ---- columns -------------------------------------------------------------
    def of_kind(self, *kinds: str) -> list[str]:
        return [n for n in self.names if self.stats[n].kind in kinds]

    def column(self, name: str) -> Column:
        return F.col(f"c{self.stats[name].position}")

    def number(self, name: str) -> Column:
        dtype = self.rows.schema[f"c{self.stats[name].position}"].dataType
        return as_number(self.column(name), dtype)

    # ---- pass A: one scan, no shuffle ---------------------------------------
    # A measure is SQL text over a projection that gives, per column i, the value
    # c{i}, its double view x{i} and, for text, the stripped form s{i} and what it
    # looks like (number p{i}, date d{i}, sentinel word w{i}): each is computed once
    # per row however many measures use it.
    def _measures(self, name: str, group: str) -> dict[str, str]:
        stats = self.stats[name]
        i, kind = stats.position, stats.kind
        # count(CASE ...) and not count_if, which with IN ran ten times longer than a sum of CASE
        if group == "nulls":
            found = {"non_null": f"count(c{i})"}
            if kind == "string":
                found["blanks"] = f"count(CASE WHEN s{i} = '' THEN 1 END)"
            return found
        if group == "domain":
            return {} if kind == "other" else {"sketch_ndv": f"approx_count_distinct(c{i})"}
        if group == "moments" and kind in ("numeric", "boolean"):
            return {"min": f"min(x{i})", "max": f"max(x{i})", "mean": f"avg(x{i})", "std": f"stddev_samp(x{i})"}
        if group == "whole" and stats.floating:
            return {"whole": f"bool_and(c{i} = floor(c{i}))"}
        if group == "shapes" and kind == "string":
            boolean = f"lower(s{i}) IN ('true', 'false')"
            return {
                "currency": f"count(CASE WHEN y{i} THEN 1 END)",
                "dates": f"count(CASE WHEN d{i} THEN 1 END)",
                "numbers": f"count(CASE WHEN p{i} THEN 1 END)",
                "booleans": f"count(CASE WHEN {boolean} THEN 1 END)",
                "words": f"count(CASE WHEN NOT (p{i} OR d{i} OR {boolean}) AND s{i} <> '' THEN 1 END)",
            }
        if group == "variants" and stats.physical_type == "variant":
            # the type of each value; a JSON null is a void and counts for no class
            shape = f"schema_of_variant(c{i})"
            return {
                "numbers": f"count(CASE WHEN {shape} RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)' THEN 1 END)", "booleans": f"count(CASE WHEN {shape} = 'BOOLEAN' THEN 1 END)",
                "words": f"count(CASE WHEN {shape} = 'STRING' THEN 1 END)", "dates": f"count(CASE WHEN {shape} RLIKE '^(DATE|TIMESTAMP)' THEN 1 END)",
                "objects": f"count(CASE WHEN {shape} RLIKE '^OBJECT' THEN 1 END)", "arrays": f"count(CASE WHEN {shape} RLIKE '^ARRAY' THEN 1 END)",
                "voids": f"count(CASE WHEN {shape} = 'VOID' THEN 1 END)",
            }
        if group == "sentinels" and kind in ("numeric", "string"):
            codes = ", ".join(f"{s}D" for s in fixed.NUMERIC_SENTINELS)
            found = {
                "numeric_view": f"count(x{i})",
                "negatives": f"count(CASE WHEN x{i} < 0 THEN 1 END)",
                "over_125": f"count(CASE WHEN x{i} > 125 THEN 1 END)",
                "code_hits": f"count(CASE WHEN x{i} IN ({codes}) THEN 1 END)",
            }
            if kind == "string":
                found["view_mean"] = f"avg(x{i})"
                found["text_hits"] = f"count(CASE WHEN w{i} THEN 1 END)"
            return found
        if group == "examples" and kind == "string":
            # The set is bounded by the spellings of the sentinel words.
            return {"text_examples": f"slice(array_sort(collect_set(CASE WHEN w{i} THEN s{i} END)), 1, 5)"}
        if group == "codes" and kind in ("numeric", "string"):
            hits = ", ".join(f"count(CASE WHEN x{i} = {s}D THEN 1 END)" for s in fixed.NUMERIC_SENTINELS)
            return {"number_hits": f"array({hits})"}
        return {}

    def _looked_at(self, rows: DataFrame, texts: Iterable[Any]) -> DataFrame:
        """Columns c{i} of text with what is read off them: s{i}, p{i}, d{i}, y{i}, w{i}, x{i}."""
        texts = list(texts)
        looks = {"p": looks_number, "d": looks_date, "y": looks_currency, "w": is_sentinel_word}
        rows = rows.select("*", *[strip(F.col(f"c{i}")).alias(f"s{i}") for i in texts])
        rows = rows.select("*", *[test(F.col(f"s{i}")).alias(f"{k}{i}") for i in texts for k, test in looks.items()])
        return rows.select("*", *[F.when(F.col(f"p{i}"), F.col(f"s{i}").try_cast("double")).alias(f"x{i}") for i in texts])

    def _views(self, names: Sequence[str]) -> DataFrame:
        at = {n: self.stats[n].position for n in names}
        numbers = [self.number(n).alias(f"x{at[n]}") for n in names if self.stats[n].kind in ("numeric", "boolean")]
        rows = self.rows.select(*[f"c{i}" for i in at.values()], *numbers)
        return self._looked_at(rows, [at[n] for n in names if self.stats[n].kind == "string"])

    def _stacked(self, names: Sequence[str]) -> DataFrame:
        """(position, c, x) of columns that are all text, or all numbers: code for them is generated once, not once a column.

        A measure of each of a dozen columns in one aggregate ran several times longer.
        """
        places = [str(self.stats[n].position) for n in names]
        if self.stats[names[0]].kind == "string":
            cells = [self.column(n).cast("string").alias(i) for n, i in zip(names, places)]
            return self._looked_at(self.rows.select(*cells).unpivot([], places, "position", "c"), [""])
        cells = [self.number(n).alias(i) for n, i in zip(names, places)]
        return self.rows.select(*cells).unpivot([], places, "position", "c").withColumn("x", F.col("c"))

    def scan(self, *groups: str, names: Iterable[str] | None = None) -> "TableContext":
        """Fill the given measure groups: one scan for all text columns, one for all numbers, one for what is left."""
        names = self.names if names is None else list(names)
        apart: list[tuple[str, str, str]] = []
        alike: dict[tuple, list[str]] = {}  # (text or number, measures) -> columns
        for name in names:
            found: dict[str, str] = {}
            for group in groups:
                if (name, group) in self._done:
                    continue
                self._done.add((name, group))
                found |= self._measures(name, group)
            stats = self.stats[name]
            stack = {k: e for k, e in found.items() if k not in APART and stats.kind in ("string", "numeric", "boolean")}
            if stack:
                alike.setdefault((stats.kind == "string", *stack), []).append(name)
            apart += [(name, k, e) for k, e in found.items() if k not in stack]
        for text in (True, False):
            self._stacked_scan([(part, keys) for (is_text, *keys), part in alike.items() if is_text == text], groups)
        columns = list(dict.fromkeys(name for name, _, _ in apart))
        pending = [columns[i:i + COLUMNS_PER_SCAN] for i in range(0, len(columns), COLUMNS_PER_SCAN)]
        for part in pending or ([[]] if self._count is None else []):
            mine = [job for job in apart if job[0] in set(part)]
            extra = {} if self._count is not None else {"n": "count(1)"}
            if part == self.names and self._sparse is None:
                extra["sparse"] = f"count(CASE WHEN {self._sparse_test()} THEN 1 END)"  # every column is read anyway
            row = self._views(part).selectExpr(
                *[f"{e} AS {k}" for k, e in extra.items()], *[f"{e} AS m{i}" for i, (_, _, e) in enumerate(mine)]
            ).collect()[0]
            if "n" in extra:
                self._count = int(row["n"])
            if "sparse" in extra:
                self._sparse = int(row["sparse"])
            for i, (n, key, _) in enumerate(mine):
                self.stats[n].values[key] = row[f"m{i}"]
        for name in names:
            s = self.stats[name]
            if "non_null" in s.values:
                s.values["nulls"] = self._count - s["non_null"]
                s.values.setdefault("blanks", 0)
                s.values["missing"] = s["nulls"] + s["blanks"]
        return self

    def _stacked_scan(self, parts: Sequence[tuple[list[str], list[str]]], groups: Sequence[str]) -> None:
        """Measures of columns that are all text, or all numbers, by one aggregate grouped by column."""
        if not parts:
            return
        names = [n for part, _ in parts for n in part]
        texts: dict[str, str] = {}
        for part, _ in parts:
            i = self.stats[part[0]].position
            for group in groups:
                texts |= {k: re.sub(rf"\b([cxspdyw]){i}\b", r"\1", e) for k, e in self._measures(part[0], group).items() if k not in APART}
        rows = self._stacked(names)
        aggregates = [F.expr(e).alias(f"m{i}") for i, e in enumerate(texts.values())]
        found = {int(r["position"]): r for r in rows.groupBy("position").agg(F.count(F.lit(1)).alias("n"), *aggregates).collect()}
        if not found:  # a table without rows
            empty = rows.limit(0).agg(F.count(F.lit(1)).alias("n"), *aggregates).collect()[0]
            found = {self.stats[n].position: empty for n in names}
        keys = list(texts)
        for part, wanted in parts:
            for n in part:
                row = found[self.stats[n].position]
                self._count = int(row["n"])
                self.stats[n].values.update({k: row[f"m{keys.index(k)}"] for k in wanted})

    @property
    def count(self) -> int:
        if self._count is None:
            self.scan()
        return self._count

    @property
    def sparse_rows(self) -> int:
        """Rows with more than half of their cells null."""
        if self._sparse is None:
            found = self.rows.selectExpr(f"count(CASE WHEN {self._sparse_test()} THEN 1 END)").collect()[0][0] if self.names else 0
            self._sparse = int(found)
        return self._sparse

    def _sparse_test(self) -> str:
        nulls = " + ".join(f"int(c{i} IS NULL)" for i in range(len(self.names)))
        return f"{nulls} > {len(self.names) * 0.5}D"

    # ---- pass B: frequencies -------------------------------------------------
    def frequencies(self, names: Sequence[str]) -> DataFrame:
        """(position, value, cnt) for the given columns; combined before the shuffle."""
        texts = [self.column(n).cast("string").alias(str(self.stats[n].position)) for n in names]
        if len(names) == 1:
            long = self.rows.select(
                F.lit(str(self.stats[names[0]].position)).alias("position"), texts[0].alias("value")
            )
        else:
            long = self.rows.select(*texts).unpivot(
                [], [str(self.stats[n].position) for n in names], "position", "value"
            )
        return long.filter("value IS NOT NULL").groupBy("position", "value").agg(F.count(F.lit(1)).alias("cnt"))

    def distinct(self, names: Iterable[str], tops: bool = False) -> "TableContext":
        """Exact distinct counts, and with ``tops`` the most frequent values."""
        group = "tops" if tops else "ndv"
        names = [
            n for n in names
            if self.stats[n].kind != "other" and (n, group) not in self._done and (n, "tops") not in self._done
        ]
        if not names:
            return self
        self._done.update((n, group) for n in names)
        seen = {int(r["position"]): r for r in self._value_counts(names, tops).collect()}
        for n in names:
            row = seen.get(self.stats[n].position)
            values = self.stats[n].values
            values["ndv"] = int(row["ndv"]) if row else 0
            if tops:
                values["tops"] = [(t["value"], int(t["cnt"])) for t in row["tops"]] if row else []
        return self

    def _value_counts(self, names: Sequence[str], tops: bool) -> DataFrame:
        counted = self.frequencies(names)
        if not tops:
            return counted.groupBy("position").agg(F.count(F.lit(1)).alias("ndv"))
        # Both branches ask for value and count, so they read one and the same shuffle.
        sizes = counted.groupBy("position").agg(F.count("value").alias("ndv"), F.sum("cnt").alias("filled"))
        return sizes.join(top_values(counted, "position", TOP_VALUES), "position", "left")

    def small_domain(self, names: Iterable[str], tops: bool = False) -> "TableContext":
        """Exact distinct counts where they can matter for a threshold up to 25.

        Columns that provably exceed every threshold are marked MANY without the
        shuffle an exact count would need.
        """
        names = [n for n in names if self.stats[n].kind != "other"]
        unknown = [n for n in names if "ndv" not in self.stats[n].values]
        self.scan("domain", names=unknown)
        small = [n for n in names if self.stats[n].get("sketch_ndv", 0) <= SMALL_DOMAIN]
        self.distinct(small, tops=tops)
        for n in unknown:
            self.stats[n].values.setdefault("ndv", MANY)
        return self

    # ---- pass C: quantiles ---------------------------------------------------
    def quantiles(self, names: Iterable[str]) -> "TableContext":
        names = [n for n in names if (n, "quantiles") not in self._done]
        if not names:
            return self
        self._done.update((n, "quantiles") for n in names)
        counts = {}
        texts = [n for n in names if self.stats[n].kind == "string"]
        self.scan("sentinels", names=texts)
        self.scan("nulls", names=names)
        for n in names:
            counts[n] = self.stats[n]["numeric_view" if n in texts else "non_null"]
        found = exact_quantiles(
            self.rows, {n: self.number(n) for n in names}, QUARTILES, counts, self.buffer_limit
        )
        for n in names:
            p01, q1, median, q3, p99 = found[n]
            self.stats[n].values.update(p01=p01, q25=q1, median=median, q75=q3, p99=p99)
        return self

    # ---- pass F: repeated rows ----------------------------------------------
    def repeated_rows(self, names: Sequence[str] | None = None) -> int:
        names = self.names if names is None else names
        key = tuple(f"c{self.stats[n].position}" for n in names)
        if key not in self._repeats:
            self._repeats[key] = int(surplus_rows(self.rows, key).collect()[0][0]) if key else 0
        return self._repeats[key]

    # ---- results -------------------------------------------------------------
    def table(self, names: Iterable[str], fields: dict[str, str]) -> DataFrame:
        """Local table of per-column statistics: position, name, kind and ``fields`` (name -> type)."""
        schema = ", ".join(
            ["position bigint", "`column` string", "kind string", "n bigint", "is_target boolean"]
            + [f"{k} {t}" for k, t in fields.items()]
        )
        rows = [
            {
                "position": s.position, "column": s.name, "kind": s.kind, "n": self.count,
                "is_target": s.name == self.target,
                **{k: None if s.values.get(k) == MANY else s.values.get(k) for k in fields},  # MANY is no count
            }
            for s in (self.stats[n] for n in names)
        ]
        return local_frame(self.spark, rows, schema)


def most_frequent(ctx: TableContext, names: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column as text, the smallest on a tie; columns without values are left out."""
    heavy = heavy_values(ctx.rows, {n: ctx.column(n) for n in names}, 1)
    known = {n: tops[0][0] for n, tops in heavy.items() if tops}
    names = [n for n in names if n not in heavy]
    if not names:
        return known
    counted = ctx.frequencies(names)
    best = counted.groupBy("position").agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("value"))
    return known | {ctx.names[int(r["position"])]: r["value"] for r in best.collect()}


def top_values(counted: DataFrame, group: str, k: int) -> DataFrame:
    """(group, tops): the k most frequent values per group, ties by value.

    The rank filter is pushed below the shuffle (WindowGroupLimit), so a reducer
    sees at most k rows per group and map task.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(F.desc("cnt"), "value")
    best = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    entry = F.struct("place", "value", "cnt")
    return best.groupBy(group).agg(F.array_sort(F.collect_list(entry)).alias("tops"))
