"""Pairwise Pearson correlation in tiles of columns, without shuffling rows.

The columns' means are known from an earlier scan, so a pair needs only sums of
shifted products.  Sums of single columns are shared by all their pairs: k
complete columns take one sum per pair, not a covariance and two deviations.
Where the shifted sums would cancel (a pair whose common rows lie far from the
column means) the pair is recomputed with Spark's numerically stable aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import TableContext

TILE = 10  # columns per side: a job reads at most 20 columns and holds 100 pairs
MERGERS = 8  # tasks that add up the sums of all others
CANCELLED = 1e-6


@dataclass(frozen=True)
class Variable:
    """A double expression, its mean (None if unknown) and whether it has no nulls."""

    name: str
    value: Column
    mean: float | None
    complete: bool


def correlations(frame: DataFrame, pairs: Sequence[tuple[Variable, Variable]]) -> list[tuple[float, int]]:
    """(r, common rows) per pair; r is 0 where a side is constant."""
    variables = list({v.name: v for pair in pairs for v in pair}.values())
    at = {v.name: i for i, v in enumerate(variables)}
    shifted = [
        (v.value if v.mean is None else v.value - F.lit(v.mean)).alias(f"v{i}") for i, v in enumerate(variables)
    ]
    views = frame.select(*shifted)
    sums: dict[str, None] = {}

    def total(text: str) -> str:
        sums.setdefault(text)
        return text

    recipes = []
    for x, y in pairs:
        a, b = f"v{at[x.name]}", f"v{at[y.name]}"
        seen = [v for v, one in ((a, x), (b, y)) if not one.complete]
        n = total(f"count_if({' AND '.join(f'{v} IS NOT NULL' for v in sorted(seen))})" if seen else "count(1)")
        if x.mean is None or y.mean is None:
            recipes.append([n, total(stable_sql(a, b))])
            continue
        keys = [n]
        for own, other, whole in ((a, b, y.complete), (b, a, x.complete)):
            kept = own if whole else f"CASE WHEN {other} IS NOT NULL THEN {own} END"
            keys += [total(f"sum({kept})"), total(f"sum({own} * {kept})")]
        recipes.append([*keys, total(f"sum({a} * {b})")])

    row = views.selectExpr(*[f"{text} AS m{i}" for i, text in enumerate(sums)]).collect()[0]
    value = dict(zip(sums, row))
    results: list[tuple[float, int]] = []
    again: list[int] = []
    for i, keys in enumerate(recipes):
        found = [value[k] or 0 for k in keys]
        if len(keys) == 2:
            results.append((float(found[1]), int(found[0])))
            continue
        r = from_sums(*found)
        if r is None:
            again.append(i)
        results.append((r or 0.0, int(found[0])))
    if again:
        stable = [f"{stable_sql(f'v{at[pairs[i][0].name]}', f'v{at[pairs[i][1].name]}')} AS r{i}" for i in again]
        raw = frame.select(*[v.value.alias(f"v{i}") for i, v in enumerate(variables)])
        for i, r in zip(again, raw.selectExpr(*stable).collect()[0]):
            results[i] = (float(r), results[i][1])
    return results


def from_sums(n: float, sx: float, qx: float, sy: float, qy: float, p: float) -> float | None:
    """r from sums over the common rows; None where cancellation has eaten the digits."""
    if n == 0 or qx == 0 or qy == 0:
        return 0.0
    vx, vy = qx - sx * sx / n, qy - sy * sy / n
    if not (math.isfinite(vx * vy) and vx > CANCELLED * qx and vy > CANCELLED * qy):
        return None
    return max(-1.0, min(1.0, (p - sx * sy / n) / math.sqrt(vx) / math.sqrt(vy)))


def _product_tools(count: int):
    """Functions for Python workers, nested so that they are shipped by value."""

    def add_up(batches):
        """Per task: sums over common rows of all pairs, four matrices in one row."""
        import numpy as np
        import pyarrow as pa

        total = np.zeros((4, count, count))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, count))
            filled = ~np.isnan(x)
            x, m = np.where(filled, x, 0.0), filled.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(4 * count * count)
        for batch in batches:
            for row in batch["sums"]:
                total += np.frombuffer(row.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return add_up, merge


def product_sums(frame: DataFrame, variables: Sequence[Variable]) -> np.ndarray:
    """(n, sum x, sum x^2, sum x y) over the common rows of every pair, in one scan; [k, i, j] has x = i and y = j."""
    views = frame.select(*[(v.value - F.lit(v.mean)).alias(f"v{i}") for i, v in enumerate(variables)])
    add_up, merge = _product_tools(len(variables))
    parts = views.mapInArrow(add_up, "sums binary")
    # each merging task adds the sums of some tasks, one at a time
    rows = parts.repartition(MERGERS).mapInArrow(merge, "sums binary").collect()
    return sum(np.frombuffer(r["sums"]) for r in rows).reshape(4, len(variables), len(variables))


def stable_sql(a: str, b: str) -> str:
    """Pairwise-complete r that yields 0 for a constant side.

    ``corr`` divides by zero under ANSI mode when a side is constant; the
    regression form guards that case itself and the covariance supplies the sign.
    """
    return f"coalesce(signum(covar_pop({a}, {b})) * sqrt(regr_r2({a}, {b})), 0D)"


def tiles(names: Sequence[str]) -> list[list[tuple[str, str]]]:
    blocks = [names[i:i + TILE] for i in range(0, len(names), TILE)]
    jobs = []
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            pairs = [
                (a, b) for x, a in enumerate(left) for y, b in enumerate(right)
                if left is not right or x < y
            ]
            if pairs:
                jobs.append(pairs)
    return jobs


def variable(ctx: TableContext, name: str) -> Variable:
    s = ctx.stats[name]
    if s.kind == "string":
        return Variable(name, ctx.number(name), s.get("view_mean"), s["numeric_view"] == ctx.count)
    return Variable(name, ctx.number(name), s.get("mean"), s["nulls"] == 0)


def correlate(ctx: TableContext, names: Sequence[str]) -> dict[tuple[str, str], float]:
    """r per unordered pair; null cells drop out pair by pair; constant sides give 0."""
    ctx.scan("nulls", "moments", names=names)
    constant = {n for n in names if ctx.stats[n].get("min") == ctx.stats[n].get("max")}
    cache = ctx.__dict__.setdefault("_pearson", {})
    wide = [v for v in (variable(ctx, n) for n in names if n not in constant) if v.mean is not None]
    if len(names) > TILE and len(wide) > 1:  # several tiles: one scan for all
        n, s, q, p = product_sums(ctx.rows, wide)
        for i, a in enumerate(wide):
            for j in range(i + 1, len(wide)):
                r = from_sums(n[i, j], s[i, j], q[i, j], s[j, i], q[j, i], p[i, j])
                if r is not None:
                    cache.setdefault((a.name, wide[j].name), r)
    for pairs in tiles(names):
        cache.update({p: 0.0 for p in pairs if p not in cache and constant.intersection(p)})
        todo = [p for p in pairs if p not in cache]
        if todo:
            found = correlations(ctx.rows, [(variable(ctx, a), variable(ctx, b)) for a, b in todo])
            cache.update({p: r for p, (r, _) in zip(todo, found)})
    return {p: cache[p] for pairs in tiles(names) for p in pairs}
