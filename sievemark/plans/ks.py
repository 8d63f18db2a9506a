"""Two-sample Kolmogorov-Smirnov statistic without sorting the samples.

D is the largest gap between two cumulative shares.  Cut points split the values
into cells; one counting scan gives the gap at every cut exactly, and bounds the
gap that could hide inside a cell.  Only cells whose bound exceeds the best gap
known so far are looked into: they are split further while they hold more than
``limit`` rows, and finally resolved value by value with a running sum inside
each cell.  A cut that is itself a heavy value is a cell of its own, so a hot
value never makes a cell large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 63
ACCURACY = 1000


@dataclass
class Cell:
    """Open interval (low, high) with counts before it and inside it, per side."""

    low: float | None
    high: float | None
    before: tuple[int, int]
    inside: tuple[int, int]

    def bound(self, n1: int, n2: int) -> float:
        (a, b), (u, v) = self.before, self.inside
        return max(abs((a + u) / n1 - b / n2), abs(a / n1 - (b + v) / n2))

    def holds(self, value: str) -> str:
        test = f"{value} IS NOT NULL"
        if self.low is not None:
            test += f" AND {value} > double('{self.low!r}')"
        if self.high is not None:
            test += f" AND {value} < double('{self.high!r}')"
        return test


def ks_statistics(
    frame: DataFrame, side: Column, values: Mapping[str, Column], sizes: Mapping[str, tuple[int, int]],
    limit: int = 1_000_000, cuts: int = CUTS,
) -> dict[str, float]:
    """D per name.  ``side`` is 0 for the reference rows and 1 for the current rows."""
    frame = frame.select(side.alias("side"), *[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    values = {n: f"v{i}" for i, n in enumerate(values)}
    best = {n: 0.0 for n in values}
    live = {n: [Cell(None, None, (0, 0), sizes[n])] for n in values if min(sizes[n]) > 0}
    for _ in range(8):
        large = {
            n: [c for c in cells if sum(c.inside) > limit]
            for n, cells in live.items()
        }
        large = {n: cells for n, cells in large.items() if cells}
        if not large:
            break
        split = _split(frame, values, large, cuts)
        for n, pieces in split.items():
            n1, n2 = sizes[n]
            kept = [c for c in live[n] if not any(c is big for big in large[n])]
            for known, cells in pieces:
                best[n] = max([best[n], *(abs(a / n1 - b / n2) for a, b in known)])
                kept += cells
            live[n] = [c for c in kept if c.bound(n1, n2) > best[n]]
    live = {n: cells for n, cells in live.items() if cells}
    for n, gap in _resolve(frame, values, live, sizes).items():
        best[n] = max(best[n], gap)
    return best


def _placed(frame: DataFrame, marks: Mapping[str, Sequence[float]]) -> DataFrame:
    """The frame with ``{v}_at`` per column v: 2 * i between cuts, 2 * i + 1 at cut i, null for nulls.

    A binary search in an array of the cuts, one step a projection, so neither code nor work grows with their number but
    by its logarithm.
    """
    cuts = {v: F.split(F.lit(",".join(repr(float(m)) for m in known)), ",").cast("array<double>") for v, known in marks.items() if known}
    frame = frame.withColumns({f"{v}_at": F.when(F.col(v).isNotNull(), F.lit(0)) for v in marks})
    step = 1 << max((len(known) for known in marks.values()), default=0).bit_length()
    while step := step >> 1:
        upto = lambda v: F.get(cuts[v], F.col(f"{v}_at") + F.lit(step - 1)) <= F.col(v)  # noqa: B023, E731
        frame = frame.withColumns({f"{v}_at": F.col(f"{v}_at") + F.when(upto(v), step).otherwise(0) for v in cuts})
    hit = lambda v: F.get(cuts[v], F.col(f"{v}_at") - 1) == F.col(v)
    return frame.withColumns({f"{v}_at": 2 * F.col(f"{v}_at") - F.when(hit(v), 1).otherwise(0) for v in cuts})


def _long(frame: DataFrame, marks: Mapping[str, Sequence[float]], values: bool) -> DataFrame:
    """(side, name, slot), with ``values`` also v: one row a column, not a cell."""
    own = lambda v: [F.col(v).alias("v")] if values else []
    entries = F.array(*[F.struct(F.lit(v).alias("name"), F.col(f"{v}_at").alias("slot"), *own(v)) for v in marks])
    return _placed(frame, marks).select("side", F.inline(entries)).where("slot IS NOT NULL")


def _edges(cells: Sequence[Cell]) -> tuple[list[float], dict[int, Cell]]:
    """The cells' ends in order, and each cell by its slot between them."""
    edges = sorted({e for c in cells for e in (c.low, c.high) if e is not None})
    place = {e: i for i, e in enumerate(edges)}
    return edges, {2 * (len(edges) if c.high is None else place[c.high]): c for c in cells}


def _in_cells(frame, values, cells: Mapping[str, Sequence[Cell]]) -> tuple[DataFrame, dict[tuple[str, int], tuple[str, Cell]]]:
    """(side, name, slot, v) of the values inside the cells, and what cell (name, slot) is."""
    found = {n: _edges(group) for n, group in cells.items()}
    if sum(map(len, cells.values())) <= CUTS:  # most rows may lie in no such cell: leave them out before they multiply
        frame = frame.filter(" OR ".join(f"({c.holds(values[n])})" for n, group in cells.items() for c in group))
    long = _long(frame, {values[n]: edges for n, (edges, _) in found.items()}, True)
    wanted = " OR ".join(f"(name = '{values[n]}' AND slot IN ({', '.join(map(str, slots))}))" for n, (_, slots) in found.items())
    return long.where(wanted), {(values[n], slot): (n, cell) for n, (_, slots) in found.items() for slot, cell in slots.items()}


def _cut_points(frame, values, cells: Mapping[str, Sequence[Cell]], cuts: int) -> dict[str, list[list[float]]]:
    """Proposed cuts of every cell; a value goes into its own cell's sketch only."""
    grid = ", ".join(f"double('{(i + 1) / (cuts + 1)!r}')" for i in range(cuts))
    long, known = _in_cells(frame, values, cells)
    rows = long.groupBy("name", "slot").agg(F.expr(f"approx_percentile(v, array({grid}), {ACCURACY})").alias("m")).collect()
    found = {id(known[r["name"], r["slot"]][1]): sorted({float(v) for v in r["m"]}) for r in rows}
    return {n: [found.get(id(c), []) for c in group] for n, group in cells.items()}


def _split(frame, values, cells, cuts):
    """Count the cells between new cut points: per name, per old cell, (known gaps, new cells)."""
    points = _cut_points(frame, values, cells, cuts)
    marks = {n: sorted({m for k, c in enumerate(group) for m in (c.low, c.high, *points[n][k]) if m is not None}) for n, group in cells.items()}
    counted = _long(frame, {values[n]: known for n, known in marks.items()}, False).groupBy("name", "slot").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")).collect()
    table = {(r["name"], r["slot"]): (r["a"], r["b"]) for r in counted}
    result: dict[str, list] = {}
    for n, group in cells.items():
        place = {m: i for i, m in enumerate(marks[n])}
        for cell, mine in zip(group, points[n]):
            first = 2 * (0 if cell.low is None else place[cell.low] + 1)
            a, b = cell.before
            known, pieces = [], []
            for slot in range(2 * len(mine) + 1):
                u, v = table.get((values[n], first + slot), (0, 0))
                if slot % 2 == 0 and (u or v):
                    low = mine[slot // 2 - 1] if slot else cell.low
                    high = mine[slot // 2] if slot // 2 < len(mine) else cell.high
                    pieces.append(Cell(low, high, (a, b), (u, v)))
                a, b = a + u, b + v
                known.append((a, b))
            result.setdefault(n, []).append((known, pieces))
    return result


def _resolve(frame, values, live, sizes) -> dict[str, float]:
    """Exact gap inside the remaining cells: value counts, then a running sum per cell."""
    if not live:
        return {}
    from .local import local_frame

    long, known = _in_cells(frame, values, live)
    rows = [
        {"name": name, "slot": slot, "a0": c.before[0], "b0": c.before[1], "n1": sizes[n][0], "n2": sizes[n][1]}
        for (name, slot), (n, c) in known.items()
    ]
    before = local_frame(frame.sparkSession, rows, "name string, slot int, a0 bigint, b0 bigint, n1 bigint, n2 bigint")
    counted = long.groupBy("name", "slot", "v").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    run = Window.partitionBy("name", "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs((F.col("a0") + F.col("ra")) / F.col("n1") - (F.col("b0") + F.col("rb")) / F.col("n2"))
    best = (
        counted.withColumn("ra", F.sum("a").over(run)).withColumn("rb", F.sum("b").over(run))
        .join(F.broadcast(before), ["name", "slot"])  # one row per cell
        .groupBy("name").agg(F.max(gap).alias("gap")).collect()
    )
    names = {v: n for n, v in values.items()}
    return {names[r["name"]]: float(r["gap"]) for r in best}
