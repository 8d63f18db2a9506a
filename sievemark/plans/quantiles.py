"""Exact quantiles of many columns without sorting or shuffling the data.

``percentile`` is exact but keeps every distinct value of a column in one
reducer buffer, so it is used only while the row count bounds that buffer.
Beyond that the wanted ranks are cornered: a fixed-size sketch proposes a narrow
bracket around each rank, one counting scan proves that the rank lies inside it,
and this repeats until a bracket holds at most ``limit`` rows or a single value.
``percentile_disc`` then picks the rank inside the bracket.  Every step is a
map-side aggregate with one output row; the sketch only steers, it never decides
the result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

BUFFER_LIMIT = 1_000_000
SKETCH_ACCURACY = 10_000
EXPRESSIONS_PER_JOB = 120


Rank = tuple[str, int]  # column name, zero-based rank


@dataclass(frozen=True)
class Bracket:
    """Closed value range [low, high] holding ``inside`` rows, ``below`` rows under it."""

    low: float
    high: float
    below: int
    inside: int

    def covers(self, rank: int) -> bool:
        return self.below <= rank < self.below + self.inside


def _row(views: DataFrame, expressions: Sequence[str], weights: Sequence[int] | None = None) -> list:
    """One-row aggregates over few enough expressions that the generated code compiles.

    ``weights`` bound what an expression may hold in the reducer's memory; a job
    takes expressions up to ``BUFFER_LIMIT * 4`` in total.
    """
    values: list = []
    part: list[str] = []
    load = 0
    for i, expression in enumerate(expressions):
        weight = weights[i] if weights else 0
        if part and (len(part) == EXPRESSIONS_PER_JOB or load + weight > BUFFER_LIMIT * 4):
            values.extend(_one_job(views, part))
            part, load = [], 0
        part.append(expression)
        load += weight
    return values + (_one_job(views, part) if part else [])


def _one_job(views: DataFrame, expressions: Sequence[str]) -> list:
    return list(views.selectExpr(*[f"{e} AS m{i}" for i, e in enumerate(expressions)]).collect()[0])


def _double(value: float) -> str:
    return f"double('{float(value)!r}')"


def exact_quantiles(
    frame: DataFrame,
    values: Mapping[str, Column],
    probabilities: Sequence[float],
    counts: Mapping[str, int] | None = None,
    limit: int = BUFFER_LIMIT,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per named double expression (nulls ignored)."""
    names = list(values)
    if not names:
        return {}
    views = frame.select(*[values[n].alias(f"v{i}") for i, n in enumerate(names)])
    at = {n: f"v{i}" for i, n in enumerate(names)}
    if counts is None:
        counts = dict(zip(names, _row(views, [f"count({at[n]})" for n in names])))
    answers: dict[str, list[float | None]] = {
        n: [None] * len(probabilities) for n in names if not counts[n]
    }
    small = [n for n in names if 0 < counts[n] <= limit]
    if small:
        grid = ", ".join(_double(p) for p in probabilities)
        found = _row(views, [f"percentile({at[n]}, array({grid}))" for n in small], [counts[n] for n in small])
        for n, result in zip(small, found):
            answers[n] = [float(v) for v in result]
    large = [n for n in names if n not in answers]
    if large:
        answers.update(_cornered(views, {n: at[n] for n in large}, probabilities, counts, limit))
    return answers


def _cornered(
    views: DataFrame, at: Mapping[str, str], probabilities: Sequence[float], counts: Mapping[str, int], limit: int
) -> dict[str, list[float]]:
    """All columns go through the same few scans together."""
    positions = {n: [p * (counts[n] - 1) for p in probabilities] for n in at}
    wanted = [
        (n, r) for n in at for r in sorted({r for x in positions[n] for r in (math.floor(x), math.ceil(x))})
    ]
    found = _ranks(views, at, wanted, counts, limit)
    answers = {}
    for n in at:
        answers[n] = []
        for x in positions[n]:
            low, high = math.floor(x), math.ceil(x)
            a, b = found[n, low], found[n, high]
            answers[n].append(a if a == b else (high - x) * a + (x - low) * b)
    return answers


def _ranks(
    views: DataFrame, at: Mapping[str, str], wanted: Sequence[Rank], counts: Mapping[str, int], limit: int
) -> dict[Rank, float]:
    ends = _row(views, [e for n in at for e in (f"min({at[n]})", f"max({at[n]})")])
    whole = {n: Bracket(float(ends[2 * i]), float(ends[2 * i + 1]), 0, counts[n]) for i, n in enumerate(at)}
    place = {key: whole[key[0]] for key in wanted}
    slack = 2.0 / SKETCH_ACCURACY
    for _ in range(12):
        todo = [k for k in wanted if place[k].inside > limit and place[k].low < place[k].high]
        if not todo:
            break
        proposals = _propose(views, at, place, todo, slack)
        checks = sorted({(n, *proposals[n, r]) for n, r in todo})
        tested = _row(views, [
            e for n, low, high in checks for e in (
                f"count(CASE WHEN {at[n]} < {_double(low)} THEN 1 END)",
                f"count(CASE WHEN {at[n]} BETWEEN {_double(low)} AND {_double(high)} THEN 1 END)",
            )
        ])
        measured = {
            check: Bracket(check[1], check[2], int(tested[2 * i]), int(tested[2 * i + 1]))
            for i, check in enumerate(checks)
        }
        narrowed = False
        for n, r in todo:
            bracket = measured[(n, *proposals[n, r])]
            if bracket.covers(r) and bracket.inside < place[n, r].inside:
                place[n, r], narrowed = bracket, True
        if not narrowed:
            slack *= 8
    return _pick(views, at, place)


def _shared(place: Mapping[Rank, Bracket], keys: Sequence[Rank]) -> dict[tuple[str, Bracket], list[int]]:
    """Ranks that lie in the same bracket of the same column."""
    groups: dict[tuple[str, Bracket], list[int]] = {}
    for n, r in keys:
        groups.setdefault((n, place[n, r]), []).append(r)
    return groups


def _inside(value: str, bracket: Bracket) -> str:
    return f"CASE WHEN {value} BETWEEN {_double(bracket.low)} AND {_double(bracket.high)} THEN {value} END"


def _propose(views, at, place, todo, slack) -> dict[Rank, tuple[float, float]]:
    groups = _shared(place, todo)
    expressions = []
    for (n, bracket), ranks in groups.items():
        points = []
        for r in ranks:
            centre = (r - bracket.below) / max(1, bracket.inside - 1)
            points += [_double(max(0.0, centre - slack)), _double(min(1.0, centre + slack))]
        expressions.append(
            f"approx_percentile({_inside(at[n], bracket)}, array({', '.join(points)}), {SKETCH_ACCURACY})"
        )
    proposals = {}
    for ((n, _), ranks), cuts in zip(groups.items(), _row(views, expressions)):
        for i, r in enumerate(ranks):
            proposals[n, r] = (float(cuts[2 * i]), float(cuts[2 * i + 1]))
    return proposals


def _pick(views: DataFrame, at: Mapping[str, str], place: Mapping[Rank, Bracket]) -> dict[Rank, float]:
    answers = {k: b.low for k, b in place.items() if b.low == b.high}
    groups = _shared(place, [k for k in place if k not in answers])
    picks = []
    for (n, bracket), ranks in groups.items():
        # The k-th smallest of m values is the first whose cumulative share reaches (k + 1/2) / m.
        shares = ", ".join(_double((r - bracket.below + 0.5) / bracket.inside) for r in ranks)
        picks.append(f"percentile_disc(array({shares})) WITHIN GROUP (ORDER BY {_inside(at[n], bracket)})")
    sizes = [bracket.inside for _, bracket in groups]
    for ((n, _), ranks), found in zip(groups.items(), _row(views, picks, sizes)):
        answers.update({(n, r): float(v) for r, v in zip(ranks, found)})
    return answers
