"""The most frequent values of columns of any cardinality, without shuffling every value.

A first scan keeps frequent-items sketches of 64-bit hashes: every task combines its own, their size is fixed, and no text
is held.  A second scan counts the candidates exactly, and only they are shuffled.  A sketch never decides: its error is
bounded, so a result stands only if its last value is more frequent than any other value could be, or if the candidates
are all there is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .local import local_frame

#: Hashes a sketch tracks, and candidates taken from it for each column.
TRACKED, CANDIDATES = 10_000, 256
#: Times rows / tracked: above this no value is left out of a sketch.  A sketch has at least 4/3 entries for each tracked
#: hash, errs by at most 3.5 / entries of all rows, and returns what is surely above its error.
SURE = 2 * 3.5 * 0.75


def heavy_values(rows: DataFrame, values: Mapping[str, Column], k: int, tracked: int = TRACKED, candidates: int = CANDIDATES) -> dict[str, list[tuple[str, int]]]:
    """Exact k most frequent values (as text, ties by value) and counts of each column for which that could be proven.

    Nulls are no values; a column without values has an empty list.  A column is left out if its k-th value is too rare
    for a proof: it must be counted in full.  The driver holds ``candidates`` hashes and k values a column.
    """
    if not values:
        return {}
    names = list(values)
    texts = rows.select(*[values[n].cast("string").alias(f"v{i}") for i, n in enumerate(names)])
    hashed = texts.select(*[F.when(F.col(f"v{i}").isNotNull(), F.xxhash64(f"v{i}")).alias(f"h{i}") for i in range(len(names))])
    seen = hashed.agg(F.count(F.lit(1)).alias("n"), *[
        part for i in range(len(names))
        for part in (F.count(f"h{i}").alias(f"n{i}"), F.expr(f"approx_top_k(h{i}, {candidates + 1}, {tracked}) FILTER (WHERE h{i} IS NOT NULL)").alias(f"c{i}"))
    ]).collect()[0]
    error = SURE * seen["n"] / tracked
    chosen, bounds = [], []
    for i in range(len(names)):
        found = seen[f"c{i}"] or []
        rest = found[candidates:]  # a further value is as frequent as the next estimate at most
        bounds.append(max([error, *[c["count"] for c in rest]]))
        chosen += [{"position": i, "h": c["item"]} for c in found[:candidates]]
    picked = local_frame(rows.sparkSession, chosen, "position int, h bigint")
    long = texts.unpivot([], [f"v{i}" for i in range(len(names))], "position", "value").where("value IS NOT NULL")
    long = long.select(F.substring("position", 2, 10).cast("int").alias("position"), "value", F.xxhash64("value").alias("h"))
    counted = long.join(F.broadcast(picked), ["position", "h"], "left_semi").groupBy("position", "value").agg(F.count(F.lit(1)).alias("cnt"))
    order = F.struct((-F.col("cnt")).alias("less"), "value")
    best = counted.groupBy("position").agg(F.sum("cnt").alias("covered"), F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("tops"))
    exact = {r["position"]: r for r in best.collect()}
    result = {}
    for i, n in enumerate(names):
        tops = [(t["value"], -t["less"]) for t in exact[i]["tops"]] if i in exact else []
        complete = (exact[i]["covered"] if i in exact else 0) == seen[f"n{i}"]
        if complete or (len(tops) == k and tops[-1][1] > bounds[i]):
            result[n] = tops
    return result
