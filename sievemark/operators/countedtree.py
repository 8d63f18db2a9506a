"""A classification tree for any number of classes, grown by counting in Spark.

``pyspark.ml`` keeps one count a class in every node, bin and prediction; with as many classes as a table has customers that
is more than an executor holds.  Here the counts stay rows: a level of the tree groups its rows by node, feature, bin and
class, and only cells that occur exist.  The driver holds the splits, at most 2 ** depth of them.

The rules are those of the library's trees: Gini impurity, numbers cut at up to 31 quantiles, a text column split into one of
its levels and the rest, every split with a positive gain is taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bucket_sql, quoted

DEPTH, BINS, ACCURACY = 6, 32, 10_000


@dataclass
class Split:
    """Rows of a node go left if number ``feature`` is < ``cut``, or if text ``feature`` isn't ``level``."""

    feature: str
    gain: float
    rows: int
    cut: float | None = None
    level: str | None = None

    def left(self) -> Column:
        value = quoted(self.feature)
        return value < F.lit(self.cut) if self.level is None else value != F.lit(self.level)


@dataclass
class CountedTree:
    """Nodes in heap order: children of node k are 2k + 1 and 2k + 2."""

    splits: dict[int, Split] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def node(self, at: int = 0) -> Column:
        """The leaf a row reaches."""
        split = self.splits.get(at)
        return F.lit(at) if split is None else F.when(split.left(), self.node(2 * at + 1)).otherwise(self.node(2 * at + 2))

    def label(self, at: int = 0) -> Column:
        """The label predicted for a row: the most frequent of its leaf, the lowest of equals."""
        split = self.splits.get(at)
        return F.lit(self.leaves[at]) if split is None else F.when(split.left(), self.label(2 * at + 1)).otherwise(self.label(2 * at + 2))

    def importances(self) -> dict[tuple[str, str | None], float]:
        """Share of the total gain by (feature, level)."""
        found: dict[tuple[str, str | None], float] = {}
        for s in self.splits.values():
            found[s.feature, s.level] = found.get((s.feature, s.level), 0.0) + s.gain * s.rows
        total = sum(found.values())
        return {k: v / total for k, v in found.items()}


def _number_sides(cells: DataFrame) -> DataFrame:
    """(node, place, bin, n, n_left, left, right) from (node, place, label, bin, c): both sides' sums of squared class counts.

    A bin changes the squares of its own classes only, so what it adds is found within a class (at most BINS rows), and
    running sums over a node's bins give both sides.
    """
    upto = F.sum("c").over(Window.partitionBy("node", "place", "label").orderBy("bin"))
    all_ = F.sum("c").over(Window.partitionBy("node", "place", "label"))
    square = lambda x: x.cast("double") * x.cast("double")
    cells = cells.select("node", "place", "label", "bin", "c", upto.alias("u"), all_.alias("t"))
    before, after, rest = F.col("u") - F.col("c"), F.col("u"), F.col("t") - F.col("u")
    grown = cells.groupBy("node", "place", "bin").agg(
        F.sum("c").alias("c"), F.sum(square(after) - square(before)).alias("dl"), F.sum(square(rest) - square(rest + F.col("c"))).alias("dr"))
    node = Window.partitionBy("node", "place")  # at most BINS rows
    return grown.select(
        "node", "place", "bin", F.sum("c").over(node).alias("n"), F.sum("c").over(node.orderBy("bin")).alias("n_left"),
        F.sum("dl").over(node).alias("whole"), F.sum("dl").over(node.orderBy("bin")).alias("left"),
        (F.sum("dl").over(node) + F.sum("dr").over(node.orderBy("bin"))).alias("right"))


def _level_sides(cells: DataFrame, totals: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same from (node, place, label, level, c), for one level on the right and all others on the left."""
    parts = cells.join(totals, ["node", "label"]).groupBy("node", "place", "level").agg(
        F.sum("c").alias("m"), F.sum(F.col("c").cast("double") * F.col("c")).alias("right"), F.sum(F.col("c").cast("double") * F.col("t")).alias("cross"))
    return parts.join(F.broadcast(sizes), "node").select(
        "node", "place", "level", "n", (F.col("n") - F.col("m")).alias("n_left"), "whole", (F.col("whole") - 2 * F.col("cross") + F.col("right")).alias("left"), "right")


def _best(sides: DataFrame, key: str) -> DataFrame:
    """One row a node: its best split and gain; of equal gains the most even split, then the first feature's and lowest place's.

    Where all classes are of one size every split gains the same, and uneven ones would make a chain of leaves of one class.
    """
    n, a = F.col("n").cast("double"), F.col("n_left").cast("double")
    b = n - a
    # n * gini = n - squares / n on either side
    gain = (F.col("left") / a + F.col("right") / b - F.col("whole") / n) / n
    found = sides.where((F.col("n_left") > 0) & (F.col("n_left") < F.col("n"))).withColumn("gain", gain)
    return found.groupBy("node").agg(F.min(F.struct((-F.round("gain", 12)).alias("loss"), F.abs(F.col("n") - 2 * F.col("n_left")).alias("uneven"), "place", F.col(key).alias("key"), "n")).alias("best"))


def grow(rows: DataFrame, numbers: Sequence[str], texts: Sequence[str], label: str = "label", depth: int = DEPTH, bins: int = BINS) -> CountedTree:
    """Tree of the rows' number and text columns, none of them null."""
    tree = CountedTree()
    cuts: dict[str, list[float]] = {}
    if numbers:
        grid = [i / bins for i in range(1, bins)]
        row = rows.agg(*[F.percentile_approx(quoted(c), grid, ACCURACY) for c in numbers], *[F.min(quoted(c)) for c in numbers]).first()
        for i, c in enumerate(numbers):
            cuts[c] = sorted({float(v) for v in row[i] or [] if v > row[len(numbers) + i]})
    coded = rows.select(
        F.col(label).alias("label"), *[quoted(c) for c in [*numbers, *texts]],
        *[F.expr(bucket_sql(f"`{c.replace('`', '``')}`", cuts[c])).alias(f"_b{i}") for i, c in enumerate(numbers)]).persist()
    try:
        waiting = [0]
        for _ in range(depth):
            if not waiting or not (numbers or texts):
                break
            here = coded.withColumn("node", tree.node()).where(F.col("node").isin(waiting))
            waiting = []
            found = []
            if numbers:
                bins_ = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"_b{i}").cast("int").alias("bin")) for i in range(len(numbers))])).alias("e")
                cells = here.select("node", "label", bins_).groupBy("node", "e.place", "label", "e.bin").agg(F.count(F.lit(1)).alias("c"))
                found += [(r["node"], r["best"], False) for r in _best(_number_sides(cells), "bin").collect()]
            if texts:
                levels = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), quoted(c).alias("level")) for i, c in enumerate(texts)])).alias("e")
                cells = here.select("node", "label", levels).groupBy("node", "e.place", "label", "e.level").agg(F.count(F.lit(1)).alias("c"))
                totals = here.groupBy("node", "label").agg(F.count(F.lit(1)).alias("t"))
                sizes = totals.groupBy("node").agg(F.sum("t").alias("n"), F.sum(F.col("t").cast("double") * F.col("t")).alias("whole"))
                found += [(r["node"], r["best"], True) for r in _best(_level_sides(cells, totals, sizes), "level").collect()]
            for node, best, text in sorted(found, key=lambda f: (f[0], f[1]["loss"], f[1]["uneven"], f[2])):
                if node in tree.splits or not -best["loss"] > 0:
                    continue
                if text:
                    tree.splits[node] = Split(texts[best["place"]], -best["loss"], best["n"], level=best["key"])
                else:
                    name = numbers[best["place"]]
                    tree.splits[node] = Split(name, -best["loss"], best["n"], cut=cuts[name][best["key"]])
                waiting += [2 * node + 1, 2 * node + 2]
        counts = coded.groupBy(tree.node().alias("node"), "label").agg(F.count(F.lit(1)).alias("c"))
        leaves = counts.groupBy("node").agg(F.min(F.struct((-F.col("c")).alias("less"), "label")).alias("top"))
        tree.leaves = {r["node"]: float(r["top"]["label"]) for r in leaves.collect()}  # one row a leaf
    finally:
        coded.unpersist()
    return tree
