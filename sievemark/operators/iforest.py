"""Joint anomalies across numeric columns: an isolation forest on Spark.

Each tree needs 256 rows only.  They are picked by a hash of the row's content,
so a rerun picks the same rows.  A row counts as often as it occurs.  Trees
grow in parallel, one task group per tree; the finished forest is a few thousand
nodes and travels to the executors as a broadcast variable for scoring.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.context import TableContext
from ..plans.local import stored
from ..plans.quantiles import exact_quantiles
from ..plans.repeats import row_hash

TREES, SAMPLE, CONTAMINATION = 100, 256, 0.03
NODE_SCHEMA = "tree int, node int, feature int, cut double, path double"


def unit_hash(*columns: Column) -> Column:
    """Content hash spread evenly over [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _tree_tools():
    """The two functions that run in Python workers.

    They are nested so that they are shipped by value: workers need no copy of
    this package.
    """

    def expected_depth(size: float) -> float:
        """Average depth of an unsuccessful search among ``size`` points."""
        if size <= 1:
            return 0.0
        if size == 2:
            return 1.0
        return 2.0 * (math.log(size - 1) + 0.5772156649015329) - 2.0 * (size - 1) / size

    def grow(points: pd.DataFrame) -> pd.DataFrame:
        """One tree in heap order: children of node k are 2k+1 and 2k+2."""
        tree = int(points["tree"].iloc[0])
        ordered = points.sort_values("place")
        data = ordered[[c for c in points.columns if c.startswith("x")]].to_numpy(dtype=float)
        draw = np.random.default_rng(tree)
        deepest = max(1, math.ceil(math.log2(max(2, len(data)))))
        nodes, waiting = [], [(0, data, 0)]
        while waiting:
            node, part, depth = waiting.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= deepest or len(part) <= 1 or not len(usable):
                nodes.append((tree, node, -1, 0.0, depth + expected_depth(len(part))))
                continue
            feature = int(draw.choice(usable))
            cut = float(draw.uniform(low[feature], high[feature]))
            left = part[:, feature] <= cut
            nodes.append((tree, node, feature, cut, 0.0))
            waiting += [(2 * node + 1, part[left], depth + 1), (2 * node + 2, part[~left], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "path"])

    return expected_depth, grow


expected_depth, _grow = _tree_tools()


def grow_forest(points: DataFrame, names: Sequence[str], identity: Sequence[str], count: int) -> DataFrame:
    """Node table of the forest; ``identity`` columns feed the content hash.

    Rows are drawn as often as they occur: a row that stands c times in the table is due c times the sampling rate
    draws, whole ones for certain and the rest by its hash.  Only hashes and counts are shuffled to find the draws, about
    three times what the trees need, whatever the table's size.
    """
    rows = points.withColumn("h", row_hash([F.col(c) for c in identity]))
    due = F.col("copies") * F.lit(3.0 * TREES * SAMPLE / max(1, count))
    draws = F.floor(due) + (unit_hash(F.col("h"), F.lit("pick")) < due - F.floor(due)).cast("int")
    counted = rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).select("h", draws.alias("draws")).filter("draws > 0")
    xs = [F.col(c).alias(f"x{i}") for i, c in enumerate(names)]
    drawn = rows.select("h", *xs).join(F.broadcast(counted), "h").dropDuplicates(["h"])
    spread = drawn.withColumn("turn", F.explode(F.sequence(F.lit(0), (F.col("draws") - 1).cast("int"))))
    # a row's draws go round the trees, so that copies are spread evenly
    spread = spread.withColumn("tree", F.pmod(F.xxhash64("h", F.lit("tree")) + F.col("turn"), F.lit(TREES)).cast("int"))
    order = Window.partitionBy("tree").orderBy(F.xxhash64("h", "turn", "tree"), "h", "turn")
    chosen = spread.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE)
    columns = ["tree", "place"] + [f"x{i}" for i in range(len(names))]
    return chosen.select(*columns).groupBy("tree").applyInPandas(_grow, NODE_SCHEMA)


def filled_points(ctx: TableContext, names: Sequence[str]) -> tuple[list[Column], DataFrame, list[str]]:
    """The forest's inputs (v0, v1, ..., nulls as medians), and the table with them and the columns that tell a row's content."""
    ctx.quantiles(names)
    filled = [
        F.coalesce(ctx.number(n), F.lit(ctx.stats[n].get("median", 0.0))).alias(f"v{i}") for i, n in enumerate(names)
    ]
    plain = [c for n in ctx.names if ctx.stats[n].kind != "other" for c in [f"c{ctx.stats[n].position}"]]
    return filled, ctx.rows.select(*filled, *plain), plain


def scores_by_table(points: DataFrame, row: str, values: Sequence[str], nodes: DataFrame, count: int) -> DataFrame:
    """(row, anomaly) from the forest's node table alone: what ``anomaly_scores`` does in numpy, said in relations.

    One join with a table of one row a tree, its nodes as arrays by their number; a row then goes down a tree by looking
    its node up, so that it meets every tree once and not once a level.  Below a leaf that stands higher than the last level,
    rows go left of an endless cut, so every step is the same.  ``row`` names a column that tells rows apart.
    """
    deepest = math.ceil(math.log2(SAMPLE))
    depth = F.length(F.conv(F.col("node") + 1, 10, 2)) - 1
    lowest = ((F.col("node") + 1) * F.pow(F.lit(2), deepest - depth)).cast("int") - 1
    keyed = lambda test, key, value: F.map_from_entries(F.collect_list(F.when(test, F.struct(key, value))))
    inner = F.col("feature") >= 0
    trees = nodes.groupBy("tree").agg(
        keyed(inner, F.col("node"), F.col("feature")).alias("f"), keyed(inner, F.col("node"), F.col("cut")).alias("c"),
        keyed(~inner, lowest, F.col("path")).alias("p"))
    above, below = F.sequence(F.lit(0), F.lit((1 << deepest) - 2)), F.sequence(F.lit((1 << deepest) - 1), F.lit((2 << deepest) - 2))
    trees = trees.select(
        F.transform(above, lambda i: F.coalesce(F.col("f")[i], F.lit(0))).alias("_feature"),
        F.transform(above, lambda i: F.coalesce(F.col("c")[i], F.lit(math.inf))).alias("_cut"),
        F.transform(below, lambda i: F.coalesce(F.col("p")[i], F.lit(0.0))).alias("_path"))
    here = points.select(row, F.array(*[F.col(v) for v in values]).alias("_x")).crossJoin(F.broadcast(trees)).withColumn("node", F.lit(0))
    for _ in range(deepest):
        right = F.get("_x", F.get("_feature", "node")) > F.get("_cut", "node")
        here = here.withColumn("node", F.when(right, 2 * F.col("node") + 2).otherwise(2 * F.col("node") + 1))
    usual = expected_depth(min(SAMPLE, count)) or 1.0
    path = F.get("_path", F.col("node") - F.lit((1 << deepest) - 1))
    return here.groupBy(row).agg(F.pow(F.lit(2.0), -F.avg(path) / usual).alias("anomaly"))


def complete_trees(nodes: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Every tree filled up to the same depth: features and cuts of each level (tree, place in the level), and leaf paths.

    Below a leaf that stands higher, all rows go left of an endless cut to a leaf with its path.
    """
    at = np.searchsorted(np.sort(nodes["tree"].unique()), nodes["tree"])
    width = int(nodes["node"].max()) + 1
    shape = (int(at.max()) + 1, max(1, 1 << width.bit_length()) - 1)
    feature, cut, path = np.full(shape, -1, dtype=np.intp), np.full(shape, np.inf), np.zeros(shape)
    place = (at, nodes["node"].to_numpy())
    feature[place], path[place] = nodes["feature"], nodes["path"]
    cut[place] = np.where(nodes["feature"] >= 0, nodes["cut"], np.inf)
    features, cuts, first = [], [], 0
    while 2 * first + 1 < shape[1]:
        level = slice(first, 2 * first + 1)
        tree, leaf = np.nonzero(feature[:, level] < 0)
        path[tree, 2 * (leaf + first) + 1] = path[tree, leaf + first]
        features.append(np.maximum(feature[:, level], 0))
        cuts.append(cut[:, level])
        first = 2 * first + 1
    return features, cuts, path[:, first:]


def anomaly_scores(ctx: TableContext, names: Sequence[str], keep: Sequence[str] = (), nodes: DataFrame | None = None) -> DataFrame:
    """Isolation score in (0, 1) per row (column ``anomaly``), plus the kept columns.

    ``nodes`` is the forest of ``grow_forest`` on the same inputs, if it is there already.
    """
    filled, points, plain = filled_points(ctx, names)
    values = [f"v{i}" for i in range(len(names))]
    grown = grow_forest(points, values, plain, ctx.count) if nodes is None else nodes
    usual = expected_depth(min(SAMPLE, ctx.count)) or 1.0
    forest = ctx.spark.sparkContext.broadcast((*complete_trees(grown.toArrow().to_pandas()), usual))

    @F.pandas_udf("double")
    def isolation(point: pd.DataFrame) -> pd.Series:
        features, cuts, path, usual = forest.value
        x = np.ascontiguousarray(point.to_numpy(dtype=float).T)
        size = x.shape[1]
        flat, rows, total = x.ravel(), np.arange(size), np.zeros(size)
        starts = [feature * size for feature in features]  # where the features' values begin
        for t in range(len(path)):
            place = np.zeros(size, dtype=np.intp)  # in the level
            for start, cut in zip(starts, cuts):
                if len(start[t]) == 1:  # all rows are at the root
                    place += x[start[t][0] // size if size else 0] > cut[t][0]
                    continue
                value = start[t].take(place)
                value += rows
                right = flat.take(value) > cut[t].take(place)
                place += place
                place += right
            total += path[t].take(place)
        return pd.Series(np.power(2.0, -total / len(path) / usual))

    kept = [ctx.column(n).alias(n) for n in keep]
    return ctx.rows.select(*kept, isolation(F.struct(*filled)).alias("anomaly"))


def kept_scores(ctx: TableContext, names: Sequence[str]) -> DataFrame:
    """``anomaly_scores``, written once for the passes that follow: each row is scored once."""
    return stored(anomaly_scores(ctx, names))


def joint_anomalies(ctx: TableContext, names: Sequence[str], scores: DataFrame | None = None) -> int:
    """Rows whose score lies above the (1 - contamination) quantile of all scores."""
    scores = kept_scores(ctx, names) if scores is None else scores
    cut = exact_quantiles(scores, {"a": F.col("anomaly")}, [1.0 - CONTAMINATION], {"a": ctx.count}, ctx.buffer_limit)["a"][0]
    return int(scores.filter(F.col("anomaly") > cut).count())
