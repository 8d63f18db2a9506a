"""Mergeable distinct counts, types of variant values and the isolation forest's node table."""

import json

from pyspark.sql import functions as F

from sievemark.operators import iforest, types
from sievemark.plans.context import TableContext
from sievemark.plans.local import durable
from sievemark.plans.sketches import distinct_sketches, estimates, largest_error, merged


def test_sketches_of_days_merge(spark):
    made = spark.range(20_000).select(
        (F.col("id") % 7).alias("day"), (F.col("id") % 5000).alias("many"), F.when(F.col("id") % 3 > 0, F.col("id") % 4).alias("few"),
        F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(1.5).alias("x"), F.array("id").alias("nested"))
    parts = distinct_sketches(made, part=F.col("day"))
    assert parts.count() == 7 * 4
    found = {r["column"]: r for r in estimates(merged(parts)).collect()}
    assert set(found) == {"day", "many", "few", "x"}
    assert (found["few"]["distinct"], found["x"]["distinct"], found["day"]["distinct"]) == (4, 1, 7)
    assert found["x"]["non_null"] == 10_000
    assert abs(found["many"]["distinct"] - 5000) <= 5000 * largest_error()
    by_day = {(r["part"], r["column"]): r["distinct"] for r in estimates(parts).collect()}
    assert by_day[("3", "day")] == 1
    assert distinct_sketches(made.where("false")).count() == 0 and distinct_sketches(made.select("nested")).count() == 0


def test_types_of_variant_values(spark):
    values = [1, 2.5, "x", "12", True, None, {"a": 1}, [1]]
    rows = [(json.dumps(v), json.dumps(str(v)), json.dumps(v if isinstance(v, int) else 7)) for v in values] + [(None, None, None)]
    frame = spark.createDataFrame(rows, "a string, b string, c string").select(*[F.parse_json(c).alias(c) for c in "abc"])
    found = {r["column"]: r for r in types.variant_shapes(TableContext(frame)).collect()}
    a = found["a"]
    assert (a["numbers"], a["words"], a["booleans"], a["voids"], a["objects"], a["arrays"], a["non_null"]) == (2, 2, 1, 1, 1, 1, 8)
    assert (a["verdict"], found["b"]["verdict"], found["c"]["verdict"]) == ("mixed", None, "mixed")
    issues = {r["issue_id"] for r in types.check_types(TableContext(frame)).issues.collect()}
    assert issues == {"data_types_mixed_types_a", "data_types_mixed_types_c"}


def test_forest_scores_from_its_node_table(spark):
    made = durable(spark.range(3000).select("id", (F.rand(1) * 10).alias("a"), F.when(F.col("id") % 500 == 0, 90.0).otherwise(F.rand(2)).alias("b"), F.when(F.col("id") % 9 > 0, F.rand(3)).alias("c")))
    ctx = TableContext(made)
    filled, points, plain = iforest.filled_points(ctx, ["a", "b", "c"])
    nodes = durable(iforest.grow_forest(points, ["v0", "v1", "v2"], plain, ctx.count))
    again = iforest.scores_by_table(ctx.rows.select(*filled, ctx.column("id").alias("id")), "id", ["v0", "v1", "v2"], nodes, ctx.count)
    both = iforest.anomaly_scores(ctx, ["a", "b", "c"], ["id"]).join(again.withColumnRenamed("anomaly", "again"), "id")
    assert both.count() == 3000 and both.where("abs(anomaly - again) > 1e-9").count() == 0


def test_rows_meet_every_tree_once_and_are_scored_once(spark):
    """Leaves at several heights: small samples grow trees that end early."""
    frame = spark.range(40).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 13 % 11).cast("double").alias("b"))
    frame = durable(frame)
    ctx = TableContext(frame)
    filled, points, plain = iforest.filled_points(ctx, ["a", "b"])
    nodes = durable(iforest.grow_forest(points, ["v0", "v1"], plain, ctx.count))
    again = iforest.scores_by_table(ctx.rows.select(*filled, ctx.column("id").alias("id")), "id", ["v0", "v1"], nodes, ctx.count)
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    both = iforest.anomaly_scores(ctx, ["a", "b"], ["id"], nodes).join(again.withColumnRenamed("anomaly", "again"), "id")
    assert both.count() == 40 and both.where("abs(anomaly - again) > 1e-9").count() == 0
    scores = iforest.kept_scores(ctx, ["a", "b"])
    assert "ArrowEvalPython" not in scores._jdf.queryExecution().executedPlan().toString()
    one = nodes.toPandas()
    features, cuts, path = iforest.complete_trees(one)
    place = {(r.tree, r.node): r for r in one.itertuples()}
    for tree in range(0, 100, 9):
        for x in ((0.0, 10.0), (6.0, 3.0), (3.5, 0.5)):
            node, at = 0, 0
            while place[tree, node].feature >= 0:
                node = 2 * node + 1 + (x[place[tree, node].feature] > place[tree, node].cut)
            for feature, cut in zip(features, cuts):
                at = 2 * at + (x[feature[tree][at]] > cut[tree][at])
            assert path[tree][at] == place[tree, node].path
