"""Exact splits, ROC curves, logistic certificates, level dictionaries and tree tables against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sievemark.operators import countedtree, curves, logistic, mlbench, treetables
from sievemark.operators.mlbench import Encoding, fit_baseline, numbered_classes, prepare, split
from sievemark.operators.repair import repair
from sievemark.plans import strata
from sievemark.plans.local import ROWS_A_FILE, stored


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("narrow", [4096, 3])
def test_every_class_gives_its_share(spark, monkeypatch, narrow):
    monkeypatch.setattr(strata, "NARROW", narrow)
    rows = [("hot", 1)] * 3000 + [("big", i) for i in range(2001)] + [(f"c{i % 40}", i) for i in range(400)] + [(None, i) for i in range(7)] + [("one", 1)]
    made = frame(spark, rows, "c string, x int")
    for share in (0.75, 0.5, 0.0, 1.0):
        found = split(made, "c", share)
        assert found.columns == ["c", "x", "train"]
        sizes = {}
        for c, _ in rows:
            sizes[c] = sizes.get(c, 0) + 1
        got = {r["c"]: (r["n"], r["t"]) for r in found.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.count_if("train").alias("t")).collect()}
        assert got == {c: (n, math.floor(share * n + 0.5)) for c, n in sizes.items()}
    assert split(made.where("false"), "c").count() == 0


def test_split_depends_on_content_only(spark):
    rows = [(f"c{i % 3}", i) for i in range(3000)]
    one, other = [{tuple(r) for r in split(frame(spark, r, "c string, x int").repartition(k), "c").where("train").select("c", "x").collect()} for r, k in ((rows, 2), (rows[::-1], 5))]
    assert one == other


def plain_auc(pairs):
    pos, neg = [s for s, h in pairs if h], [s for s, h in pairs if not h]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else 0.5


def test_roc_auc_with_ties_and_one_class(spark):
    rng = random.Random(1)
    for scores in ([rng.randint(0, 9) for _ in range(400)], [rng.random() for _ in range(300)], [1.0] * 50):
        pairs = [(float(s), rng.random() < 0.3 + 0.04 * (s if s < 10 else 0)) for s in scores]
        assert curves.roc_auc(frame(spark, pairs, "score double, positive boolean").repartition(3)) == pytest.approx(plain_auc(pairs), abs=1e-12)
    assert curves.roc_auc(frame(spark, [(0.3, True), (0.4, True)], "score double, positive boolean")) == 0.5
    assert curves.roc_auc(frame(spark, [], "score double, positive boolean")) == 0.5
    assert curves.roc_auc(frame(spark, [(None, True), (0.1, False), (0.2, True), (0.3, None)], "score double, positive boolean")) == 1.0


def test_newton_ends_where_the_gradient_is_zero(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3)) * [1, 5, 0.2]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [1.0, -0.3, 2.0] + 0.5)))).astype(float)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    made = frame(spark, [*rows, (None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double")
    weights, intercept, told = logistic.newton(made, [F.col(c) for c in "abc"], F.col("y"), 0.01)
    p = 1 / (1 + np.exp(-(x @ weights + intercept)))
    assert np.abs((p - y) @ x / 500 + 0.01 * np.array(weights)).max() < 1e-9 and abs((p - y).mean()) < 1e-9
    assert told.steepest < 1e-9
    ready = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(made.dropna().withColumnRenamed("y", "label"))
    fitted = LogisticRegression(regParam=0.01, standardization=False, tol=1e-10, maxIter=500).fit(ready)
    scored = fitted.transform(ready).withColumn("p", vector_to_array("probability")[1])
    there = logistic.certificate(scored, fitted.coefficients.toArray(), 0.01)
    assert there.steepest < 1e-6 and there.loss == pytest.approx(told.loss, abs=1e-9)
    off = logistic.certificate(scored.withColumn("p", F.lit(0.5)), [0.0, 0.0, 0.0], 0.01)
    assert off.loss == pytest.approx(math.log(2)) and off.steepest > 0.01


def test_separable_classes_and_constant_features(spark):
    rows = [(float(i), 1.0, float(i >= 50)) for i in range(100)]
    weights, _, told = logistic.newton(frame(spark, rows, "a double, b double, y double"), [F.col("a"), F.col("b")], F.col("y"), 0.01)
    assert told.steepest < 1e-6 and weights[0] > 0


def test_levels_and_classes_are_numbered_in_spark(spark):
    rows = [(f"v{i}", "x" if i % 2 else "y", float(i)) for i in range(300)] + [("v1", None, None), (None, "x", 2.0), ("", "y", 1.0)]
    made = frame(spark, rows, "many string, `odd name.` string, n double")
    columns, encoding = prepare(made, ["many", "odd name.", "n"])
    ready = made.select(*columns)
    encoded = encoding.fit(ready)
    assert encoded.size == 1 + 301 + 2
    out = encoded.transform(ready)
    assert out.columns == [*ready.columns, "features"] and out.count() == len(rows)
    assert all(r["features"].numNonzeros() in (2, 3) for r in out.collect())
    levels = sorted({"(empty)" if r[0] == "" else r[0] for r in rows if r[0] is not None})
    row = out.where("t_many = 'v17'").first()
    assert row["features"][1 + levels.index("v17")] == 1.0
    assert encoded.names([0, 1 + levels.index("v17"), 303]) == {0: "n", 1 + levels.index("v17"): "many_v17", 303: "odd name._y"}
    unknown = encoded.transform(ready.limit(1).withColumn("t_many", F.lit("never seen"))).first()["features"]
    assert all(unknown[i] == 0.0 for i in range(1, 302))
    numbered, count = numbered_classes(made.where("many IS NOT NULL"), "many")
    assert count == 301 and numbered.where("n = 17").first()["many"] == float(sorted({r[0] for r in rows if r[0] is not None}).index("v17"))
    assert Encoding([], []).fit(ready).size == 0


def test_tree_table_walks_and_gains(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    made = frame(spark, [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "row int, a double, b double, label double")
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(made)
    fitted = DecisionTreeClassifier(maxDepth=4, seed=1).fit(ready)
    nodes = treetables.node_table(fitted)
    table = {(r["tree"], r["node"]): r for r in nodes.collect()}
    assert len(table) == fitted.numNodes
    for r in treetables.walk(ready, nodes, 4).collect():
        at = table[(0, 0)]
        while at["feature"] is not None:
            at = table[(0, at["left"] if r["features"][at["feature"]] <= at["cut"] else at["right"])]
        assert r["node"] == at["node"]
    said = {r["row"]: r["p"] for r in fitted.transform(ready).select("row", vector_to_array("probability").alias("p")).collect()}
    for r in treetables.class_shares(treetables.walk(ready, nodes, 4), nodes, "row", 2).collect():
        assert r["probability"] == pytest.approx(said[r["row"]])
    assert all(r["gain"] == pytest.approx(r["again"]) for r in treetables.gains(nodes).collect())


def test_baselines_of_every_kind(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.choice("abc"), i % 2) for i in range(200)]
    made = frame(spark, [(x + y, c, f"k{y}") for x, c, y in rows], "x double, c string, y string")
    for model in ("logistic_regression", "decision_tree"):
        fit = fit_baseline(made, "y", "classification", True, model)
        assert fit.metrics["roc_auc"] > 0.95 and fit.judged_on == "test rows"
    assert fit_baseline(made, "y", "classification", True, "logistic_regression").steepest < 1e-5
    assert fit_baseline(made, "x", "regression", False, "ridge").metrics["r2"] > 0.5
    one_each = frame(spark, [(float(i), f"k{i}") for i in range(6)], "x double, y string")
    assert fit_baseline(one_each, "y", "classification", False, "decision_tree").judged_on == "training rows"
    with pytest.raises(Exception):  # what isn't an empty side is no reason to fall back
        fit_baseline(made.withColumn("x", F.raise_error(F.lit("broken")).cast("double")), "y", "classification", True, "decision_tree")


def test_rows_of_every_stage_in_one_pass(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["p", "q", None]), rng.choice([1.0, float("nan"), None]), rng.randint(0, 3)) for _ in range(400)]
    made = frame(spark, rows, "k int, s string, t double, o int")
    actions = ["drop_exact_duplicates", "drop_target_na:t", "drop_sparse_rows", "drop_duplicates_by_key:k", "drop_duplicates_by_key:s"]
    done = repair(made, actions, "t", order_by=["o", "s", "k"])
    found = [r["rows_after"] for r in done.stage_rows().collect()]
    left = {tuple(None if v != v else v for v in r) for r in rows}
    wanted = [len({repr(r) for r in rows})]
    left = [r for r in left if r[2] is not None]
    wanted.append(len(left))
    left = [r for r in left if sum(v is not None for v in r) >= 2]
    wanted.append(len(left))
    for key in (0, 1):
        first = {}
        for r in sorted(left, key=lambda r: [(r[i] is not None, r[i]) if r[i] is not None else (False, 0) for i in (3, 1, 0)]):
            first.setdefault(r[key], r)
        left = list(first.values())
        wanted.append(len(left))
    assert found == wanted and done.frame.count() == wanted[-1]
    assert [r["rows_after"] for r in repair(made.where("false"), actions, "t", order_by=["o"]).stage_rows().collect()] == [0] * 5


def test_large_classes_are_split_without_being_dealt_by_class(spark, monkeypatch):
    monkeypatch.setattr(strata, "NARROW", 50)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = spark.range(2000).selectExpr("CASE WHEN id < 1500 THEN 'hot' WHEN id < 1900 THEN 'warm' WHEN id < 1990 THEN NULL ELSE concat('k', id % 4) END AS c", "id % 7 AS x")
        found = split(made, "c")
        plan = found._jdf.queryExecution().executedPlan().toString()
        counts = {r["c"]: (r["n"], r["t"]) for r in found.groupBy("c").agg(F.count("*").alias("n"), F.count_if("train").alias("t")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan
    assert counts == {"hot": (1500, 1125), "warm": (400, 300), None: (90, 68), "k0": (2, 2), "k1": (2, 2), "k2": (3, 2), "k3": (3, 2)}


def test_wide_vectors_describe_no_slot_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(mlbench, "OneHotEncoder", None)  # it makes an attribute a slot
    rows = spark.createDataFrame([(float(i), f"a{i:05d}", "even" if i % 2 == 0 else "odd") for i in range(10_500)], "x double, name string, kind string")
    columns, encoding = mlbench.prepare(rows, ["x", "name", "kind"])
    ready = rows.select("x", *columns)
    encoded = encoding.fit(ready)
    extra = ready.limit(1).select(F.lit(0.0).alias("x"), F.lit(5249.5).alias("n_x"), F.lit("new").alias("t_name"), F.lit("odd").alias("t_kind"))
    coded = encoded.transform(ready.unionByName(extra))
    assert len(coded.schema.json()) < 2000
    got = {(r["x"], r["t_name"]): r["features"] for r in coded.where("x < 3").collect()}
    assert encoded.size == 10_503 and all(v.size == 10_503 for v in got.values())
    assert [list(got[i, f"a{i:05.0f}"].indices) for i in (0.0, 1.0, 2.0)] == [[0, 1, 10_501], [0, 2, 10_502], [0, 3, 10_501]]
    assert list(got[0.0, "new"].indices) in ([0, 10_502], [10_502]) and got[0.0, "new"].values[-1] == 1.0
    assert got[1.0, "a00001"].values[0] == pytest.approx((1 - 5249.5) / np.std(np.arange(10_500), ddof=1))


def test_counted_tree_takes_the_best_split_and_any_number_of_classes(spark):
    """Against all splits of the first node by hand, and the library's tree where both can be grown."""
    draw = np.random.default_rng(3)
    data = [(float(draw.integers(0, 12)), float(draw.integers(0, 20)), "abc"[draw.integers(0, 3)]) for _ in range(400)]
    rows = [(float((a > 6) * 4 + (t == "b") * 2 + (b > 15)), a, b, t) for a, b, t in data]
    made = spark.createDataFrame(rows, "label double, a double, b double, t string")
    tree = countedtree.grow(made, ["a", "b"], ["t"], depth=3)

    def gini(labels):
        return 1 - sum((labels.count(v) / len(labels)) ** 2 for v in set(labels))

    def gain(test):
        left, right = [r[0] for r in rows if test(r)], [r[0] for r in rows if not test(r)]
        return gini([r[0] for r in rows]) - (len(left) * gini(left) + len(right) * gini(right)) / len(rows) if left and right else 0

    best = max([gain(lambda r: r[k] < c) for k in (1, 2) for c in range(1, 20)] + [gain(lambda r: r[3] != v) for v in "abc"])
    assert tree.splits[0].gain == pytest.approx(best)
    assert made.where(tree.label() == F.col("label")).count() == 400  # three splits tell all classes apart
    assert sum(tree.importances().values()) == pytest.approx(1.0)
    many = spark.range(3000).selectExpr("concat('c', id % 1500) AS who", "CAST(id % 1500 AS DOUBLE) AS x")
    fit = mlbench.fit_baseline(many, "who", "classification", False, "decision_tree")
    # each class has two rows, both in training, so all rows judge: 64 leaves name 64 of 1,500 classes
    assert fit.judged_on == "training rows" and fit.importances == {"x": 1.0}
    assert 32 / 1500 <= fit.metrics["accuracy"] + 5e-5 and fit.metrics["accuracy"] <= 64 / 1500 + 5e-5


def test_stored_rows_are_dealt_evenly(spark):
    """A task wrote one file of all its rows, which no reader could deal to several tasks."""
    rows = stored(spark.range(0, 300_000, 1, 1))
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 300_000 and rows.distinct().count() == 300_000
    assert len(sizes) >= 4 and max(sizes) <= ROWS_A_FILE


@pytest.mark.parametrize("model, kept", [("ridge", False), ("random_forest", True)])
def test_vectors_take_no_memory_from_the_model(spark, monkeypatch, model, kept):
    rows = spark.range(200).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 7 + 2 * id AS DOUBLE) AS y")
    levels, plain = [], mlbench.estimator_for

    def watched(*given):
        name, estimator = plain(*given)
        fit = estimator.fit
        estimator.fit = lambda ready: levels.append(ready.storageLevel) or fit(ready)
        return name, estimator

    monkeypatch.setattr(mlbench, "estimator_for", watched)
    assert fit_baseline(rows, "y", "regression", False, model).metrics["r2"] > 0.9
    assert [(level.useDisk, level.useMemory) for level in levels] == [(kept, False)]


def test_only_columns_with_gaps_are_looked_at_for_what_fills_them(spark, monkeypatch):
    """Gaps of either side count; what fills them is of the training rows."""
    train = spark.createDataFrame([(float(i), float(i), None if i == 5 else float(i), "a" if i else "b", "c" if i else "d") for i in range(9)], "w double, t double, g double, s string, u string")
    test = spark.createDataFrame([(1.0, None, 2.0, "a", None), (float("nan"), 3.0, 2.0, "", "d")], train.schema)
    asked, plain = [], mlbench.most_frequent
    monkeypatch.setattr(mlbench, "most_frequent", lambda ctx, names: asked.append(list(names)) or plain(ctx, names))
    names = train.columns
    columns, encoding = prepare(train, names, test)
    every, same = prepare(train, names)
    assert asked == [["u"], ["s", "u"]] and (encoding.numbers, encoding.texts) == (same.numbers, same.texts) == (["w", "t", "g"], ["s", "u"])
    for side in (train, test):
        assert side.select(*columns).collect() == side.select(*every).collect()
    assert [tuple(r) for r in test.select(*columns).collect()] == [(1.0, 4.0, 2.0, "a", "c"), (4.0, 3.0, 2.0, "(empty)", "d")]
