"""Before/after model benchmark with pyspark.ml: does the repair help a baseline model?"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import fold_missing, kind_of, quoted
from ..plans.context import TableContext, most_frequent
from ..plans.local import durable, local_frame, stored
from ..plans.quantiles import exact_quantiles
from ..plans.ranking import dense_codes
from ..plans.strata import drawn, lowest_share
from . import countedtree
from .curves import roc_auc
from .logistic import certificate

SEED = 42
TRAIN_SHARE, HALF_SHARE, SMALL_TABLE = 0.75, 0.5, 50
MAX_CLASSES = 10
#: Beyond so many classes a decision tree is grown by counting; the library's holds a count a class in every bin and row.
DENSE_CLASSES = 100
#: Beyond so many slots vectors are put together without the library's encoders, which describe every slot on the driver.
WIDE = 10_000
#: Codes of at most so many values are broadcast.
FEW_CODES = 100_000
CLASS_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")
VALUE_METRICS = ("r2", "mae", "rmse")


@dataclass
class Fit:
    """Metrics and feature importances of one trained baseline."""

    model: str
    metrics: dict[str, float]
    importances: dict[str, float] = field(default_factory=dict)
    judged_on: str = "test rows"
    #: Largest entry of the penalised loss's gradient at a logistic regression's coefficients.
    steepest: float | None = None


@dataclass
class Benchmark:
    task: str
    binary: bool
    raw: Fit
    clean: Fit
    frame: DataFrame  # any frame, for its session

    def table(self) -> DataFrame:
        """(metric, raw, clean, uplift)."""
        rows = [
            {"metric": k, "raw": self.raw.metrics.get(k, 0.0), "clean": v,
             "uplift": round(v - self.raw.metrics.get(k, 0.0), 4), "judged_on": self.clean.judged_on}
            for k, v in self.clean.metrics.items()
        ]
        return local_frame(self.frame.sparkSession, rows, "metric string, raw double, clean double, uplift double, judged_on string")

    def top_features(self, k: int = 10) -> DataFrame:
        """(feature, importance) of the model trained on the clean table."""
        rows = [{"feature": n, "importance": v} for n, v in self.clean.importances.items()]
        frame = local_frame(self.frame.sparkSession, rows, "feature string, importance double")
        return frame.orderBy(F.desc("importance"), "feature").limit(k)

    def summary(self) -> str:
        gains = ", ".join(f"{k} {v - self.raw.metrics.get(k, 0.0):+.4f}" for k, v in self.clean.metrics.items())
        return f"{self.clean.model}, clean against raw: {gains}"


def detect_task(frame: DataFrame, target: str) -> tuple[str, bool]:
    """(classification | regression, is binary): text or up to ten values is classification."""
    ctx = TableContext(frame.select(quoted(target)))
    ctx.small_domain([target])
    levels = ctx.stats[target].get("ndv", 0)
    if levels == 0:
        return "classification", True
    if ctx.stats[target].kind not in ("numeric", "boolean") or levels <= MAX_CLASSES:
        return "classification", levels == 2
    return "regression", False


def split(rows: DataFrame, label: str, share: float = TRAIN_SHARE) -> DataFrame:
    """The rows with ``train``: true for exactly floor(share * n + 0.5) rows of each class of n, drawn by content.

    ``label`` names the classes; one constant gives a plain split.
    """
    ready = drawn(rows, [quoted(c) for c in rows.columns], SEED)
    return lowest_share(ready, label, share).withColumnRenamed("chosen", "train")


def numbered_classes(rows: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Alphabetical class numbers in ``label``, and how many there are; the names stay in Spark."""
    codes = durable(dense_codes(rows.select(quoted(label).alias("value"))))
    count = codes.count()
    known = codes.select(F.col("value").alias("_name"), F.col("code").alias("_code"))
    number = F.col("_code").alias(label, metadata={"ml_attr": {"type": "nominal", "num_vals": count}})
    others = [quoted(c) for c in rows.columns if c != label]
    return rows.join(_small(known, count), rows[label] == F.col("_name")).select(*others, number), count


def _small(codes: DataFrame, count: int) -> DataFrame:
    """Codes to join with: broadcast if they are few, so that no frequent value lands in one task."""
    return F.broadcast(codes) if count <= FEW_CODES else codes


def estimator_for(task: str, model: str, rows: int, label_std: float = 1.0):
    """(display name, estimator).

    C = 1 and alpha = 1 correspond to a penalty of 1/n; the linear solver divides its penalty by the label's standard
    deviation, so that is multiplied in.
    """
    if task == "classification":
        if model == "logistic_regression":
            return "Logistic Regression", LogisticRegression(
                maxIter=500, tol=1e-9, regParam=1.0 / max(1, rows), elasticNetParam=0.0, standardization=False)
        if model == "decision_tree":
            return "Decision Tree Classifier", DecisionTreeClassifier(maxDepth=6, seed=SEED)
        return "Random Forest Classifier", RandomForestClassifier(numTrees=50, maxDepth=8, seed=SEED)
    if model == "ridge":
        return "Ridge Regressor", LinearRegression(
            regParam=label_std / max(1, rows), elasticNetParam=0.0, standardization=False)
    if model == "decision_tree":
        return "Decision Tree Regressor", DecisionTreeRegressor(maxDepth=6, seed=SEED)
    return "Random Forest Regressor", RandomForestRegressor(numTrees=50, maxDepth=8, seed=SEED)


class Encoding:
    """One slot a number, then one slot a level of each text column, in alphabetical order.

    The levels of all text columns are numbered by one distributed ranking and joined to the rows; a level that training
    rows don't have gives zeros.  What grows with the levels on the driver is the vector's length, as in every model on
    it, not their names.
    """

    def __init__(self, numbers: Sequence[str], texts: Sequence[str]):
        self.numbers, self.texts = list(numbers), list(texts)

    def fit(self, train: DataFrame) -> Encoded:
        slots = None
        sizes = [0] * len(self.texts)
        if self.texts:
            level = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), quoted(f"t_{c}").alias("level")) for i, c in enumerate(self.texts)]))
            ranks = dense_codes(train.select(level.alias("value")))
            slots = durable(ranks.select(F.col("value.column").alias("column"), F.col("value.level").alias("level"), F.col("code").cast("long").alias("slot")))
            for column, size in slots.groupBy("column").agg(F.count(F.lit(1))).collect():  # one row a text column
                sizes[column] = size
        scaler = None
        if self.numbers:
            scaler = Pipeline(stages=[
                VectorAssembler(inputCols=[f"n_{c}" for c in self.numbers], outputCol="numbers"),
                StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
            ]).fit(train)
        return Encoded(self.numbers, self.texts, sizes, slots, scaler)


class Encoded:
    """A fitted ``Encoding``; ``size`` is the vector's length."""

    def __init__(self, numbers: list[str], texts: list[str], sizes: list[int], slots: DataFrame | None, scaler: PipelineModel | None):
        self.numbers, self.texts, self.sizes, self.slots, self.scaler = numbers, texts, sizes, slots, scaler
        self.size = len(numbers) + sum(sizes)

    def transform(self, rows: DataFrame) -> DataFrame:
        if self.size > WIDE:
            return self._wide(rows)
        kept, inputs, first = rows.columns, [], 0
        if self.scaler is not None:
            rows = self.scaler.transform(rows)
            inputs.append("scaled")
        for i, (c, size) in enumerate(zip(self.texts, self.sizes)):
            known = _small(self.slots.where(F.col("column") == i).select(F.col("level").alias("_level"), (F.col("slot") - first).cast("double").alias("_index")), size)
            index = F.coalesce("_index", F.lit(float(size))).alias(f"i_{i}", metadata={"ml_attr": {"type": "nominal", "num_vals": size + 1}})
            rows = rows.join(known, quoted(f"t_{c}") == F.col("_level"), "left").select(*[quoted(n) for n in rows.columns], index)
            # the last category, a level unknown to training, has no slot
            coder = OneHotEncoder(inputCol=f"i_{i}", outputCol=f"o_{i}", dropLast=True)
            rows = coder.fit(rows.limit(0)).transform(rows)
            rows = rows.withColumn(f"o_{i}", F.col(f"o_{i}").alias(f"o_{i}", metadata={"ml_attr": {"num_attrs": size}}))
            inputs.append(f"o_{i}")
            first += size
        ready = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(rows)
        vector = F.col("features").alias("features", metadata={"ml_attr": {"num_attrs": self.size}})
        return ready.select(*[quoted(n) for n in kept], vector)

    def _wide(self, rows: DataFrame) -> DataFrame:
        """The same vectors, sparse and by Spark's own functions: OneHotEncoder and VectorAssembler make an attribute a slot on the driver."""
        kept = [quoted(n) for n in rows.columns]
        numbers = F.array().cast("array<double>")
        if self.scaler is not None:
            rows = self.scaler.transform(rows)
            numbers = vector_to_array("scaled")
        slots = []
        for i, (c, size) in enumerate(zip(self.texts, self.sizes)):
            place = (F.col("slot") + len(self.numbers)).cast("int").alias(f"s_{i}")
            known = _small(self.slots.where(F.col("column") == i).select(F.col("level").alias("_level"), place), size)
            rows = rows.join(known, quoted(f"t_{c}") == F.col("_level"), "left").drop("_level")
            slots.append(F.col(f"s_{i}"))
        ones = F.array_compact(F.array(*slots))  # a level unknown to training has no slot
        first = F.array(*[F.lit(i) for i in range(len(self.numbers))]).cast("array<int>")
        # a sparse vector as its type's fields; a reader turns them into the type
        vector = F.struct(
            F.lit(0).alias("type"), F.lit(self.size).alias("size"), F.concat(first, ones).alias("indices"),
            F.concat(numbers, F.transform(ones, lambda _: F.lit(1.0))).alias("values"))
        read = F.from_json(F.to_json(F.struct(vector.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))
        return rows.select(*kept, read["v"].alias("features", metadata={"ml_attr": {"num_attrs": self.size}}))

    def names(self, places: Sequence[int]) -> dict[int, str]:
        """Names of a few slots: the column, for a level with the level behind it."""
        found = {i: self.numbers[i] for i in places if i < len(self.numbers)}
        wanted = [int(i) - len(self.numbers) for i in places if i >= len(self.numbers)]
        if wanted:
            for column, level, slot in self.slots.where(F.col("slot").isin(wanted)).select("column", "level", "slot").collect():
                found[slot + len(self.numbers)] = f"{self.texts[column]}_{level}"
        return found


def prepare(train: DataFrame, features: Sequence[str], test: DataFrame | None = None) -> tuple[list[Column], Encoding]:
    """Imputing projection (medians, modes of the training rows) and encoding.

    If ``test`` has all other rows to come, columns without a gap in either need no median or mode.
    """
    ctx = TableContext(train.select(*[quoted(c) for c in features]))
    numbers = [c for c in features if ctx.stats[c].kind == "numeric"]
    others = [c for c in features if ctx.stats[c].kind not in ("numeric", "other")]
    ctx.scan("nulls", names=numbers + others)
    numbers, levels = [[c for c in part if ctx.stats[c]["non_null"] > 0] for part in (numbers, others)]
    gaps = [c for c in numbers + levels if ctx.stats[c]["nulls"] > 0] if test is not None else numbers + levels
    whole = [c for c in numbers + levels if c not in gaps]
    if whole:
        missing = [F.count_if(fold_missing(quoted(c), test.schema[c].dataType).isNull()) for c in whole]
        gaps += [c for c, n in zip(whole, test.agg(*missing).first()) if n]
    holes = [c for c in numbers if c in gaps]
    medians = exact_quantiles(ctx.rows, {c: ctx.number(c) for c in holes}, [0.5], {c: ctx.stats[c]["non_null"] for c in holes}, ctx.buffer_limit)
    columns = []
    for c in numbers:
        value = fold_missing(quoted(c), train.schema[c].dataType).cast("double")
        columns.append((F.coalesce(value, F.lit(medians[c][0])) if c in gaps else value).alias(f"n_{c}"))
    modes = most_frequent(ctx, [c for c in levels if c in gaps])
    for c in levels:
        text = quoted(c).cast("string")
        text = F.coalesce(text, F.lit(modes[c])) if c in gaps else text
        columns.append(F.when(text == "", "(empty)").otherwise(text).alias(f"t_{c}"))  # levels need a name
    return columns, Encoding(numbers, levels)


def importances(model: Transformer, encoded: Encoded) -> dict[str, float]:
    """Feature importance by expanded feature name; slots without any are left out if the vector is sparse."""
    weights = getattr(model, "featureImportances", None)
    if weights is None:
        return {}
    places, values = _sparse(weights)
    names = encoded.names([int(i) for i in places])
    return {names.get(int(i), f"slot_{i}"): round(float(v), 4) for i, v in zip(places, values)}


def _sparse(vector):
    return (vector.indices, vector.values) if hasattr(vector, "indices") else (range(len(vector)), vector)


def class_metrics(scored: DataFrame, binary: bool) -> dict[str, float]:
    """Accuracy and class-weighted precision, recall, F1 from the confusion matrix; ROC-AUC if binary."""
    cells = scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    truth = cells.groupBy(F.col("label").alias("c")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("said"))
    per = truth.join(said, "c", "left").select(
        "support", "hit",
        F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)).alias("p"), (F.col("hit") / F.col("support")).alias("r"),
    ).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    n = F.sum("support")
    row = per.agg(
        (F.sum("hit") / n).alias("accuracy"), (F.sum(F.col("p") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / n).alias("recall"), (F.sum(F.col("f") * F.col("support")) / n).alias("f1"),
    ).collect()[0]
    found = {k: round(float(row[k] or 0.0), 4) for k in CLASS_METRICS[:4]}
    found["roc_auc"] = 0.0
    if binary:
        ranked = scored.select(vector_to_array("rawPrediction")[1].alias("score"), (F.col("label") == 1).alias("positive"))
        found["roc_auc"] = round(roc_auc(ranked), 4)
    return found


def value_metrics(scored: DataFrame) -> dict[str, float]:
    """R2, MAE and RMSE in one aggregate."""
    gap = F.col("label") - F.col("prediction")
    row = scored.agg(
        F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"), F.var_pop("label").alias("var")
    ).collect()[0]
    spread = row["var"] or 0.0
    r2 = 1.0 - row["mse"] / spread if spread else 0.0
    return {"r2": round(r2, 4), "mae": round(row["mae"], 4), "rmse": round(row["mse"] ** 0.5, 4)}


def fit_baseline(frame: DataFrame, target: str, task: str, binary: bool, model: str = "random_forest") -> Fit:
    """Train on about 75% of the rows and score on the rest."""
    y = fold_missing(quoted(target), frame.schema[target].dataType)
    rows = frame.filter(y.isNotNull())
    features = [c for c in frame.columns if c != target and kind_of(frame.schema[c].dataType) != "other"]
    if task == "classification":
        text = y.cast("string")
        if rows.select(text.alias("c")).distinct().limit(2).count() < 2:
            return Fit("Baseline Classifier", {k: 1.0 for k in CLASS_METRICS})
        label = F.when(text == "", "(empty)").otherwise(text)
    else:
        label = y.cast("double")
    rows = rows.select(*[quoted(c) for c in features], label.alias("label"))
    classes = 0
    if task == "classification":
        rows, classes = numbered_classes(rows, "label")
    total = rows.count()
    by_class = rows.withColumn("stratum", F.col("label") if classes else F.lit(0.0))
    halves = stored(split(by_class, "stratum", TRAIN_SHARE if total >= SMALL_TABLE else HALF_SHARE).drop("stratum"))
    if classes:  # columns read back have lost what the estimators need to know of the label
        kept = F.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "num_vals": classes}})
        halves = halves.select(*[quoted(c) for c in features], kept, "train")
    train, test = halves.filter("train"), halves.filter("NOT train")
    judged_on = "test rows"
    if train.isEmpty() or test.isEmpty():
        logging.getLogger(__name__).warning("the split left one side empty: all rows are used for both")
        train, test, judged_on = halves, halves, "training rows"

    columns, encoding = prepare(train, features, test)
    if classes > DENSE_CLASSES and model == "decision_tree":
        return _counted_fit(train, test, columns, encoding, judged_on)
    size, spread = train.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    name, estimator = estimator_for(task, model, size, spread or 1.0)
    inputs = train.select(train["label"], *columns)
    encoded = encoding.fit(inputs)
    ready = encoded.transform(inputs)
    if model != "ridge":  # its two passes read the rows anew; others pass more often, and need the memory for what they keep
        ready.persist(StorageLevel.DISK_ONLY)
    try:
        fitted = estimator.fit(ready)
        scored = fitted.transform(encoded.transform(test.select(test["label"], *columns)))
        kept = ["label", "prediction"] + (["rawPrediction"] if binary and task == "classification" else [])
        scored = scored.select(*kept).persist()
        try:
            found = class_metrics(scored, binary) if task == "classification" else value_metrics(scored)
        finally:
            scored.unpersist()
        fit = Fit(name, found, importances(fitted, encoded), judged_on)
        if model == "logistic_regression" and classes == 2:
            told = fitted.transform(ready).select("features", "label", vector_to_array("probability")[1].alias("p"))
            fit.steepest = certificate(told, fitted.coefficients.toArray(), 1.0 / max(1, size)).steepest
        return fit
    finally:
        ready.unpersist()


def _counted_fit(train: DataFrame, test: DataFrame, columns: Sequence[Column], encoding: Encoding, judged_on: str) -> Fit:
    """A decision tree on many classes, from the columns before they are one-hot encoded."""
    numbers, texts = [f"n_{c}" for c in encoding.numbers], [f"t_{c}" for c in encoding.texts]
    tree = countedtree.grow(train.select("label", *columns), numbers, texts)
    found = class_metrics(test.select("label", *columns).select("label", tree.label().alias("prediction")), False)
    weights = {c[2:] if level is None else f"{c[2:]}_{level}": round(v, 4) for (c, level), v in tree.importances().items()}
    return Fit("Decision Tree Classifier", found, weights, judged_on)


def benchmark(raw: DataFrame, clean: DataFrame, target: str, model: str = "random_forest") -> Benchmark:
    """Train the same baseline on the raw and on the repaired table."""
    for label, frame in (("raw", raw), ("repaired", clean)):
        if target not in frame.columns:
            raise ValueError(f"target {target} is missing from the {label} table")
    task, binary = detect_task(clean, target)
    return Benchmark(
        task, binary, fit_baseline(raw, target, task, binary, model), fit_baseline(clean, target, task, binary, model),
        clean,
    )
