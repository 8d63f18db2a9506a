"""Centroid clustering of integer vectors, with centroids filtered by an n-simplex projection.

Every vector is measured once against a few pivots; these distances fix an apex over the simplex of the pivots: its
coordinates in the pivots' space and its height above that space.  Between two apexes the straight distance never exceeds
the true one, and with one height mirrored it is never less.  A centroid whose lower bound lies above another's upper
bound can't be the nearest; whatever the bounds leave is compared exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.llm.common import staged, table

#: Below this size of components squared distances of up to 512 components fit 64 bits; beyond it Python's integers are used.
NARROW = 1 << 26
#: Sums are added up in two parts, so that sums of any float's size stay exact.
PART = 60
LARGEST = 1 << 63


def packed(vectors: list[list[int]]) -> np.ndarray:
    """Integer vectors as rows: 64-bit numbers if all are narrow, else Python integers."""
    wide = any(abs(x) >= NARROW for v in vectors for x in v)
    return np.array(vectors, object if wide else np.int64).reshape(len(vectors), -1)


def integers(rows: list[bytes], wide: list[bool], dimensions: int) -> np.ndarray:
    """Vectors from their stored form: little-endian 64-bit numbers, or decimals joined by commas where ``wide``."""
    if not any(wide):
        return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), dimensions)
    return np.array([[int(x) for x in r.split(b",")] if w else np.frombuffer(r, "<i8").tolist() for r, w in zip(rows, wide)], object).reshape(len(rows), dimensions)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    if a.dtype != b.dtype:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(axis=1)


class Simplex:
    """Pivots, and apexes over them.

    The pivots' differences from the first one are turned into an orthonormal base by Gram-Schmidt with the longest
    remainder first, which keeps the simplex well shaped; candidates that add (almost) no height are left out.
    """

    def __init__(self, candidates: np.ndarray, pivots: int):
        points = candidates.astype(np.float64)
        self.points, left = points[:1], points[1:] - points[:1]
        base, chosen = np.zeros((0, points.shape[1])), []
        longest = np.sqrt((left ** 2).sum(axis=1)).max(initial=0)
        while len(chosen) + 1 < min(pivots, points.shape[1]) and len(left):
            heights = np.sqrt((left ** 2).sum(axis=1))
            k = int(heights.argmax())
            if not heights[k] > 1e-3 * longest:
                break
            chosen.append(k)
            base = np.vstack([base, left[k] / heights[k]])
            left = left - np.outer(left @ base[-1], base[-1])
        self.points = np.vstack([points[:1], points[1:][chosen]])
        #: Row i: place of pivot i + 1 in the base, a triangular matrix.
        self.places = (self.points[1:] - self.points[:1]) @ base.T
        self.norms = (self.places ** 2).sum(axis=1)
        self.solve = np.linalg.inv(self.places) if len(self.places) else np.zeros((0, 0))
        #: How much an error of the distances may grow on its way to the coordinates.
        self.growth = 1 + np.abs(self.solve).sum() * (np.abs(self.places).max(initial=0) + 1)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to all pivots."""
        v = vectors.astype(np.float64)
        return np.stack([((v - p) ** 2).sum(axis=1) for p in self.points], axis=1)

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """One row a vector: coordinates in the pivots' space, then the height, both from distances alone."""
        d = self.distances(vectors)
        inside = ((d[:, :1] - d[:, 1:] + self.norms) / 2) @ self.solve.T
        height = np.sqrt(np.maximum(d[:, 0] - (inside ** 2).sum(axis=1), 0))
        return np.concatenate([inside, height[:, None]], axis=1)


def candidates(apexes: np.ndarray, centres: np.ndarray, growth: float) -> np.ndarray:
    """Which centres (columns) may be nearest to which vectors (rows).

    ``slack`` covers what rounding may have done to the squared bounds: if it is large, more centres are compared.
    """
    size = (apexes ** 2).sum(axis=1)[:, None] + (centres ** 2).sum(axis=1)[None, :]
    lower = np.maximum(size - 2 * (apexes @ centres.T), 0)
    upper = lower + 4 * np.outer(apexes[:, -1], centres[:, -1])
    slack = 1e-12 * growth * (size.max(axis=1, keepdims=True) + 1)
    near = ~(lower > upper.min(axis=1, keepdims=True) + slack)  # anything that isn't a number is compared, too
    return near | ~np.isfinite(lower)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centres: np.ndarray, growth: float, measure: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Number of the nearest centroid (ties: the smaller number) and, if ``measure``, the exact squared distance.

    Without ``measure`` a vector with one candidate needs no exact comparison.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        near = candidates(apexes, centres, growth)
    found = near.argmax(axis=1)
    open_ = np.arange(len(vectors)) if measure else np.flatnonzero(near.sum(axis=1) > 1)
    if not len(open_):
        return found, None
    kind = object if vectors.dtype == object or centroids.dtype == object else np.int64
    best = np.full(len(vectors), -1, kind)
    for c in range(len(centroids)):
        rows = open_[near[open_, c]]
        if not len(rows):
            continue
        d = squared(vectors[rows], np.broadcast_to(centroids[c], (len(rows), vectors.shape[1])))
        better = (best[rows] < 0) | (d < best[rows])
        found[rows[better]], best[rows[better]] = c, d[better]
    return found, best if measure else None


def _kept(column: Column, dimensions: int) -> Column:
    inf = F.lit(float("inf"))
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False)))
    return F.coalesce((F.size(column) == dimensions) & finite, F.lit(False))


def _whole(vectors: list[list[float]], scale: float) -> tuple[list[bytes], list[bool]]:
    values = np.array(vectors, np.float64) * scale
    if np.abs(values).max(initial=0) < NARROW - 1:
        return [v.tobytes() for v in np.floor(values).astype("<i8")], [False] * len(vectors)
    rows, wide = [], []
    for v in np.floor(values):
        wide.append(bool(np.abs(v).max(initial=0) >= NARROW - 1))
        rows.append(b",".join(b"%d" % int(x) for x in v) if wide[-1] else v.astype("<i8").tobytes())
    return rows, wide


def _projector(shared):
    """Vectors to integers and apexes; runs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simplex, scale, dimensions = shared
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, wide = _whole(batch["v"].to_pylist(), scale)
            with np.errstate(over="ignore", invalid="ignore"):
                apexes = simplex.apexes(integers(rows, wide, dimensions))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(rows, pa.binary()), pa.array(wide), pa.array([a.tobytes() for a in apexes], pa.binary())], names=["id", "q", "wide", "apex"])

    return run


def _assigner(simplex: Simplex, centroids: np.ndarray, last: bool):
    """A round: per task and centroid, how many vectors it has and their componentwise sums; ``last``: the vectors themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimensions = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), object)
        with np.errstate(over="ignore", invalid="ignore"):
            centres = simplex.apexes(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = integers(batch["q"].to_pylist(), batch["wide"].to_pylist(), dimensions)
            apexes = np.frombuffer(b"".join(batch["apex"].to_pylist()), np.float64).reshape(len(vectors), -1)
            found, distances = nearest(vectors, apexes, centroids, centres, simplex.growth, last)
            if last:
                exact = [d if d < LARGEST else None for d in distances.tolist()]
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, pa.int32()), pa.array(exact, pa.int64())], names=["id", "cluster", "distance"])
                continue
            counts += np.bincount(found, minlength=k)
            for c in np.unique(found):
                sums[c] += vectors[found == c].sum(axis=0)  # narrow parts of a batch fit 64 bits
        if not last:
            used = np.flatnonzero(counts)
            values = sums[used].ravel().tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, dimensions), pa.int32()), pa.array(np.tile(np.arange(dimensions), len(used)), pa.int32()), pa.array(np.repeat(counts[used], dimensions), pa.int64()),
                 pa.array([x & ((1 << PART) - 1) for x in values], pa.decimal128(38)), pa.array([x >> PART for x in values], pa.decimal128(38))],
                names=["cluster", "i", "n", "low", "high"])

    return run


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: float = 1024.0, seed: str = "3:",
                    pivots: int = 16, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """Rows (id, cluster, distance) of the kept vectors, and the final centroids.

    Kept are vectors of exactly ``dimensions`` components, none null, NaN or infinite; a component x counts as
    floor(scale * x).  Centroids start as the ``k`` kept vectors whose sha256 of ``seed`` and id comes first (a null id
    after all others, repeated ids by their components); fewer vectors give fewer centroids, none give an empty result.
    Repeated rows are vectors of their own.  Distances are squared and exact; one that doesn't fit a long is null.

    Driver and broadcast hold k centroids and 64 candidates for pivots, whatever the table's size.  A round is one
    scan of the stored integers and apexes: tasks add up their own vectors, at most k * dimensions numbers leave a task.
    """
    rows = vectors.select(vectors[id].alias("id"), vectors[vector].alias("v"))
    rows = rows.where(_kept(F.col("v"), dimensions)).select("id", F.col("v").cast("array<double>").alias("v"))
    hashed = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = rows.select("id", "v", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(max(k, 64)).collect()
    if not first:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), []
    data, wide = _whole([r["v"] for r in first], scale)
    start = integers(data, wide, dimensions)
    with np.errstate(over="ignore", invalid="ignore"):
        simplex = Simplex(start, pivots)
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("q", T.BinaryType()), T.StructField("wide", T.BooleanType()), T.StructField("apex", T.BinaryType())])
    cached = staged(rows.mapInArrow(_projector((simplex, scale, dimensions)), schema))
    centroids = [[int(x) for x in v] for v in start[:k]]
    for _ in range(rounds):
        parts = cached.mapInArrow(_assigner(simplex, packed(centroids), False), "cluster int, i int, n long, low decimal(38,0), high decimal(38,0)")
        before = centroids
        centroids = [list(c) for c in centroids]
        for c, i, n, low, high in parts.groupBy("cluster", "i").agg(F.sum("n"), F.sum("low"), F.sum("high")).collect():  # k * dimensions rows
            centroids[c][i] = ((int(high) << PART) + int(low)) // n
        if centroids == before:
            break  # every later round would give the same
    schema = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return cached.mapInArrow(_assigner(simplex, packed(centroids), True), schema), centroids


def cluster_report(vectors: DataFrame, id: str = "vec_id", **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector; see ``cluster_vectors``.

    A sum of distances that doesn't fit a long is null.
    """
    found, centroids = cluster_vectors(vectors, id=id, **options)
    empty = F.lit(None).cast("long")
    if not centroids:
        return found.select(F.col("id").alias("vec_id"), "cluster", "distance", empty.alias("cluster_inertia"), empty.alias("inertia"), F.lit("").alias("centroid_sha256"))
    found = staged(found)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()}
    whole = None if None in sums.values() else sum(sums.values())

    def number(x) -> Column:
        return (empty if x is None or x >= LARGEST else F.lit(int(x)).cast("long"))

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = F.array(*[F.struct(number(sums.get(c, 0)).alias("s"), F.lit(d).alias("d")) for c, d in enumerate(digests)])
    return found.withColumn("_of", F.get(per, "cluster")).select(
        F.col("id").alias("vec_id"), "cluster", "distance", F.col("_of.s").alias("cluster_inertia"), number(whole).alias("inertia"), F.col("_of.d").alias("centroid_sha256"))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_report(table(spark, folder, "embeddings"))


def clustering_sql(k: int = 8, rounds: int = 10, dimensions: int = 64, seed: str = "3:") -> str:
    """The query in SQL, one pair of tables a round."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS rn FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM kept QUALIFY c < {k})"""]
    apart = "list_sum(list_transform(list_zip(kept.v, {c}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        best = f"SELECT rn, vec_id, kept.v AS v, c, CAST({apart.format(c=f'c{r}')} AS BIGINT) AS d FROM kept, c{r}"
        steps.append(f"a{r} AS MATERIALIZED (SELECT rn, vec_id, v, min_by(c, (d, c)) AS c, min(d) AS d FROM ({best}) GROUP BY ALL)")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT c, list(m ORDER BY i) AS v FROM (
    SELECT c, i, CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) + CASE
        WHEN CAST(floor(CAST(s AS DOUBLE) / n) AS HUGEINT) * n > s THEN -1
        WHEN (CAST(floor(CAST(s AS DOUBLE) / n) AS HUGEINT) + 1) * n <= s THEN 1 ELSE 0 END AS m
    FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dimensions})) AS i FROM a{r}) GROUP BY c, i)) GROUP BY c)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))")
    last = f"a{rounds}"
    steps.append(f"sums AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM {last} GROUP BY c)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, s AS cluster_inertia,
  CAST((SELECT sum(s) FROM sums) AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM {last} JOIN sums USING (c) JOIN c{rounds} USING (c)"""


OP11_SQL = clustering_sql()
