"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import pieces, table
from sievemark.llm.op4_near import PLAIN, word_hashes


def term_vector(text: bytes, slots: int) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, the last slot for words equal to the one before.

    Zero for a text of under three bytes.
    """
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(slots, np.float32)
    hashed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
    hashed ^= hashed >> np.uint32(15)
    counts = np.bincount((hashed * np.uint32(0x2C1B3C6D) >> np.uint32(16)) % np.uint32(slots - 1), minlength=slots)
    terms = np.sqrt(counts / (len(data) - 2)).astype(np.float32)
    words = word_hashes(text.translate(PLAIN))
    if len(words) > 1:
        terms[-1] = np.sqrt(np.mean(words[1:] == words[:-1]))
    return terms


@dataclass
class Voters:
    """Labelled vectors of unit length, the projection that makes them, and how they vote."""

    rarity: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int
    sharpness: float

    @classmethod
    def fit(cls, terms: np.ndarray, labels: np.ndarray, dimensions: int = 32, neighbours: int = 9, sharpness: float = 12.0, seed: int = 5) -> Voters:
        """Latent dimensions by a randomised decomposition of the weighted term matrix."""
        slots = terms.shape[1]
        if not len(labels):
            return cls(np.zeros(slots, np.float32), np.zeros((slots, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5, neighbours, sharpness)
        rarity = (np.log((1 + len(terms)) / (1 + (terms > 0).sum(axis=0))) + 0.1).astype(np.float32)
        weighted = terms * rarity
        size = min(dimensions, *weighted.shape)
        basis = np.random.default_rng(seed).normal(size=(slots, min(size + 16, slots))).astype(np.float32)
        for _ in range(4):
            basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
        _, _, turned = np.linalg.svd(weighted @ basis, full_matrices=False)
        projection = (basis @ turned[:size].T).astype(np.float32)
        return cls(rarity, projection, cls._unit(weighted @ projection), labels.astype(np.float32), float(labels.mean()), neighbours, sharpness)

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by similarity; the prior for an empty text."""
        out = np.full(len(terms), self.prior)
        rows = np.flatnonzero(terms.any(axis=1))
        if not len(self.labels) or not len(rows):
            return out
        cosines = self._unit((terms[rows] * self.rarity) @ self.projection) @ self.vectors.T
        k = min(self.neighbours, cosines.shape[1])
        nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, nearest, axis=1), 0) ** self.sharpness
        votes = (weights * self.labels[nearest]).sum(axis=1)
        out[rows] = (votes + 0.01 * self.prior) / (weights.sum(axis=1) + 0.01)
        return np.clip(out, 0, 1)


def held_out(id, parts: int):
    """True where crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def _termed(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = [term_vector(t, slots).tobytes() for t in part["_bytes"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["label"], pa.array(rows, pa.binary())], names=["label", "terms"])

    return run


def fit_voters(docs: DataFrame, labels: DataFrame, most: int = 3000, slots: int = 2048, parts: int = 5,
               id: str = "doc_id", text: str = "text", label: str = "quality", **options) -> Voters:
    """Voters from at most ``most`` labelled documents (documented bound), the first by a hash of their id.

    Held-out rows are never used.  Several labels of a document count by their mean; null labels are left out.
    """
    named = labels.select(labels[id].alias("lid"), labels[label].alias("label")).where("lid IS NOT NULL AND label IS NOT NULL")
    named = named.where(~held_out(F.col("lid"), parts)).groupBy("lid").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    source = docs.select(docs[id].alias("id"), docs[text].cast("binary").alias("_bytes"))
    known = source.select("id").join(named, F.col("id") == F.col("lid"), "left_semi").distinct()
    chosen = named.join(known.withColumnRenamed("id", "lid"), "lid").orderBy(F.xxhash64("lid"), "lid").limit(most)  # a labelled id has a text
    rows = source.where("_bytes IS NOT NULL").join(F.broadcast(chosen), F.col("id") == F.col("lid")).select("label", "_bytes")
    found = rows.mapInArrow(_termed(slots), "label int, terms binary").limit(most).toPandas()
    terms = np.frombuffer(b"".join(found["terms"]), np.float32).reshape(-1, slots) if len(found) else np.zeros((0, slots), np.float32)
    order = np.array(sorted(range(len(found)), key=lambda i: (int(found["label"][i]), found["terms"][i])), np.int64)  # rows come in any order
    return Voters.fit(terms[order], found["label"].to_numpy(np.float32)[order], **options)


def _voter(shared, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in batches:
            for part in pieces(batch):
                terms = np.stack([term_vector(t or b"", slots) for t in part["_bytes"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(voters.scores(terms), pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, voters: Voters | None = None, slots: int = 2048, parts: int = 5, least: float = 0.3,
             id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 at ``least`` or more) of every document.

    Every document is compared with every labelled vector, 256 documents a block.  Null and empty texts get the share
    of label 1 among the labelled rows, 0.5 without any.  Only the text enters the score.  Repeated rows score alike;
    extra columns are left out.  The broadcast holds ``most`` vectors and one projection, a few MB.
    """
    voters = voters or fit_voters(docs, labels, slots=slots, parts=parts, id=id, text=text, **options)
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    rows = docs.select(docs[id].alias("doc_id"), held_out(docs[id], parts).alias("held_out"), docs[text].cast("binary").alias("_bytes"))
    schema = rows.select("doc_id", "held_out", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_voter(shared, slots), schema).withColumn("predicted", (F.col("score") >= least).cast("int"))


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
