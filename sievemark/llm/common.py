"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inside a character class: the white space that separates words.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, in local mode a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(frame: DataFrame) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    Unlike ``checkpoint()`` it runs the plan once and keeps columns compressed.
    """
    spark = frame.sparkSession
    path = f"{scratch(spark)}/staged-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``id``, ``text`` and ``th``: a row is known by its id and the hash of its text.

    Rows equal in both are one document to every operator and get the same answer.
    """
    return docs.select(docs[id].alias("id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("th"))


def join_back(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Left join of ``found`` (columns id, th, ...) to keyed documents; null ids match null ids."""
    right = found.withColumnsRenamed({"id": "_rid", "th": "_rth"})
    return docs.join(right, docs["id"].eqNullSafe(right["_rid"]) & (docs["th"] == right["_rth"]), "left").drop("_rid", "_rth")


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of an Arrow batch, so that few long texts are Python objects at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def read_local(path: str) -> bytes:
    """A model file on the driver's disk, such as a tokenizer's vocabulary."""
    with open(os.fspath(path), "rb") as file:
        return file.read()
