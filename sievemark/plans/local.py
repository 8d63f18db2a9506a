"""Small result tables and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: Iterable[Mapping], schema: str | T.StructType) -> DataFrame:
    """Rows bounded by column count as a local relation (no Spark job needed)."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    maps = [f.name for f in struct.fields if isinstance(f.dataType, T.MapType)]
    ready = []
    for row in rows:
        row = dict(row)
        for name in maps:
            if row.get(name) is not None:
                row[name] = list(row[name].items())
        ready.append(row)
    table = pa.Table.from_pylist(ready, schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, schema=struct)


def settle(frame: DataFrame) -> DataFrame:
    """Evaluate a frame whose size is bounded by column count, once.

    The result is a local relation: no lineage, nothing to lose with an executor.
    Only statistics go through here, never data rows.
    """
    return local_frame(frame.sparkSession, [r.asDict() for r in frame.collect()], frame.schema)


def shared_folder(spark: SparkSession, name: str | None = None) -> str:
    """A fresh sub-folder of the folder that driver and executors share.

    That is ``spark.checkpoint.dir``.  Only a local master may do without it: a temporary folder would be another one on
    each machine of a cluster.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name or 'tables'}-{uuid.uuid4().hex}"


def durable(frame: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession, "checkpoints"))
    return frame.checkpoint(eager=True)


#: Types that Parquet can't hold.
UNSTORED = ("void", "interval")
#: Rows of a file at most.  A file's rows can't be dealt to several tasks, and a reader takes 32 files a task at most, as
#: each counts 4 MB of the 128 MB of a task.
ROWS_A_FILE = 1 << 16


def stored(frame: DataFrame) -> DataFrame:
    """Like ``durable``, in Parquet: for long tables that several passes read some columns of.

    The files are small, so that readers deal the rows evenly however they were dealt before.
    """
    if any(word in f.dataType.simpleString() for f in frame.schema.fields for word in UNSTORED):
        return durable(frame)
    folder = shared_folder(frame.sparkSession)
    frame.write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
