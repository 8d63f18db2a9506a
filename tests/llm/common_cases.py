"""Rows that every text operator must take: nulls in any column, empty and long texts, repeats, clashing names."""

import pyarrow as pa
from pyspark.sql import functions as F

LINES = [f"line number {i} of the shared passage that several texts have in common today" for i in range(6)]
LONG = " ".join(f"word{i % 701} and the" for i in range(9000))

TEXTS = [
    (1, "A plain text of its own that has the usual words in it, and nothing else to find at all for anyone here."),
    (2, None), (3, ""), (4, " \t\n"), (None, "Text of a document without any id, which has the words and the marks."), (None, None),
    (5, LONG), (6, "\n".join(LINES) + "\nonly here"), (7, "something first\n" + "\n".join(LINES)), (8, "\n".join(LINES[:2])),
    (9, "twice the same row"), (9, "twice the same row"), (10, "é ñ ß 漢字 \u0301 '' <|endoftext|>"),
]
#: Names that operators use inside or return.
CLASHES = ("id", "th", "node", "kept", "_row", "_text", "_bytes", "label", "score", "key", "spans", "gone", "rank")


def frame(spark, rows=TEXTS):
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    docs = spark.createDataFrame(table)
    return docs.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit(i) for i, c in enumerate(CLASHES)})


def collected(result):
    return sorted((r.asDict(recursive=True) for r in result.collect()), key=lambda r: str(sorted(r.items(), key=str)))


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=str)


ALL_IDS = sorted((r[0] for r in TEXTS), key=str)
