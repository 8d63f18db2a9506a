"""Pipeline from raw documents to token ids; each stage calls one operator of ``sievemark.llm``.

A stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns the columns of ``docs``; the
last one returns tokens.  Results are written as Parquet between stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import staged, table
from sievemark.llm.op1_quality import kept_documents
from sievemark.llm.op3_lines import dedupe_lines
from sievemark.llm.op4_near import one_of_each
from sievemark.llm.op5_decontaminate import decontaminate
from sievemark.llm.op7_bpe import encode_documents


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps, unchanged."""
    return kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier passages; a document of which nothing is left goes."""
    return _measured(dedupe_lines(docs)).where(F.length(F.btrim("text", F.lit(" \t\r\n\x0b\x0c"))) > 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, unchanged."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; a document that is mostly benchmark goes."""
    return _measured(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    return encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe", bpe),
]

#: Order MinHash and BPE can't be said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
