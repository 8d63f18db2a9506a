"""The operators' queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import run as pipeline
from sievemark.llm.op1_quality import op1_quality_rules
from sievemark.llm.op10_lm import op10_lm_scoring
from sievemark.llm.op11_centroids import OP11_SQL, op11_centroid_clustering
from sievemark.llm.op12_manifest import OP12_SQL, op12_merkle_manifest
from sievemark.llm.op13_packing import op13_best_fit_packing
from sievemark.llm.op2_urls import op2_url_filter
from sievemark.llm.op3_lines import OP3_SQL, op3_line_dedup
from sievemark.llm.op4_near import op4_near_duplicates
from sievemark.llm.op5_decontaminate import OP5_SQL, op5_decontamination
from sievemark.llm.op6_pii import op6_personal_data
from sievemark.llm.op7_bpe import op7_bpe
from sievemark.llm.op8_secrets import op8_secret_scan
from sievemark.llm.op9_classifier import op9_quality_classifier

ROOT = str(Path(__file__).resolve().parents[2])


def importable(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Let Python workers import this package from where the driver did, whatever folder the driver was started in.

    Where executors don't see that folder, submit the package with ``--py-files`` as usual.
    """

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
        if ROOT not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = ":".join([*filter(None, paths), ROOT])
        return query(spark, folder)

    return run


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filter": op2_url_filter,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_decontamination": op5_decontamination,
    "op6_personal_data": op6_personal_data,
    "op7_bpe": op7_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_best_fit_packing": op13_best_fit_packing,
    "pipeline": pipeline,
}
QUERIES = {name: importable(query) for name, query in QUERIES.items()}

SQL = {"op3_line_dedup": OP3_SQL, "op5_decontamination": OP5_SQL, "op11_centroid_clustering": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
