"""Sinks for tables and audit reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import Report


def write_table(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet for ``.parquet`` paths, CSV with a header otherwise."""
    writer = frame.write.mode(mode)
    if path.lower().rstrip("/").endswith(".parquet"):
        writer.parquet(path)
    else:
        writer.options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        ).csv(path)


def write_report(report: Report, folder: str, mode: str = "errorifexists") -> None:
    """The report's tables as JSON lines, one sub-folder each."""
    tables = {
        "summary": report.summary, "dimension_scores": report.dimension_scores,
        "checker_scores": report.checker_scores, "issues": report.issues, "profile": report.profile,
        "alerts": report.alerts, "recommendations": report.recommendations,
        "severity_counts": report.severity_counts,
    }
    for name, table in tables.items():
        stamped = table.withColumn("created_at", F.current_timestamp()) if name == "summary" else table
        stamped.coalesce(1).write.mode(mode).json(f"{folder.rstrip('/')}/{name}")
