"""The issue table: one row per finding, every check returns the same schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans.local import local_frame

ISSUE_SCHEMA = (
    "seq bigint, issue_id string, dimension string, checker_id string, severity string, title string, "
    "affected_columns array<string>, affected_rows_count bigint, affected_rows_percentage double, "
    "details map<string,string>, remediation string, auto_fixable boolean, fix_action string, "
    "penalty double, fails boolean"
)
ISSUE_COLUMNS = [part.split()[0] for part in ISSUE_SCHEMA.split(", ")]

CHECKER_ORDER = (
    "missing_values", "duplicate_rows", "outliers", "class_imbalance", "data_leakage",
    "high_correlation", "data_types", "constant_columns", "suspicious_values",
)
DIMENSION_OF = {c: d for d, (_, checkers) in fixed.DIMENSIONS.items() for c in checkers}


@dataclass
class Check:
    """Findings of one checker plus what scoring needs to know about it."""

    checker_id: str
    issues: DataFrame | Sequence[DataFrame]
    metrics: dict[str, Any] = field(default_factory=dict)
    base_penalty: float = 0.0
    cap: float = 100.0
    dimension: str | None = None

    def __post_init__(self):
        self.parts = [self.issues] if isinstance(self.issues, DataFrame) else list(self.issues)
        self.issues = join_issues(self.parts)
        self.dimension = self.dimension or DIMENSION_OF.get(self.checker_id, "Validity")


def no_issues(spark: SparkSession) -> DataFrame:
    return local_frame(spark, [], ISSUE_SCHEMA)


def as_text(value: Any) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def make_issues(
    source: DataFrame,
    checker_id: str,
    *,
    issue_id: Column,
    severity: Column | str,
    title: Column,
    remediation: Column | str,
    columns: Column | None = None,
    rows: Column | None = None,
    pct: Column | None = None,
    details: Mapping[str, Column | str] | None = None,
    fix_action: Column | None = None,
    seq: Column | int = 0,
    penalty: Column | float = 0.0,
    fails: Column | bool = True,
    dimension: str | None = None,
) -> DataFrame:
    """Turn each row of ``source`` into one issue."""
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    pairs = [part for k, v in (details or {}).items() for part in (F.lit(k), as_text(v))]
    fix = fix_action if fix_action is not None else F.lit(None).cast("string")
    return source.select(
        lit(seq).cast("bigint").alias("seq"),
        F.concat(F.lit(checker_id + "_"), issue_id).alias("issue_id"),
        F.lit(dimension or DIMENSION_OF.get(checker_id, "Validity")).alias("dimension"),
        F.lit(checker_id).alias("checker_id"),
        lit(severity).alias("severity"),
        title.alias("title"),
        (columns if columns is not None else F.array().cast("array<string>")).alias("affected_columns"),
        (rows if rows is not None else F.lit(None)).cast("bigint").alias("affected_rows_count"),
        (pct if pct is not None else F.lit(None)).cast("double").alias("affected_rows_percentage"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("details"),
        lit(remediation).alias("remediation"),
        fix.isNotNull().alias("auto_fixable"),
        fix.alias("fix_action"),
        lit(penalty).cast("double").alias("penalty"),
        lit(fails).alias("fails"),
    )


def join_issues(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def name_has(column: Column, fragments: Sequence[str]) -> Column:
    """Lower-cased name holds any of the fragments."""
    lowered = F.lower(column)
    found = F.lit(False)
    for fragment in fragments:
        found = found | F.contains(lowered, F.lit(fragment))
    return found
