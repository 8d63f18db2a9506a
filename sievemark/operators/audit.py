"""Run the checks over one table and assemble the report."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.context import TableContext
from ..plans.local import local_frame, settle
from . import scoring
from .constant import check_constant
from .correlation import check_correlation
from .duplicates import check_duplicates
from .imbalance import check_imbalance
from .issues import DIMENSION_OF, ISSUE_SCHEMA, Check, make_issues
from .leakage import check_leakage
from .missing import check_missing
from .outliers import check_outliers
from .profile import profile
from .suspicious import check_suspicious
from .types import check_types

Checker = Callable[[TableContext], Check]

CHECKERS: dict[str, Checker] = {
    "missing_values": check_missing,
    "duplicate_rows": check_duplicates,
    "outliers": check_outliers,
    "class_imbalance": check_imbalance,
    "data_leakage": check_leakage,
    "high_correlation": check_correlation,
    "data_types": check_types,
    "constant_columns": check_constant,
    "suspicious_values": check_suspicious,
}


@dataclass
class Report:
    """Result tables of one audit; each is a DataFrame bounded by column count."""

    ctx: TableContext
    name: str
    checkers: DataFrame
    issues: DataFrame

    @cached_property
    def checker_scores(self) -> DataFrame:
        return settle(scoring.checker_scores(self.checkers, self.issues))

    @cached_property
    def dimension_scores(self) -> DataFrame:
        return settle(scoring.dimension_scores(self.checker_scores, self.issues))

    @cached_property
    def overall(self) -> DataFrame:
        return settle(scoring.overall_score(self.dimension_scores))

    @cached_property
    def alerts(self) -> DataFrame:
        return settle(scoring.alerts(self.checker_scores, self.issues))

    @cached_property
    def recommendations(self) -> DataFrame:
        return settle(scoring.recommendations(self.issues, self.checkers))

    @cached_property
    def severity_counts(self) -> DataFrame:
        return settle(scoring.severity_counts(self.issues))

    @cached_property
    def profile(self) -> DataFrame:
        return settle(profile(self.ctx, self.issues))

    @cached_property
    def diagnosis(self) -> DataFrame:
        return settle(scoring.diagnosis(self.overall, self.alerts))

    @property
    def summary(self) -> DataFrame:
        """One row: name, shape, target, score, grade, issue count."""
        total = self.severity_counts.agg(F.sum("cnt").alias("total_issues"))
        return self.overall.crossJoin(F.broadcast(total)).select(
            F.lit(self.name).alias("dataset"), F.lit(self.ctx.count).cast("bigint").alias("total_rows"),
            F.lit(len(self.ctx.names)).cast("bigint").alias("total_columns"),
            F.lit(self.ctx.target).cast("string").alias("target"), "overall_score", "grade", "total_issues",
        )

    def score(self) -> float:
        return self.overall.collect()[0]["overall_score"]


def run_checker(ctx: TableContext, checker_id: str, checker: Checker) -> Check:
    """Run one checker and settle its findings.

    A checker that raises yields a MEDIUM issue and score 50; the audit goes on.
    """
    try:
        check = checker(ctx)
        rows = [r.asDict() for part in check.parts for r in part.collect()]
        found = local_frame(ctx.spark, rows, ISSUE_SCHEMA)
        return Check(check.checker_id, found, check.metrics, check.base_penalty, check.cap, check.dimension)
    except Exception as problem:  # noqa: BLE001 - reported as an issue
        logging.getLogger(__name__).warning("check %s failed: %s", checker_id, problem)
        text = str(problem).splitlines()[0][:500] if str(problem) else type(problem).__name__
        one = local_frame(ctx.spark, [{"text": text}], "text string")
        failed = make_issues(
            one, checker_id, issue_id=F.lit("error"), severity="MEDIUM",
            title=F.concat(F.lit(f"Check {checker_id} failed: "), F.col("text")),
            remediation="Inspect the table's format", penalty=50.0,
            dimension=DIMENSION_OF.get(checker_id, "Validity"),
        )
        return Check(checker_id, settle(failed))


def audit(
    frame: DataFrame,
    target: str | None = None,
    name: str = "dataset",
    checkers: Mapping[str, Checker] | None = None,
    ctx: TableContext | None = None,
    full: bool = True,
) -> Report:
    """Audit a table.  ``checkers`` replaces the default nine by name.

    With ``full`` the statistics that several checks share are gathered up front
    in as few scans as possible.  Exact distinct counts of large-domain columns
    take a shuffle and are left to the profile, which reports them.
    """
    ctx = ctx or TableContext(frame, target)
    checkers = checkers or CHECKERS
    if full and ctx.names and set(CHECKERS) <= set(checkers):
        ctx.scan("nulls", "domain", "moments", "whole", "shapes", "sentinels")
        if ctx.count:
            ctx.small_domain(ctx.names, tops=True)
            ctx.quantiles(ctx.of_kind("numeric"))
    checks = [run_checker(ctx, key, checker) for key, checker in checkers.items()]
    rows = [r.asDict() for c in checks for r in c.issues.collect()]
    issues = local_frame(ctx.spark, rows, ISSUE_SCHEMA)
    return Report(ctx, name, scoring.checker_table(checks), issues)
