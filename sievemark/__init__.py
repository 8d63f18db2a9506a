"""Tabular data quality on Spark: audit, score, repair, compare, assert, benchmark."""

from .operators.audit import audit
from .plans.context import TableContext

__all__ = ["TableContext", "audit"]
