"""Declarative row rules.

Each rule is one boolean pass expression in which null means fail, so all rules
but ``unique`` are counted in a single scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.expr import as_number, as_timestamp, fold_missing, is_blank, kind_of, normal_word, percent, quoted
from ..plans.local import local_frame

SAMPLES_KEPT = 5


@dataclass
class Rule:
    rule_id: str
    rule_type: str
    column: str
    description: str = ""
    severity: str = "HIGH"
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: list[str] = field(default_factory=list)
    regex_pattern: str | None = None
    comparison_column: str | None = None
    comparison_operator: str | None = None
    expected_type: str | None = None


RULE_SCHEMA = T.StructType([
    T.StructField(f.name, T.DoubleType() if f.name in ("min_value", "max_value")
                  else T.ArrayType(T.StringType()) if f.name == "allowed_values" else T.StringType())
    for f in fields(Rule)
])


def rules_from(frame: DataFrame) -> list[Rule]:
    """Rules from a frame with :data:`RULE_SCHEMA`; the rule list itself is small."""
    rules = []
    for row in frame.collect():
        given = {k: v for k, v in row.asDict().items() if v is not None}
        rules.append(Rule(**given))
    return rules


def java_pattern(pattern: str) -> str:
    """Python search pattern for Spark: Unicode classes, and Python's named-group spelling."""
    return "(?U)" + pattern.replace("(?P<", "(?<")


def pattern_problem(frame: DataFrame, pattern: str) -> str | None:
    """Why the pattern cannot be used, or None.  Checked before any plan is built."""
    try:
        re.compile(pattern)
    except re.error as problem:
        return f"Invalid regular expression '{pattern}': {problem}"
    try:
        frame.sparkSession.range(1).select(F.lit("").rlike(java_pattern(pattern))).collect()
    except Exception as problem:  # noqa: BLE001 - dialects differ
        return f"Invalid regular expression '{pattern}': {str(problem).splitlines()[0]}"
    return None


class _Table:
    """Column access with NaN folded to null."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def dtype(self, name: str):
        return self.frame.schema[name].dataType

    def value(self, name: str) -> Column:
        return fold_missing(quoted(name), self.dtype(name))

    def number(self, name: str) -> Column:
        return as_number(self.value(name), self.dtype(name))

    def text(self, name: str) -> Column:
        return self.value(name).cast("string")


def passes(frame: DataFrame, rule: Rule) -> Column | None:
    """Pass expression of a rule; None for ``unique``, which is no row predicate."""
    table = _Table(frame)
    if rule.column not in frame.columns:
        return F.lit(False)
    value, kind = table.value(rule.column), rule.rule_type
    if kind == "unique":
        return None
    if kind == "not_null":
        found = value.isNotNull()
        if kind_of(table.dtype(rule.column)) == "string":
            found = found & ~is_blank(value)
    elif kind == "range":
        x = table.number(rule.column)
        found = x.isNotNull()
        if rule.min_value is not None:
            found = found & (x >= float(rule.min_value))
        if rule.max_value is not None:
            found = found & (x <= float(rule.max_value))
    elif kind == "allowed_values":
        allowed = sorted({str(v).strip().lower() for v in rule.allowed_values})
        found = normal_word(table.text(rule.column)).isin(*allowed) if allowed else F.lit(False)
    elif kind == "regex":
        if not rule.regex_pattern:
            return F.lit(True)
        found = table.text(rule.column).rlike(java_pattern(rule.regex_pattern))
    elif kind == "comparison":
        if not rule.comparison_column or rule.comparison_column not in frame.columns:
            return F.lit(False)
        a, b = table.number(rule.column), table.number(rule.comparison_column)
        tests = {">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b, "==": a == b}
        found = tests.get(rule.comparison_operator or ">=", tests[">="])
    elif kind == "type_check":
        if rule.expected_type == "numeric":
            found = table.number(rule.column).isNotNull()
        elif rule.expected_type == "datetime":
            layouts = fixed.DATE_LAYOUTS + fixed.MONTH_FIRST_LAYOUTS + fixed.DAY_FIRST_LAYOUTS
            found = as_timestamp(value, table.dtype(rule.column), layouts).isNotNull()
        else:
            found = value.isNotNull()
    else:
        return F.lit(True)
    return F.coalesce(found, F.lit(False))


def repeated_values(frame: DataFrame, column: str) -> DataFrame:
    """(value, cnt) of values, null included, that occur more than once."""
    value = _Table(frame).value(column)
    return frame.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")


def _plans(frame: DataFrame, rules: Sequence[Rule]) -> list[tuple[Rule, Column | None, str | None]]:
    """(rule, pass expression, problem); a rule that cannot be planned fails every row."""
    plans = []
    for rule in rules:
        problem = None
        if rule.column not in frame.columns:
            problem = f"Column '{rule.column}' is not in the table"
        elif rule.rule_type == "regex" and rule.regex_pattern:
            problem = pattern_problem(frame, rule.regex_pattern)
        if problem:
            plans.append((rule, F.lit(False), problem))
            continue
        try:
            test = passes(frame, rule)
            if test is not None:
                frame.select(test)  # analysis only
            plans.append((rule, test, None))
        except Exception as failure:  # noqa: BLE001 - an unusable rule fails all rows
            plans.append((rule, F.lit(False), str(failure).splitlines()[0]))
    return plans


def run_rules(frame: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: evaluated, passed, failed, pass_rate, status, message."""
    plans = _plans(frame, rules)
    scan = [(i, test) for i, (_, test, _) in enumerate(plans) if test is not None]
    total, *hits = frame.agg(F.count(F.lit(1)), *[F.count_if(test).alias(f"p{i}") for i, test in scan]).collect()[0]
    passed = {i: int(n) for (i, _), n in zip(scan, hits)}
    repeats: dict[str, int] = {}
    for i, (rule, test, _) in enumerate(plans):
        if test is None:
            if rule.column not in repeats:
                found = repeated_values(frame, rule.column).agg(F.coalesce(F.sum("cnt"), F.lit(0))).collect()
                repeats[rule.column] = int(found[0][0])
            passed[i] = total - repeats[rule.column]
    rows = [
        {"rule_no": i, "rule_id": r.rule_id, "rule_type": r.rule_type, "column": r.column, "severity": r.severity,
         "description": r.description, "total_evaluated": total, "passed_count": passed[i], "problem": problem}
        for i, (r, _, problem) in enumerate(plans)
    ]
    frame_ = local_frame(
        frame.sparkSession, rows,
        "rule_no int, rule_id string, rule_type string, `column` string, severity string, description string, "
        "total_evaluated bigint, passed_count bigint, problem string",
    )
    n, ok = F.col("total_evaluated"), F.col("passed_count")
    failed, rate = n - ok, F.when(n == 0, 100.0).otherwise(percent(ok, n))
    broken = F.col("problem").isNotNull()
    rate = F.when(broken, 0.0).otherwise(rate)
    status = F.when(broken | (failed > 0), "FAILED").otherwise("PASSED")
    message = F.coalesce(
        "problem",
        F.when(failed == 0, F.format_string("all %s rows pass", n))
        .otherwise(F.format_string("%s of %s rows fail (%s%% pass)", failed, n, rate)),
    )
    return frame_.select(
        "rule_no", "rule_id", "rule_type", "column", "severity", "description", "total_evaluated", "passed_count",
        failed.alias("failed_count"), rate.alias("pass_rate_pct"), status.alias("status"), message.alias("message"),
    )


def suite_summary(results: DataFrame) -> DataFrame:
    """One row: rules, passed, failed, pass rate (one decimal) and status."""
    n, ok = F.col("total_rules"), F.col("passed_rules")
    return results.agg(
        F.count(F.lit(1)).alias("total_rules"), F.count_if(F.col("status") == "PASSED").alias("passed_rules")
    ).select(
        n, ok, (n - ok).alias("failed_rules"),
        F.when(n == 0, 100.0).otherwise(F.round(F.try_divide(ok, n) * 100.0, 1)).alias("overall_pass_rate"),
        F.when(n == ok, "PASSED").otherwise("FAILED").alias("status"),
    )


def violations(
    frame: DataFrame, rule: Rule, key_columns: Sequence[str], keep: int | None = None, whole_rows: bool = False
) -> DataFrame:
    """Failing rows (keys only, or whole rows): all of them, or with ``keep`` the first ones in key order.

    Sorting is then a bounded top-k per task.  For ``unique`` the failing rows are
    those whose value is among the repeated ones; the join is null-safe and
    Spark splits a hot value's partition (AQE) or broadcasts a small side.
    """
    [(_, test, _)] = _plans(frame, [rule])
    if test is None:
        repeated = repeated_values(frame, rule.column).select(F.col("value").alias("__repeated"))
        value = _Table(frame).value(rule.column)
        failing = frame.join(repeated, value.eqNullSafe(F.col("__repeated")), "left_semi")
    else:
        failing = frame.filter(~test)
    columns = frame.columns if whole_rows else list(key_columns)
    if keep is not None:
        failing = failing.orderBy(*[quoted(c) for c in key_columns]).limit(keep)
    return failing.select(*[quoted(c) for c in columns])


def sample_violations(frame: DataFrame, rule: Rule, key_columns: Sequence[str]) -> DataFrame:
    return violations(frame, rule, key_columns, SAMPLES_KEPT, whole_rows=True)


def template_rules(template: str, columns: Sequence[str]) -> list[Rule]:
    """Ready-made rules matched to columns by name: ``fintech``, ``ecommerce`` or general hygiene."""
    # Fixed values: (name fragments, rule id, rule type, severity, description, parameters), first match per column.
    catalogue = {
        "fintech": (
            (("age",), "fin_age_range", "range", "CRITICAL", "age between 18 and 100",
             {"min_value": 18.0, "max_value": 100.0}),
            (("income", "salary"), "fin_income_positive", "range", "HIGH", "income not negative", {"min_value": 0.0}),
            (("id",), "fin_id_unique", "unique", "CRITICAL", "identifier unique", {}),
        ),
        "ecommerce": (
            (("price", "amount"), "ecom_price_positive", "range", "CRITICAL", "price above zero", {"min_value": 0.01}),
            (("rating", "score"), "ecom_rating_bounds", "range", "MEDIUM", "rating between 1 and 5",
             {"min_value": 1.0, "max_value": 5.0}),
            (("email",), "ecom_email_regex", "regex", "HIGH", "well-formed e-mail address",
             {"regex_pattern": r"^[\w\.-]+@[\w\.-]+\.\w+$"}),
        ),
    }
    if template not in catalogue:
        return [
            Rule(f"hygiene_not_null_{c}", "not_null", c, f"{c} is filled", "MEDIUM") for c in list(columns)[:4]
        ]
    found = []
    for c in columns:
        for fragments, rule_id, rule_type, severity, text, parameters in catalogue[template]:
            if any(f in c.lower() for f in fragments):
                found.append(Rule(rule_id, rule_type, c, text, severity, **parameters))
                break
    return found


def rules_table(spark, rules: Sequence[Rule]) -> DataFrame:
    return local_frame(spark, [asdict(r) for r in rules], RULE_SCHEMA)
