"""Null-safe, ANSI-safe column expressions.

Every helper returns a built-in Catalyst expression, so it stays inside code
generation.  ANSI mode is on by default in Spark 4, hence the ``try_`` forms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

from .fixed import CURRENCY_PATTERN, DATE_PATTERN, GRADES, NUMBER_PATTERN, TEXT_SENTINELS, WHITESPACE


def kind_of(dtype: T.DataType) -> str:
    """numeric / string / datetime / boolean / other."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def quoted(name: str) -> Column:
    """A top-level column whose name may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold_missing(column: Column, dtype: T.DataType) -> Column:
    """NaN counts as missing and -0.0 equals 0.0; other types pass through."""
    if is_floating(dtype):
        return F.when(~F.isnan(column), column + F.lit(0).cast(dtype))
    return column


def starts_within(text: Column, low: str, high: str) -> Column:
    """Whether the first byte lies in [low, high): a cheap test before dearer ones."""
    plain = F.collate(text, "UTF8_BINARY")
    return (plain >= low) & (plain < high)


def strip(column: Column) -> Column:
    """Without white space at both ends; text that has ASCII letters, digits or signs there is left as it is, unsearched."""
    bare = starts_within(column, "!", "\x7f") & starts_within(F.right(column, F.lit(1)), "!", "\x7f")
    return F.when(bare, column).otherwise(F.btrim(column, F.lit(WHITESPACE)))


def looks_number(text: Column) -> Column:
    """Whether stripped text is a plain number."""
    return starts_within(text, "+", ":") & text.rlike(NUMBER_PATTERN)


def looks_date(text: Column) -> Column:
    """Whether stripped text is a date in digits."""
    return starts_within(text, "0", ":") & text.rlike(DATE_PATTERN)


def looks_currency(text: Column) -> Column:
    """Whether stripped text is an amount, with or without its sign."""
    plain = F.collate(text, "UTF8_BINARY")
    return ((plain < ":") | (plain >= "\x7f")) & text.rlike(CURRENCY_PATTERN)


def is_sentinel_word(text: Column) -> Column:
    """Whether stripped text is a placeholder word."""
    return (F.length(text) <= max(map(len, TEXT_SENTINELS))) & F.lower(text).isin(*TEXT_SENTINELS)


def is_blank(column: Column) -> Column:
    return strip(column) == ""


def normal_word(column: Column) -> Column:
    return F.lower(strip(column))


def as_number(column: Column, dtype: T.DataType) -> Column:
    """Double view of a column; text that is no plain number becomes null."""
    kind = kind_of(dtype)
    if kind in ("numeric", "boolean"):
        return column.cast("double")
    if kind == "string":
        text = strip(column)
        return F.when(looks_number(text), text.try_cast("double"))
    return F.lit(None).cast("double")


def as_timestamp(column: Column, dtype: T.DataType, layouts: Sequence[str]) -> Column:
    """Timestamp view; text is tried against each layout, bad text becomes null."""
    if kind_of(dtype) == "datetime":
        return column.cast("timestamp")
    if kind_of(dtype) != "string":
        return F.lit(None).cast("timestamp")
    text = strip(column)
    # a layout that can't fit costs an exception a row, so its separator is looked for first
    marks = {layout: "-" if "-" in layout else "/" if "/" in layout else "" for layout in layouts}
    attempts = [F.when(text.contains(marks[layout]), F.try_to_timestamp(text, F.lit(layout))) for layout in layouts]
    full = F.when(~text.rlike(DATE_PATTERN) & text.rlike(r"^\d{4}-\d"), text.try_cast("timestamp"))
    return F.coalesce(*attempts, full)


def percent(part: Column, whole: Column) -> Column:
    """100*part/whole, half-up to two digits in integer arithmetic; 0 when empty."""
    part, whole = part.cast("bigint"), whole.cast("bigint")
    scaled = F.call_function("div", part * 20000 + whole, whole * 2)
    return F.when(whole > 0, scaled / F.lit(100.0)).otherwise(F.lit(0.0))


def percent_of(part: int, whole: int) -> float:
    """Driver-side twin of :func:`percent`."""
    return ((part * 20000 + whole) // (2 * whole)) / 100 if whole else 0.0


def grade_of(score: Column) -> Column:
    ladder = F.when(score >= GRADES[0][0], GRADES[0][1])
    for floor, letter in GRADES[1:]:
        ladder = ladder.when(score >= floor, letter)
    return ladder.otherwise("F")


def bucket_sql(value: str, cuts: Sequence[float], points: bool = False) -> str:
    """SQL for the index of the interval that holds ``value``: a balanced CASE tree.

    With ``points`` false the result is the number of cuts <= value (left-closed
    intervals).  With ``points`` true open intervals get even ids 0, 2, 4 ... and
    a value equal to cut ``i`` gets the odd id ``2*i + 1``.
    """
    def descend(low: int, high: int) -> str:
        if low == high:
            return str(2 * low if points else low)
        middle = (low + high) // 2
        cut = f"double('{float(cuts[middle])!r}')"
        equal = f" WHEN {value} = {cut} THEN {2 * middle + 1}" if points else ""
        return f"CASE WHEN {value} < {cut} THEN {descend(low, middle)}{equal} ELSE {descend(middle + 1, high)} END"

    return f"CASE WHEN {value} IS NOT NULL THEN {descend(0, len(cuts))} END"
