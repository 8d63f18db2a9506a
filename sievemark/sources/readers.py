"""Table readers: CSV/TXT, Parquet and JSON, chosen by the path's suffix."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import quoted, strip
from ..functions.fixed import NA_TOKENS, NUMBER_PATTERN
from ..operators.rules import RULE_SCHEMA, Rule, rules_from
from .ranges import csv_records, dealt, decoded, json_records, pieces_of


class EmptyInput(ValueError):
    """The input holds no rows."""


@dataclass
class Look:
    """What one scan over the lines of all files tells."""

    files: int
    broken: bool  # bytes that are not UTF-8
    odd_quotes: bool  # a line that ends inside quotes


def look(spark: SparkSession, path: str) -> Look:
    """One aggregate over all lines; a single row reaches the driver, however many files there are."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"')))
    row = spark.read.text(path).select("value").agg(
        F.count(F.lit(1)), F.bool_or(~F.is_valid_utf8("value")), F.bool_or(quotes % 2 == 1)).collect()[0]
    return Look(row[0], bool(row[1]), bool(row[2]))


def json_lines(spark: SparkSession, path: str) -> bool | None:
    """Whether every filled line of all files begins and ends as a JSON object; None if there is nothing to read.

    A line may be a whole file, so none is read whole: files are cut after closing braces, as ``ranges.json_records`` cuts
    them.  A line break then has blanks only between it and the brace before it, and an object's start behind it; a file
    begins so too, and what follows its last brace is blank.  A single row reaches the driver.  If the first file begins
    with anything else, such as an array, that settles it.
    """
    text, blanks = F.col("piece").cast("string"), F.lit(" \r\n")
    pieces = dealt(pieces_of(spark, path, "}")).select(
        "file", "size", F.struct("block", "line").alias("place"), F.octet_length("piece").alias("bytes"),
        (text.contains("\n") | text.contains("\r")).alias("breaks"), F.ltrim(text, blanks).alias("rest"))
    starts = F.col("rest").startswith("{") & ~F.col("rest").contains("\n") & ~F.col("rest").contains("\r")
    empty = F.col("rest") == ""
    pieces = pieces.select("file", "size", "place", "bytes", "breaks", starts.alias("starts"), empty.alias("empty"))
    top = pieces.first()
    if top is None:
        return None
    if not (top["starts"] or top["empty"] or top["place"]["block"]):
        return False
    files = pieces.groupBy("file").agg(
        (F.sum("bytes") + F.count(F.lit(1)) - F.first("size")).alias("over"),
        F.bool_and(~F.col("breaks") | F.col("starts") | F.col("empty")).alias("fit"),
        F.min_by(F.col("starts") | F.col("empty"), "place").alias("begun"),
        F.max_by("empty", "place").alias("ended"), F.max_by(F.col("breaks") & F.col("empty"), "place").alias("last"),
        F.count_if(F.col("breaks") & F.col("empty")).alias("bare"))
    # only a file's last piece may lack a brace; a byte order mark isn't read, a compressed file's size tells nothing
    whole = F.when(F.col("over").isin(1, -2), F.col("ended") & (F.col("bare") == F.col("last").cast("long"))).when(F.col("over").isin(0, -3), F.col("bare") == 0)
    row = files.agg(F.count(F.lit(1)), F.bool_and(F.col("fit") & F.col("begun") & F.coalesce(whole, F.lit(True))), F.count_if(whole.isNull())).collect()[0]
    if not row[0]:
        return None
    if row[1] and row[2]:
        bare = F.trim(F.col("value"))
        return bool(spark.read.text(path).agg(F.bool_and(F.when(bare != "", bare.startswith("{") & bare.endswith("}")))).collect()[0][0])
    return row[1]


#: Encodings in which line breaks, commas and quotes are the bytes that ASCII has for them, and no other letter's.
ASCII_LIKE = ("utf8", "ascii", "usascii", "latin1", "iso88591", "iso885915", "windows1252", "cp1252", "windows1250", "windows1251")


def column_names(header: str) -> list[str]:
    """Names of a header record, as Spark's reader gives them: _c and the place for a blank one, the place after repeated ones."""
    cells = next(csv.reader(io.StringIO(header, newline="")), [])
    seen = Counter(c.lower() for c in cells)
    return [f"_c{i}" if not c else f"{c}{i}" if seen[c.lower()] > 1 else c for i, c in enumerate(cells)]


def _from_ranges(spark: SparkSession, path: str, encoding: str | None, fallback: str, quotes: bool) -> DataFrame:
    """Cells of CSV files as text, every file read by as many tasks as it has ranges."""
    found = csv_records(spark, path, quotes)
    record = decoded(F.col("record"), F.col("broken"), encoding, fallback)
    heads = found.where("first").select(record.alias("r")).agg(F.min("r")).first()[0]
    if heads is None:
        raise EmptyInput(f"{path} holds no rows")
    names = column_names(heads.removeprefix("\ufeff"))
    struct = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    cells = F.from_csv(record, struct, {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    return found.where(~F.col("first")).select(cells.alias("c")).select("c.*")


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | str | None = None,
    encoding: str | None = None,
    fallback: str = "ISO-8859-1",
    na_values: Sequence[str] = NA_TOKENS,
    infer: bool = True,
    multi_line: bool | None = None,
) -> DataFrame:
    """Delimited text with a header.

    A scan over the lines finds whether all files are UTF-8 and whether a quoted cell holds a line break.  If so and if not,
    Spark's reader takes the folder as it is.  Else records are found in byte ranges, all files at once and every file by
    many tasks (``ranges.csv_records``); a file that isn't UTF-8 is decoded by ``fallback``, each file by itself.  Name
    both ``encoding`` and ``multi_line`` to save the scan.  Encodings in which a line break isn't one byte, such as UTF-16,
    are left to Spark's reader, which reads a file with line breaks in cells by one task.  Cells are read as text, NA
    tokens become null, then columns are typed: with the given schema, or by one aggregate that finds which columns hold
    only integers, numbers or booleans.
    """
    ascii_like = encoding is None or re.sub("[^a-z0-9]", "", encoding.lower()) in ASCII_LIKE
    found = Look(1, False, bool(multi_line)) if encoding is not None and multi_line is not None else look(spark, path)
    if not found.files:
        raise EmptyInput(f"{path} holds no rows")
    quotes = found.odd_quotes if multi_line is None else multi_line
    if ascii_like and (quotes or found.broken and encoding is None):
        raw = _from_ranges(spark, path, encoding, fallback, quotes)
    else:
        reader = spark.read.option("header", True).option("encoding", encoding or "UTF-8").option("multiLine", quotes)
        raw = reader.option("quote", '"').option("escape", '"').csv(path)
    tokens = [t for t in na_values]
    text = raw.select(*[F.when(~quoted(c).isin(*tokens), quoted(c)).alias(c) for c in raw.columns])
    if schema is not None:
        struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return text.select(*[quoted(f.name).try_cast(f.dataType).alias(f.name) for f in struct.fields])
    return _typed(text) if infer else text


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """JSON Lines, arrays of objects, single objects and objects one after the other, also mixed in one folder.

    Where all is JSON Lines, Spark's reader takes the folder as it is.  Else objects are found in byte ranges, every file
    by many tasks, and written as JSON Lines to the shared folder (``ranges.json_records``).  A file that ends inside a
    value is an error; what is no object is left to Spark's reader, as a corrupt record.
    """
    lines = json_lines(spark, path)
    if lines is None:
        raise EmptyInput(f"{path} holds no rows")
    return spark.read.json(path if lines else json_records(spark, path), schema=schema, **options)


def _typed(text: DataFrame) -> DataFrame:
    measures: list[Column] = []
    for c in text.columns:
        bare = strip(quoted(c))
        measures += [
            F.count(quoted(c)),
            F.count_if(bare.rlike(r"^[+-]?\d{1,18}$")),
            F.count_if(bare.rlike(NUMBER_PATTERN)),
            F.count_if(bare.isin("True", "False", "TRUE", "FALSE", "true", "false")),
        ]
    row = text.agg(*[m.alias(f"m{i}") for i, m in enumerate(measures)]).collect()[0]
    parts = []
    for i, c in enumerate(text.columns):
        filled, whole, number, boolean = row[4 * i:4 * i + 4]
        if filled and whole == filled:
            target = "bigint"
        elif filled and number == filled:
            target = "double"
        elif filled and boolean == filled:
            target = "boolean"
        else:
            target = None
        parts.append((strip(quoted(c)).try_cast(target) if target else quoted(c)).alias(c))
    return text.select(*parts)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by suffix (.csv .txt .parquet .json; anything else as CSV); empty input is an error."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".parquet"):
        frame = spark.read.parquet(path)
    elif lowered.endswith(".json"):
        frame = read_json(spark, path, **options)
    else:
        frame = read_csv(spark, path, **options)
    if frame.isEmpty():
        raise EmptyInput(f"{path} holds no rows")
    return frame


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from a JSON array of rule objects, or one object a line."""
    return rules_from(read_json(spark, path, RULE_SCHEMA))
