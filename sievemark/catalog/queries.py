"""The query catalogue: name -> (Spark query, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import grade_of
from ..operators import correlation, drift, duplicates, imbalance, leakage, missing, outliers, profile, scoring
from ..operators import constant as constant_ops
from ..operators import rules as rule_ops
from ..operators import suspicious, types
from ..operators.audit import CHECKERS, audit, run_checker
from ..operators.issues import Check
from ..operators.repair import compare_reports, repair
from ..operators.rules import Rule
from ..plans.context import TableContext
from ..plans.local import shared_folder
from ..sources import readers, writers
from . import oracle as sql
from .tables import TARGET, dirty, drift_pair, table

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Query, str | None]] = {}
D = sql.WITH_DIRTY
COLS = sql.DIRTY_COLUMNS


def query(name: str, twin: str | None = None):
    def keep(function: Query) -> Query:
        CATALOGUE[name] = (function, twin)
        return function

    return keep


def context(spark: SparkSession, folder: str) -> TableContext:
    return TableContext(dirty(spark, folder), TARGET)


def shown(issues: DataFrame) -> DataFrame:
    """Issues without the count of the isolation forest's, whose trees SQL cannot grow; out_joint_anomalies checks it."""
    known = F.col("issue_id") != "outliers_multivariate_anomalies"
    return issues.select(
        "checker_id", "issue_id", "severity", F.when(known, F.col("affected_rows_count").cast("double")).alias("affected_rows_count"),
        F.when(known, F.col("affected_rows_percentage")).alias("affected_rows_percentage"), "fix_action",
        F.round("penalty", 4).alias("penalty"),
    )


def portable(frame: DataFrame) -> DataFrame:
    """Nullable integers as doubles and timestamps as text: forms every client reads alike."""
    parts = []
    for f in frame.schema.fields:
        if f.name in ("sparse_col", "k", "age"):
            parts.append(F.col(f.name).cast("double").alias(f.name))
        elif f.dataType.typeName() in ("timestamp", "timestamp_ntz"):
            parts.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            parts.append(F.col(f.name))
    return frame.select(*parts)


def dirty_report(spark: SparkSession, folder: str):
    return audit(dirty(spark, folder), TARGET, checkers=CHECKERS)


# ---- sources and sinks ------------------------------------------------------------
ORDERS_SUMMARY = """SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS customers,
  round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus"""


def _orders_summary(frame: DataFrame) -> DataFrame:
    return frame.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").cast("bigint").alias("customers"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


@query("src_parquet", ORDERS_SUMMARY)
def src_parquet(spark, folder):
    return _orders_summary(readers.read_table(spark, f"{folder}/orders.parquet"))


@query("src_csv_snk_csv", ORDERS_SUMMARY)
def src_csv(spark, folder):
    path = f"{shared_folder(spark)}/orders.csv"
    writers.write_table(table(spark, folder, "orders"), path)
    return _orders_summary(readers.read_table(spark, path))


@query("src_json", ORDERS_SUMMARY)
def src_json(spark, folder):
    path = f"{shared_folder(spark)}/orders.json"
    table(spark, folder, "orders").write.json(path)
    return _orders_summary(readers.read_table(spark, path))


@query("src_json_array", ORDERS_SUMMARY)
def src_json_array(spark, folder):
    """One array of objects per file beside files of JSON Lines, in one folder."""
    path, orders = f"{shared_folder(spark)}/orders.json", table(spark, folder, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    orders.filter(~odd).write.json(path)
    object_ = F.to_json(F.struct(*orders.columns))
    # an array per 2,000 order keys and file, so that no collected list grows with the table
    groups = orders.filter(odd).groupBy(F.floor(F.col("o_orderkey") / 2000).alias("g")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(object_), ",\n"), F.lit("\n]")).alias("value"))
    groups.select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).mode("append").text(path)
    return _orders_summary(readers.read_table(spark, path))


def _at_range_sizes(spark, read, sizes):
    """A bounded aggregate of what ``read`` gives, at several sizes of the ranges that files are read in."""
    from ..plans.local import settle

    kept, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), None
    try:
        for size in sizes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            part = settle(read().withColumn("range_size", F.lit(size).cast("bigint")))
            found = part if found is None else found.unionByName(part)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    return found


RANGE_SIZES = (100_003, 1_000_000, 128_000_000)
_SIZES = "(VALUES " + ", ".join(f"({n}::BIGINT)" for n in RANGE_SIZES) + ") r(range_size)"


@query("src_csv_one_large_file", f"""SELECT range_size, o_orderstatus AS status, count(*) AS n, sum(o_custkey)::BIGINT AS customers, sum(length(o_orderpriority) + 27 + (o_orderkey % 3))::BIGINT AS letters
  FROM orders, {_SIZES} GROUP BY 1, 2""")
def src_one_csv(spark, folder):
    """One CSV file, cells with line breaks of both kinds, commas and doubled quotes, read in ranges of several sizes.

    That it is one file is the point, so one task writes it; as many tasks read it as it has ranges.
    """
    path = f"{shared_folder(spark)}/one.csv"
    note = F.concat(F.lit("said \"\"\nand, on line two:\r\n"), F.repeat(F.lit("\n"), (F.col("o_orderkey") % 3).cast("int")), "o_orderpriority")
    frame = table(spark, folder, "orders").select("o_orderstatus", note.alias("note"), "o_custkey")
    frame.coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)

    def read():
        found = readers.read_table(spark, path)
        return found.groupBy(F.col("o_orderstatus").alias("status")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("o_custkey").cast("bigint").alias("customers"), F.sum(F.length("note")).cast("bigint").alias("letters"))

    return _at_range_sizes(spark, read, RANGE_SIZES)


@query("src_json_one_large_array", f"""SELECT range_size, o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS customers, round(sum(o_totalprice), 2) AS total FROM orders, {_SIZES} GROUP BY 1, 2""")
def src_one_array(spark, folder):
    """One file that is one array in one line, with braces and quotes inside texts, read in ranges of several sizes.

    The text writer puts brackets and commas between the records of its only file.  Every range is read and cut by itself, as
    many as hold 128 MB by one task if they are small.
    """
    path, orders = f"{shared_folder(spark)}/one.json", table(spark, folder, "orders")
    note = F.concat(F.lit("}, {\"a\": [\\"), "o_orderpriority")
    objects = orders.select(F.to_json(F.struct("o_orderstatus", F.struct(note.alias("note")).alias("deep"), "o_custkey", "o_totalprice")).alias("value"))
    whole = spark.createDataFrame([("[",)], "value string").unionByName(objects.select(F.concat("value", F.lit(",")).alias("value"))).unionByName(spark.createDataFrame([('{"o_custkey": -1}]',)], "value string"))
    whole.coalesce(1).write.option("lineSep", " ").text(path)
    return _at_range_sizes(spark, lambda: _orders_summary(readers.read_table(spark, path).where("o_custkey >= 0")), RANGE_SIZES)


@query("src_csv_line_breaks", "SELECT o_orderstatus AS status, count(*) AS n, sum(o_custkey)::BIGINT AS customers FROM orders GROUP BY 1")
def src_line_breaks(spark, folder):
    """A quoted cell with a line break and a doubled quote keeps its row, and the columns after it their types."""
    path = f"{shared_folder(spark)}/notes.csv"
    note = F.concat(F.lit("first \"line\"\nsecond, line "), F.col("o_orderpriority")).alias("note")
    frame = table(spark, folder, "orders").select("o_orderstatus", note, "o_custkey")
    frame.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    found = readers.read_table(spark, path).filter(F.col("note").contains("\nsecond"))
    return found.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").cast("bigint").alias("customers"))


@query("src_mixed_encodings", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'café' ELSE 'thé' END AS drink, count(*) AS n FROM orders GROUP BY 1")
def src_mixed(spark, folder):
    """UTF-8 and ISO-8859-1 files in one folder: each is decoded by its own encoding."""
    path = f"{shared_folder(spark)}/drinks.csv"
    even = F.col("o_orderkey") % 2 == 0
    frame = table(spark, folder, "orders").select("o_orderkey", F.when(even, "café").otherwise("thé").alias("drink"))
    for part, code in ((frame.filter(even), "UTF-8"), (frame.filter(~even), "ISO-8859-1")):
        part.write.mode("append").option("header", True).option("encoding", code).csv(path)
    return readers.read_table(spark, path).groupBy("drink").agg(F.count(F.lit(1)).alias("n"))


@query("src_unknown_suffix", ORDERS_SUMMARY)
def src_suffix(spark, folder):
    path = f"{shared_folder(spark)}/orders.data"
    table(spark, folder, "orders").write.option("header", True).csv(path)
    return _orders_summary(readers.read_table(spark, path))


@query("src_empty_input", "SELECT count(*) AS n, true AS refused FROM orders")
def src_empty(spark, folder):
    """A table without rows is refused."""
    path, orders = f"{shared_folder(spark)}/empty.parquet", table(spark, folder, "orders")
    orders.filter("o_orderkey < 0").write.parquet(path)
    try:
        readers.read_table(spark, path)
        refused = False
    except readers.EmptyInput:
        refused = True
    return orders.agg(F.count(F.lit(1)).alias("n"), F.lit(refused).alias("refused"))


@query("snk_parquet", "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM orders")
def snk_parquet(spark, folder):
    path = f"{shared_folder(spark)}/orders.parquet"
    writers.write_table(table(spark, folder, "orders"), path)
    return portable(readers.read_table(spark, path))


@query("src_csv_na_tokens", D + """SELECT status, count(*) AS n FROM
  (SELECT CASE WHEN status NOT IN ('', 'N/A') THEN status END AS status FROM d) x GROUP BY status""")
def src_na_tokens(spark, folder):
    path = f"{shared_folder(spark)}/dirty.csv"
    writers.write_table(dirty(spark, folder), path)
    return readers.read_table(spark, path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("snk_json_report", D + f"SELECT {sql.SHOWN} FROM ({sql.issue_list(COLS, TARGET)}) q")
def snk_report(spark, folder):
    path = f"{shared_folder(spark)}/report"
    report = dirty_report(spark, folder)
    writers.write_report(report, path)
    return shown(spark.read.schema(report.issues.schema).json(f"{path}/issues"))


@query("src_latin1", """SELECT o_orderstatus || 'é' AS status, count(*) AS n FROM orders GROUP BY 1""")
def src_latin1(spark, folder):
    path = f"{shared_folder(spark)}/latin.csv"
    text = table(spark, folder, "orders").select(F.concat("o_orderstatus", F.lit("é")).alias("status"), "o_orderkey")
    text.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_table(spark, path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- profile --------------------------------------------------------------------
@query("pro_counts_and_types", D + f"""SELECT col AS "column", non_null, n - non_null AS nulls, {sql.pct('n - non_null', 'n')} AS null_pct,
  ndv, {sql.pct('ndv', 'n')} AS distinct_pct, {sql.inferred()} AS inferred_type, col = '{TARGET}' AS is_target
  FROM ({sql.distincts(COLS)}) s""")
def pro_counts(spark, folder):
    return profile.column_counts(context(spark, folder)).select(
        "column", "non_null", "nulls", "null_pct", "ndv", "distinct_pct", "inferred_type", "is_target"
    )


@query("pro_counts_lineitem", f"""SELECT col AS "column", n - non_null AS nulls, ndv, {sql.pct('ndv', 'n')} AS distinct_pct,
  {sql.inferred()} AS inferred_type FROM ({sql.distincts(sql.LINEITEM_COLUMNS, 'lineitem')}) s""")
def pro_lineitem(spark, folder):
    return profile.column_counts(TableContext(table(spark, folder, "lineitem"))).select(
        "column", "nulls", "ndv", "distinct_pct", "inferred_type"
    )


@query("pro_distinct_sketches", """SELECT c AS "column", count(*) AS parts, sum(filled)::BIGINT AS non_null, true AS merges_exactly, true AS within_error FROM (
  SELECT 'l_orderkey' AS c, strftime(l_shipdate, '%Y-%m') AS part, count(l_orderkey) AS filled FROM lineitem GROUP BY 2
  UNION ALL SELECT 'l_partkey', strftime(l_shipdate, '%Y-%m'), count(l_partkey) FROM lineitem GROUP BY 2
  UNION ALL SELECT 'l_extendedprice', strftime(l_shipdate, '%Y-%m'), count(l_extendedprice) FROM lineitem GROUP BY 2
  UNION ALL SELECT 'l_shipmonth', strftime(l_shipdate, '%Y-%m'), count(l_shipdate) FROM lineitem GROUP BY 2) x GROUP BY 1""")
def pro_sketches(spark, folder):
    """A stored sketch per month and column: merged they tell what a sketch of all rows tells, near the exact count."""
    from ..plans.sketches import distinct_sketches, estimates, largest_error, merged

    month = F.date_format("l_shipdate", "yyyy-MM")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", month.alias("l_shipmonth"))
    path = f"{shared_folder(spark)}/sketches"
    distinct_sketches(lines, part=F.col("l_shipmonth")).write.parquet(path)
    stored = spark.read.parquet(path)
    parts = stored.groupBy("column").agg(F.count(F.lit(1)).alias("parts"))
    whole = estimates(distinct_sketches(lines)).select("column", F.col("distinct").alias("of_all"))
    exact = lines.agg(*[F.countDistinct(c).alias(c) for c in lines.columns]).unpivot([], lines.columns, "column", "exact")
    found = estimates(merged(stored)).join(parts, "column").join(whole, "column").join(exact, "column")
    near = F.abs(F.col("distinct") - F.col("exact")) <= largest_error() * F.col("exact")
    # union of sketches may round otherwise than one sketch that saw all rows
    same = F.abs(F.col("distinct") - F.col("of_all")) <= largest_error() * F.col("of_all")
    return found.select("column", "parts", "non_null", same.alias("merges_exactly"), near.alias("within_error"))


@query("pro_numeric_summary", D + sql.numeric_summary(COLS))
def pro_numeric(spark, folder):
    return profile.numeric_summary(context(spark, folder)).select("column", *profile.NUMBERS)


@query("pro_numeric_summary_lineitem", sql.numeric_summary(sql.LINEITEM_COLUMNS, "lineitem"))
def pro_numeric_lineitem(spark, folder):
    return profile.numeric_summary(TableContext(table(spark, folder, "lineitem"))).select("column", *profile.NUMBERS)


@query("pro_samples", D + sql.frequent(COLS, 5))
def pro_samples(spark, folder):
    return profile.frequent_values(context(spark, folder), 5, ("string",)).drop("position")


@query("pro_top_values", D + sql.frequent(COLS, 3))
def pro_top(spark, folder):
    return profile.frequent_values(context(spark, folder), 3, ("string",)).drop("position")


@query("pro_top10_values", sql.frequent([("event_type", sql.TXT, False)], 10, "events"))
def pro_top10(spark, folder):
    ctx = TableContext(table(spark, folder, "events").select("event_type"))
    return profile.distribution(ctx, "event_type").drop("position")


@query("pro_histogram", """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events),
  c AS (SELECT least(floor((value - lo) / w), 29)::INTEGER AS bin, count(*) AS cnt FROM events, b WHERE value IS NOT NULL GROUP BY 1)
  SELECT r::INTEGER AS bin, round(lo + r * w, 4) AS bin_start, round(lo + (r + 1) * w, 4) AS bin_end, coalesce(cnt, 0)::BIGINT AS cnt
  FROM b, range(30) t(r) LEFT JOIN c ON c.bin = r""")
def pro_histogram(spark, folder):
    found = profile.histogram(TableContext(table(spark, folder, "events").select("value")), "value")
    return found.select("bin", F.round("bin_start", 4).alias("bin_start"), F.round("bin_end", 4).alias("bin_end"), "cnt")


@query("pro_box_summary", D + sql.union([
    f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS \"min\", round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, "
    f"round(median({c}::DOUBLE), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, max({c})::DOUBLE AS \"max\" FROM d"
    for c, kind, _ in COLS if kind == sql.NUM]))
def pro_box(spark, folder):
    box = profile.box_summary(context(spark, folder))
    return box.select("column", "min", *[F.round(c, 4).alias(c) for c in ("q25", "median", "q75")], "max")


@query("pro_preview", "SELECT least(count(*), 5) AS shown, least(count(*), 5) AS known FROM nation")
def pro_preview(spark, folder):
    """Any five rows of a longer table, all of them rows of it."""
    nation = table(spark, folder, "nation")
    shown = profile.preview(TableContext(nation))
    return shown.join(nation.withColumn("hit", F.lit(1)), nation.columns, "left").agg(F.count(F.lit(1)).alias("shown"), F.count("hit").alias("known"))


@query("pro_type_counts", D + f"""SELECT count(*) FILTER (t LIKE '%numeric%') AS numeric_columns,
  count(*) FILTER (t LIKE '%categorical%') AS categorical_columns, count(*) AS "columns"
  FROM (SELECT {sql.inferred()} AS t FROM ({sql.distincts(COLS)}) s) x""")
def pro_type_counts(spark, folder):
    return profile.type_counts(profile.column_counts(context(spark, folder)))


@query("pro_shape", D + f"SELECT count(*) AS total_rows, {len(COLS)}::BIGINT AS total_columns FROM d")
def pro_shape(spark, folder):
    return profile.shape(context(spark, folder))


def _touched(issues: str) -> str:
    cases = " UNION ALL ".join(
        f"SELECT '{c}' AS col, count(*) AS n FROM i WHERE "
        f"(checker_id NOT IN ('high_correlation', 'data_leakage', 'class_imbalance') AND (fix_action LIKE '%:{c}' ))"
        f" OR (checker_id = 'class_imbalance' AND '{c}' = '{TARGET}') OR (checker_id = 'data_leakage' AND "
        f"('{c}' = '{TARGET}' OR issue_id LIKE '%\\_{c}' ESCAPE '\\'))"
        f" OR (issue_id = 'outliers_multivariate_anomalies' AND '{c}' IN ('k', 'total_price', 'sparse_col', 'base_price'))"  # the first four judged
        f" OR (checker_id = 'high_correlation' AND (fix_action = 'drop_column:{c}' OR starts_with(issue_id, 'high_correlation_collinear_{c}_')))"
        for c, _, _ in COLS)
    return D + f", i AS ({issues}) SELECT col AS \"column\", n AS issues_count FROM ({cases}) x WHERE n > 0"


@query("pro_issue_rollup", _touched(sql.issue_list(COLS, TARGET)))
def pro_rollup(spark, folder):
    return profile.issue_rollup(dirty_report(spark, folder).issues).select("column", "issues_count")


@query("pro_full_profile")
def pro_full(spark, folder):
    ctx = context(spark, folder)
    report = audit(ctx.frame, TARGET, ctx=ctx, checkers={"missing_values": missing.check_missing})
    return report.profile.withColumn("top_values", F.to_json("top_values"))


# ---- completeness ------------------------------------------------------------------
@query("mis_column_breakdown", D + f"""SELECT col AS "column", n, nulls, blanks, nulls + blanks AS missing,
  {sql.pct('nulls + blanks', 'n')} AS missing_pct FROM ({sql.nulls(COLS)}) s""")
def mis_breakdown(spark, folder):
    return missing.missing_breakdown(context(spark, folder)).select(
        "column", "n", "nulls", "blanks", "missing", "missing_pct"
    )


@query("mis_totals", D + f"""SELECT sum(n)::BIGINT AS total_cells, sum(m)::BIGINT AS total_missing_cells,
  {sql.pct('sum(m)::BIGINT', 'sum(n)::BIGINT')} AS overall_missing_percentage, count(*) FILTER (m > 0) AS columns_with_missing,
  count(*) FILTER (p > 0 AND p <= 60) AS columns_to_impute, count(*) FILTER (p > 60) AS columns_to_drop_count,
  sum(blanks)::BIGINT AS whitespace_only_detected
  FROM (SELECT *, nulls + blanks AS m, {sql.pct('nulls + blanks', 'n')} AS p FROM ({sql.nulls(COLS)}) s) t""")
def mis_totals(spark, folder):
    from ..plans.local import local_frame

    found = missing.totals(context(spark, folder))
    types_ = {k: "double" if k == "overall_missing_percentage" else "bigint" for k in found}
    return local_frame(spark, [found], ", ".join(f"{k} {t}" for k, t in types_.items()))


@query("mis_issues_with_target", D + f"SELECT {sql.SHOWN} FROM ({sql.missing_issues(COLS, 'total_price')}) q")
def mis_issues_target(spark, folder):
    return shown(missing.check_missing(TableContext(dirty(spark, folder), "total_price")).issues)


@query("mis_sparse_rows", D + f"""SELECT {sql.SHOWN} FROM (
  {sql.missing_issues([('total_price', sql.NUM, True), ('sparse_col', sql.NUM, False)], '', '(SELECT total_price, sparse_col FROM d) p')}) q""")
def mis_sparse(spark, folder):
    return shown(missing.check_missing(TableContext(dirty(spark, folder).select("total_price", "sparse_col"))).issues)


@query("mis_empty_table", "SELECT 'CRITICAL' AS severity, 0.0::DOUBLE AS score, count(*) AS n FROM (SELECT 1 FROM orders LIMIT 1) o")
def mis_empty(spark, folder):
    ctx = TableContext(table(spark, folder, "orders").filter("o_orderkey < 0"))
    check = run_checker(ctx, "missing_values", missing.check_missing)
    scores = scoring.checker_scores(scoring.checker_table([check]), check.issues)
    return check.issues.join(scores, "checker_id").groupBy("severity", "score").agg(F.count(F.lit(1)).alias("n"))


# ---- uniqueness ---------------------------------------------------------------------
@query("dup_exact_rows", D + f"""SELECT n, c AS duplicates, {sql.pct('c', 'n')} AS duplicate_pct
  FROM (SELECT count(*) AS n, {sql.repeats([c for c, _, _ in COLS])} AS c FROM d) x""")
def dup_exact(spark, folder):
    return duplicates.exact_duplicates(context(spark, folder))


LINE_KEYS = sql.key_names(sql.LINEITEM_COLUMNS)


@query("dup_key_violations", sql.union([
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS ndv, count({c}) - count(DISTINCT {c}) AS repeated, "
    f"{sql.pct(f'count({c}) - count(DISTINCT {c})', f'count({c})')} AS repeated_pct FROM lineitem" for c in LINE_KEYS]))
def dup_keys(spark, folder):
    ctx = TableContext(table(spark, folder, "lineitem"))
    return duplicates.key_violations(ctx).select("column", "non_null", "ndv", "repeated", "repeated_pct")


DOC_COLUMNS = [("doc_id", sql.NUM, False), ("text", sql.TXT, False), ("lang", sql.TXT, False), ("n_chars", sql.NUM, False)]


@query("dup_same_features", f"""SELECT n, r AS repeats, r - x AS extra, {sql.pct('r - x', 'n')} AS extra_pct FROM (SELECT count(*) AS n,
  {sql.repeats(['text', 'lang', 'n_chars'], 'documents')} AS r, {sql.repeats(['doc_id', 'text', 'lang', 'n_chars'], 'documents')} AS x FROM documents) s""")
def dup_features(spark, folder):
    return duplicates.feature_duplicates(TableContext(table(spark, folder, "documents").drop("source")))


@query("dup_issues_lineitem", f"SELECT {sql.SHOWN} FROM ({sql.duplicate_issues(sql.LINEITEM_COLUMNS, None, 'lineitem')}) q")
def dup_lineitem(spark, folder):
    return shown(duplicates.check_duplicates(TableContext(table(spark, folder, "lineitem"))).issues)


@query("dup_issues_documents", f"SELECT {sql.SHOWN} FROM ({sql.duplicate_issues(DOC_COLUMNS, None, 'documents')}) q")
def dup_documents(spark, folder):
    return shown(duplicates.check_duplicates(TableContext(table(spark, folder, "documents").drop("source"))).issues)


# ---- outliers -----------------------------------------------------------------------
def _fence_rows(stats: str) -> str:
    return f"""SELECT col AS "column", non_null, round(q1, 4) AS q25, round(median, 4) AS median, round(q3, 4) AS q75, round(mad, 4) AS mad,
  round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound, outliers, extremes, z_outliers,
  {sql.pct('outliers', 'non_null')} AS outlier_pct, {sql.pct('extremes', 'non_null')} AS extreme_pct FROM ({stats}) s"""


def _fences(ctx: TableContext) -> DataFrame:
    rounded = [F.round(c, 4).alias(c) for c in ("q25", "median", "q75", "mad", "lower_bound", "upper_bound")]
    return outliers.outlier_stats(ctx).select(
        "column", "non_null", *rounded, "outliers", "extremes", "z_outliers", "outlier_pct", "extreme_pct"
    )


@query("out_stats", D + _fence_rows(sql.fences(COLS, TARGET)))
def out_stats(spark, folder):
    return _fences(context(spark, folder))


EVENT_COLUMNS = [("event_id", sql.NUM, False), ("user_id", sql.NUM, False), ("value", sql.NUM, True)]


@query("out_stats_events", _fence_rows(sql.fences(EVENT_COLUMNS, None, "events")))
def out_events(spark, folder):
    return _fences(TableContext(table(spark, folder, "events")))


@query("out_stats_documents", _fence_rows(sql.fences([("doc_id", sql.NUM, False), ("n_chars", sql.NUM, False)], None, "documents")))
def out_documents(spark, folder):
    return _fences(TableContext(table(spark, folder, "documents")))


@query("out_stats_large_table_path", D + _fence_rows(sql.fences(
    [c if c[0] == "total_price" else (c[0], sql.TXT, c[2]) for c in COLS], TARGET)))
def out_large(spark, folder):
    """The same figures by the bracket search that tables beyond the buffer limit take."""
    frame = dirty(spark, folder)
    kept = frame.select(*[F.col(c) if c == "total_price" else F.col(c).cast("string").alias(c) for c in frame.columns])
    return _fences(TableContext(kept, TARGET, buffer_limit=2_000))


@query("out_repeated_rows", """WITH n AS (SELECT count(*) AS n FROM lineitem), far AS (SELECT count(*) AS n FROM lineitem WHERE l_orderkey % 300 = 7)
  SELECT n.n AS n, far.n AS planted, far.n AS found FROM n, far""")
def out_repeated(spark, folder):
    """A table of few distinct rows: the planted far-off rows, as often as they occur, have the highest scores."""
    from ..operators.iforest import anomaly_scores

    far = F.col("l_orderkey") % 300 == 7
    usual = [(F.col("l_linenumber") * k).cast("double") for k in (1, 3)] + [F.col("l_quantity").cast("int").cast("double")]
    frame = table(spark, folder, "lineitem").select(far.alias("planted"), *[F.when(far, 400.0 + 9 * i).otherwise(c).alias(f"v{i}") for i, c in enumerate(usual)])
    scores = anomaly_scores(TableContext(frame), ["v0", "v1", "v2"], keep=["planted"])
    lowest = scores.filter("planted").agg(F.min("anomaly").alias("cut"))
    above = scores.join(F.broadcast(lowest)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("planted").alias("planted"), F.count_if(F.col("anomaly") >= F.col("cut")).alias("found"))
    return above


@query("out_joint_anomalies", D + """SELECT count(*) AS n, true AS some_found, true AS within_share FROM d""")
def out_joint(spark, folder):
    """Rows above the 97 % quantile of the scores: some, and no more than 3 % of all."""
    from ..operators.iforest import joint_anomalies

    ctx = context(spark, folder)
    found = joint_anomalies(ctx, outliers.candidates(ctx))
    return ctx.frame.agg(F.count(F.lit(1)).alias("n"), F.lit(found > 0).alias("some_found"), (F.lit(found) <= F.ceil(0.03 * F.count(F.lit(1)))).alias("within_share"))


@query("out_joint_scores")
def out_forest(spark, folder):
    from ..operators.iforest import CONTAMINATION, joint_anomalies, kept_scores
    from ..plans.local import local_frame

    ctx = context(spark, folder)
    names = outliers.candidates(ctx)
    scores = kept_scores(ctx, names)
    rows = [{"n": ctx.count, "columns": len(names), "anomalies": joint_anomalies(ctx, names, scores)}]
    best = scores.agg(F.round(F.max("anomaly"), 4).alias("highest_score"))
    found = local_frame(spark, rows, "n bigint, columns bigint, anomalies bigint")
    return found.crossJoin(F.broadcast(best)).withColumn("contamination", F.lit(CONTAMINATION))


# ---- constant columns, suspicious values ---------------------------------------------
@query("con_column_states", D + f"""SELECT col AS "column", non_null, ndv, top_value, top_count, top_pct, state
  FROM ({sql.constants(COLS, TARGET)}) s WHERE state IS NOT NULL""")
def con_states(spark, folder):
    return constant_ops.constant_stats(context(spark, folder)).filter("state IS NOT NULL").select(
        "column", "non_null", "ndv", "top_value", "top_count", "top_pct", "state"
    )


@query("sus_text_sentinels", D + f"""SELECT col AS "column", non_null, hits AS text_hits, examples, {sql.pct('hits', 'non_null')} AS hit_pct
  FROM ({sql.sentinel_words(COLS)}) s WHERE hits > 0""")
def sus_text(spark, folder):
    found = suspicious.text_sentinels(context(spark, folder))
    return found.select("column", "non_null", "text_hits", F.array_join("text_examples", ", ").alias("examples"), "hit_pct")


@query("sus_numeric_sentinels", D + f"""SELECT col AS "column", sentinel, hits, {sql.pct('hits', 'non_null')} AS hit_pct
  FROM ({sql.sentinel_codes(COLS)}) s""")
def sus_numeric(spark, folder):
    return suspicious.numeric_sentinels(context(spark, folder)).select("column", "sentinel", "hits", "hit_pct")


AGES = """(SELECT c_custkey AS cust, c_acctbal::INTEGER % 150 AS age, c_acctbal AS annual_income, c_acctbal / 50 AS bmi FROM customer) a"""
AGE_COLUMNS = [("cust", sql.NUM, False), ("age", sql.NUM, False), ("annual_income", sql.NUM, True), ("bmi", sql.NUM, True)]


def people(spark, folder) -> DataFrame:
    """Customers with an age, an income and a body-mass column derived from the balance."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("cust"), F.round("c_acctbal").cast("int").alias("balance"), "c_acctbal"
    ).select("cust", (F.col("balance") % 150).alias("age"), F.col("c_acctbal").alias("annual_income"),
             (F.col("c_acctbal") / 50).alias("bmi"))


AGES = AGES.replace("c_acctbal::INTEGER", "round(c_acctbal)::INTEGER")


@query("sus_impossible_values", f"""SELECT col AS "column", rule, bad, {sql.pct('bad', 'non_null')} AS bad_pct
  FROM ({sql.impossible(AGE_COLUMNS, AGES)}) s""")
def sus_ranges(spark, folder):
    return suspicious.impossible_values(TableContext(people(spark, folder))).select("column", "rule", "bad", "bad_pct")


@query("sus_issues_people", f"SELECT {sql.SHOWN} FROM ({sql.suspicious_issues([c for c in AGE_COLUMNS] + [('t', sql.TXT, False)], None, AGES.replace('AS bmi', f'AS bmi, {chr(39)}x{chr(39)} AS t'))}) q")
def sus_people(spark, folder):
    return shown(suspicious.check_suspicious(TableContext(people(spark, folder).withColumn("t", F.lit("x")))).issues)


@query("sus_flagged_columns", D + f"""SELECT count(DISTINCT col) AS suspicious_columns FROM (
  SELECT col FROM ({sql.sentinel_words(COLS)}) a WHERE hits > 0 UNION ALL SELECT col FROM ({sql.sentinel_codes(COLS)}) b
  UNION ALL SELECT col FROM ({sql.impossible(COLS)}) c) x""")
def sus_columns(spark, folder):
    issues = suspicious.check_suspicious(context(spark, folder)).issues
    return issues.agg(F.count_distinct(F.get("affected_columns", F.lit(0))).alias("suspicious_columns"))


@query("out_forest_nodes", "SELECT count(*) AS n, 100::BIGINT AS trees, 0::BIGINT AS other_scores, 0::BIGINT AS bad_nodes FROM lineitem")
def out_forest(spark, folder):
    """The forest as a node table: rows joined with its trees get the scores of the numpy walk, and every split has two children."""
    from ..operators import iforest
    from ..plans.local import durable, stored

    lines = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", F.monotonically_increasing_id().alias("row"))
    lines = stored(lines)
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    ctx = TableContext(lines)
    filled, points, plain = iforest.filled_points(ctx, names)
    values = [f"v{i}" for i in range(3)]
    nodes = durable(iforest.grow_forest(points, values, plain, ctx.count))
    by_table = iforest.scores_by_table(ctx.rows.select(*filled, ctx.column("row").alias("row")), "row", values, nodes, ctx.count)
    both = iforest.anomaly_scores(ctx, names, ["row"], nodes).join(by_table.withColumnRenamed("anomaly", "again"), "row")
    inner = nodes.where("feature >= 0")
    children = inner.select("tree", F.explode(F.array(2 * F.col("node") + 1, 2 * F.col("node") + 2)).alias("node"))
    bad = children.join(nodes, ["tree", "node"], "left_anti").count() + nodes.where("node > 0").join(children, ["tree", "node"], "left_anti").count()
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.lit(nodes.select("tree").distinct().count()).cast("bigint").alias("trees"),
        F.count_if(F.abs(F.col("anomaly") - F.col("again")) > 1e-9).alias("other_scores"), F.lit(bad).cast("bigint").alias("bad_nodes"))


# ---- correlation, types ---------------------------------------------------------------
@query("cor_pairs", D + f"SELECT col_a, col_b, round(r, 4) AS r FROM ({sql.pairs(COLS, TARGET)}) s")
def cor_pairs(spark, folder):
    return correlation.correlation_pairs(context(spark, folder)).select("col_a", "col_b", F.round("r", 4).alias("r"))


@query("cor_pairs_lineitem", f"SELECT col_a, col_b, round(r, 4) AS r FROM ({sql.pairs(sql.LINEITEM_COLUMNS, None, 'lineitem')}) s")
def cor_lineitem(spark, folder):
    found = correlation.correlation_pairs(TableContext(table(spark, folder, "lineitem")))
    return found.select("col_a", "col_b", F.round("r", 4).alias("r"))


@query("cor_collinear", D + f"""SELECT col_a, col_b, round(r, 4) AS r, CASE WHEN abs(r) >= 0.95 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM ({sql.pairs(COLS, TARGET)}) s WHERE abs(r) >= 0.85""")
def cor_collinear(spark, folder):
    return correlation.collinear_pairs(context(spark, folder)).select("col_a", "col_b", F.round("r", 4).alias("r"), "severity")


@query("cor_matrix", D + f"""SELECT col_a, col_b, round(r, 2) AS r FROM (SELECT col_a, col_b, r FROM ({sql.pairs(COLS, TARGET)}) a
  UNION ALL SELECT col_b, col_a, r FROM ({sql.pairs(COLS, TARGET)}) b
  UNION ALL {sql.union([f"SELECT '{c}', '{c}', CASE WHEN stddev_samp({c}) > 0 THEN 1.0 ELSE 0.0 END FROM d" for c, k, _ in COLS if k == sql.NUM and c != TARGET])}) m""")
def cor_matrix(spark, folder):
    return correlation.correlation_matrix(context(spark, folder))


@query("typ_text_shapes", D + f'SELECT col AS "column", non_null, currency, dates, numbers, booleans, words, verdict FROM ({sql.shapes(COLS)}) s')
def typ_shapes(spark, folder):
    return types.text_shapes(context(spark, folder)).select(
        "column", "non_null", "currency", "dates", "numbers", "booleans", "words", "verdict"
    )


_MIXED = """(SELECT CASE o_orderkey % 4 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN 'true' WHEN 2 THEN '2020-01-05'
  ELSE o_orderstatus END AS grab_bag, o_orderstatus AS status FROM orders) x"""


@query("typ_mixed_text", f"""SELECT col AS "column", numbers, booleans, dates, words, verdict
  FROM ({sql.shapes([('grab_bag', sql.TXT, False), ('status', sql.TXT, False)], _MIXED)}) s""")
def typ_mixed(spark, folder):
    turn = F.col("o_orderkey") % 4
    bag = (
        F.when(turn == 0, F.col("o_orderkey").cast("string")).when(turn == 1, "true").when(turn == 2, "2020-01-05")
        .otherwise(F.col("o_orderstatus"))
    )
    frame = table(spark, folder, "orders").select(bag.alias("grab_bag"), F.col("o_orderstatus").alias("status"))
    return types.text_shapes(TableContext(frame)).select("column", "numbers", "booleans", "dates", "words", "verdict")


_WHOLE = "(SELECT (o_orderkey % 4)::DOUBLE AS quarter, o_totalprice FROM orders) x"


_BAGS = """(SELECT (o_orderkey % 5) AS turn, o_orderstatus FROM orders) x"""


@query("typ_mixed_json", f"""SELECT 'bag' AS "column", count(*) FILTER (turn = 0) AS numbers, count(*) FILTER (turn = 1) AS booleans, count(*) FILTER (turn IN (2, 4)) AS words,
  0::BIGINT AS objects, 0::BIGINT AS arrays, count(*) FILTER (turn = 3) AS voids, 'mixed' AS verdict, 'HIGH' AS severity FROM {_BAGS}
  UNION ALL SELECT 'deep', 0, 0, 0, count(*) FILTER (turn % 2 = 0), count(*) FILTER (turn % 2 = 1), 0, 'mixed', 'HIGH' FROM {_BAGS}
  UNION ALL SELECT 'status', 0, 0, count(*), 0, 0, 0, NULL, NULL FROM {_BAGS}""")
def typ_json(spark, folder):
    """Fields of JSON texts whose values are numbers, booleans, words and nulls by turns, or objects and arrays; and a clean one."""
    turn, status = F.col("o_orderkey") % 5, F.col("o_orderstatus")
    value = F.when(turn == 0, F.col("o_orderkey").cast("string")).when(turn == 1, "true").when(turn == 2, '"12"').when(turn == 3, "null").otherwise(F.concat(F.lit('"'), status, F.lit('"')))
    deep = F.when(turn % 2 == 0, '{"a": 1}').otherwise("[1, 2]")
    text = F.concat(F.lit('{"bag": '), value, F.lit(', "deep": '), deep, F.lit(', "status": "'), status, F.lit('"}'))
    line = table(spark, folder, "orders").select(F.parse_json(text).alias("v"))
    frame = line.select(*[F.variant_get("v", f"$.{c}", "variant").alias(c) for c in ("bag", "deep", "status")])
    ctx = TableContext(frame)
    issues = types.check_types(ctx).issues.select(F.get("affected_columns", F.lit(0)).alias("column"), "severity")
    found = types.variant_shapes(ctx).select("column", "numbers", "booleans", "words", "objects", "arrays", "voids", "verdict")
    return found.join(issues, "column", "left")


@query("typ_whole_floats", f"""SELECT col AS "column", as_integer FROM (
  {sql.whole_floats([('quarter', sql.NUM, True), ('o_totalprice', sql.NUM, True)], _WHOLE)}) s""")
def typ_whole(spark, folder):
    frame = table(spark, folder, "orders").select((F.col("o_orderkey") % 4).cast("double").alias("quarter"), "o_totalprice")
    return types.whole_floats(TableContext(frame)).select("column", "as_integer")


# ---- imbalance, leakage -----------------------------------------------------------------
@query("imb_target_found", D + "SELECT 'status' AS by_name, 'rare_target' AS last_binary, count(*) AS n FROM d")
def imb_target(spark, folder):
    frame = dirty(spark, folder)
    by_name = imbalance.balance_target(TableContext(frame))
    renamed = frame.select("k", "const_col", F.col("quasi").alias("grp"), F.col("rare_target").alias("rare_target_"))
    last = imbalance.balance_target(TableContext(renamed))
    return frame.agg(F.lit(by_name).alias("by_name"), F.lit(last.rstrip("_")).alias("last_binary"), F.count(F.lit(1)).alias("n"))


@query("imb_continuous_target", "SELECT count(*) AS n, 0 AS issues, true AS classes_unknown FROM orders")
def imb_continuous(spark, folder):
    """A target with more than ten values has no class balance, and no class count is invented for it."""
    orders = table(spark, folder, "orders")
    found = imbalance.check_imbalance(TableContext(orders, "o_totalprice"))
    return orders.agg(F.count(F.lit(1)).alias("n"), F.lit(found.issues.count()).alias("issues"), F.lit(found.metrics["classes_count"] is None).alias("classes_unknown"))


@query("imb_empty_target", "SELECT count(*) AS n, 'class_imbalance_error' AS issue_id, 'MEDIUM' AS severity, 50.0::DOUBLE AS penalty FROM orders")
def imb_empty(spark, folder):
    orders = table(spark, folder, "orders").withColumn("empty", F.lit(None).cast("string"))
    issue = imbalance.check_imbalance(TableContext(orders, "empty")).issues.select("issue_id", "severity", F.col("penalty").cast("double").alias("penalty"))
    return orders.agg(F.count(F.lit(1)).alias("n")).join(issue)


@query("con_all_null", """SELECT 'nothing' AS "column", 'all_null' AS state, count(*) AS affected FROM orders
  UNION ALL SELECT 'one', 'constant', count(*) FROM orders""")
def con_all_null(spark, folder):
    frame = table(spark, folder, "orders").select("o_orderkey", F.lit(None).cast("double").alias("nothing"), F.lit(7).alias("one"))
    found = constant_ops.check_constant(TableContext(frame)).issues
    state = F.when(F.col("issue_id").contains("all_null_"), "all_null").otherwise("constant")
    return found.select(F.col("affected_columns")[0].alias("column"), state.alias("state"), F.col("affected_rows_count").cast("bigint").alias("affected"))


@query("mis_bands", """WITH s AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 10 >= 6) AS b40, count(*) FILTER (o_orderkey % 10 >= 3) AS b70 FROM orders)
  SELECT 'some' AS "column", 'MEDIUM' AS severity, b40 AS missing FROM s UNION ALL SELECT 'most', 'HIGH', b70 FROM s""")
def mis_bands(spark, folder):
    """A column with about 40 % missing cells and one with about 70 %."""
    digit = F.col("o_orderkey") % 10
    frame = table(spark, folder, "orders").select("o_orderkey", F.when(digit < 6, 1).alias("some"), F.when(digit < 3, 1).alias("most"))
    found = missing.check_missing(TableContext(frame)).issues
    return found.filter(F.size("affected_columns") == 1).select(F.col("affected_columns")[0].alias("column"), "severity", F.col("affected_rows_count").cast("bigint").alias("missing"))


@query("sus_text_numbers", """SELECT 'price' AS "column", count(*) FILTER (o_orderkey % 50 = 0) AS hits FROM orders""")
def sus_text_numbers(spark, folder):
    """A text column that mostly reads as numbers is searched for numeric sentinels."""
    price = F.when(F.col("o_orderkey") % 50 == 0, "-999").when(F.col("o_orderkey") % 7 == 0, "by phone").otherwise(F.format_string("%.2f", "o_totalprice"))
    found = suspicious.numeric_sentinels(TableContext(table(spark, folder, "orders").select(price.alias("price"))))
    return found.select("column", F.col("hits").cast("bigint").alias("hits"))


@query("lek_target_by_name", "SELECT count(*) AS n, 'loan_status' AS target FROM orders")
def lek_by_name(spark, folder):
    frame = table(spark, folder, "orders").withColumnRenamed("o_orderstatus", "loan_status")
    return frame.agg(F.count(F.lit(1)).alias("n"), F.lit(leakage.leakage_target(TableContext(frame))).alias("target"))


@query("imb_class_distribution", f"""SELECT label, cnt, {sql.pct('cnt', 'n')} AS pct FROM (SELECT o_orderpriority AS label, count(*) AS cnt,
  (SELECT count(*) FROM orders) AS n FROM orders GROUP BY 1) s""")
def imb_distribution(spark, folder):
    return imbalance.class_distribution(TableContext(table(spark, folder, "orders")), "o_orderpriority")


def _balance(ctx: TableContext, target: str) -> DataFrame:
    return imbalance.class_balance(imbalance.class_distribution(ctx, target)).withColumn(
        "total", F.col("total").cast("bigint")
    )


@query("imb_balance_quality", sql.balance("quality", "labels"))
def imb_quality(spark, folder):
    return _balance(TableContext(table(spark, folder, "labels")), "quality")


@query("imb_balance_toxic", sql.balance("toxic", "labels"))
def imb_toxic(spark, folder):
    return _balance(TableContext(table(spark, folder, "labels")), "toxic")


@query("imb_balance_rare_target", D + sql.balance("rare_target"))
def imb_rare(spark, folder):
    return _balance(TableContext(dirty(spark, folder), "rare_target"), "rare_target")


@query("imb_issues", D + f"SELECT {sql.SHOWN} FROM ({sql.imbalance_issues(COLS, 'rare_target')}) q")
def imb_issues(spark, folder):
    return shown(imbalance.check_imbalance(TableContext(dirty(spark, folder), "rare_target")).issues)


@query("lek_target_correlations", D + f"""SELECT col AS "column", round(abs_r, 4) AS abs_r, pairs FROM ({sql.leak_numbers(COLS, TARGET)}) s WHERE pairs > 20""")
def lek_numbers(spark, folder):
    return leakage.target_correlations(context(spark, folder)).select("column", F.round("abs_r", 4).alias("abs_r"), "pairs")


@query("lek_text_target", D + """SELECT 'base_price' AS "column", round(abs(corr(base_price, y)), 4) AS abs_r FROM
  (SELECT base_price, dense_rank() OVER (ORDER BY status) - 1 AS y FROM d) x""")
def lek_text(spark, folder):
    ctx = TableContext(dirty(spark, folder).select("base_price", "status"), "status")
    return leakage.target_correlations(ctx).select("column", F.round("abs_r", 4).alias("abs_r"))


@query("lek_proxy_purity", D + f'SELECT col AS "column", round(purity, 6) AS purity FROM ({sql.purity(COLS, TARGET)}) s')
def lek_purity(spark, folder):
    return leakage.proxy_purity(context(spark, folder)).select("column", F.round("purity", 6).alias("purity"))


_PROXY = "(SELECT o_orderstatus, o_orderpriority, (o_orderstatus = 'F')::INT AS target FROM orders) p"


@query("lek_issues_proxy", f"""SELECT {sql.SHOWN} FROM ({sql.leakage_issues([('o_orderstatus', sql.TXT, False),
  ('o_orderpriority', sql.TXT, False), ('extra', sql.NUM, False)], TARGET, _PROXY.replace('FROM orders', ', o_totalprice AS extra FROM orders').replace('target ,', 'target,'))}) q""")
def lek_proxy(spark, folder):
    frame = table(spark, folder, "orders").select(
        "o_orderstatus", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias(TARGET),
        F.col("o_totalprice").alias("extra"),
    )
    return shown(leakage.check_leakage(TableContext(frame, TARGET)).issues)


# ---- the checks' issues, one query per check ------------------------------------------------
def _register_check(checker_id: str) -> None:
    make, _ = sql.CHECKS[checker_id]

    @query(f"issues_{checker_id}", D + f"SELECT {sql.SHOWN} FROM ({make(COLS, TARGET)}) q")
    def run(spark, folder):
        return shown(CHECKERS[checker_id](context(spark, folder)).issues)


for _checker in sql.CHECKS:
    _register_check(_checker)

# ---- scoring and reporting ---------------------------------------------------------------
SCORED = D + ", " + sql.score_ctes(COLS, TARGET) + " "
OVERALL = "(SELECT round(greatest(0, least(100, sum(weighted_score))), 1) AS overall_score FROM dims)"


@query("sco_all_issues", SCORED + f"SELECT {sql.SHOWN} FROM issues")
def sco_issues(spark, folder):
    return shown(dirty_report(spark, folder).issues)


@query("sco_checker_scores", SCORED + "SELECT checker_id, dimension, passed, score, n_issues FROM checkers")
def sco_checkers(spark, folder):
    return dirty_report(spark, folder).checker_scores.select("checker_id", "dimension", "passed", "score", "n_issues")


@query("sco_dimension_scores", SCORED + "SELECT * FROM dims")
def sco_dimensions(spark, folder):
    return dirty_report(spark, folder).dimension_scores.withColumn("dimension_no", F.col("dimension_no").cast("int"))


@query("sco_overall", SCORED + f"SELECT overall_score, {sql.GRADE} AS grade FROM {OVERALL} o")
def sco_overall(spark, folder):
    return dirty_report(spark, folder).overall


@query("sco_grades", f"""SELECT n_chars, overall_score, {sql.GRADE} AS grade FROM
  (SELECT n_chars, (n_chars % 1001) / 10.0 AS overall_score, count(*) FROM documents GROUP BY n_chars) x""")
def sco_grades(spark, folder):
    scores = table(spark, folder, "documents").select("n_chars").distinct()
    scores = scores.withColumn("overall_score", (F.col("n_chars") % 1001) / F.lit(10.0))
    return scores.withColumn("grade", grade_of(F.col("overall_score")))


@query("sco_alerts", SCORED + f""", m AS (SELECT {sql.pct('sum(nulls + blanks)::BIGINT', f'any_value(n) * {len(COLS)}')} AS p
    FROM ({sql.nulls(COLS)}) s), a AS (
  SELECT 1 AS alert_no, 'missing_values' AS code, p AS amount FROM m WHERE p > 0
  UNION ALL SELECT 2, 'duplicate_rows', affected_rows_count FROM issues WHERE issue_id = 'duplicate_rows_exact_duplicates_found'
  UNION ALL SELECT 3, 'class_imbalance', affected_rows_percentage FROM issues WHERE checker_id = 'class_imbalance' AND severity IN ('CRITICAL', 'HIGH')
  UNION ALL SELECT 4, 'data_leakage', count(*) FROM issues WHERE checker_id = 'data_leakage' AND penalty = 45 HAVING count(*) > 0
  UNION ALL SELECT 5, 'outliers', count(*) FROM issues WHERE checker_id = 'outliers' AND penalty = 12 HAVING count(*) > 0
  UNION ALL SELECT 6, 'suspicious_values', count(DISTINCT seq // 100) FROM issues WHERE checker_id = 'suspicious_values' HAVING count(*) > 0
  UNION ALL SELECT 7, 'high_correlation', count(*) FROM issues WHERE checker_id = 'high_correlation' HAVING count(*) > 0
  UNION ALL SELECT 8, 'data_types', count(*) FROM issues WHERE checker_id = 'data_types' AND penalty = 18 HAVING count(*) > 0
  UNION ALL SELECT 9, 'constant_columns', count(*) FROM issues WHERE checker_id = 'constant_columns' AND penalty = 10 HAVING count(*) > 0)
  SELECT alert_no, code, amount::DOUBLE AS amount FROM a""")
def sco_alerts(spark, folder):
    return dirty_report(spark, folder).alerts.select("alert_no", "code", "amount")


RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
PLAN = f"""SELECT row_number() OVER (ORDER BY {RANK}, checker_no, seq, issue_id)::INTEGER AS step, issue_id, dimension,
  severity, fix_action, fix_action IS NOT NULL AS auto_fixable FROM issues JOIN checkers USING (checker_id)"""


@query("sco_recommendations", SCORED + PLAN)
def sco_recommendations(spark, folder):
    return dirty_report(spark, folder).recommendations.select(
        "step", "issue_id", "dimension", "severity", "fix_action", "auto_fixable"
    )


@query("sco_severity_counts", SCORED + """SELECT rank, s.severity, count(issue_id) AS cnt FROM
  (VALUES (0, 'CRITICAL'), (1, 'HIGH'), (2, 'MEDIUM'), (3, 'LOW'), (4, 'INFO')) s(rank, severity)
  LEFT JOIN issues i ON i.severity = s.severity GROUP BY rank, s.severity""")
def sco_severities(spark, folder):
    return dirty_report(spark, folder).severity_counts


@query("sco_report", SCORED + f"""SELECT 'orders' AS dataset, (SELECT count(*) FROM d) AS total_rows, {len(COLS)}::BIGINT AS total_columns,
  '{TARGET}' AS target, overall_score, {sql.GRADE} AS grade, (SELECT count(*) FROM issues) AS total_issues FROM {OVERALL} o""")
def sco_report(spark, folder):
    return audit(dirty(spark, folder), TARGET, name="orders", checkers=CHECKERS).summary


@query("sco_failing_checker", "SELECT 'broken' AS checker_id, 50.0::DOUBLE AS score, false AS passed, 'MEDIUM' AS severity, 'broken_error' AS issue_id, count(*) AS n FROM orders")
def sco_failing(spark, folder):
    def broken(ctx):
        ctx.rows.select("no_such_column").collect()

    report = audit(table(spark, folder, "orders"), checkers={"broken": broken})
    return report.checker_scores.join(report.issues, "checker_id").select(
        "checker_id", "score", "passed", "severity", "issue_id", F.lit(report.ctx.count).cast("bigint").alias("n")
    )


@query("sco_custom_checker", "SELECT 'late_orders' AS checker_id, 'LOW' AS severity, count(*) FILTER (o_orderstatus = 'P') AS affected_rows_count FROM orders")
def sco_custom(spark, folder):
    from ..operators.issues import make_issues

    def pending(ctx):
        found = ctx.frame.filter("o_orderstatus = 'P'").agg(F.count(F.lit(1)).alias("n"))
        return Check("late_orders", make_issues(
            found, "late_orders", issue_id=F.lit("pending"), severity="LOW", title=F.lit("pending orders"),
            remediation="follow up", rows=F.col("n"), penalty=5.0))

    report = audit(table(spark, folder, "orders"), checkers={"late_orders": pending})
    return report.issues.select("checker_id", "severity", "affected_rows_count")


CLEAN_CHECKERS = {k: v for k, v in CHECKERS.items()}


@query("sco_before_after", D + ", " + sql.CLEAN_CTES + ", " + sql.score_ctes(COLS, TARGET, "d", "a_") + ", "
       + sql.score_ctes(sql.CLEAN_COLUMNS, TARGET, "c", "b_")
       + """ SELECT a.dimension, a.score AS score_before, b.score AS score_after, round(b.score - a.score, 1) AS delta
       FROM a_dims a JOIN b_dims b USING (dimension)""")
def sco_before_after(spark, folder):
    before = dirty_report(spark, folder)
    cleaned = repair(before.ctx.frame, target=TARGET, report=before)
    after = audit(cleaned.frame, TARGET, checkers=CLEAN_CHECKERS)
    return compare_reports(before, after).drop("dimension_no")


@query("sco_gates", SCORED + f"""SELECT 'min_score' AS gate, overall_score >= 80 AS passed, overall_score AS value, 80.0::DOUBLE AS threshold FROM {OVERALL} o
  UNION ALL SELECT 'no_leakage', count(*) = 0, count(*)::DOUBLE, 0.0::DOUBLE FROM (SELECT 1 FROM issues WHERE checker_id = 'data_leakage' AND penalty = 45 LIMIT 1) l""")
def sco_gates(spark, folder):
    report = dirty_report(spark, folder)
    return scoring.score_gate(report.overall, 80.0).unionByName(scoring.leakage_gate(report.alerts))


@query("sco_diagnosis", SCORED + f""", f AS (SELECT overall_score, {sql.GRADE} AS grade,
    (SELECT count(*) > 0 FROM issues WHERE checker_id = 'data_leakage' AND penalty = 45) AS target_leakage,
    (SELECT count(*) > 0 FROM issues WHERE checker_id = 'class_imbalance' AND severity IN ('CRITICAL', 'HIGH')) AS class_imbalance,
    (SELECT count(*) > 0 FROM issues WHERE checker_id = 'missing_values') AS missing_data,
    (SELECT count(*) > 0 FROM issues WHERE checker_id = 'suspicious_values') AS sentinel_codes,
    (SELECT count(*) > 0 FROM issues WHERE issue_id = 'duplicate_rows_exact_duplicates_found') AS duplicate_records FROM {OVERALL} o)
  SELECT *, CASE risk_level WHEN 'LOW' THEN 15 WHEN 'MODERATE' THEN 45 WHEN 'HIGH' THEN 75 ELSE 95 END AS risk_score FROM (
  SELECT *, CASE WHEN overall_score >= 85 AND NOT target_leakage THEN 'LOW' WHEN overall_score >= 70 THEN 'MODERATE'
    WHEN overall_score >= 50 OR target_leakage THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM f) x""")
def sco_diagnosis(spark, folder):
    return dirty_report(spark, folder).diagnosis


@query("sco_root_causes", SCORED + """SELECT checker_no, checker_id, passed, score, n_issues FROM checkers
  WHERE NOT passed OR score < 95 ORDER BY checker_no LIMIT 5""")
def sco_causes(spark, folder):
    return scoring.root_causes(dirty_report(spark, folder).checker_scores)


@query("sco_first_actions", SCORED + f"SELECT step, issue_id, fix_action FROM ({PLAN}) p WHERE step <= 4")
def sco_actions(spark, folder):
    return scoring.first_actions(dirty_report(spark, folder).recommendations).select("step", "issue_id", "fix_action")


# ---- repair ----------------------------------------------------------------------------
@query("cln_action_plan", SCORED + f"SELECT DISTINCT fix_action FROM ({PLAN}) p WHERE fix_action IS NOT NULL")
def cln_plan(spark, folder):
    from ..operators.repair import plan_actions
    from ..plans.local import local_frame

    found = plan_actions(dirty(spark, folder), report=dirty_report(spark, folder), target=TARGET)
    return local_frame(spark, [{"fix_action": a} for a in found], "fix_action string")


@query("cln_drop_exact_duplicates", D + "SELECT DISTINCT * REPLACE (k::DOUBLE AS k, sparse_col::DOUBLE AS sparse_col) FROM d")
def cln_exact(spark, folder):
    return portable(repair(dirty(spark, folder), ["drop_exact_duplicates"]).frame)


@query("cln_drop_target_na", D + "SELECT * REPLACE (k::DOUBLE AS k, sparse_col::DOUBLE AS sparse_col) FROM d WHERE total_price IS NOT NULL")
def cln_target(spark, folder):
    return portable(repair(dirty(spark, folder), ["drop_target_na:total_price"], "total_price").frame)


@query("cln_drop_sparse_rows", D + "SELECT total_price, sparse_col::DOUBLE AS sparse_col FROM d WHERE total_price IS NOT NULL OR sparse_col IS NOT NULL")
def cln_sparse(spark, folder):
    return portable(repair(dirty(spark, folder).select("total_price", "sparse_col"), ["drop_sparse_rows"]).frame)


_LINE_ORDER = [c for c, _, _ in sql.LINEITEM_COLUMNS if c != "l_orderkey"]


@query("cln_first_by_key", f"""SELECT {', '.join(c for c, _, _ in sql.LINEITEM_COLUMNS[:-1])}, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY {', '.join(_LINE_ORDER)}) AS rn FROM lineitem) x WHERE rn = 1""")
def cln_first(spark, folder):
    return portable(repair(table(spark, folder, "lineitem"), ["drop_duplicates_by_key:l_orderkey"], order_by=_LINE_ORDER).frame)


@query("cln_null_sentinels", D + f"""SELECT k, CASE WHEN total_price NOT IN ({sql._CODES}) THEN total_price END AS total_price,
  CASE WHEN lower(trim(status)) NOT IN ({sql._WORDS}) THEN status END AS status FROM d""")
def cln_sentinels(spark, folder):
    frame = dirty(spark, folder).select("k", "total_price", "status")
    return repair(frame, ["replace_sentinels_with_nan:total_price", "replace_sentinels_with_nan:status"]).frame


@query("cln_null_detected_sentinels", D + f"""SELECT k, CASE WHEN total_price NOT IN ({sql.number_list(sql.fixed.NUMERIC_SENTINELS)}) THEN total_price END AS total_price,
  CASE WHEN lower(trim(status)) NOT IN ({sql.quoted_list(sql.fixed.TEXT_SENTINELS)}) AND trim(status) <> '' THEN status END AS status FROM d""")
def cln_detected(spark, folder):
    frame = dirty(spark, folder).select("k", "total_price", "status")
    actions = ["replace_sentinels_with_nan:total_price", "replace_sentinels_with_nan:status"]
    return repair(frame, actions, detected=True).frame


@query("cln_sanitize_age", f"SELECT cust, (CASE WHEN age BETWEEN 0 AND 120 THEN age END)::DOUBLE AS age FROM {AGES}")
def cln_age(spark, folder):
    return portable(repair(people(spark, folder).select("cust", "age"), ["sanitize_age_bounds:age"]).frame)


@query("cln_absolute", D + "SELECT k, abs(total_price)::DOUBLE AS total_price FROM d")
def cln_absolute(spark, folder):
    return repair(dirty(spark, folder).select("k", "total_price"), ["abs_or_nan:total_price"]).frame


@query("cln_currency_text", D + "SELECT k, replace(replace(amount_txt, '$', ''), ',', '')::DOUBLE AS amount_txt FROM d")
def cln_currency(spark, folder):
    return repair(dirty(spark, folder).select("k", "amount_txt"), ["clean_numeric_string:amount_txt"]).frame


@query("cln_text_to_date", D + "SELECT k::DOUBLE AS k, strftime(strptime(date_txt, '%Y/%m/%d'), '%Y-%m-%d %H:%M:%S') AS date_txt FROM d")
def cln_date(spark, folder):
    return portable(repair(dirty(spark, folder).select("k", "date_txt"), ["convert_to_datetime:date_txt"]).frame)


@query("cln_to_integer", "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS l_quantity FROM lineitem")
def cln_integer(spark, folder):
    frame = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return repair(frame, ["cast_to_int:l_quantity"]).frame


@query("cln_clip_outliers", D + """SELECT k, round(CASE WHEN total_price IS NOT NULL THEN greatest(least(total_price, hi), lo) END, 4) AS total_price
  FROM d, (SELECT quantile_cont(total_price, 0.01) AS lo, quantile_cont(total_price, 0.99) AS hi FROM d) b""")
def cln_clip(spark, folder):
    out = repair(dirty(spark, folder).select("k", "total_price"), ["clip_outliers:total_price"]).frame
    return out.withColumn("total_price", F.round("total_price", 4))


@query("cln_impute_median", D + "SELECT k, round(coalesce(total_price, (SELECT median(total_price) FROM d)), 4) AS total_price FROM d")
def cln_median(spark, folder):
    out = repair(dirty(spark, folder).select("k", "total_price"), ["impute:total_price"]).frame
    return out.withColumn("total_price", F.round("total_price", 4))


@query("cln_impute_mode", D + """, s AS (SELECT k, CASE WHEN trim(status) NOT IN ('N/A', '?') THEN status END AS status FROM d)
  SELECT k, coalesce(status, (SELECT arg_min(status, (-n, status)) FROM (SELECT status, count(*) AS n FROM s WHERE status IS NOT NULL GROUP BY status) m)) AS status FROM s""")
def cln_mode(spark, folder):
    frame = dirty(spark, folder).select("k", "status")
    return repair(frame, ["replace_sentinels_with_nan:status", "impute:status"]).frame


@query("cln_drop_columns", D + "SELECT * EXCLUDE (const_col, quasi) REPLACE (k::DOUBLE AS k, sparse_col::DOUBLE AS sparse_col) FROM d")
def cln_columns(spark, folder):
    actions = ["drop_column:const_col", "drop_column:quasi", "drop_column:target"]
    return portable(repair(dirty(spark, folder), actions, TARGET).frame)


CLEANED = D + ", " + sql.CLEAN_CTES


@query("cln_full_repair", CLEANED + """ SELECT k::DOUBLE AS k, round(total_price, 4) AS total_price, status, amount_txt,
  strftime(date_txt, '%Y-%m-%d %H:%M:%S') AS date_txt, target, base_price, rare_target FROM c""")
def cln_full(spark, folder):
    frame = dirty(spark, folder)
    out = repair(frame, target=TARGET, report=dirty_report(spark, folder)).frame
    return portable(out.withColumn("total_price", F.round("total_price", 4)))


@query("cln_stats", CLEANED + f"""SELECT (SELECT count(*) FROM d) AS initial_rows, {len(COLS)}::BIGINT AS initial_columns,
  (SELECT count(*) FROM c) AS cleaned_rows, {len(sql.CLEAN_COLUMNS)}::BIGINT AS cleaned_columns,
  (SELECT count(*) FROM d) - (SELECT count(*) FROM c) AS rows_removed, {len(COLS) - len(sql.CLEAN_COLUMNS)}::BIGINT AS columns_removed""")
def cln_stats(spark, folder):
    found = repair(dirty(spark, folder), target=TARGET, report=dirty_report(spark, folder)).stats()
    return found.drop("actions_executed")


@query("cln_stage_rows", D + """SELECT 'drop_exact_duplicates' AS stage, count(*) AS rows_after FROM (SELECT DISTINCT * FROM d) x
  UNION ALL SELECT 'drop_target_na', count(*) FROM (SELECT DISTINCT * FROM d) x WHERE total_price IS NOT NULL""")
def cln_stages(spark, folder):
    done = repair(dirty(spark, folder), ["drop_exact_duplicates", "drop_target_na:total_price"], "total_price")
    return done.stage_rows().select("stage", "rows_after")


@query("cln_stage_rows_of_every_kind", D + """, a AS (SELECT DISTINCT * FROM d), b AS (SELECT * FROM a WHERE total_price IS NOT NULL), c AS (SELECT status, count(*) AS n FROM b GROUP BY 1), e AS (
  SELECT target, count(*) AS n FROM (SELECT target, status, row_number() OVER (PARTITION BY status ORDER BY k NULLS FIRST, total_price) AS r FROM b) x WHERE r = 1 GROUP BY 1)
  SELECT 1 AS step, 'drop_exact_duplicates' AS stage, count(*) AS rows_after FROM a UNION ALL SELECT 2, 'drop_target_na', count(*) FROM b
  UNION ALL SELECT 3, 'drop_duplicates_by_key', count(*) FROM c UNION ALL SELECT 4, 'drop_duplicates_by_key', count(*) FROM e""")
def cln_every_stage(spark, folder):
    """Repeats, a filter and two keys one after the other, counted in one pass."""
    actions = ["drop_exact_duplicates", "drop_target_na:total_price", "drop_duplicates_by_key:status", "drop_duplicates_by_key:target"]
    done = repair(dirty(spark, folder), actions, "total_price", order_by=["k", "total_price"])
    return done.stage_rows().select("step", "stage", "rows_after")


# ---- drift -----------------------------------------------------------------------------
_LATER = "o_orderdate >= TIMESTAMP '1998-06-01'"
PAIR = f"""WITH o AS (SELECT *, (o_orderkey % 4)::INTEGER AS n_items FROM orders),
a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, n_items FROM o WHERE NOT {_LATER}),
b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 1.3 AS o_totalprice,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '0-NOW' ELSE o_orderpriority END AS o_orderpriority, n_items FROM o WHERE {_LATER})"""
DRIFT_NUM = ("o_orderkey", "o_custkey", "o_totalprice")
DRIFT_CAT = ("o_orderstatus", "o_orderpriority", "n_items")


def _psi(c: str) -> str:
    grid = ", ".join(str(i / 10) for i in range(11))
    return f"""SELECT '{c}' AS col, greatest(0, round(sum((x - e) * ln(x / e)), 4)) AS psi FROM (
  SELECT e / sum(e) OVER () AS e, x / sum(x) OVER () AS x FROM (
  SELECT CASE WHEN ec = 0 THEN 1e-4 ELSE ec / (SELECT count({c}) FROM a) END AS e,
    CASE WHEN xc = 0 THEN 1e-4 ELSE xc / (SELECT count({c}) FROM b) END AS x FROM (
  SELECT i, (SELECT count(*) FROM a WHERE (i = 0 OR {c} >= g[i + 1]) AND (i = m - 2 OR {c} < g[i + 2])) AS ec,
    (SELECT count(*) FROM b WHERE (i = 0 OR {c} >= g[i + 1]) AND (i = m - 2 OR {c} < g[i + 2])) AS xc
  FROM (SELECT g, len(g) AS m, unnest(range(len(g) - 1)) AS i FROM (SELECT list_sort(list_distinct(
    quantile_cont({c}::DOUBLE, [{grid}]))) AS g FROM a) q) r) s) t) v"""


def _ks(c: str) -> str:
    return f"""SELECT '{c}' AS col, any_value(n1) AS n_ref, any_value(n2) AS n_cur, max(abs(c1 / n1 - c2 / n2)) AS d FROM (
  SELECT sum(x) OVER (ORDER BY v) AS c1, sum(y) OVER (ORDER BY v) AS c2, (SELECT count({c}) FROM a) AS n1, (SELECT count({c}) FROM b) AS n2
  FROM (SELECT v, sum(x) AS x, sum(y) AS y FROM (SELECT {c} AS v, 1 AS x, 0 AS y FROM a UNION ALL SELECT {c}, 0, 1 FROM b) u
    WHERE v IS NOT NULL GROUP BY v) w) z"""


_EN = "sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur))"
_LAM = f"(({_EN} + 0.12 + 0.11 / {_EN}) * d)"
_P = (f"CASE WHEN {_LAM} <= 0 THEN 1 ELSE least(1, greatest(0, "
      + " + ".join(f"({2.0 * (-1) ** (k - 1)}) * exp({-2.0 * k * k} * {_LAM} * {_LAM})" for k in range(1, 10)) + ")) END")
KS = f"SELECT col, n_ref, n_cur, round(d, 4) AS ks, round({_P}, 4) AS p_value FROM ({sql.union([_ks(c) for c in DRIFT_NUM])}) k"
PSI = sql.union([_psi(c) for c in DRIFT_NUM])
MEANS = sql.union([
    f"SELECT '{c}' AS col, (SELECT avg({c}) FROM a) AS m1, (SELECT avg({c}) FROM b) AS m2" for c in DRIFT_NUM])


def _cat(c: str) -> str:
    return f"""SELECT '{c}' AS col, round(0.5 * sum(abs(x / (SELECT count({c}) FROM a) - y / (SELECT count({c}) FROM b))), 4) AS tvd,
  count(*) FILTER (x = 0 AND y > 0) AS novel_count, coalesce(string_agg(v, ', ' ORDER BY v) FILTER (x = 0 AND y > 0), '') AS novel
  FROM (SELECT v, sum(x) AS x, sum(y) AS y FROM (SELECT {c}::VARCHAR AS v, 1 AS x, 0 AS y FROM a UNION ALL SELECT {c}::VARCHAR, 0, 1 FROM b) u
    WHERE v IS NOT NULL GROUP BY v) w"""


NUM_DRIFT = f"""SELECT k.col, CASE WHEN psi >= 0.25 OR (ks > 0.35 AND p_value < 0.01) THEN 'CRITICAL_DRIFT'
    WHEN psi >= 0.1 OR (ks > 0.2 AND p_value < 0.05) THEN 'MODERATE_DRIFT' ELSE 'STABLE' END AS status, psi, ks, p_value,
  round(m1, 3) AS mean_ref, round(m2, 3) AS mean_cur, round((m2 - m1) / (abs(m1) + 1e-6) * 100, 1) AS mean_diff_pct
  FROM ({KS}) k JOIN ({PSI}) p USING (col) JOIN ({MEANS}) m USING (col)"""
CAT_DRIFT = f"""SELECT *, CASE WHEN (novel_count > 0 OR tvd > 0.35) AND (novel_count >= 3 OR tvd > 0.5) THEN 'CRITICAL_DRIFT'
    WHEN novel_count > 0 OR tvd > 0.35 THEN 'MODERATE_DRIFT' ELSE 'STABLE' END AS status FROM ({sql.union([_cat(c) for c in DRIFT_CAT])}) c"""
STATUSES = f"SELECT col, status FROM ({NUM_DRIFT}) n UNION ALL SELECT col, status FROM ({CAT_DRIFT}) c"


def compared(spark, folder, **limits) -> drift.Drift:
    return drift.compare(*drift_pair(spark, folder), **limits)


@query("drf_shared_columns", """SELECT 'l_orderkey' AS "column", count(l_orderkey) AS reference_filled, (SELECT count(o_orderkey) FROM orders) AS current_filled FROM lineitem
  UNION ALL SELECT 'price', count(l_extendedprice), (SELECT count(o_totalprice) FROM orders) FROM lineitem""")
def drf_shared(spark, folder):
    """Columns that two tables of different width have in common, and their filled cells on both sides."""
    left = table(spark, folder, "lineitem").withColumnRenamed("l_extendedprice", "price")
    right = table(spark, folder, "orders").withColumnsRenamed({"o_orderkey": "l_orderkey", "o_totalprice": "price"})
    names = drift.shared_columns(left, right)
    def filled(frame: DataFrame, label: str) -> DataFrame:
        return frame.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "column", label)

    return filled(left, "reference_filled").join(filled(right, "current_filled"), "column")


@query("drf_routing", PAIR + sql.union([f" SELECT '{c}' AS \"column\", count(DISTINCT {c}) > 5 AS is_numeric FROM a" for c in DRIFT_NUM + ("n_items",)]))
def drf_routing(spark, folder):
    from ..plans.local import local_frame

    found = compared(spark, folder)
    rows = [{"column": c, "is_numeric": c in found.numeric} for c in DRIFT_NUM + ("n_items",)]
    return local_frame(spark, rows, "`column` string, is_numeric boolean")


@query("drf_psi", PAIR + f' SELECT col AS "column", psi::DOUBLE AS psi FROM ({PSI}) p')
def drf_psi(spark, folder):
    return compared(spark, folder).psi


@query("drf_ks", PAIR + f' SELECT col AS "column", n_ref, n_cur, ks, p_value::DOUBLE AS p_value FROM ({KS}) k')
def drf_ks(spark, folder):
    return compared(spark, folder).ks


@query("drf_ks_large_table_path", PAIR + f' SELECT col AS "column", n_ref, n_cur, ks, p_value::DOUBLE AS p_value FROM ({KS}) k')
def drf_ks_cells(spark, folder):
    """The same figures by the cell refinement that tables beyond the limit take."""
    return compared(spark, folder, cell_limit=3_000).ks


@query("drf_means", PAIR + f""" SELECT col AS "column", round(m1, 3) AS mean_ref, round(m2, 3) AS mean_cur,
  round((m2 - m1) / (abs(m1) + 1e-6) * 100, 1) AS mean_diff_pct FROM ({MEANS}) m""")
def drf_means(spark, folder):
    return compared(spark, folder).means.select(
        "column", F.round("mean_ref", 3).alias("mean_ref"), F.round("mean_cur", 3).alias("mean_cur"),
        F.round("mean_diff_pct", 1).alias("mean_diff_pct"))


@query("drf_numeric_columns", PAIR + f""" SELECT col AS "column", status, psi::DOUBLE AS psi, ks, p_value::DOUBLE AS p_value,
  mean_ref, mean_cur, mean_diff_pct FROM ({NUM_DRIFT}) n""")
def drf_numeric(spark, folder):
    return compared(spark, folder).numeric_columns.drop("column_type")


@query("drf_categories", PAIR + f' SELECT col AS "column", tvd, novel_count, novel, status FROM ({CAT_DRIFT}) c')
def drf_categories(spark, folder):
    found = compared(spark, folder).categorical_columns
    return found.withColumn("novel", F.array_join("novel", ", "))


@query("drf_report", PAIR + f""", s AS ({STATUSES}), t AS (SELECT count(*) AS shared_columns,
    round(avg(CASE status WHEN 'CRITICAL_DRIFT' THEN 100 WHEN 'MODERATE_DRIFT' THEN 50 ELSE 0 END), 1) AS drift_score,
    count(*) FILTER (status = 'CRITICAL_DRIFT') AS critical_columns, count(*) FILTER (status = 'MODERATE_DRIFT') AS moderate_columns,
    count(*) FILTER (status = 'STABLE') AS stable_columns FROM s)
  SELECT (SELECT count(*) FROM a) AS reference_rows, (SELECT count(*) FROM b) AS current_rows, *,
    CASE WHEN critical_columns > 0 OR drift_score >= 40 THEN 'CRITICAL_DRIFT' WHEN moderate_columns > 0 OR drift_score >= 15
      THEN 'MODERATE_DRIFT' ELSE 'STABLE' END AS overall_status FROM t""")
def drf_report(spark, folder):
    return compared(spark, folder).report


@query("drf_alerts", PAIR + f""" SELECT col AS "column", status FROM ({STATUSES}) s WHERE status <> 'STABLE'""")
def drf_alerts(spark, folder):
    return compared(spark, folder).alerts.select("column", "status")


@query("drf_psi_gate", PAIR + f""" SELECT 'max_psi' AS gate, max(psi) <= 0.25 AS passed, max(psi)::DOUBLE AS value, 0.25::DOUBLE AS threshold FROM ({PSI}) p""")
def drf_gate(spark, folder):
    return scoring.psi_gate(compared(spark, folder).psi, 0.25)


LINE_PAIR = "WITH a AS (SELECT * FROM lineitem WHERE year(l_shipdate) % 2 = 0), b AS (SELECT * FROM lineitem WHERE year(l_shipdate) % 2 = 1)"


@query("drf_ks_lineitem_by_year", LINE_PAIR + f""" SELECT col AS "column", n_ref, n_cur, ks, p_value::DOUBLE AS p_value FROM (
  SELECT col, n_ref, n_cur, round(d, 4) AS ks, round({_P}, 4) AS p_value FROM ({sql.union([_ks(c) for c in ('l_quantity', 'l_extendedprice', 'l_discount')])}) k) x""")
def drf_lineitem(spark, folder):
    lines = table(spark, folder, "lineitem")
    even = F.year("l_shipdate") % 2 == 0
    kept = ["l_quantity", "l_extendedprice", "l_discount"]
    return drift.compare(lines.filter(even).select(kept), lines.filter(~even).select(kept)).ks


# ---- rules -----------------------------------------------------------------------------
def _rule_rows(parts: list[tuple[str, str, str]]) -> str:
    """(rule id, table, pass condition) -> counts per rule."""
    rows = sql.union([
        f"SELECT '{i}' AS rule_id, count(*) AS total_evaluated, count(*) FILTER (coalesce({test}, false)) AS passed_count FROM {t}"
        for i, t, test in parts
    ])
    return f"""SELECT rule_id, total_evaluated, passed_count, total_evaluated - passed_count AS failed_count,
  {sql.pct('passed_count', 'total_evaluated')} AS pass_rate_pct,
  CASE WHEN total_evaluated = passed_count THEN 'PASSED' ELSE 'FAILED' END AS status FROM ({rows}) r"""


def _counts(frame: DataFrame, rules: list[Rule]) -> DataFrame:
    return rule_ops.run_rules(frame, rules).select(
        "rule_id", "total_evaluated", "passed_count", "failed_count", "pass_rate_pct", "status"
    )


_NUMERIC_STATUS = f"regexp_matches(trim(status), '{sql.NUMBER}')"
DIRTY_RULES = [
    (Rule("missing_column", "not_null", "nope"), "false"),
    (Rule("filled", "not_null", "status"), "trim(status) <> ''"),
    (Rule("filled_price", "not_null", "total_price"), "total_price IS NOT NULL"),
    (Rule("in_range", "range", "total_price", min_value=0, max_value=300000), "total_price BETWEEN 0 AND 300000"),
    (Rule("text_range", "range", "amount_txt", min_value=0), "false"),
    (Rule("known_status", "allowed_values", "status", allowed_values=["f", " O "]), "lower(trim(status)) IN ('f', 'o')"),
    (Rule("date_shape", "regex", "date_txt", regex_pattern=r"^\d{4}/(0[1-6])/"), "regexp_matches(date_txt, '^\\d{4}/(0[1-6])/')"),
    (Rule("no_pattern", "regex", "date_txt"), "true"),
    (Rule("bad_pattern", "regex", "date_txt", regex_pattern="([a-z+"), "false"),
    (Rule("ge", "comparison", "principal", comparison_column="base_price", comparison_operator=">="), "principal >= base_price"),
    (Rule("gt", "comparison", "principal", comparison_column="base_price", comparison_operator=">"), "principal > base_price"),
    (Rule("le", "comparison", "total_price", comparison_column="base_price", comparison_operator="<="), "total_price <= base_price"),
    (Rule("lt", "comparison", "total_price", comparison_column="base_price", comparison_operator="<"), "total_price < base_price"),
    (Rule("eq", "comparison", "total_price", comparison_column="base_price", comparison_operator="=="), "total_price = base_price"),
    (Rule("odd_operator", "comparison", "principal", comparison_column="base_price", comparison_operator="~"), "principal >= base_price"),
    (Rule("no_other", "comparison", "principal", comparison_column="nope"), "false"),
    (Rule("is_number", "type_check", "status", expected_type="numeric"), _NUMERIC_STATUS),
    (Rule("is_date", "type_check", "date_txt", expected_type="datetime"), "try_strptime(date_txt, '%Y/%m/%d') IS NOT NULL"),
    (Rule("is_text", "type_check", "status", expected_type="string"), "status IS NOT NULL"),
    (Rule("unknown_type", "sorcery", "status"), "true"),
    (Rule("unique_key", "unique", "k"), "k NOT IN (SELECT k FROM d GROUP BY k HAVING count(*) > 1)"),
    (Rule("unique_sparse", "unique", "sparse_col"),
     "sparse_col IN (SELECT sparse_col FROM d GROUP BY sparse_col HAVING count(*) = 1)"),
]
DIRTY_RULE_SQL = _rule_rows([(r.rule_id, "d", test) for r, test in DIRTY_RULES])


@query("rul_every_rule_type", D + DIRTY_RULE_SQL)
def rul_all(spark, folder):
    return _counts(dirty(spark, folder), [r for r, _ in DIRTY_RULES])


@query("rul_suite", D + f"""SELECT count(*) AS total_rules, count(*) FILTER (status = 'PASSED') AS passed_rules, count(*) FILTER (status = 'FAILED') AS failed_rules,
  round(count(*) FILTER (status = 'PASSED') / count(*) * 100, 1) AS overall_pass_rate,
  CASE WHEN bool_and(status = 'PASSED') THEN 'PASSED' ELSE 'FAILED' END AS status FROM ({DIRTY_RULE_SQL}) s""")
def rul_suite(spark, folder):
    return rule_ops.suite_summary(rule_ops.run_rules(dirty(spark, folder), [r for r, _ in DIRTY_RULES]))


@query("rul_pass_rate_gate", D + f"""SELECT 'min_pass_rate' AS gate, v >= 100 AS passed, v AS value, 100.0::DOUBLE AS threshold
  FROM (SELECT round(count(*) FILTER (status = 'PASSED') / count(*) * 100, 1) AS v FROM ({DIRTY_RULE_SQL}) s) g""")
def rul_gate(spark, folder):
    results = rule_ops.run_rules(dirty(spark, folder), [r for r, _ in DIRTY_RULES])
    return scoring.pass_rate_gate(rule_ops.suite_summary(results))


@query("rul_customer_balance", _rule_rows([("balance", "customer", "c_acctbal >= 0"), ("name", "customer", "regexp_matches(c_name, '^Customer#\\d+$')")]))
def rul_customer(spark, folder):
    return _counts(table(spark, folder, "customer"), [
        Rule("balance", "range", "c_acctbal", min_value=0),
        Rule("name", "regex", "c_name", regex_pattern=r"^Customer#\d+$")])


@query("rul_event_props", _rule_rows([("json", "events", "regexp_matches(props, '\"[a-z]+\"\\s*:')"), ("kind", "events", "lower(event_type) IN ('click', 'view')")]))
def rul_events(spark, folder):
    return _counts(table(spark, folder, "events"), [
        Rule("json", "regex", "props", regex_pattern=r'"[a-z]+"\s*:'),
        Rule("kind", "allowed_values", "event_type", allowed_values=["click", "View"])])


@query("rul_violating_keys", D + "SELECT k FROM d WHERE NOT coalesce(total_price BETWEEN 0 AND 300000, false)")
def rul_violations(spark, folder):
    return rule_ops.violations(dirty(spark, folder), DIRTY_RULES[3][0], ["k"])


@query("rul_violating_samples", """SELECT * FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 5""")
def rul_samples(spark, folder):
    rule = Rule("balance", "range", "c_acctbal", min_value=0)
    return rule_ops.sample_violations(table(spark, folder, "customer"), rule, ["c_custkey"])


@query("rul_violating_unique", D + """SELECT k, base_price FROM d WHERE k IN (SELECT k FROM d GROUP BY k HAVING count(*) > 1)
""")
def rul_unique_rows(spark, folder):
    frame = dirty(spark, folder).select("k", "base_price")
    return rule_ops.violations(frame, Rule("u", "unique", "k"), ["k", "base_price"])


_AGES_RULES = [("fin_age_range", AGES, "age BETWEEN 18 AND 100"), ("fin_income_positive", AGES, "annual_income >= 0")]


@query("rul_template_fintech", _rule_rows(_AGES_RULES))
def rul_fintech(spark, folder):
    frame = people(spark, folder)
    return _counts(frame, rule_ops.template_rules("fintech", frame.columns))


@query("rul_template_ecommerce", D + _rule_rows([("ecom_price_positive", "d", f"{c} >= 0.01") for c in ("total_price", "base_price")]
       + [("ecom_price_positive", "d", "false")]))
def rul_ecommerce(spark, folder):
    frame = dirty(spark, folder)
    return _counts(frame, rule_ops.template_rules("ecommerce", frame.columns))


@query("rul_template_hygiene", D + _rule_rows([
    ("hygiene_not_null_k", "d", "k IS NOT NULL"), ("hygiene_not_null_total_price", "d", "total_price IS NOT NULL"),
    ("hygiene_not_null_status", "d", "trim(status) <> ''"), ("hygiene_not_null_amount_txt", "d", "trim(amount_txt) <> ''")]))
def rul_hygiene(spark, folder):
    frame = dirty(spark, folder)
    return _counts(frame, rule_ops.template_rules("general", frame.columns))


@query("rul_rule_file", _rule_rows([
    ("from_file", "orders", "o_totalprice BETWEEN 10000 AND 400000"), ("status_known", "orders", "lower(trim(o_orderstatus)) IN ('f', 'o')"), ("priority_filled", "orders", "trim(o_orderpriority) <> ''")]))
def rul_file(spark, folder):
    path = f"{shared_folder(spark)}/rules.json"
    rules = [
        Rule("from_file", "range", "o_totalprice", min_value=10000, max_value=400000), Rule("status_known", "allowed_values", "o_orderstatus", allowed_values=["F", "O"]),
        Rule("priority_filled", "not_null", "o_orderpriority"),
    ]
    rule_ops.rules_table(spark, rules).coalesce(1).write.json(path)
    return _counts(table(spark, folder, "orders"), readers.read_rules(spark, path))


# ---- before/after benchmark ------------------------------------------------------------
def quality_features(spark, folder) -> DataFrame:
    """Labels with features of the labelled documents; language is unknown for every tenth document."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.size(F.split("text", r"\s+")).alias("n_words"),
        F.size(F.split("text", "\n")).alias("n_lines"),
    )
    joined = table(spark, folder, "labels").join(docs, "doc_id")
    return joined.withColumn("lang", F.when(F.col("doc_id") % 10 != 3, F.col("lang"))).drop("doc_id", "toxic")


@query("mlb_task_detection", D + """SELECT 'target' AS col, 'classification' AS task, true AS is_binary, count(*) AS n FROM d
  UNION ALL SELECT 'base_price', 'regression', false, count(*) FROM d UNION ALL SELECT 'status', 'classification', false, count(*) FROM d""")
def mlb_task(spark, folder):
    from ..operators.mlbench import detect_task
    from ..plans.local import local_frame

    frame = dirty(spark, folder)
    n = frame.count()
    found = [(c, *detect_task(frame, c)) for c in ("target", "base_price", "status")]
    rows = [{"col": c, "task": task, "is_binary": binary, "n": n} for c, task, binary in found]
    return local_frame(spark, rows, "col string, task string, is_binary boolean, n bigint")


def _repaired_pair(spark, folder) -> tuple[DataFrame, DataFrame]:
    raw = dirty(spark, folder).drop("leak_flag", "date_txt", "amount_txt")
    report = audit(raw, "rare_target", checkers=CHECKERS)
    return raw, repair(raw, target="rare_target", report=report).frame


@query("mlb_random_forest")
def mlb_forest(spark, folder):
    from ..operators.mlbench import benchmark

    raw, clean = _repaired_pair(spark, folder)
    return benchmark(raw, clean, "rare_target", "random_forest").table()


@query("mlb_decision_tree")
def mlb_tree(spark, folder):
    from ..operators.mlbench import benchmark

    features = quality_features(spark, folder)
    clean = repair(features, ["impute:lang"], "quality").frame
    return benchmark(features, clean, "quality", "decision_tree").table()


@query("mlb_logistic_regression")
def mlb_logistic(spark, folder):
    from ..operators.mlbench import benchmark

    features = quality_features(spark, folder)
    clean = repair(features, ["impute:lang"], "quality").frame
    return benchmark(features, clean, "quality", "logistic_regression").table()


@query("mlb_ridge")
def mlb_ridge(spark, folder):
    from ..operators.mlbench import benchmark

    raw = dirty(spark, folder).select("total_price", "sparse_col", "status", "principal", "base_price")
    clean = repair(raw, ["clip_outliers:total_price", "impute:total_price"], "base_price").frame
    return benchmark(raw, clean, "base_price", "ridge").table()


@query("mlb_top_features")
def mlb_features(spark, folder):
    from ..operators.mlbench import benchmark

    features = quality_features(spark, folder)
    clean = repair(features, ["impute:lang"], "quality").frame
    return benchmark(features, clean, "quality", "decision_tree").top_features()


_CELLS = "SELECT target AS label, leak_flag AS prediction, count(*) AS n FROM d GROUP BY 1, 2"


@query("mlb_class_metrics", D + f"""SELECT round(sum(hit) / sum(support), 4) AS accuracy, round(sum(p * support) / sum(support), 4) AS "precision",
  round(sum(r * support) / sum(support), 4) AS recall, round(sum(2 * p * r / (p + r) * support) / sum(support), 4) AS f1
  FROM (SELECT label, sum(n) AS support, sum(n) FILTER (label = prediction) AS hit, sum(n) FILTER (label = prediction) / sum(n) AS r,
    sum(n) FILTER (label = prediction) / (SELECT sum(n) FROM ({_CELLS}) c2 WHERE c2.prediction = c1.label) AS p
    FROM ({_CELLS}) c1 GROUP BY label) x""")
def mlb_class_metrics(spark, folder):
    """Scores of the leaking flag taken as a prediction of the target."""
    from ..operators.mlbench import class_metrics
    from ..plans.local import local_frame

    scored = dirty(spark, folder).select(
        F.col("target").cast("double").alias("label"), F.col("leak_flag").cast("double").alias("prediction"))
    found = class_metrics(scored, binary=False)
    found.pop("roc_auc")
    return local_frame(spark, [found], ", ".join(f"`{k}` double" for k in found))


@query("mlb_value_metrics", D + """SELECT round(1 - avg((base_price - principal) ** 2) / var_pop(base_price), 4) AS r2,
  round(avg(abs(base_price - principal)), 4) AS mae, round(sqrt(avg((base_price - principal) ** 2)), 4) AS rmse FROM d""")
def mlb_value_metrics(spark, folder):
    """Scores of the collinear column taken as a prediction of the price."""
    from ..operators.mlbench import value_metrics
    from ..plans.local import local_frame

    found = value_metrics(dirty(spark, folder).select(F.col("base_price").alias("label"), F.col("principal").alias("prediction")))
    return local_frame(spark, [found], ", ".join(f"{k} double" for k in found))


def _one_hot(frame, column):
    from ..operators.mlbench import prepare

    columns, encoding = prepare(frame, [column])
    ready = frame.select(F.col(column).isNull().alias("hole"), *columns)
    encoded = encoding.fit(ready)
    return encoded.transform(ready), encoded


@query("mlb_many_levels", """WITH t AS (SELECT concat('clerk', o_custkey) AS level FROM orders WHERE o_orderkey % 9 <> 0), m AS (SELECT level FROM t GROUP BY 1 ORDER BY count(*) DESC, level LIMIT 1)
  SELECT (SELECT count(DISTINCT level) FROM t) AS levels, (SELECT level FROM m) AS filled_with, count(*) FILTER (o_orderkey % 9 = 0) AS filled FROM orders""")
def mlb_levels(spark, folder):
    """A text column of any number of levels is filled with its mode and one-hot encoded, one slot a level."""
    frame = table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("clerk"), F.col("o_custkey"))).alias("clerk"), "o_orderkey")
    coded, encoded = _one_hot(frame, "clerk")
    return coded.agg(F.lit(encoded.size).cast("bigint").alias("levels"), F.max(F.when(F.col("hole"), F.col("t_clerk"))).alias("filled_with"), F.count_if("hole").alias("filled"))


@query("mlb_near_unique_levels", """WITH t AS (SELECT concat('order', o_orderkey) AS level FROM orders WHERE o_orderkey % 50 <> 0), r AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS slot FROM t)
  SELECT (SELECT count(*) FROM r) AS slots, count(*) AS n, (SELECT sum(slot) FROM r)::BIGINT + count(*) FILTER (o_orderkey % 50 = 0) * (SELECT min(slot) FROM r) AS slot_sum FROM orders""")
def mlb_unique_levels(spark, folder):
    """A text column with nearly as many levels as rows: numbered and joined in Spark, each row has its level's one slot."""
    frame = table(spark, folder, "orders").select(F.when(F.col("o_orderkey") % 50 != 0, F.concat(F.lit("order"), F.col("o_orderkey"))).alias("name"))
    coded, encoded = _one_hot(frame, "name")
    # the place of a vector's only entry
    held = coded.select(F.transform(F.array("features"), lambda v: v.cast("string"))[0].alias("v"))
    place = F.regexp_extract("v", r"^\(\d+,\[(\d+)\],\[1\.0\]\)$", 1).cast("bigint")
    return held.agg(F.lit(encoded.size).cast("bigint").alias("slots"), F.count(place).alias("n"), F.sum(place).alias("slot_sum"))


@query("mlb_many_classes", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS classes, 'test rows' AS judged_on FROM orders")
def mlb_classes(spark, folder):
    """A text target with over a thousand classes is trained on."""
    from ..operators.mlbench import fit_baseline

    frame = table(spark, folder, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("who"), F.col("o_custkey").alias("x"))
    fit = fit_baseline(frame, "who", "classification", False, "decision_tree")
    return frame.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("who").alias("classes"), F.lit(fit.judged_on).alias("judged_on"))


@query("mlb_all_rows_fallback", "SELECT count(*) AS n, count(DISTINCT s_name) AS classes, 'training rows' AS judged_on FROM supplier")
def mlb_fallback(spark, folder):
    """Where every class has one row, none is left to test: the model is judged on its training rows, and says so."""
    from ..operators.mlbench import fit_baseline

    frame = table(spark, folder, "supplier").select("s_acctbal", "s_name")
    fit = fit_baseline(frame, "s_name", "classification", False, "decision_tree")
    return frame.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s_name").alias("classes"), F.lit(fit.judged_on).alias("judged_on"))


@query("mlb_split_shares", D + "SELECT rare_target, count(*) AS n, round(floor(count(*) * 0.75 + 0.5) / count(*), 4) AS train_share FROM d GROUP BY 1")
def mlb_split(spark, folder):
    """Share of training rows per class: three quarters, rounded to a row."""
    from ..operators.mlbench import split

    return split(dirty(spark, folder), "rare_target").groupBy("rare_target").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count_if("train") / F.count(F.lit(1)), 4).alias("train_share"))


@query("mlb_split_bounds", D + "SELECT rare_target, count(*) AS n, abs(floor(count(*) * 0.75 + 0.5) / count(*) - 0.75) <= 4 * sqrt(0.1875 / count(*)) AS near_three_quarters FROM d GROUP BY 1")
def mlb_split_bounds(spark, folder):
    """Each class lends about three quarters of its rows to training: within four standard errors."""
    from ..operators.mlbench import split

    n, share = F.count(F.lit(1)), F.avg(F.col("train").cast("double"))
    return split(dirty(spark, folder), "rare_target").groupBy("rare_target").agg(n.alias("n"), (F.abs(share - 0.75) <= 4 * F.sqrt(0.1875 / n)).alias("near_three_quarters"))


@query("mlb_exact_split", """SELECT kind, count(*) AS n, CAST(floor(count(*) * 0.75 + 0.5) AS BIGINT) AS train FROM (
  SELECT 'many ' || l_partkey AS kind FROM lineitem UNION ALL SELECT 'hot' FROM lineitem UNION ALL SELECT 'one ' || l_orderkey FROM lineitem WHERE l_linenumber = 1) t GROUP BY kind""")
def mlb_exact(spark, folder):
    """A hot class of equal rows, thousands of small classes and classes of one row: each gives exactly its rounded share."""
    from ..operators.mlbench import split

    lines = table(spark, folder, "lineitem")
    kinds = lines.select(F.explode(F.array(
        F.concat(F.lit("many "), F.col("l_partkey")), F.lit("hot"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("one "), F.col("l_orderkey"))))).alias("kind")).where("kind IS NOT NULL")
    return split(kinds, "kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("train").alias("train"))


_RANKED = "rank() OVER (PARTITION BY flag ORDER BY score) + (count(*) OVER (PARTITION BY flag, score) - 1) / 2.0"


@query("mlb_exact_auc", f"""WITH s AS (SELECT f.flag, round(l_quantity + l_discount * 100, 0) AS score, l_returnflag = f.flag AS hit FROM lineitem, (VALUES ('A'), ('N'), ('R'), ('Z')) f(flag)),
  r AS (SELECT flag, hit, {_RANKED} AS place FROM s), t AS (SELECT flag, sum(place) FILTER (hit) AS places, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS n FROM r GROUP BY flag)
  SELECT flag, p + n AS n, round(CASE WHEN p = 0 OR n = 0 THEN 0.5 ELSE (places - p * (p + 1) / 2.0) / (p::DOUBLE * n) END, 4) AS auc FROM t""")
def mlb_auc(spark, folder):
    """Exact area under the curve with many ties, for each return flag against the others, and for a flag that no row has."""
    from ..operators.curves import roc_auc
    from ..plans.local import local_frame

    lines = table(spark, folder, "lineitem").select(F.round(F.col("l_quantity") + F.col("l_discount") * 100, 0).alias("score"), "l_returnflag")
    n = lines.count()
    rows = [{"flag": f, "n": n, "auc": round(roc_auc(lines.withColumn("positive", F.col("l_returnflag") == f)), 4)} for f in ("A", "N", "R", "Z")]
    return local_frame(spark, rows, "flag string, n bigint, auc double")


def _newton_sql(rounds: int = 12) -> str:
    """Newton steps for two features and an intercept, a 3 x 3 system each, solved by determinants."""
    steps = ["""s AS MATERIALIZED (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, (l_returnflag = 'R')::INTEGER::DOUBLE AS y FROM lineitem)""",
             "w0 AS (SELECT 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS c)"]
    for k in range(rounds):
        steps.append(f"""g{k} AS MATERIALIZED (SELECT any_value(u) AS u, any_value(v) AS v, any_value(c) AS c, avg((p - y) * a) + any_value(u) / count(*) AS g1, avg((p - y) * b) + any_value(v) / count(*) AS g2, avg(p - y) AS g3,
    avg(q * a * a) + 1.0 / count(*) AS h11, avg(q * a * b) AS h12, avg(q * a) AS h13, avg(q * b * b) + 1.0 / count(*) AS h22, avg(q * b) AS h23, avg(q) AS h33
    FROM (SELECT *, p * (1 - p) AS q FROM (SELECT *, 1 / (1 + exp(-(u * a + v * b + c))) AS p FROM s, w{k})))""")
        steps.append(f"""w{k + 1} AS MATERIALIZED (SELECT
    u - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det AS u,
    v - (h11 * (g2 * h33 - g3 * h23) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det AS v,
    c - (h11 * (h22 * g3 - h23 * g2) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det AS c
    FROM (SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS det FROM g{k}))""")
    return "WITH " + ",\n".join(steps) + f"""
  SELECT round(u, 4) + 0.0 AS quantity, round(v, 4) + 0.0 AS discount, round(c, 4) + 0.0 AS intercept, round(avg(ln(1 + exp(u * a + v * b + c)) - y * (u * a + v * b + c)) + (u * u + v * v) / 2 / count(*), 6) AS loss,
    round(abs(avg((1 / (1 + exp(-(u * a + v * b + c))) - y) * a) + u / count(*)), 6) + 0.0 AS steepest, true AS solver_agrees FROM s, w{rounds} GROUP BY u, v, c"""


@query("mlb_logistic_newton", _newton_sql())
def mlb_newton(spark, folder):
    """Newton steps end where the gradient is zero, and the benchmark's solver at the same coefficients, by its certificate too."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from ..operators.logistic import certificate, newton
    from ..operators.mlbench import estimator_for

    lines = table(spark, folder, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_returnflag") == "R").cast("double").alias("label"))
    n = lines.count()
    (u, v), c, found = newton(lines, [F.col("a"), F.col("b")], F.col("label"), 1.0 / n)
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(lines)
    fitted = estimator_for("classification", "logistic_regression", n)[1].fit(ready)
    told = certificate(fitted.transform(ready).withColumn("p", vector_to_array("probability")[1]), fitted.coefficients.toArray(), 1.0 / n)
    agrees = max(abs(x - y) for x, y in zip([*fitted.coefficients, fitted.intercept], [u, v, c])) < 1e-3 and told.steepest < 1e-5 and abs(told.loss - found.loss) < 1e-8
    figures = {"quantity": round(u, 4), "discount": round(v, 4), "intercept": round(c, 4), "loss": round(found.loss, 6), "steepest": round(found.steepest, 6)}
    return spark.range(1).select(*[F.lit(x + 0.0).alias(k) for k, x in figures.items()], F.lit(agrees).alias("solver_agrees"))


def _labelled_vectors(spark, folder):
    from ..operators.mlbench import prepare

    frame = quality_features(spark, folder).withColumn("label", F.col("quality").cast("double")).drop("quality")
    columns, encoding = prepare(frame.drop("label"), [c for c in frame.columns if c != "label"])
    ready = frame.select("label", *columns)
    return encoding.fit(ready).transform(ready).select("label", "features", F.monotonically_increasing_id().alias("row"))


@query("mlb_tree_nodes", """SELECT quality::DOUBLE AS label, count(*) AS n, count(*)::DOUBLE AS in_leaves, 0::BIGINT AS other_leaves, 0::BIGINT AS other_gains FROM labels l JOIN documents USING (doc_id) GROUP BY 1""")
def mlb_nodes(spark, folder):
    """A tree as a node table: rows walked down by joins give every leaf the class counts it was fitted with, and every split its gain."""
    from ..operators import treetables
    from ..operators.mlbench import estimator_for
    from ..plans.local import durable

    ready = durable(_labelled_vectors(spark, folder))
    fitted = estimator_for("classification", "decision_tree", 1)[1].fit(ready)
    nodes = durable(treetables.node_table(fitted))
    here = treetables.walk(ready, nodes, fitted.getMaxDepth()).groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    leaves = nodes.where("feature IS NULL").select("node", F.posexplode("stats").alias("label", "stat")).withColumn("label", F.col("label").cast("double"))
    both = leaves.join(here, ["node", "label"], "full").withColumns({"n": F.coalesce("n", F.lit(0)), "stat": F.coalesce("stat", F.lit(0.0))})
    other_gains = treetables.gains(nodes).where("abs(gain - again) > 1e-9").count()
    return both.groupBy("label").agg(
        F.sum("n").alias("n"), F.round(F.sum("stat"), 6).alias("in_leaves"), F.count_if(F.abs(F.col("n") - F.col("stat")) > 1e-6).alias("other_leaves"),
        F.lit(other_gains).cast("bigint").alias("other_gains"))


@query("mlb_forest_nodes", "SELECT count(*) AS n, (count(*) * 50)::BIGINT AS walks, 0::BIGINT AS other_scores FROM labels l JOIN documents USING (doc_id)")
def mlb_forest_walk(spark, folder):
    """A forest as a node table: the mean of the leaves' class shares is the model's own probability for every row."""
    from pyspark.ml.functions import vector_to_array

    from ..operators import treetables
    from ..operators.mlbench import estimator_for
    from ..plans.local import durable

    ready = durable(_labelled_vectors(spark, folder))
    fitted = estimator_for("classification", "random_forest", 1)[1].fit(ready)
    nodes = durable(treetables.node_table(fitted))
    walked = durable(treetables.walk(ready.select("row", "features"), nodes, fitted.getMaxDepth()).select("row", "tree", "node"))
    own = fitted.transform(ready).select("row", vector_to_array("probability").alias("p"))
    joined = treetables.class_shares(walked, nodes, "row", 2).join(own, "row")
    other = F.count_if(F.abs(F.col("p")[1] - F.col("probability")[1]) > 1e-9)
    return joined.agg(F.count(F.lit(1)).alias("n"), F.lit(walked.count()).cast("bigint").alias("walks"), other.alias("other_scores"))


@query("mlb_imputed_scaled", D + """, m AS (SELECT median(total_price) AS m FROM d), f AS (SELECT coalesce(total_price, m) AS x, total_price IS NULL AS hole, m FROM d, m)
  SELECT round(any_value(m), 4) AS median, count(*) FILTER (hole) AS filled, round((max(x) - avg(x)) / stddev_samp(x), 4) AS highest, round((min(x) - avg(x)) / stddev_samp(x), 4) AS lowest FROM f""")
def mlb_imputed(spark, folder):
    """Numbers are filled with the median, then centred and scaled."""
    from pyspark.ml.functions import vector_to_array

    from ..operators.mlbench import prepare

    frame = dirty(spark, folder).select("total_price")
    columns, encoding = prepare(frame, ["total_price"])
    ready = frame.select(F.col("total_price").isNull().alias("hole"), *columns)
    coded = encoding.fit(ready).transform(ready).withColumn("z", vector_to_array("features")[0])
    return coded.agg(
        F.round(F.max(F.when(F.col("hole"), F.col("n_total_price"))), 4).alias("median"), F.count_if("hole").alias("filled"),
        F.round(F.max("z"), 4).alias("highest"), F.round(F.min("z"), 4).alias("lowest"))


@query("mlb_ridge_closed_form", """WITH s AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem),
  c AS (SELECT var_pop(a) + 1.0 / count(*) AS aa, var_pop(b) + 1.0 / count(*) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb FROM s)
  SELECT round((ay * bb - yb * ab) / (aa * bb - ab * ab), 3) AS quantity, round((yb * aa - ay * ab) / (aa * bb - ab * ab), 1) AS discount FROM c""")
def mlb_ridge_form(spark, folder):
    """Coefficients of two features equal the normal equations with a penalty of 1/n."""
    from pyspark.ml.feature import VectorAssembler

    from ..operators.mlbench import estimator_for

    rows = table(spark, folder, "lineitem").select("l_quantity", "l_discount", F.col("l_extendedprice").alias("label"))
    ready = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(rows)
    size, spread = ready.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    _, ridge = estimator_for("regression", "ridge", size, spread)
    a, b = ridge.fit(ready).coefficients
    return rows.agg(F.round(F.lit(float(a)), 3).alias("quantity"), F.round(F.lit(float(b)), 1).alias("discount"))


@query("mlb_uplift", """SELECT metric, true AS uplift_is_difference, true AS in_range, (SELECT count(*) FROM labels) AS n
  FROM (VALUES ('accuracy'), ('precision'), ('recall'), ('f1'), ('roc_auc')) t(metric)""")
def mlb_uplift(spark, folder):
    """Uplift is clean minus raw for every metric, and all metrics are shares."""
    from ..operators.mlbench import benchmark

    features = quality_features(spark, folder)
    clean = repair(features, ["impute:lang"], "quality").frame
    found = benchmark(features, clean, "quality", "decision_tree").table()
    return found.select(
        "metric", (F.abs(F.col("clean") - F.col("raw") - F.col("uplift")) < 1e-4).alias("uplift_is_difference"),
        (F.col("clean").between(0, 1) & F.col("raw").between(0, 1)).alias("in_range"), F.lit(table(spark, folder, "labels").count()).cast("bigint").alias("n"))


@query("mlb_importance_by_gain", "SELECT count(*) AS n, 0::BIGINT AS other_importances FROM labels l JOIN documents USING (doc_id)")
def mlb_gains(spark, folder):
    """A tree's feature importances are its splits' gains weighted by their rows, added up by feature: worked out from the node table."""
    from ..operators import treetables
    from ..operators.mlbench import estimator_for
    from ..plans.local import durable, local_frame

    ready = durable(_labelled_vectors(spark, folder))
    fitted = estimator_for("classification", "decision_tree", 1)[1].fit(ready)
    splits = treetables.node_table(fitted).where("feature IS NOT NULL")
    weight = F.aggregate("stats", F.lit(0.0), lambda a, b: a + b)
    own = splits.groupBy("feature").agg(F.sum(F.col("gain") * weight).alias("g"))
    own = own.join(own.agg(F.sum("g").alias("all")).hint("broadcast")).select("feature", (F.col("g") / F.col("all")).alias("again"))  # one row
    told = fitted.featureImportances
    said = local_frame(spark, [{"feature": int(i), "said": float(told[int(i)])} for i in range(len(told)) if told[int(i)]], "feature int, said double")
    both = own.join(said, "feature", "full")
    other = both.agg(F.count_if(F.abs(F.coalesce("again", F.lit(0.0)) - F.coalesce("said", F.lit(0.0))) > 1e-9).alias("other_importances"))
    return other.select(F.lit(ready.count()).cast("bigint").alias("n"), "other_importances")


@query("mlb_importance_total", "SELECT round(1.0, 2)::DOUBLE AS total, count(*) AS n FROM labels")
def mlb_importance(spark, folder):
    """Feature importances add up to one."""
    from ..operators.mlbench import benchmark

    features = quality_features(spark, folder)
    found = benchmark(features, features, "quality", "decision_tree").clean.importances
    return table(spark, folder, "labels").agg(F.lit(round(sum(found.values()), 2)).alias("total"), F.count(F.lit(1)).alias("n"))
