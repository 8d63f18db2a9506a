"""Line deduplication over overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import join_back, keyed, let, table

TRIM = " \t\r\x0b\x0c"


def _windows(text: Column, lines: int, long_words: int) -> Column:
    """Array of (start, len, a, b): windows of a text over its non-blank lines, with a 128-bit hash.

    Every run of ``lines`` lines is a window, and so is a shorter run that already holds ``long_words`` words.
    """
    filled = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(TRIM))), lambda x: x != "")
    hashed = F.transform(filled, lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit("second")).alias("b"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("n")))

    def of(h: Column) -> Column:
        def window(i: Column, n: int) -> Column:
            parts = [F.get(h, i + k) for k in range(n)]
            made = F.struct(i.alias("start"), F.lit(n).alias("len"), F.xxhash64(*[p["a"] for p in parts]).alias("a"), F.xxhash64(*[p["b"] for p in parts], F.lit(n)).alias("b"))
            fits = i + n <= F.size(h)
            if n == lines:
                return F.when(fits, made)
            words = sum((p["n"] for p in parts[1:]), parts[0]["n"])
            return F.when(fits & (words >= long_words), made)

        every = F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array(*[window(i, n) for n in range(1, lines + 1)]))
        return F.when(F.size(h) > 0, F.array_compact(F.flatten(every)))

    return let(hashed, of)


def repeated_lines(docs: DataFrame, lines: int = 3, long_words: int = 50) -> DataFrame:
    """Per keyed document (id, th): ``gone``, the sorted numbers of its non-blank lines that repeat earlier ones.

    The first occurrence of a window, by (id, text hash, line), stays; a null id comes first.  A hot window is combined
    map-side for its first occurrence; the join back is a plain sort-merge join that Spark may split.
    """
    windows = docs.select("id", "th", F.inline(_windows(F.col("text"), lines, long_words)))
    place = F.struct("id", "th", "start")
    firsts = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(firsts, ["a", "b"]).where(~F.struct("id", "th", "start").eqNullSafe(F.col("first")))
    # covered positions are merged per document; repeats within one window length fold map-side
    covered = later.select("id", "th", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("line"))
    return covered.groupBy("id", "th").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _kept_text(text: Column, gone: Column) -> Column:
    """Text without the non-blank lines numbered in ``gone``; blank lines stay."""

    def of(lines: Column) -> Column:
        blank = F.transform(lines, lambda x: F.btrim(x, F.lit(TRIM)) == "")
        numbers = F.filter(F.transform(blank, lambda b, i: F.when(~b, i)), lambda i: i.isNotNull())
        drop = let(numbers, lambda n: F.transform(gone, lambda g: F.get(n, g)))
        # line numbers are unique: the set difference keeps their order and looks each up once
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return let(F.split(text, "\n"), of)


def dedupe_lines(docs: DataFrame, lines: int = 3, long_words: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows and columns, with later occurrences of repeated line windows removed from ``text``.

    Lines are compared without surrounding white space; blank ones are skipped.  Null text stays null, empty text empty;
    rows equal in id and text are one document and are cut alike; a text of which nothing new is left becomes empty.
    """
    source = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    rows = source.select(F.col("_row")[id].alias("id"), F.col("_row")[text].alias("text"), F.xxhash64(F.col("_row")[text]).alias("th"), "_row")
    cut = join_back(rows, repeated_lines(keyed(docs, id, text), lines, long_words))
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_kept_text(F.col("text"), F.col("gone")))
    return cut.select(*[(new if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, lines: int = 3, long_words: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines (non-blank), n_removed and the remaining text of every document."""
    rows = keyed(docs, id, text)
    cut = join_back(rows, repeated_lines(rows, lines, long_words))
    left = F.coalesce(F.col("text"), F.lit(""))
    n = F.size(F.filter(F.split(left, "\n"), lambda x: F.btrim(x, F.lit(TRIM)) != ""))
    return cut.select(
        F.col("id").alias("doc_id"), n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_kept_text(F.col("text"), F.col("gone"))).alias("text"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(table(spark, folder, "documents"))


#: Window words are counted as spaces plus one, as the operator does.
OP3_SQL = r"""WITH lines AS (
  SELECT doc_id, k, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
    generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
filled AS (
  SELECT doc_id, k, trim(x, e' \t\r\x0b\x0c') AS s, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i
  FROM lines WHERE trim(x, e' \t\r\x0b\x0c') <> ''),
runs AS (
  SELECT doc_id, i, s AS s1, lead(s, 1) OVER w AS s2, lead(s, 2) OVER w AS s3,
    length(s) - length(replace(s, ' ', '')) + 1 AS n1,
    lead(length(s) - length(replace(s, ' ', '')) + 1) OVER w AS n2
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
windows AS (
  SELECT doc_id, i, 1 AS n, s1 AS w FROM runs WHERE n1 >= 50
  UNION ALL SELECT doc_id, i, 2, s1 || chr(10) || s2 FROM runs WHERE s2 IS NOT NULL AND n1 + n2 >= 50
  UNION ALL SELECT doc_id, i, 3, s1 || chr(10) || s2 || chr(10) || s3 FROM runs WHERE s3 IS NOT NULL),
later AS (
  SELECT doc_id, i, n FROM (SELECT *, row_number() OVER (PARTITION BY n, w ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM later),
gone_lines AS (SELECT filled.doc_id, k FROM filled JOIN gone USING (doc_id, i)),
kept AS (
  SELECT doc_id, string_agg(x, chr(10) ORDER BY k) AS text FROM lines ANTI JOIN gone_lines USING (doc_id, k) GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM filled GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_lines, coalesce(cut.n, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""
