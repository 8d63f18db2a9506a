"""Quality rules: a threshold table compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import SPACE, let, table

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that was for on are with as be at by this from or an have not "
    "der die das und ist den von zu mit sich des auf für im dem nicht ein eine als auch "
    "le la les un une des du et est que qui dans pour pas sur au avec par plus ce "
    "el los las y en es una por con para del se no al lo su más como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high``; a missing bound holds always."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production threshold table.
RULES = (
    Rule("word_count", "n_words", low=20),
    Rule("repeated_words", "repeat_word_ratio", high=0.30),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("stop_words", "stop_word_ratio", low=0.03),
    Rule("repeated_lines", "dup_line_ratio", high=0.50),
    Rule("lines_of_one_word", "short_line_ratio", high=0.90),
)


def _repeated_words(windows: Column, width: int) -> Column:
    """Words covered by windows (hashes in text order) that occur twice or more."""

    def covered(positions: Column) -> Column:
        steps = F.transform(positions, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(positions, i + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(ordered, repeated))


def _counts(text: Column, width: int) -> Column:
    """All counts of one text as a struct."""
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - (width - 1)
        return F.when(last < 1, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, width))))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), lambda x: _repeated_words(x, width))).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: ~F.btrim(y, F.lit(" \t\r\x0b\x0c")).rlike(f"[{SPACE}]"))).cast("long").alias("n_short_lines"),
        )

    stops = STOP_WORDS + [w.capitalize() for w in STOP_WORDS] + [w.upper() for w in STOP_WORDS]
    return F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))


def quality(docs: DataFrame, rules=RULES, id: str = "doc_id", text: str = "text", window: int = 8) -> DataFrame:
    """Counts, ratios and verdict of every document, in one projection without a shuffle.

    ``failed_rules`` lists the rules broken, in table order; ``kept`` is true if there is none and the base limits
    (20 words; repeated words at most 30 %) hold.  Null and empty texts have no words: base_failed, not kept.  Repeated
    rows, null ids and extra columns change nothing; the result holds the columns below only.  Windows are compared by
    64-bit hash within their own text.
    """
    source = docs.select(docs[id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    # a generator of one row: a filter on the verdict can't be pushed below it, which would count once for each use
    counted = source.select("doc_id", F.explode(F.array(_counts(F.col("_text"), window))).alias("c"))
    flat = counted.select("doc_id", "c.w.*", "c.l.*", "c.n_symbols")
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    ratios = flat.select(
        "*", (F.col("word_chars") / one("n_words")).alias("mean_word_chars"), (F.col("n_symbols") / one("n_words")).alias("symbol_ratio"),
        (F.col("n_stop_words") / one("n_words")).alias("stop_word_ratio"), (F.col("n_dup_lines") / one("n_lines")).alias("dup_line_ratio"),
        (F.col("n_short_lines") / one("n_lines")).alias("short_line_ratio"), (F.col("n_repeat_words") / one("n_words")).alias("repeat_word_ratio"),
    )

    def broken(rule: Rule) -> Column:
        tests = [F.col(rule.metric) < rule.low] if rule.low is not None else []
        tests += [F.col(rule.metric) > rule.high] if rule.high is not None else []
        return F.when(reduce(lambda a, b: a | b, tests), F.lit(rule.name))

    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = ratios.select("*", base.alias("base_failed"), F.array_compact(F.array(*[broken(r) for r in rules])).alias("failed_rules"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
        "failed_rules", "stop_word_ratio", "symbol_ratio", "dup_line_ratio", "mean_word_chars", "short_line_ratio",
    )


def kept_documents(docs: DataFrame, rules=RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows, with all their columns, that the rules keep."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    judged = quality(row.select("_row", F.col("_row")[text].alias("_t")), rules, "_row", "_t")
    return judged.where("kept").select("doc_id.*")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"))
