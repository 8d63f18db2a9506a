"""URL filter: rules by host and path first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import let, lower_ascii, table

#: Fixed values of the production rules: (verdict, host, path).
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)

#: Words of the labelled URL table: hosts and paths put together from the first are unwanted, from the second wanted.
UNWANTED = (
    "casino poker bets jackpot slots win pills pharma viagra cheap free ads track click banner spam farm "
    "loans payday replica hookup dating adult xxx porn crack warez torrent seo links promo bonus coupon"
).split()
WANTED = (
    "news daily library school museum garden river history science journal city travel health weather music art "
    "books forum wiki docs data open code research world times post review kitchen sport nature market bridge "
    "church village county bakery studio theatre orchestra institute society foundation university college laboratory "
    "observatory gallery archive press gazette tribune herald academy hospital clinic transport railway harbour island "
    "mountain forest meadow winter summer letters language grammar poetry chess cycling running hiking sailing rowing "
    "teachers parents children engineers farmers brewers potters weavers northern southern western eastern northshire"
).split()
SECTIONS = ("en", "de", "fr", "es", "about", "index", "article", "archive", "page")
PREFIXES = ("www", "blog", "m", "")
ENDS = ("com", "org", "net")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled URL table (1: unwanted): neighbouring words of a list make a host, a rule picks the rest.

    Both classes get the same prefixes, endings and paths, so that only the words tell them apart.
    """
    rows = []
    for label, words in ((1, UNWANTED), (0, WANTED)):
        names = [*(f"{a}-{b}" for a, b in zip(words, words[1:] + words[:1])), *words, *(a + b for a, b in zip(words, words[3:] + words[:3]))]
        for i, name in enumerate(names):
            host = f"{PREFIXES[i % 4]}.{name}.example.{ENDS[i % 3]}".lstrip(".")
            rows.append((f"https://{host}/{SECTIONS[i % len(SECTIONS)]}/{(i * 37) % 1000}", label))
    return rows


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def _grams(host: Column, path: Column, sizes: Iterable[int] = (3, 4, 5)) -> Column:
    """Character n-grams of host and path, marked by where they come from; digits count as one letter."""
    def of(mark: str, text: Column, n: int) -> Column:
        padded = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]", "0"), F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
        return let(padded, lambda p: F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(p, i, F.lit(n)))))

    return F.array_distinct(F.concat(*[of(m, t, n) for m, t in (("h", host), ("p", path)) for n in sizes]))


def _featured(rows: DataFrame, slots: int) -> DataFrame:
    grams = rows.withColumn("_grams", _grams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=slots, binary=True, inputCol="_grams", outputCol="_features").transform(grams).drop("_grams")


def train_url_model(labelled: DataFrame, slots: int = 1 << 14, strength: float = 0.002) -> LogisticRegressionModel:
    """Logistic regression on a labelled table (url, label 0/1); rows without url or label are left out."""
    host, path = host_path(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=strength, maxIter=40).fit(_featured(rows, slots))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct (rule, verdict), null if none fits; of equal lengths the blocking one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"), reverse=True):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(pages: DataFrame, model: LogisticRegressionModel, rules=RULES, least: float = 0.5, id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the model's ``unwanted`` probability of every row.

    A rule's verdict stands before the model's, which blocks at ``least`` or more.  A null URL or one without ``://``
    has an empty host and path, fits no rule and is scored like any other; repeated rows are judged alike; extra
    columns are left out.
    """
    host, path = host_path(pages[url])
    rows = pages.select(pages[id].alias("page_id"), host.alias("host"), path.alias("path"))
    slots = model.numFeatures
    scored = model.transform(_featured(rows, slots)).select("page_id", "host", "path", vector_to_array("probability")[1].alias("unwanted"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    scored = scored.withColumn("_rule", rule)
    return scored.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("unwanted") >= least, "block").otherwise("allow")).alias("verdict"), "unwanted")


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(v).alias("label")) for u, v in labelled_urls()])
    return spark.range(1).select(F.inline(rows))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), train_url_model(labelled_table(spark)))
