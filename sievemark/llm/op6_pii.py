"""Personal data: base patterns, and identifiers found by bootstrapped context patterns, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.llm.common import SPACE, join_back, keyed, let, lower_ascii, staged, table

KINDS = ("email", "ip", "card", "phone")

#: Base patterns.  Where a run of letters can't begin a match further inside, the search is told so (each run is read
#: once); possessive quantifiers keep it from trying a run again.  Matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else may be an identifier: a word with a digit or @ in it, groups of digits with marks or brackets between them, and
#: a mail address whose @ is written out.
WORD = rf"(?<![^{SPACE}])(?=[^{SPACE}0-9@]*+[0-9@])[^{SPACE}]{{5,}}+"
RUN = r"\(?[0-9]++\)?(?:[\x20./:-]\(?[0-9]++\)?)++"
MASKED = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
LOOSE = {"word": WORD, "run": RUN, "masked": MASKED}
#: Weight of an instance that can't be of a kind, whatever its context.
UNFIT = 0.5
EDGES = r"^[^A-Za-z0-9+@]+|[^A-Za-z0-9]+$"


def _matches(kind: str, text: Column, pattern: str, guard: Column) -> Column:
    """All matches in a text: kind, number, letters before it since the last match, match, and the text on both sides,
    earlier and later matches with it."""

    def some(part: Column, k: Column, last: bool) -> Column:
        """The last or first words of what stands between two matches, or of a match, none of them cut."""
        tokens = F.split(F.coalesce(F.get(part, k), F.lit("")), f"[{SPACE}]+", -1)
        return let(tokens, lambda t: F.array_join(F.slice(t, F.greatest(F.size(t) - 3, F.lit(1)) if last else F.lit(1), F.lit(4)), " "))

    def zipped(gaps: Column, hits: Column) -> Column:
        return F.transform(hits, lambda h, j: F.struct(
            F.lit(kind).alias("kind"), j.alias("j"), F.length(F.get(gaps, j)).alias("gap"), h.alias("hit"),
            F.concat(*[some(x, j - k, True) for x, k in ((gaps, 2), (hits, 2), (gaps, 1), (hits, 1), (gaps, 0))]).alias("left"),
            F.concat(*[some(x, j + k, False) for x, k in ((gaps, 1), (hits, 1), (gaps, 2))]).alias("right")))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(guard, let(F.split(text, pattern, -1), lambda gaps: let(hits, lambda found: zipped(gaps, found))))


def _luhn(digits: Column) -> Column:
    one = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(F.filter(one, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "email", F.lit(True)).when(kind == "ip", hit.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(10, 15)).otherwise(False))


def found_pieces(rows: DataFrame) -> DataFrame:
    """Base matches and what else may be an identifier (kinds of LOOSE) of keyed rows, with their places in code points.

    One scan of the texts; places are running sums over a text's matches, so long texts cost no more than their length.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = text.rlike("[0-9]")
    guards = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": digit, "phone": F.contains(text, F.lit("+"))}
    guards |= {"word": digit | guards["email"], "run": digit, "masked": text.rlike(r"[(\[](?:at|AT)[)\]]")}
    every = [_matches(k, text, x, guards[k]) for k, x in (PATTERNS | LOOSE).items()]
    empty = F.array().cast("array<struct<kind:string,j:int,gap:int,hit:string,left:string,right:string>>")
    listed = F.concat(*[F.coalesce(x, empty) for x in every])
    numbered = rows.where(digit | guards["email"] | guards["masked"]).withColumn("row", F.monotonically_increasing_id())  # before rows multiply
    numbered = numbered.select("id", "th", "row", F.inline(listed))
    order = Window.partitionBy("row", "kind").orderBy("j")
    end = F.sum(F.col("gap") + F.length("hit")).over(order)
    return numbered.select("*", end.cast("long").alias("end")).withColumn("start", F.col("end") - F.length("hit")).drop("gap")


def _context(word: Column) -> Column:
    """A context word as it stands in a pattern: lower case, digits as 0, without marks at its ends but : = #."""
    return F.regexp_replace(F.regexp_replace(lower_ascii(word), "[0-9]", "0"), r"^[^a-z0-9À-ɏ:=#]+|[^a-z0-9À-ɏ:=#]+$", "")


def _patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of an occurrence: two words before it, or one on each side, or one before, around an open place.

    Marks by themselves, such as a bracket before the occurrence, are no words.
    """
    words = lambda side: F.filter(F.split(side, f"[{SPACE}]+"), lambda x: x.rlike("[A-Za-z0-9À-ɏ:=#]"))
    before = let(words(left), lambda w: F.transform(F.array(F.get(w, F.size(w) - 2), F.get(w, F.size(w) - 1)), lambda x: _context(F.coalesce(x, F.lit("")))))
    after = _context(F.coalesce(F.get(words(right), F.lit(0)), F.lit("")))

    def of(b: Column) -> Column:
        first, last = F.get(b, F.lit(0)), F.get(b, F.lit(1))
        made = [F.concat_ws(" ", first, last, F.lit("_")), F.concat_ws(" ", last, F.lit("_"), after), F.concat_ws(" ", last, F.lit("_"))]
        return F.when(F.length(last) > 0, F.array_distinct(F.array(*made))).otherwise(F.array().cast("array<string>"))

    return let(before, of)


def _weight(kind: Column, instance: Column) -> Column:
    """How well an instance's look goes with a kind: 1, or UNFIT if it has too few or too many digits, or letters in a number.

    Looser than the base patterns: phones need no plus, cards no right check digit, addresses may have more parts.
    """
    digits, letters = F.length(F.regexp_replace(instance, "[^0-9]", "")), instance.rlike("[A-Za-z]")
    fits = (
        F.when(kind == "email", letters & (F.contains(instance, F.lit("@")) | instance.rlike(r"[(\[](?:at|AT)[)\]]")))
        .when(kind == "ip", F.length(F.regexp_replace(instance, "[^.:]", "")).between(3, 7) & ~instance.rlike("[G-Zg-z@ ]") & (digits > 3))
        .when(kind == "card", digits.between(12, 19) & ~letters).when(kind == "phone", digits.between(7, 15) & ~letters))
    return F.when(F.coalesce(fits, F.lit(False)), 1.0).otherwise(UNFIT)


def bootstrap(edges: DataFrame, rounds: int = 3, least: float = 0.7, support: int = 3) -> DataFrame:
    """Confident patterns (pattern, kind, confidence) of a graph of edges (pattern, instance, kind or null, n).

    Seeds score 1 for their kind.  In each round a pattern's confidence for a kind is the share of its occurrences whose
    instances score for it, one more occurrence added to the whole; with ``support`` distinct scoring instances and
    ``least`` confidence it gives its instances that confidence, less if their look doesn't go with the kind, the best
    one counting.
    """
    seeds = edges.where("kind IS NOT NULL").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    scores = seeds
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    for _ in range(rounds):
        good = edges.select("pattern", "instance", "n").join(scores, "instance").groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("score")).alias("good"), F.count(F.lit(1)).alias("instances"))
        patterns = good.join(totals, "pattern").withColumn("confidence", F.col("good") / (F.col("total") + 1))
        patterns = staged(patterns.where((F.col("confidence") >= least) & (F.col("instances") >= support)).select("pattern", "kind", "confidence"))
        new = edges.select("pattern", "instance").join(patterns, "pattern").groupBy("instance", "kind").agg((F.max("confidence") * _weight(F.col("kind"), F.col("instance"))).alias("score"))
        scores = staged(seeds.unionByName(new).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    return patterns


def pii_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """(base spans, added spans), each distinct (id, th, kind, start, end).

    Base spans are the seeds, whatever they hold.  Any word with a digit or @, any groups of digits and any base match
    that isn't valid may be found by a pattern, the longest one where they lie in each other; the pattern's confidence
    times the weight of the found instance's look must reach ``least``.
    """
    least = options.get("least", 0.7)
    pieces = staged(found_pieces(keyed(docs, id, text)))
    valid = F.col("kind").isin(*KINDS) & _valid(F.col("kind"), F.col("hit"))
    base = pieces.where(valid)
    # candidates: loose matches, and matches of base patterns that aren't valid, with the white space inside them
    trimmed = F.when(F.col("kind") == "word", F.regexp_replace("hit", EDGES, "")).otherwise(F.col("hit"))
    others = pieces.where(~valid).select("id", "th", "row", F.col("kind").isin(*LOOSE).alias("loose"), "left", "right", trimmed.alias("instance"), (F.col("start") + F.position(trimmed, F.col("hit")) - 1).alias("start"))
    others = others.withColumn("end", F.col("start") + F.length("instance")).where("length(instance) >= 5")
    others = others.groupBy("id", "th", "row", "start", "end").agg(F.min(F.struct("loose", "left", "right", "instance")).alias("one"))
    others = others.select("id", "th", "row", "one.left", "one.right", "one.instance", "start", "end")
    longest = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    others = others.withColumn("_held", F.max("end").over(longest)).where(F.coalesce(F.col("_held") < F.col("end"), F.lit(True))).drop("_held")

    # which of them overlap a base span: the last base span that began before, and the first that begins after
    none = F.lit(None).cast("string")
    seeds = base.select("id", "th", "row", "left", "right", F.col("hit").alias("instance"), "start", "end", "kind")
    both = others.withColumn("kind", none).unionByName(seeds)
    up = Window.partitionBy("row").orderBy("start", F.col("kind").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.col("kind").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("before", F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(up))
    both = both.withColumn("after", F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(down))
    free = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
    both = both.where(F.col("kind").isNotNull() | free)
    occurrences = staged(both.select("id", "th", "instance", "start", "end", "kind", _patterns(F.col("left"), F.col("right")).alias("patterns")))
    edges = staged(occurrences.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("n")))
    patterns = bootstrap(edges, **options)
    unseen = occurrences.where("kind IS NULL").select("id", "th", "start", "end", "instance", F.explode("patterns").alias("pattern")).join(patterns, "pattern")
    unseen = unseen.withColumn("confidence", F.col("confidence") * _weight(F.col("kind"), F.col("instance"))).where(F.col("confidence") >= least)
    added = unseen.groupBy("id", "th", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("id", "th", F.col("best.kind").alias("kind"), "start", "end")
    return base.select("id", "th", "kind", "start", "end").distinct(), added


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and ``spans`` (kind:start:end in code points) of every document.

    Null and empty texts have no spans.  Spans come by start, then by kind in the order of KINDS.  An added span has the
    kind whose seeds led to it and never overlaps a base span; two added
    spans may overlap.  Rows equal in id and text get the same spans; extra
    columns are left out.
    """
    base, added = pii_spans(docs, id, text, **options)
    marked = base.withColumn("base", F.lit(True)).unionByName(added.withColumn("base", F.lit(False)))
    rank = sum((F.when(F.col("kind") == k, F.lit(i)).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    one = F.struct(F.col("start"), rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("text"))
    grouped = marked.groupBy("id", "th").agg(
        *[F.sum(F.when(F.col("base") & (F.col("kind") == k), 1).otherwise(0)).alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.collect_list(F.when(F.col("base"), one))).alias("own"), F.sort_array(F.collect_list(one)).alias("every"))
    line = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), ",")
    grouped = grouped.select("id", "th", *[f"n_{k}" for k in KINDS], line("own").alias("own"), line("every").alias("every"))
    rows = join_back(keyed(docs, id, text).select("id", "th"), grouped)
    return rows.select(
        F.col("id").alias("doc_id"), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("own", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("every", F.lit("")).alias("spans"))


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))
