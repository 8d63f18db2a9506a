"""Exact shares of every class, without ordering a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import quoted
from .local import durable, stored

#: A pass splits each class's bracket into 2 ** STEP cells; brackets of at most NARROW rows are ranked.
STEP, NARROW = 10, 4096
#: Low bits of a draw that tell repeated rows apart.
COPY_BITS = 24
#: Brackets of at most so many classes are broadcast.
FEW_CLASSES = 200_000


def drawn(rows: DataFrame, content: list[Column], seed: int) -> DataFrame:
    """The rows, written once, with ``_draw``: 64 bits, the upper from the content, the lower from the row's place.

    Rows that differ are drawn by what they hold; copies of one row are told apart by where they stand, so that even a
    table of copies splits exactly.
    """
    top = F.shiftleft(F.shiftright(F.xxhash64(*content, F.lit(seed)), COPY_BITS), COPY_BITS)
    low = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(1 << COPY_BITS))
    return stored(rows.withColumns({"_draw": top + low, "_row": F.monotonically_increasing_id()}))


def lowest_share(rows: DataFrame, label: str, share: float) -> DataFrame:
    """``drawn`` rows with ``chosen``: true for the floor(share * n + 0.5) rows of least draw of each class of n rows.

    Classes of at most NARROW rows are ranked, each by itself.  A larger class's threshold is found by counting: every pass
    counts the cells of the bracket that holds it, with map-side combining, and goes on in one cell; only what is left of
    it, NARROW rows at most, is ranked.  There are at most as many large classes as rows / NARROW: their brackets are
    broadcast, so their rows are scanned and not shuffled.
    """
    sizes = rows.groupBy(quoted(label).alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.floor(F.col("n") * F.lit(share) + 0.5)
    # in a bracket are draws whose upper bits are ``prefix``; at the start all are
    brackets = durable(sizes.where(F.col("n") > NARROW).select("_c", wanted.alias("need"), "n", F.lit(0).cast("long").alias("prefix")))
    large = brackets.count()
    names = [c for c in rows.columns if c not in ("_draw", "_row")]

    def beside(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if large <= FEW_CLASSES else frame

    same = quoted(label).eqNullSafe(F.col("_c"))
    small = rows.join(beside(brackets.select("_c")), same, "left_anti") if large else rows
    each = Window.partitionBy(quoted(label))
    need = F.floor(F.count(F.lit(1)).over(each) * F.lit(share) + 0.5)
    place = F.row_number().over(each.orderBy("_draw", "_row"))
    small = small.withColumns({"_place": place, "_need": need}).select(*[quoted(c) for c in names], (F.col("_place") <= F.col("_need")).alias("chosen"))
    if not large:
        return small
    shift = 64
    while True:
        widest = brackets.where("n > 0").agg(F.max("n")).first()[0] or 0
        if shift == 0 or widest <= NARROW and shift < 64:
            break
        inside = F.lit(True) if shift == 64 else F.shiftright("_draw", shift) == F.col("prefix")
        shift = max(shift - STEP, 0)
        cells = rows.select(quoted(label), "_draw").join(beside(brackets.select("_c", "need", "prefix")), quoted(label).eqNullSafe(F.col("_c"))).where(inside)
        cells = cells.groupBy("_c", F.shiftright("_draw", shift).alias("cell")).agg(F.count(F.lit(1)).alias("m"), F.first("need").alias("need"))
        upto = F.sum("m").over(Window.partitionBy("_c").orderBy("cell"))  # at most 2 ** STEP cells a class
        cells = cells.withColumn("upto", upto).where((F.col("need") > F.col("upto") - F.col("m")) & (F.col("need") <= F.col("upto")))
        found = cells.select("_c", (F.col("need") - F.col("upto") + F.col("m")).alias("need"), F.col("m").alias("n"), F.col("cell").alias("prefix"))
        none = brackets.where("need = 0").select("_c", "need", F.lit(0).cast("long").alias("n"), "prefix")  # nothing is wanted of these
        brackets = durable(found.unionByName(none))
    edge = rows.select(quoted(label), "_draw", "_row").join(beside(brackets.select("_c", "need", "prefix")), quoted(label).eqNullSafe(F.col("_c")))
    edge = edge.where((F.col("need") > 0) & (F.shiftright("_draw", shift) == F.col("prefix")))
    rank = F.row_number().over(Window.partitionBy("_c").orderBy("_draw", "_row"))
    last = edge.withColumn("_r", rank).where(F.col("_r") == F.col("need")).select(F.col("_c").alias("_e"), F.col("_draw").alias("_d"), F.col("_row").alias("_w"))
    # the row that fills each class's share; none where nothing is wanted
    ends = durable(brackets.join(last, F.col("_c").eqNullSafe(F.col("_e")), "left").select("_c", "_d", "_w"))
    placed = rows.join(beside(ends), same)
    before = (F.col("_draw") < F.col("_d")) | ((F.col("_draw") == F.col("_d")) & (F.col("_row") <= F.col("_w")))
    return placed.select(*[quoted(c) for c in names], F.coalesce(before, F.lit(False)).alias("chosen")).unionByName(small)
