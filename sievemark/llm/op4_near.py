"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with how often it occurred before.  A sketch holds, for
each of ``functions`` hash functions, the ``picks`` labelled shingles of least hash in text order, and for texts of few
shingles further functions of one shingle.  Texts that share one entry are candidates, and all of them are verified.  The similarity of two sequences of a and b shingles is L / (a + b - L), L being the length of
their longest common subsequence; as labelled shingles are unique it is a longest increasing run of matched places.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.llm.common import keyed, pieces, staged, table

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A-Z lower-cased, white space between words as spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values (a finaliser with two multiplications)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, p, np.uint64))]) for p in (MULTIPLIER, INVERSE))


def word_hashes(plain: bytes, places: bool = False):
    """A hash of every word of a text that has gone through PLAIN, from running sums over its bytes; also their places."""
    data = np.frombuffer(plain, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], data == 32, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(1 << max(10, len(data).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return (hashes, starts, ends) if places else hashes


def labelled_shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of the labelled shingles in text order; a shorter text with a word is one shingle."""
    hashes = word_hashes(text.translate(PLAIN))
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) - size + 1, np.uint64)
        for k in range(size):
            total = total * MULTIPLIER + hashes[k: len(hashes) - size + 1 + k]
        shingles = mixed(total)
        order = np.argsort(shingles, kind="stable")
        ranked = shingles[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        if not new.all():
            places = np.arange(len(ranked))
            shingles[order] = mixed(ranked + (places - np.maximum.accumulate(np.where(new, places, 0))).astype(np.uint64) * INVERSE)
    return shingles


SHORT = 512


@lru_cache(maxsize=8)
def single_keys(functions: int, picks: int, least: float) -> list[int]:
    """How many functions of one pick a text of so many shingles has besides, longer ones none.

    Of a + b - L shingles, L are common at least, so a function of p picks agrees with probability C(L, p) / C(a + b - L, p)
    at least: for few shingles clearly less than least ** p.  The further functions keep the chance that two similar
    texts share no key below twice that of long texts.  The longer text's number never exceeds the shorter one's.
    """
    if not 0 < least < 1:
        return [0] * SHORT
    allowed, need = log(2) + functions * log(1 - least**picks), [0] * SHORT
    for a in range(1, SHORT):
        for b in range(max(1, ceil(least * a - 1e-9)), a + 1):
            common = ceil(least * (a + b) / (1 + least) - 1e-9)
            if common > b or common == a == b:  # never similar, or only if equal
                continue
            p = comb(common, picks) / comb(a + b - common, picks)
            missed = functions * log(1 - p) if p < 1 else -float("inf")
            need[a] = max(need[a], ceil((missed - allowed) / -log(1 - least) - 1e-9))
    return np.maximum.accumulate(need[::-1])[::-1].tolist()


def all_keys(shingles: np.ndarray, functions: int, picks: int, least: float) -> list[int]:
    """The keys of a text, those of one pick for texts of few shingles last."""
    more = single_keys(functions, picks, least)[len(shingles)] if len(shingles) < SHORT else 0
    return sketch(shingles, functions, picks) + (sketch(shingles, more, 1, functions) if more else [])


def sketch(shingles: np.ndarray, functions: int, picks: int, after: int = 0) -> list[int]:
    """One 64-bit key a function: its least labelled shingles, hashed in text order; the first ``after`` functions are left out."""
    seeds = mixed(np.arange(after + 1, after + functions + 1, dtype=np.uint64) * MULTIPLIER)
    step = max(1, 2_000_000 // len(shingles))
    keys = []
    for k in range(0, functions, step):
        own = seeds[k: k + step, None]
        values = (shingles[None, :] ^ own) * (own | np.uint64(1))
        if shingles.size > picks:
            chosen = np.sort(np.argpartition(values, picks, axis=1)[:, :picks], axis=1)
        else:
            chosen = np.broadcast_to(np.arange(shingles.size), (len(own), shingles.size))
        key = own[:, 0]
        for column in shingles[chosen].T:
            key = mixed(key * MULTIPLIER + column)
        keys += key.astype(np.int64).tolist()
    return keys


def _sketcher(words: int, functions: int, picks: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for part in pieces(batch):
                nodes, sizes, keys = [], [], []
                for text in part["text"].cast(pa.binary()).to_pylist():
                    shingles = labelled_shingles(text or b"", words)
                    sizes.append(len(shingles))
                    nodes.append(xxhash.xxh3_128_digest(b" ".join(text.translate(PLAIN).split())) if len(shingles) else None)
                    keys.append(all_keys(shingles, functions, picks, least) if len(shingles) else [])
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["th"], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "th", "node", "n", "keys"])

    return run


CELLS = 128


def compared(a: np.ndarray, b: np.ndarray, least: float) -> tuple[float, tuple[list[int], list[int]]]:
    """Similarity of two sequences of labelled shingles (0 if no alignment inside the band can reach ``least``), and how
    many shingles only one of them has, counted in CELLS cells by their hash."""
    both, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    cells = lambda x: np.bincount((x % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    shared = cells(both)
    common = (cells(a) - shared).tolist(), (cells(b) - shared).tolist()
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0, common
    band = int((len(a) + len(b)) * (1 - least) / (1 + least)) + 1  # the most unmatched shingles that still give ``least``
    inside = np.abs(at - to) <= band
    at, to = at[inside], to[inside]
    to = to[np.argsort(at)]
    if len(to) < least * max(len(a), len(b)):
        return 0.0, common
    if (to[1:] > to[:-1]).all():
        length = len(to)
    else:
        tails: list[int] = []
        for x in to.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        length = len(tails)
    return length / (len(a) + len(b) - length), common


def _verifier(words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            for part in pieces(batch):
                found: list[tuple[float, tuple[list[int], list[int]]]] = []
                for a, text_a, text_b in zip(*[part[c].to_pylist() for c in ("a", "text_a", "text_b")]):
                    if a != last[0]:
                        last = a, labelled_shingles(text_a, words)
                    found.append(compared(last[1], labelled_shingles(text_b, words), least))
                yield pa.RecordBatch.from_arrays(
                    [part["a"], part["b"], pa.array([x[0] for x in found], pa.float64()), *[pa.array([x[1][k] for x in found], pa.list_(pa.int32())) for k in (0, 1)]],
                    names=["a", "b", "similarity", "only_a", "only_b"])

    return run


def _shingler(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for part in pieces(batch, 64):
                lists = [labelled_shingles(t, words).astype(np.int64) for t in part["text"].to_pylist()]
                owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                yield pa.RecordBatch.from_arrays([part["node"].take(pa.array(owner)), pa.array(np.concatenate(lists) if lists else [], pa.int64())], names=["node", "shingle"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each linked node's component, by alternating large and small stars.

    Done as soon as the edges are stars: each node has one root, and no root has one.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.*").where("u != v").distinct())
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        ends = ends.groupBy("e.n").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        if ends.where("up > 1 OR up = 1 AND down = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(root, up): the new root of each root whose component further links join; ``roots`` holds the (node, root) of the links' ends."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.select("a", "b").join(side("a"), "a").join(side("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    return components(between).select(F.col("node").alias("root"), F.col("root").alias("up"))


def with_new_roots(rows: DataFrame, up: DataFrame) -> DataFrame:
    return rows.join(up, "root", "left").withColumn("root", F.coalesce("up", "root")).drop("up")


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, functions: int = 16, picks: int = 3, rounds: int = 3,
                    id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, node, class_key) in place of the documents, and the verified links (a, b, similarity) between nodes.

    A node is a distinct text, compared by its lower-cased words; copies share it and are never paired.  At similarity
    0.8 a function agrees with probability about 0.51, so two long texts share none of 16 keys in about 1 of 100,000
    cases; texts of few shingles have further keys (``single_keys``), so that it's at most 2.1 of 100,000 at any length.

    First every text of a bucket (texts with one key) is compared with the bucket's pivot, the text whose buckets are
    largest in all: linear in the bucket, and enough for a group of copies around one original.  Then, for ``rounds``
    rounds at most, buckets that still hold several components elect another pivot in their largest one, and the texts
    outside it are compared with that: copies that are near the limit by chance find another copy close enough, a good
    part of them in each round.  The few texts that are left are paired with those of other components in their bucket,
    unless the first round proves them too far apart.  What a text has and its pivot has not, and the other way round, is
    counted in cells by hash: two texts with the same pivot differ in at least as many shingles as their cells do in all,
    and in at least those that no other such text has; ``least`` allows (a + b) * (1 - least) / (1 + least).  These bounds
    leave out no link, and the pairing looks at all that the rounds left, so nothing is capped.  A pair of several common
    buckets is met in that of their least common key only.  Texts without a word
    have no node and no class.
    """
    rows = keyed(docs, id, text)
    binary, long = F.lit(None).cast("binary"), F.lit(0).cast("long")
    schema = rows.select("id", "th", binary.alias("node"), F.lit(0).alias("n"), F.array(long).alias("keys")).schema
    sketched = staged(rows.mapInArrow(_sketcher(words, functions, picks, least), schema))

    place = F.min(F.struct("id", "th")).alias("place")
    nodes = sketched.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    bands = nodes.select("node", "n", F.explode(F.array_distinct("keys")).alias("key"))
    counts = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    multi = staged(bands.join(counts, "key"))
    popular = multi.groupBy("node").agg(F.sum("size").alias("popularity"))
    multi = staged(multi.join(popular, "node"))

    inside = sketched.join(popular.select("node"), "node").groupBy("node").agg(place)
    inside = inside.select("node", F.col("place.id").alias("pid"), F.col("place.th").alias("pth"))
    texts = rows.join(inside, rows["id"].eqNullSafe(inside["pid"]) & (rows["th"] == inside["pth"]))
    texts = staged(texts.select("node", F.col("text").cast("binary").alias("text")).dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
        return staged(full.mapInArrow(_verifier(words, least), "a binary, b binary, similarity double, only_a array<int>, only_b array<int>"))

    def pair(x: str, y: str) -> list:
        return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]

    allowed = (1 - least) / (1 + least)
    best = Window.partitionBy("key").orderBy(F.desc("popularity"), "node")
    pivots = multi.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    pivots = staged(pivots.select("key", F.col("node").alias("pivot"), F.col("n").alias("pn")))
    starred = multi.join(pivots, "key").where((F.col("node") != F.col("pivot")) & (F.least("n", "pn") >= least * F.greatest("n", "pn")))
    tested = verified(starred.select(*pair("pivot", "node")).distinct())
    links = tested.where(F.col("similarity") >= least).select("a", "b", "similarity")
    known = components(links)
    roots = staged(popular.select("node").join(known, "node", "left").select("node", F.coalesce("root", "node").alias("root")))

    def still_open(own: DataFrame) -> DataFrame:
        """Rows of the buckets that hold several components."""
        several = own.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
        return staged(own.join(several, "key"))

    open_ = still_open(multi.select("key", "node", "n").join(roots, "node"))
    for turn in range(rounds):
        sizes = open_.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "n")).alias("head"))
        main = sizes.groupBy("key").agg(F.max_by(F.struct("root", "head"), F.struct("size", "root")).alias("m"))
        main = main.select("key", F.col("m.root").alias("main"), F.col("m.head.node").alias("pivot"), F.col("m.head.n").alias("pn"))
        outside = open_.join(main, "key").where((F.col("root") != F.col("main")) & (F.least("n", "pn") >= least * F.greatest("n", "pn")))
        found = verified(outside.select(*pair("pivot", "node")).distinct())
        more = found.where(F.col("similarity") >= least).select("a", "b", "similarity")
        if more.isEmpty():
            break
        up = joined_roots(open_.select("node", "root").distinct(), more)
        links, roots = links.unionByName(more), with_new_roots(roots, up)
        open_ = still_open(staged(with_new_roots(open_, up)))
    roots = staged(roots)
    lone = texts.join(open_.select("node").distinct(), "node").select("node", "text").mapInArrow(_shingler(words), "node binary, shingle long")
    lone = lone.groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("k")).where("k = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    measured = open_.join(pivots, "key").withColumns({"a": F.greatest("pivot", "node"), "b": F.least("pivot", "node")})
    measured = measured.join(tested.select("a", "b", "only_a", "only_b"), ["a", "b"], "left").join(lone, "node", "left")
    cells = F.when(F.col("node") == F.col("pivot"), F.array_repeat(F.lit(0), 2 * CELLS))
    cells = cells.when(F.col("node") == F.col("a"), F.concat("only_a", "only_b")).otherwise(F.concat("only_b", "only_a"))
    measured = staged(measured.select("key", "node", "n", "root", F.coalesce("u", F.lit(0)).alias("u"), cells.alias("cells")).where(F.col("u") <= (1 - least) * F.col("n") + 1e-6))
    measured = measured.join(measured.groupBy("node").agg(F.collect_list("key").alias("keys")), "node")
    x, y = measured.alias("x"), measured.alias("y")
    limit = allowed * (F.col("x.n") + F.col("y.n")) + 1e-6
    apart = F.aggregate(F.zip_with("x.cells", "y.cells", lambda p, q: F.abs(p - q)), F.lit(0), lambda t, v: t + v)
    near = (F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.u") + F.col("y.u") <= limit)
    near &= (F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n")) & (F.coalesce(apart, F.lit(0)) <= limit)
    near &= F.col("x.key") == F.array_min(F.array_intersect("x.keys", "y.keys"))
    left = x.join(y, (F.col("x.key") == F.col("y.key")) & near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = verified(left.join(tested.select("a", "b"), ["a", "b"], "left_anti")).where(F.col("similarity") >= least).select("a", "b", "similarity")
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = with_new_roots(roots, joined_roots(roots, more))
    # a root is told of nodes with company only; texts without a word stay out of the join, where they would all meet
    own = sketched.select("id", "th", "node")
    classed = own.where("node IS NOT NULL").join(roots, "node", "left").withColumn("class_key", F.coalesce("root", "node"))
    classed = classed.select("id", "th", "node", "class_key").unionByName(own.where("node IS NULL").withColumn("class_key", binary))
    return classed, links


def near_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, class_id (least id of the class), class_size, kept (true for one document of each class) of every row.

    Empty and null texts, and texts of white space only, are alone: class_id is their own id.  Rows equal in id and
    text are one document and are kept or not together.  Null ids come after others; class_id is null if no member has one.
    """
    classed, _ = near_duplicates(docs, id=id, text=text, **options)
    classed = staged(classed)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    some = classed.where("class_key IS NOT NULL")
    heads = some.groupBy("class_key").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("size"))
    all_rows = some.join(heads, "class_key")
    none = [F.lit(None).cast(all_rows.schema[c].dataType).alias(c) for c in ("head", "size")]
    all_rows = all_rows.unionByName(classed.where("class_key IS NULL").select("*", *none))
    alone = F.col("head").isNull()
    return all_rows.select(
        F.col("id").alias("doc_id"), "th", F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
        (alone | order.eqNullSafe(F.col("head"))).alias("kept"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The input's rows and columns, one row of each class (least id); texts without words all stay, repeated rows once."""
    classes = staged(near_classes(docs, id, text, **options))
    gone = classes.where(~F.col("kept")).select(F.col("doc_id").alias("_gid"), F.col("th").alias("_gth")).distinct()
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    packed = packed.select("_row", F.col("_row")[id].alias("_id"), F.xxhash64(F.col("_row")[text]).alias("_th"))
    left = packed.join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left_anti")
    if classes.where("kept").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        left = left.dropDuplicates(["_id", "_th"])
    return left.select("_row.*")


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_classes(table(spark, folder, "documents")).drop("th")
