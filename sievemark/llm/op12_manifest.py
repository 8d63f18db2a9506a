"""Merkle manifest of a dataset, kept as postorder append logs.

Every group of rows (a source) has a log, and so has the tree over the groups' roots.  A log holds the nodes of a tree in
the order in which they are complete when leaves arrive one by one: a run's sixteenth child, then the run's node, then
what that completes in turn.  How many nodes of each level are complete at a given leaf follows from subtree sizes alone,
so a node's place in the log is a formula (``positions``), and no pointers are kept.  The leaves below an aligned node are
neighbours in the log, hence builders work on aligned blocks of leaves independently and write one segment each; block
roots are the leaves of the next tier of builders.  A proof is read by computing the places of all siblings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.llm.common import lower_ascii, staged, table
from sievemark.llm.numbering import ranked

FAN = 16
#: Levels that a builder adds to its block: it holds FAN ** DEPTH leaves at most.
DEPTH = 2
STEP = "array<struct<own:int,siblings:binary>>"


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while FAN ** levels < n:
        levels += 1
    return levels


def positions(level: int, index: np.ndarray, n: int) -> np.ndarray:
    """Places in the log of the ``index``-th nodes of a level, in a tree of ``n`` leaves.

    A node is complete with its last leaf.  By then all nodes up to its level that end there are written, and of the
    levels above it those that ended before.
    """
    end = np.minimum((np.asarray(index, np.int64) + 1) * FAN ** level, n)
    below = sum(-(-end // FAN ** j) for j in range(level + 1))
    above = sum((end - 1) // FAN ** j for j in range(level + 1, height(n) + 1))
    return below + above - 1


def size(n: int) -> int:
    """Nodes in the log of a tree of ``n`` leaves."""
    return sum(-(-n // FAN ** j) for j in range(height(n) + 1))


def digest(parts: bytes) -> bytes:
    """H of digests given as hex text."""
    return hashlib.sha256(parts).digest()


def grown(leaves: list[bytes], levels: int) -> list[tuple[int, int, bytes]]:
    """(level, index, digest) of a block's nodes in completion order."""
    log, runs, made = [], [b""] * (levels + 1), [0] * (levels + 1)
    for i, node in enumerate(leaves):
        last, level = i + 1 == len(leaves), 0
        while True:
            log.append((level, made[level], node))
            runs[level] += node.hex().encode()
            made[level] += 1
            if level == levels or not (last or made[level] % FAN == 0):
                break
            node = digest(runs[level])
            runs[level] = b""
            level += 1
    return log


def _builder(tier: int, with_rows: bool):
    """Blocks of sorted nodes to log segments: places and digests of all nodes of the block, children included."""
    base = tier * DEPTH

    def built(rows: list[tuple], n: int) -> tuple:
        block, levels = rows[0][1] // FAN ** DEPTH, min(DEPTH, height(n) - base)
        log = grown([r[2] for r in rows], levels)
        first = [block * FAN ** (DEPTH - k) for k in range(levels + 1)]
        level, index = np.array([x[0] for x in log]), np.array([x[1] for x in log])
        places = np.zeros(len(log), np.int64)
        for k in range(levels + 1):
            places[level == k] = positions(base + k, first[k] + index[level == k], n)
        return block, places.astype("<i8").tobytes(), b"".join(x[2] for x in log), log[-1][2], height(n) <= base + levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(done: list[tuple]) -> pa.RecordBatch:
            names = ["tree", "n", "block", "places", "digests", "root", "done"]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
            columns = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)]
            if with_rows:
                columns += [pa.array([d[7] for d in done], pa.list_(id_type)), pa.array([d[8] for d in done], pa.list_(pa.binary()))]
                names += ["ids", "changed"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def finish() -> tuple:
            tree, n = key[0], rows[0][3]
            made = (tree, n, *built(rows, n))
            return (*made, [r[4] for r in rows], [r[5] for r in rows]) if with_rows else made

        key, rows, done, id_type = None, [], [], pa.null()
        names = ["tree", "rank", "digest", "n", *(["id", "changed"] if with_rows else [])]
        for batch in batches:
            if with_rows:
                id_type = batch.schema.field("id").type
            for row in zip(*[batch[c].to_pylist() for c in names]):
                here = row[0], row[1] // FAN ** DEPTH
                if here != key:
                    if rows:
                        done.append(finish())
                        if len(done) >= 64:
                            yield sent(done)
                            done = []
                    key, rows = here, []
                rows.append(row)
        if rows:
            yield sent([*done, finish()])

    return run


class _Block:
    """A segment of the log, read by place."""

    def __init__(self, tier: int, block: int, n: int, places: bytes, digests: bytes, m: int):
        at = np.frombuffer(places, "<i8")
        base, self.steps = tier * DEPTH, []
        for k in range(min(DEPTH, height(n) - base)):
            count = -(-m // FAN ** k)
            found = np.searchsorted(at, positions(base + k, block * FAN ** (DEPTH - k) + np.arange(count), n))
            hexed = b"".join(digests[32 * i: 32 * i + 32] for i in found.tolist()).hex().encode()
            #: One entry a run of this level: its members' digests as hex text.
            self.steps.append([hexed[64 * FAN * r: 64 * FAN * (r + 1)] for r in range(-(-count // FAN))])

    def path(self, i: int) -> list[tuple[int, bytes]]:
        """For the i-th child: its place in each run on the way up, and the run's other members."""
        found = []
        for runs in self.steps:
            run, own = runs[i // FAN], i % FAN
            found.append((own, run[:64 * own] + run[64 * own + 64:]))
            i //= FAN
        return found


def folded(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf (hex text) and its siblings give."""
    for own, siblings in path:
        node = hashlib.sha256(siblings[:64 * own] + node + siblings[64 * own:]).hexdigest().encode()
    return node


def children(tier: int, block: int, n: int) -> int:
    """Nodes that a tier's block stands on."""
    return min(FAN ** DEPTH, -(-n // FAN ** (tier * DEPTH)) - block * FAN ** DEPTH)


def _lister(tier: int):
    """Segments to rows; what a later tier's block stands on is in an earlier tier's segments already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, n, block, places, digests in zip(*[batch[c].to_pylist() for c in ("tree", "n", "block", "places", "digests")]):
                at = np.frombuffer(places, "<i8")
                under = positions(tier * DEPTH, block * FAN ** DEPTH + np.arange(children(tier, block, n)), n)
                own = np.flatnonzero(~np.isin(at, under)) if tier else np.arange(len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(own), pa.binary()), pa.array(at[own], pa.int64()), pa.array([digests[32 * i: 32 * i + 32] for i in own.tolist()], pa.binary())],
                    names=["tree", "position", "digest"])

    return run


def _upper(row: list[dict] | None) -> list[tuple[int, bytes]]:
    return [(s["own"], s["siblings"].hex().encode()) for s in row or []]


def _pather(tier: int):
    """Segments with the path above them to one path a child."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, n, block, places, digests, above, subroot in zip(*[batch[c].to_pylist() for c in ("tree", "n", "block", "places", "digests", "steps", "subroot")]):
                m = children(tier, block, n)
                held, above = _Block(tier, block, n, places, digests, m), above or []
                steps = [[{"own": o, "siblings": bytes.fromhex(s.decode())} for o, s in held.path(i)] + above for i in range(m)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * m, pa.binary()), pa.array(range(block * FAN ** DEPTH, block * FAN ** DEPTH + m), pa.int64()),
                     pa.array(steps, pa.list_(pa.struct([("own", pa.int32()), ("siblings", pa.binary())]))), pa.array([subroot] * m, pa.binary())],
                    names=["tree", "block", "steps", "subroot"])

    return run


def _prover(root: str):
    """First-tier segments with the path above them to one row a leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("n", "block", "places", "digests", "ids", "changed", "steps", "subroot")
            kind = batch.schema.field("ids").type.value_type
            for n, block, places, digests, ids, changed, above, subroot in zip(*[batch[c].to_pylist() for c in names]):
                held, above = _Block(0, block, n, places, digests, len(ids)), _upper(above)
                tail = b"".join(s for _, s in above)
                at = np.searchsorted(np.frombuffer(places, "<i8"), positions(0, block * FAN ** DEPTH + np.arange(len(ids)), n)).tolist()
                leaves, proofs, roots = [], [], []
                for i, (k, other) in enumerate(zip(at, changed)):
                    leaf, path = digests[32 * k: 32 * k + 32], held.path(i)
                    leaves.append(leaf.hex())
                    proofs.append(hashlib.sha256(b"".join(s for _, s in path) + tail).hexdigest())
                    roots.append(folded((leaf if other is None else other).hex().encode(), path + above).decode())
                m = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, kind), pa.array(leaves), pa.array([subroot.hex()] * m), pa.array([root] * m), pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots])],
                    names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def leaf_digest(values: list[Column]) -> Column:
    """H of values: ``-`` for a null, else the UTF-8 byte count, a colon and the value; as bytes."""
    parts = [v.cast("string") for v in values]
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in parts]
    return F.unhex(F.sha2(F.concat(*told), 256))


def tiers_of(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Log segments of trees, tier by tier, and each tree's root.  ``nodes``: tree, rank, n, digest (and id, changed).

    Each tier is one shuffle of its nodes to aligned blocks; a tier has FAN ** DEPTH times fewer rows than the one below.
    """
    tiers, roots = [], None
    while True:
        with_rows = not tiers and "id" in nodes.columns
        schema = T.StructType.fromDDL("tree binary, n long, block long, places binary, digests binary, root binary, done boolean")
        if with_rows:
            schema = schema.add("ids", T.ArrayType(nodes.schema["id"].dataType)).add("changed", T.ArrayType(T.BinaryType()))
        blocks = nodes.withColumn("block", F.expr(f"rank div {FAN ** DEPTH}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
        segments = staged(blocks.mapInArrow(_builder(len(tiers), with_rows), schema))
        tiers.append(segments)
        done = segments.where("done").select("tree", "root")
        roots = done if roots is None else roots.unionByName(done)
        nodes = segments.where(~F.col("done")).select("tree", F.col("block").alias("rank"), "n", F.col("root").alias("digest"))
        if nodes.isEmpty():
            return tiers, roots


def paths_above(tiers: list[DataFrame], start: DataFrame) -> DataFrame:
    """Paths (tree, block, steps, subroot) above the first tier's blocks; ``start`` holds those above the trees' roots."""
    start = start.withColumn("block", F.lit(0).cast("long"))
    above = start
    for tier in range(len(tiers) - 1, 0, -1):
        segments = tiers[tier].drop("root", "done")
        found = segments.join(above, ["tree", "block"]).mapInArrow(_pather(tier), f"tree binary, block long, steps {STEP}, subroot binary")
        ended = start.join(tiers[tier - 1].where("done").select("tree"), "tree", "left_semi")
        above = staged(found.unionByName(ended.select(*found.columns)))
    return above


class Manifest:
    """Trees over the rows of each group and over the groups: ``tiers`` and ``top`` hold the logs, ``root`` the digest as hex text.

    ``tiers`` are the segments of the groups' logs (tree: the group's name, a zero byte for null, else a one byte and its
    UTF-8), ``top`` those of the log over the groups' roots.  ``root`` is None for an empty table.
    """

    def __init__(self, docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id: str = "doc_id", group: str = "source",
                 text: str = "text", tamper: Callable[[Column], Column] | None = None):
        """Leaves of a group ascend by id (null first; equal ids by digest).  Repeated rows are leaves of their own, and columns
        other than ``columns`` don't count.  ``tamper`` tells from the id which rows' leaves are recomputed with A-Z of the
        text lower-cased when proofs are checked (a null counts as false)."""
        name = docs[group].cast("string")
        tree = F.coalesce(F.concat(F.unhex(F.lit("01")), name.cast("binary")), F.unhex(F.lit("00")))
        other = F.lit(None).cast("binary")
        if tamper is not None:
            lowered = leaf_digest([lower_ascii(docs[c].cast("string")) if c == text else docs[c] for c in columns])
            other = F.when(tamper(docs[id]), lowered)
        leaves = docs.select(tree.alias("tree"), docs[id].alias("id"), leaf_digest([docs[c] for c in columns]).alias("digest"), other.alias("changed"))
        self.tiers, self.roots = tiers_of(ranked(leaves, "tree", ["id", "digest"]).withColumnRenamed("total", "n"))
        top = self.roots.select(F.unhex(F.lit("")).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
        top = staged(ranked(top, "tree", ["name"]).withColumnRenamed("total", "n"))
        self.names = top.select("name", "rank", F.col("digest").alias("subroot"))
        self.top, roots = tiers_of(top.select("tree", "rank", "n", "digest"))
        self.root = next((r["root"].hex() for r in roots.limit(1).collect()), None)

    def log(self) -> DataFrame:
        """(tree, position, digest) of every node of the groups' logs."""
        found = None
        for tier, segments in enumerate(self.tiers):
            part = segments.mapInArrow(_lister(tier), "tree binary, position long, digest binary")
            found = part if found is None else found.unionByName(part)
        return found

    def proofs(self) -> DataFrame:
        """id, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf."""
        nothing = F.array().cast(STEP)
        above = paths_above(self.top, self.top[-1].select("tree", nothing.alias("steps"), F.col("root").alias("subroot")))
        steps = self.top[0].drop("root", "done").join(above, ["tree", "block"]).mapInArrow(_pather(0), f"tree binary, block long, steps {STEP}, subroot binary")
        start = self.names.join(steps.select(F.col("block").alias("rank"), "steps"), "rank").select(F.col("name").alias("tree"), "steps", "subroot")
        above = paths_above(self.tiers, staged(start))
        schema = T.StructType([T.StructField("id", self.tiers[0].schema["ids"].dataType.elementType)])
        for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
            schema = schema.add(c, T.StringType())
        return self.tiers[0].drop("root", "done").join(above, ["tree", "block"]).mapInArrow(_prover(self.root or ""), schema.add("verified", T.BooleanType()))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    told = Manifest(table(spark, folder, "documents"), tamper=lambda id: F.crc32(id.cast("string").cast("binary")) % 5 == 0)
    return told.proofs().withColumnRenamed("id", "doc_id")


def manifest_sql(levels: int = 5, group_levels: int = 3) -> str:
    """The query in SQL for groups of at most 16 ** levels rows; one set of tables a level."""
    told = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(told(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps = ["t0 AS (SELECT range AS b, range AS c FROM range(256))"]
    steps += [f"t{i + 1} AS (SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM t{i})" for i in range(8)]
    steps += ["tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM t8)", """ids AS (SELECT *, list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))) AS bytes FROM documents, tab)""",
        f"""leaves AS MATERIALIZED (SELECT doc_id, coalesce('1' || source, '0') AS g, {leaf('text')} AS h, CASE WHEN doc_id IS NOT NULL AND
      xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 5 = 0
    THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM ids)""",
        "l0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM leaves)"]

    def grow(name: str, levels: int) -> None:
        for k in range(levels):
            steps.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (
  SELECT g, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > 1 GROUP BY g, i // 16))""")
            steps.append(f"r{name}{k} AS MATERIALIZED (SELECT g, i // 16 AS run, list(h ORDER BY i) AS hs FROM {name}{k} WHERE n > 1 GROUP BY g, i // 16)")

    def fold(name: str, start: str, levels: int) -> None:
        steps.append(f"f{name}0 AS ({start})")
        for k in range(levels):
            steps.append(f"""f{name}{k + 1} AS (SELECT f.* REPLACE (f.i // 16 AS i,
    CASE WHEN r.g IS NULL THEN node ELSE sha256(array_to_string(list_concat(hs[1:f.i % 16], [node], hs[f.i % 16 + 2:]), '')) END AS node,
    CASE WHEN r.g IS NULL THEN proof ELSE proof || array_to_string(list_concat(hs[1:f.i % 16], hs[f.i % 16 + 2:]), '') END AS proof)
  FROM f{name}{k} f LEFT JOIN r{name}{k} r ON r.g = f.g AND r.run = f.i // 16)""")

    def roots(name: str, levels: int) -> str:
        return " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1))

    grow("l", levels)
    steps.append(f"sub AS MATERIALIZED ({roots('l', levels)})")
    steps.append("s0 AS MATERIALIZED (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n FROM sub)")
    grow("s", group_levels)
    steps.append(f"top AS ({roots('s', group_levels)})")
    fold("l", "SELECT doc_id, g, i, h AS leaf, coalesce(other, h) AS node, '' AS proof FROM leaves", levels)
    fold("s", f"SELECT f.doc_id, '' AS g, s0.i, f.leaf, f.node, f.proof, s0.h AS subroot FROM fl{levels} f JOIN s0 ON s0.name = f.g", group_levels)
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = top.h AS verified FROM fs{group_levels}, top"""


OP12_SQL = manifest_sql()
