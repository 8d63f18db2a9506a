"""Centroid clustering, the Merkle manifest and packing against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from common_cases import CLASHES, TEXTS, frame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sievemark.llm import op11_centroids as op11
from sievemark.llm import op12_manifest as op12
from sievemark.llm import op13_packing as op13

# ---- centroids


def vectors(spark, rows):
    schema = T.StructType.fromDDL("vec_id long, embedding array<double>")
    made = spark.createDataFrame(rows, schema)
    return made.withColumns({c: F.lit(None).cast("string") for c in ("id", "q", "wide", "apex", "cluster", "v", "n")})


def plain_clusters(rows, k, rounds, dimensions):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e290 else int(x) * 1024 for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        apart = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        return [(min(range(len(d)), key=lambda c: (d[c], c)), min(d)) for d in apart]

    for _ in range(rounds):
        groups = defaultdict(list)
        for (c, _), (_, v) in zip(assign(), kept):
            groups[c].append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else old for c, old in enumerate(centroids)]
    found = assign() if kept else []
    sums = Counter()
    for c, d in found:
        sums[c] += d
    long = lambda x: x if x < 1 << 63 else None
    total = None if any(d >= 1 << 63 for _, d in found) else long(sum(sums.values()))
    broken = {c for c, d in found if d >= 1 << 63}
    return sorted(((i, c, long(d), None if c in broken else long(sums[c]), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for (i, _), (c, d) in zip(kept, found)), key=str)


def spark_clusters(frame_, **options):
    found = op11.cluster_report(frame_, **options).collect()
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in found), key=str)


def test_clusters_equal_a_plain_version(spark):
    rng = random.Random(3)
    middles = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)]) for i in range(300)]
    rows += [(i, [0.25] * 6) for i in range(300, 340)]                              # one vector many times
    rows += [(7, [0.25] * 6)] * 3 + [(None, [0.5] * 6), (None, [0.5] * 6)]          # repeated rows and ids, null ids
    rows += [(400, None), (401, []), (402, [1.0] * 5), (403, [1.0] * 7), (404, [1.0] * 5 + [None]), (405, [float("nan")] + [1.0] * 5), (406, [float("inf")] * 6)]
    assert spark_clusters(vectors(spark, rows), dimensions=6) == plain_clusters(rows, 8, 10, 6)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0])],
                                  [(1, [1e30, -1e30]), (2, [1e30, 5.0]), (3, [0.1, 0.2]), (4, [-7e12, 1.0])], [(i, [float(i % 3), 1.0]) for i in range(12)]])
def test_few_equal_and_huge_vectors(spark, rows):
    assert spark_clusters(vectors(spark, rows), k=2, rounds=4, dimensions=2) == plain_clusters(rows, 2, 4, 2)


def test_bounds_enclose_true_distances_and_leave_the_nearest():
    rng = np.random.default_rng(1)
    data = rng.integers(-2000, 2000, (400, 20))
    data[50:] = data[:50].repeat(7, 0) + rng.integers(-60, 60, (350, 20))
    simplex = op11.Simplex(data[:40], 12)
    assert len(simplex.points) == 12
    a, c = simplex.apexes(data), simplex.apexes(data[:10])
    true = ((data[:, None] - data[None, :10]) ** 2).sum(2)
    lower = ((a[:, None] - c[None]) ** 2).sum(2)
    upper = lower + 4 * a[:, None, -1] * c[None, :, -1]
    assert (lower <= true * (1 + 1e-9) + 1e-3).all() and (upper >= true * (1 - 1e-9) - 1e-3).all()
    near = op11.candidates(a, c, simplex.growth)
    assert near[np.arange(400), true.argmin(1)].all() and near.mean() < 0.5
    found, exact = op11.nearest(data, a, data[:10], c, simplex.growth, True)
    assert (found == true.argmin(1)).all() and (exact == true.min(1)).all()


# ---- manifest


def manifest_frame(spark, rows):
    table = pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(
        [("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()), ("text", pa.string())])})
    return spark.createDataFrame(table).withColumns({c: F.lit(1) for c in ("tree", "rank", "n", "digest", "changed", "id", "block", "total")})


def plain_log(leaves):
    """Nodes of a tree in completion order, by counting what is complete after every leaf."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][k:k + 16]).encode()).hexdigest() for k in range(0, len(levels[-1]), 16)])
    log = []
    for i in range(len(leaves)):
        for k, nodes in enumerate(levels):
            span = 16 ** k
            if (i + 1) % span == 0 or i + 1 == len(leaves):
                log.append(nodes[i // span])
            else:
                break
    return levels, log


def plain_manifest(rows):
    def leaf(r, text):
        return hashlib.sha256(b"".join(b"-" if v is None else b"%d:" % len(str(v).encode()) + str(v).encode() for v in (*r[:4], text))).hexdigest()

    def lower(t):
        return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def proof(levels, i):
        found = []
        for nodes in levels[:-1]:
            run = nodes[i // 16 * 16: i // 16 * 16 + 16]
            found.append((i % 16, run[:i % 16] + run[i % 16 + 1:]))
            i //= 16
        return found

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r, leaf(r, r[4])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = plain_log([h for _, h in groups[s]])[0]
    top = plain_log([trees[s][-1][0] for s in order])[0] if order else None
    out = []
    for k, s in enumerate(order):
        for i, (r, h) in enumerate(groups[s]):
            path = proof(trees[s], i) + proof(top, k)
            node = leaf(r, lower(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else h
            for own, siblings in path:
                node = hashlib.sha256("".join(siblings[:own] + [node] + siblings[own:]).encode()).hexdigest()
            proof_hash = hashlib.sha256("".join(x for _, siblings in path for x in siblings).encode()).hexdigest()
            out.append((r[0], h, trees[s][-1][0], top[-1][0], proof_hash, node, node == top[-1][0]))
    return sorted(out, key=str)


def spark_manifest(docs):
    told = op12.Manifest(docs, tamper=lambda i: F.crc32(i.cast("string").cast("binary")) % 5 == 0)
    return told, sorted((tuple(r) for r in told.proofs().select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_positions_are_the_completion_order():
    for n in [*range(1, 40), 255, 256, 257, 272, 273, 4096, 4097]:
        levels, log = plain_log([f"{i}" for i in range(n)])
        assert op12.height(n) == len(levels) - 1 and op12.size(n) == len(log)
        seen = [log[p] for k, nodes in enumerate(levels) for p in op12.positions(k, np.arange(len(nodes)), n).tolist()]
        assert seen == [x for nodes in levels for x in nodes]
        assert sorted(p for k, nodes in enumerate(levels) for p in op12.positions(k, np.arange(len(nodes)), n).tolist()) == list(range(len(log)))


def test_manifest_equals_a_plain_version(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "Z"]), rng.choice(["en", None]), rng.randint(0, 99), f"Text Number {i} ß") for i in range(700)]
    rows += [(1000 + i, "hot", "en", i, f"UPPER {i % 2}") for i in range(5000)]     # three tiers of blocks
    rows += [(i, f"source {i}", "en", 1, "A") for i in range(300)]                  # more sources than a block of the top tree
    rows += [(5, None, None, None, None), (None, None, None, None, None), (None, "a", "en", 2, "X"), (None, "a", "en", 2, "X"), (6, "", "", 0, ""), (7, "one", "de", 3, "x" * 70_000)]
    told, found = spark_manifest(manifest_frame(spark, rows))
    assert found == plain_manifest(rows)
    logs = defaultdict(dict)
    for tree, position, digest in told.log().collect():
        assert position not in logs[bytes(tree)]
        logs[bytes(tree)][position] = digest.hex()
    hot = sorted((r for r in rows if r[1] == "hot"), key=lambda r: r[0])
    leaves = {r[0]: r[1] for r in found}
    assert [logs[b"\x01hot"][p] for p in range(op12.size(5000))] == plain_log([leaves[r[0]] for r in hot])[1]
    assert sum(map(len, logs.values())) == sum(op12.size(n) for n in Counter(r[1] for r in rows).values())


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "A")], [(None, None, None, None, None)], [(4, "s", None, 0, "")] * 20])
def test_small_manifests(spark, rows):
    assert spark_manifest(manifest_frame(spark, rows))[1] == plain_manifest(rows)


def test_manifest_and_clusters_sql(spark, tmp_path):
    rows = [(i, ["a", None, "b"][i % 3], "en", i, f"Some TEXT {i}") for i in range(800)]
    con = duckdb.connect()
    con.register("docs", pa.table({c: [r[k] for r in rows] for k, c in enumerate(("doc_id", "source", "lang", "n_chars", "text"))}))
    con.execute("CREATE TABLE documents AS SELECT * FROM docs")
    wanted = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({op12.OP12_SQL})").fetchall()
    assert sorted(wanted, key=str) == plain_manifest(rows)


# ---- packing


def plain_pack(lengths, capacity):
    """Minimum bin slack one sequence at a time, with sets of reachable sums."""
    left, fills = Counter(lengths), []
    while left:
        longest = max(left)
        left[longest] -= 1
        sums = {0}
        for x in (left + Counter()).elements():
            if x + longest <= capacity:
                sums |= {s + x for s in sums if s + x + longest <= capacity}
        fills.append(longest + max(sums))
        left += Counter()
        chosen = op13.fullest(dict(left), capacity - longest)
        assert sum(x * k for x, k in chosen.items()) == max(sums) and all(left[x] >= k for x, k in chosen.items())
        left = left - chosen
    return fills


def test_plan_is_minimum_bin_slack():
    rng = random.Random(2)
    for capacity, most, n in ((20, 20, 60), (50, 17, 200), (64, 64, 150), (7, 3, 40)):
        lengths = [rng.randint(1, most) for _ in range(n)] + [most] * 30
        found = op13.plan(Counter(lengths), capacity)
        fills = [sum(x * k for x, k in chosen.items()) for chosen, times in found for _ in range(times)]
        assert fills == plain_pack(lengths, capacity)
        taken = Counter()
        for chosen, times in found:
            for x, k in chosen.items():
                taken[x] += k * times
        assert taken == Counter(lengths)
        assert len(fills) <= 1 + max(-(-sum(lengths) // capacity), sum(x > capacity / 2 for x in lengths))


def check_packing(found, texts, capacity):
    library = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
    wanted = defaultdict(list)
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        spans = [(0, first), *((s, capacity) for s in range(first, len(ids), capacity))]
        wanted[i] += [(k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for k, (s, n) in enumerate(spans)]
    got = {i: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) for i, rows in pieces.items()}
    assert got == {i: sorted(rows) for i, rows in wanted.items()}
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [r["length"] for r in found]
    assert len(sequences) == sum(times for _, times in op13.plan(Counter(lengths), capacity))


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_equals_a_plain_version(spark, capacity):
    rows = [*TEXTS, *((100 + i, "the same text in many copies") for i in range(50)), (200, "<|endoftext|> in a text<|endoftext|>"), (201, "'S 'll  \n\n x\x1c ²")]
    docs = frame(spark, rows).withColumns({c: F.lit(0) for c in ("piece", "length", "part", "nth", "number", "offset")}).repartition(5)
    check_packing(op13.pack_documents(docs, capacity).collect(), [(r[0], r[1]) for r in rows], capacity)


def test_packing_of_nothing(spark):
    assert op13.pack_documents(frame(spark).where("false")).collect() == []


def test_long_texts_are_cut_without_changing_ids():
    coder = op13.default_coder()
    rng = random.Random(4)
    words = ["word", "it's", " ", "\t", "\n", "12", "é", "漢字", "<|endoftext|>", "...", "a\n", "\r\n", "end. ", "x" * 300]
    for seed in range(3):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(60_000))
        assert len(list(op13.parts_of(text))) > 3
        assert coder.ids(text).tolist() == coder.by_library(text).tolist()
    spaces = " " * 300_000 + "end"
    assert coder.ids(spaces).tolist() == coder.by_library(spaces).tolist()


def test_every_letter_has_the_same_ids_by_ranks_and_library():
    coder = op13.default_coder()
    for low in range(0, 0x110000, 0x4000):
        text = "".join(chr(k) + (" " if k % 3 else "") + ("a" if k % 5 == 0 else "") for k in range(low, low + 0x4000) if not 0xD800 <= k < 0xE000)
        assert coder.ids(text).tolist() == coder.by_library(text).tolist()


def test_kept_ids_are_the_pieces(spark):
    found = op13.pack_documents(frame(spark), 100, keep_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in found)
    assert CLASHES
