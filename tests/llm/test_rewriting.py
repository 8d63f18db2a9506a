"""Operators that drop or change documents, and the pipeline."""

import bisect
import re
from collections import Counter, defaultdict

import numpy as np
from common_cases import LINES, TEXTS, collected, frame, ids

import corpus_pipeline
from sievemark.llm import op3_lines, op4_near, op5_decontaminate
from sievemark.llm.common import staged

TRIM = " \t\r\x0b\x0c"


def brute_lines(rows, width=3, words=50):
    """Rows equal in id and text count once; ids in order, null first."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for key in distinct:
        lines = (key[1] or "").split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip(TRIM)]
        gone = set()
        for a in range(len(filled)):
            for n in range(1, width + 1):
                part = tuple(lines[k].strip(TRIM) for k in filled[a:a + n])
                if len(part) < n or n < width and sum(x.count(" ") + 1 for x in part) < words:
                    continue
                if part in seen:
                    gone |= set(filled[a:a + n])
                seen.add(part)
        out[key] = (len(filled), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone) if key[1] is not None else None)
    return out


def test_lines(spark):
    wide = " ".join(f"w{i}" for i in range(55))
    rows = TEXTS + [(20, wide), (21, "before\n" + wide + "\nafter"), (22, "a\na\na\na\na"), (23, "x\n\n" + LINES[0] + "\n \n" + LINES[1] + "\n" + LINES[2]), (24, LINES[0] + " " * 3)]
    want = brute_lines(rows)
    found = collected(op3_lines.line_report(frame(spark, rows)))
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_removed"], str(r["text"])) for r in found) == sorted((str(k[0]), *want[k][:2], str(want[k][2])) for k in rows)
    cut = op3_lines.dedupe_lines(frame(spark, rows))
    assert cut.columns == frame(spark).columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in collected(cut)) == sorted((str(k[0]), str(want[k][2])) for k in rows)
    assert op3_lines.dedupe_lines(frame(spark, [])).count() == 0


def labelled(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    k, seen, out = min(k, len(words)), Counter(), []
    for i in range(len(words) - k + 1 if words else 0):
        part = tuple(words[i:i + k])
        out.append((part, seen[part]))
        seen[part] += 1
    return out


def brute_similarity(a, b):
    at, tails = {x: i for i, x in enumerate(b)}, []
    for x in (at[s] for s in a if s in at):
        k = bisect.bisect_left(tails, x)
        tails[k:k + 1] = [x]
    return len(tails) / (len(a) + len(b) - len(tails))


def brute_classes(rows, least=0.8):
    shingles = [labelled(t) for _, t in rows]
    holders = defaultdict(list)
    for i, own in enumerate(shingles):
        for s in own:
            holders[s].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if brute_similarity(shingles[a], shingles[b]) >= least:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(rows))]


def near_rows():
    random = np.random.default_rng(8)
    rows, text = [], lambda n: list(random.choice([f"v{i}" for i in range(400)], n))
    for base in range(12):
        words = text(int(random.integers(60, 200)))
        rows.append((base * 100, " ".join(words)))
        for copy in range(1, 7):
            changed = list(words)
            for _ in range(int(random.integers(0, 5))):
                changed[int(random.integers(len(changed)))] = "new"
            rows.append((base * 100 + copy, " ".join(changed)))
    shared = text(40)
    rows += [(5000 + i, " ".join(shared + text(30))) for i in range(30)]  # a common passage is no near copy
    rows += [(6000, "two words"), (6001, "Two  words"), (6002, "two word")]
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    found = {r["doc_id"]: r for r in collected(op4_near.near_classes(frame(spark, rows)))}
    roots = brute_classes(rows)
    want = {rows[i][0]: min(rows[k][0] for k in range(len(rows)) if roots[k] == roots[i]) for i in range(len(rows))}
    assert {k: r["class_id"] for k, r in found.items()} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in found.values())


def test_near_duplicates_without_rounds(spark):
    """What the pivot rounds find, the pairing of all that they would leave finds as well."""
    classes = lambda n: {r["doc_id"]: r["class_id"] for r in collected(op4_near.near_classes(frame(spark, near_rows()), rounds=n))}
    assert classes(0) == classes(3)


def test_near_duplicates_of_odd_rows(spark):
    found = collected(op4_near.near_classes(frame(spark)))
    assert ids(found) == ids([{"doc_id": r[0]} for r in TEXTS])
    alone = [r for r in found if r["doc_id"] in (2, 3, 4)]
    assert all(r["class_id"] == r["doc_id"] and r["kept"] for r in alone)
    left = op4_near.one_of_each(frame(spark))
    assert left.columns == frame(spark).columns
    assert Counter(r["doc_id"] for r in collected(left))[9] == 1
    assert op4_near.near_classes(frame(spark, [])).count() == 0


def test_group_without_centre(spark):
    """Copies that are linked in a chain only: no pivot knows them all, later rounds do."""
    words = [f"c{i}" for i in range(150)]
    rows = []
    for step in range(25):
        changed = list(words)
        for k in range(step):
            changed[6 * k] = f"n{k}"
        rows.append((step, " ".join(changed)))
    assert set(brute_classes(rows)) == {0}
    assert {r["class_id"] for r in collected(op4_near.near_classes(frame(spark, rows)))} == {0}


def test_components(spark):
    random = np.random.default_rng(4)
    pairs = {tuple(sorted(random.integers(0, 300, 2).tolist())) for _ in range(220)}
    links = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in pairs if a != b], "a binary, b binary")
    root = {i: i for i in range(300)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = {int.from_bytes(r["node"]): int.from_bytes(r["root"]) for r in op4_near.components(links).collect()}
    assert found == {i: find(i) for i in range(300) if find(i) != i}


def test_decontamination_cuts(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "Kept, before. " + item.upper().replace(" ", "; ") + " -- and after it more words of its own than the passage has in all, surely enough of them."), (2, item), (3, "clean text"), *TEXTS]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    cut = op5_decontaminate.decontaminate(frame(spark, rows), benchmark)
    found = collected(cut)
    assert 2 in ids(found) and len(found) == len(rows) - 1 and cut.columns == frame(spark).columns  # TEXTS has another 2
    texts = [r["text"] for r in found if r["doc_id"] == 1]
    assert any(t.startswith("Kept, before. ") and " -- and after it" in t and "THREE" not in t for t in texts)
    again = collected(op5_decontaminate.contamination(cut, benchmark))
    assert not any(r["contaminated"] for r in again)
    clean = {(str(i), str(t)) for i, t in TEXTS}
    assert clean <= {(str(r["doc_id"]), str(r["text"])) for r in found}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert op5_decontaminate.contamination(docs, benchmark).where("contaminated").count() == 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert tokens.count() == before and tokens.columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_pipeline_takes_odd_rows(spark, sf_dir):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    assert docs.count() >= 1
    none = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        none = staged(stage(spark, none, sf_dir))
    assert none.count() == 0
