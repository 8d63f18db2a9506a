"""Very long texts and very many short items."""

import time

from common_cases import frame

from sievemark.llm import op3_lines
from sievemark.llm.op5_decontaminate import ItemAutomaton, contamination, words_of


def test_texts_of_many_lines_are_cut_in_linear_time(spark):
    text = "\n".join(f"line {i} of a text" if i % 5 else "" for i in range(200_000))
    rows = [(1, text), (2, text), (3, "its own\n" + text + "\nits end"), (4, "\n".join(["again"] * 100_000))]
    start = time.time()
    found = {r["doc_id"]: r for r in op3_lines.line_report(frame(spark, rows)).collect()}
    assert time.time() - start < 90
    assert found[1]["text"] == text and found[1]["n_removed"] == 0
    assert found[2]["n_removed"] == 160_000 and found[2]["text"] == "\n" * 39_999
    assert found[3]["text"] == "its own\n" + "\n" * 40_000 + "its end"
    assert found[4]["n_lines"] == 100_000 and found[4]["text"] == "again"


def brute_hits(words, items, window):
    hit, met = set(), set()
    for name, item in items:
        n = min(window, len(item))
        parts = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in parts:
                hit |= set(range(i, i + n))
                met |= {name} - {None}
    return hit, met


def test_short_items_of_one_id_and_items_without_id(spark):
    items = [(1, "alpha beta gamma"), (1, "delta beta gamma"), (1, "gamma"), (2, "beta gamma"), (None, "omega psi"), (3, " ".join(f"w{i}" for i in range(14))), (None, " ".join(f"v{i}" for i in range(11)))]
    texts = ["Alpha beta gamma, and delta beta gamma.", "delta beta", "omega psi", " ".join(f"w{i}" for i in range(3, 13)), "v0 " + " ".join(f"v{i}" for i in range(1, 11)), "beta-gamma"]
    benchmark = frame(spark, items).withColumnRenamed("doc_id", "item_id")
    docs = frame(spark, list(enumerate(texts)))
    split = [(str(i) if i else None, words_of(t.encode())) for i, t in items]
    for r in contamination(docs, benchmark).collect():
        hit, met = brute_hits(words_of(texts[r["doc_id"]].encode()), split, 10)
        assert (r["n_hit"], r["items"], r["n_items"]) == (len(hit), sorted(met), len(met)), texts[r["doc_id"]]


def test_many_short_items_take_linear_time():
    items = [(str(i % 500), [b"a%d" % (i % 97), b"b%d" % i, b"c%d" % (i % 31)]) for i in range(10_000)]
    start = time.time()
    automaton = ItemAutomaton(items, 10)
    assert time.time() - start < 5
    for name, words in items[::997]:
        spans, met = automaton.scan([b"x", *words, b"y"])
        assert spans == [[1, 4]] and met == {name}
