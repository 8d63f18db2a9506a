"""Benchmark decontamination with a generalised suffix automaton of the test items' words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import pieces, staged, table

#: Bytes that belong to words are kept (A-Z lower-cased), all others become spaces; UTF-8 bytes over 0x7F belong to words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class ItemAutomaton:
    """Suffix automaton over several word sequences.

    ``length`` and ``link`` are those of the usual construction; ``items`` holds the item ids whose prefixes end in a
    state, ``short`` the shorter-than-window items that a state's longest string equals.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.length, self.link = [0], [-1]
        own: list[set[str]] = [set()]
        ends: list[tuple[list[bytes], set[str]]] = []
        for name, words in items:
            names, last = {name} - {None}, 0
            for word in words:
                last = self._extend(last, word, own)
                own[last] |= names
            if 0 < len(words) < window:
                ends.append((words, names))
        self.short: dict[int, tuple[int, set[str]]] = {}
        for words, names in ends:  # the state of a whole short item: walk it again, clones may have split it
            state = 0
            for word in words:
                state = self.step[state][word]
            self.short.setdefault(state, (len(words), set()))[1].update(names)
        order = sorted(range(1, len(self.step)), key=lambda s: self.length[s])
        #: Nearest state on the way to the root, itself included, that is a short item; 0 if none.
        self.near_short = [0] * len(self.step)
        for s in order:
            self.near_short[s] = s if s in self.short else self.near_short[self.link[s]]
        for s in reversed(order):  # an item in which a string ends also holds the string's suffixes
            if self.link[s] > 0 and self.length[self.link[s]] >= window:
                own[self.link[s]] |= own[s]
        self.items = [frozenset(x) if self.length[s] >= window else frozenset() for s, x in enumerate(own)]

    def _new(self, length: int, own: list[set[str]]) -> int:
        self.step.append({})
        self.length.append(length)
        self.link.append(-1)
        own.append(set())
        return len(self.step) - 1

    def _split(self, state: int, word: bytes, to: int, own: list[set[str]]) -> int:
        clone = self._new(self.length[state] + 1, own)
        self.step[clone] = dict(self.step[to])
        self.link[clone], self.link[to] = self.link[to], clone
        while state >= 0 and self.step[state].get(word) == to:
            self.step[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: bytes, own: list[set[str]]) -> int:
        to = self.step[last].get(word)
        if to is not None:  # another item has this prefix already
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to, own)
        new, state = self._new(self.length[last] + 1, own), last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state < 0:
            self.link[new] = 0
        else:
            to = self.step[state][word]
            self.link[new] = to if self.length[to] == self.length[state] + 1 else self._split(state, word, to, own)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [start, end) word spans inside window occurrences, and the items they belong to."""
        step, link, length, near, window = self.step, self.link, self.length, self.near_short, self.window
        spans: list[list[int]] = []
        found: set[str] = set()
        state = matched = 0
        for at, word in enumerate(words):
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = step[state].get(word)
            if to is None:
                continue
            state, matched = to, matched + 1
            start = -1
            if matched >= window:
                start, s = at + 1 - window, state
                while length[link[s]] >= window:
                    s = link[s]
                found |= self.items[s]
            if near[state]:
                s = near[state]
                while s:
                    size, names = self.short[s]
                    if size <= matched:
                        found |= names
                        start = min(start, at + 1 - size) if start >= 0 else at + 1 - size
                    s = near[link[s]] if link[s] > 0 else 0
            if start >= 0:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, at + 1])
        return spans, found


def _blocks(benchmark: DataFrame, id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Distinct items in blocks of at most ``block_bytes`` of text (a longer item alone), a partition at a time."""
    items = benchmark.select(benchmark[id].cast("string").alias("i"), benchmark[text].cast("binary").alias("t")).where("t IS NOT NULL").distinct()
    block, size = [], 0
    for row in items.toLocalIterator():
        words = words_of(bytes(row["t"]))
        if not words:
            continue
        if block and size + len(row["t"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["i"], words))
        size += len(row["t"])
    if block:
        yield block


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            for part in pieces(batch):
                n, spans, items = [], [], []
                for text, had_spans, had_items in zip(part["_bytes"].to_pylist(), part["_spans"].to_pylist(), part["_items"].to_pylist()):
                    words = words_of(text or b"")
                    new, names = automaton.scan(words)
                    merged: list[list[int]] = []
                    for start, end in sorted([tuple(x) for x in had_spans] + [tuple(x) for x in new]):
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([start, end])
                    n.append(len(words)), spans.append(merged), items.append(sorted(names | set(had_items)))
                yield pa.RecordBatch.from_arrays(
                    [part["_row"], part["_bytes"], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))],
                    names=["_row", "_bytes", "_n", "_spans", "_items"])

    return scan


def find_spans(rows: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8_000_000,
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns _row, _bytes, _n (words), _spans (word spans inside windows), _items for rows of (_row, _bytes).

    The automaton takes a few hundred bytes a word.  Items go into blocks of ``block_bytes`` of text; each block's
    automaton is broadcast by itself, and every further block scans the rows again, reading them from a written table.
    """
    found = rows.select("_row", "_bytes", F.lit(0).cast("long").alias("_n"), F.array().cast("array<array<int>>").alias("_spans"), F.array().cast("array<string>").alias("_items"))
    schema, first = found.schema, True
    context = rows.sparkSession.sparkContext
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        if not first:
            found = staged(found)
        found, first = found.mapInArrow(_scanner(context.broadcast(ItemAutomaton(block, window))), schema), False
    if first:  # no items: only the words are counted
        found = found.mapInArrow(_scanner(context.broadcast(ItemAutomaton([], window))), schema)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document the words inside any occurrence of an item window, and the items met.

    Null and empty texts have no words and no hits; items without words are none; equal items count once by id; an item
    without id hits words, but is neither counted nor named;
    an empty benchmark hits nothing.  Repeated rows are reported as often as they occur; extra columns are left out.
    """
    rows = docs.select(docs[id].alias("_row"), docs[text].cast("binary").alias("_bytes"))
    found = find_spans(rows, benchmark, window, **options)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + (x[1] - x[0]))
    return found.select(
        F.col("_row").alias("doc_id"), F.col("_n").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def _cut(text: str, spans: list[list[int]]) -> str:
    """Text without the words numbered in ``spans``, and without what stands between them."""
    data = text.encode()
    plain, out, at = data.translate(WORD_BYTES), [], 0
    starts, i = {}, 0
    for number, word in enumerate(plain.split()):
        i = plain.index(word, i)
        starts[number] = (i, i + len(word))
        i += len(word)
    for start, end in spans:
        out.append(data[at:starts[start][0]])
        at = starts[end - 1][1]
    out.append(data[at:])
    return b"".join(out).decode()


def _cutter(shared, most: float):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            for part in pieces(batch):
                texts, keep = [], []
                for data, spans in zip(part["_bytes"].to_pylist(), part["_spans"].to_pylist()):
                    text, n = (data.decode() if data is not None else None), len(words_of(data or b""))
                    keep.append(not n or sum(e - s for s, e in spans) <= most * n)
                    while spans and keep[-1]:  # joined ends may form a window again; each round removes words
                        text = _cut(text, spans)
                        spans = automaton.scan(words_of(text.encode()))[0]
                    texts.append(text)
                out = pa.RecordBatch.from_arrays([part["_row"], pa.array(texts, pa.string())], names=["_row", "_text"])
                yield out.filter(pa.array(keep, pa.bool_()))

    return cut


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most: float = 0.5, block_bytes: int = 8_000_000,
                  id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows and columns without benchmark passages.

    Spans inside windows (length limit) are cut from the text; a document of which more than ``most`` of the words are
    hit (coverage limit) goes.  Documents without hits stay as they are, null and empty texts too.
    """
    source = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text].cast("binary").alias("_bytes"))
    found = find_spans(source, benchmark, window, block_bytes)
    context = docs.sparkSession.sparkContext
    blocks = list(_blocks(benchmark, "item_id", "text", block_bytes)) or [[]]
    out = None
    schema = found.select("_row", F.col("_bytes").cast("string").alias("_text")).schema
    for block in blocks:
        part = found if out is None else find_spans(out.select("_row", F.col("_text").cast("binary").alias("_bytes")), benchmark, window, block_bytes)
        out = part.mapInArrow(_cutter(context.broadcast(ItemAutomaton(block, window)), most), schema)
    return out.select(*[(F.col("_text") if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans", "items")


OP5_SQL = r"""WITH dw AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM (SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
iw AS (SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS t FROM iw WHERE len(w) BETWEEN 1 AND 9
  UNION SELECT item_id, 10, array_to_string(w[i:i + 9], ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM iw WHERE len(w) >= 10)),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, list(w ORDER BY k) AS w FROM dw GROUP BY doc_id),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, places.n, i, item_id FROM places JOIN windows USING (n, t)),
words AS (SELECT doc_id, count(*) AS n FROM dw GROUP BY doc_id),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
met AS (SELECT doc_id, count(item_id) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(words.n, 0) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(met.n, 0) AS n_items,
  sha256(coalesce(met.s, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM documents d LEFT JOIN words USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id)"""
