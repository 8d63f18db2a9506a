"""Logistic context mixing over the bits of a prefix code, in numpy, many symbols at a time.

A symbol is a path of bits through a Huffman tree.  Each bit has one prediction from its tree node alone and one from
each hashed context (the last two and three symbols; or the last one and the last two frequent ones) with the node.  Predictions are mixed in the logistic domain
by weights chosen by a gate (depth in the tree, and how often the longest context was met), and an adaptive map refines
the mixed probability.  Everything is learned online, a batch at a time: predict, correct the weights, then count.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

ORDERS = 2  # hashed contexts
BACK = 3  # symbols that a context looks back at least
DEPTHS, CONFIDENCES = 12, 4
GATES = DEPTHS * CONFIDENCES
CELLS = 33
INPUTS = ORDERS + 2


@dataclass
class Code:
    """Huffman code: for every symbol the steps of its path, one after another, each node, depth and bit in one number."""

    starts: np.ndarray
    sizes: np.ndarray
    steps: np.ndarray
    count: int

    @classmethod
    def of(cls, counts: np.ndarray) -> Code:
        heap = [(int(c) + 1, k, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        children, next_id = {}, len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[next_id] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], next_id, next_id))
            next_id += 1
        paths: dict[int, tuple[list[int], list[int]]] = {heap[0][2]: ([], [])}
        for node in range(next_id - 1, len(counts) - 1, -1):
            nodes, bits = paths.pop(node)
            for bit, child in enumerate(children[node]):
                paths[child] = (nodes + [node - len(counts)], bits + [bit])
        sizes = np.array([len(paths[k][0]) for k in range(len(counts))], np.int64)
        steps = [n << 5 | min(d, DEPTHS - 1) << 1 | b for k in range(len(counts)) for d, (n, b) in enumerate(zip(*paths[k]))]
        return cls(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes, np.array(steps, np.int64), len(counts) - 1)


@dataclass
class Events:
    """The bits of a batch: where each symbol's begin, their slots in the tables, depth and value."""

    begins: np.ndarray
    slots: list[np.ndarray]
    depth: np.ndarray
    bit: np.ndarray


@dataclass
class Mixer:
    """Counts, weights and refining map; ``counts[k]`` holds (zeros, ones) of slot s at 2 s and 2 s + 1."""

    code: Code
    slot_bits: int
    frequent: int = 0  # symbols below this are frequent; 0: contexts are the last two and three symbols
    counts: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    seen: np.ndarray | None = None
    cells: np.ndarray | None = None
    tables: list[np.ndarray] = field(default_factory=list)
    confidence: np.ndarray | None = None

    def start(self) -> Mixer:
        self.counts = [np.zeros(2 * n, np.int32) for n in self.sizes()]
        self.weights = np.full((GATES, INPUTS), 0.35, np.float32)
        self.weights[:, -1] = 0
        self.seen = np.zeros(GATES)
        self.cells = np.zeros(2 * GATES * CELLS)
        return self.refresh()

    def sizes(self) -> list[int]:
        return [self.code.count] + [1 << self.slot_bits] * ORDERS

    def refresh(self) -> Mixer:
        """Tables of log odds, made anew from the counts."""
        self.tables = []
        for counts in self.counts:
            zeros, ones = counts[::2].astype(np.float32), counts[1::2].astype(np.float32)
            self.tables.append(np.log((ones + 0.3) / (zeros + 0.3)))
        total = self.counts[-1][::2] + self.counts[-1][1::2]
        self.confidence = ((total > 0).astype(np.int8) + (total > 3) + (total > 30)).astype(np.int8)
        prior = 1 / (1 + np.exp(-np.tile(np.linspace(-8, 8, CELLS), GATES)))
        self.refined = ((self.cells[1::2] + 20 * prior) / (self.cells[::2] + self.cells[1::2] + 20)).astype(np.float32)
        return self

    @staticmethod
    def _joined(hashed: np.ndarray, before: np.ndarray, k: int) -> np.ndarray:
        hashed = (hashed ^ (before.astype(np.uint32) + np.uint32(k * 977 + 1))) * np.uint32(0x9E3779B1)
        return hashed ^ (hashed >> np.uint32(15))

    def contexts(self, symbols: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Hashed contexts of every symbol; ``first`` is the place of its sequence's start."""
        at = np.arange(len(symbols))
        back = lambda k: np.where(at - k >= first, symbols[at - k], -1)
        start = np.zeros(len(symbols), np.uint32)
        if not self.frequent:
            two = self._joined(self._joined(start, back(1), 1), back(2), 2)
            return [two, self._joined(two, back(3), 3)]
        last = np.maximum.accumulate(np.where(symbols < self.frequent, at, -1))
        one = np.concatenate([[-1], last[:-1]])
        two = np.where(one > 0, one[one], -1)
        pair = self._joined(start, np.where(one >= first, symbols[one], -1), 7)
        pair = self._joined(pair, np.where((two >= first) & (one >= first), symbols[two], -1), 8)
        return [self._joined(start, back(1), 1), pair]

    def events(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> Events:
        """Bits of symbols in order."""
        sizes = self.code.sizes.take(symbols)
        begins = np.cumsum(sizes) - sizes
        path = np.repeat(self.code.starts.take(symbols) - begins, sizes)
        path += np.arange(len(path))
        steps = self.code.steps.take(path)
        node = steps >> 5
        mark = node.astype(np.uint32) * np.uint32(0x85EBCA77)
        slots = [node]
        for context in contexts:
            slot = np.repeat(context, sizes)
            slot ^= mark
            slot *= np.uint32(0x2C1B3C6D)
            slot >>= np.uint32(32 - self.slot_bits)
            slots.append(slot.astype(np.int64))
        return Events(begins, slots, (steps >> 1) & 15, steps & 1)

    def predict(self, e: Events):
        gate = e.depth * CONFIDENCES
        gate += self.confidence.take(e.slots[-1])
        inputs = np.empty((len(gate), INPUTS), np.float32)
        inputs[:, -1] = 1
        for k, (t, s) in enumerate(zip(self.tables, e.slots)):
            inputs[:, k] = t.take(s)
        mixed = np.einsum("nk,nk->n", inputs, self.weights.take(gate, axis=0))
        np.clip(mixed, -12, 12, out=mixed)
        plain = 1 / (1 + np.exp(-mixed))
        np.clip(mixed, -7.99, 7.99, out=mixed)
        mixed += np.float32(8.25)
        mixed *= np.float32(2)
        cell = mixed.astype(np.int64)
        cell += gate * CELLS
        return gate, inputs, plain, cell, np.float32(0.5) * (plain + self.refined.take(cell))

    def _stretches(self, symbols: np.ndarray, first: np.ndarray, step: int = 3000):
        """Events of stretches small enough for the processor's cache."""
        contexts = self.contexts(symbols, first)
        for at in range(0, len(symbols), step):
            yield at, self.events(symbols[at: at + step], [c[at: at + step] for c in contexts])

    def losses(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of every symbol, given those before it in its sequence."""
        out = np.zeros(len(symbols))
        for at, e in self._stretches(symbols, first):
            p = self.predict(e)[-1]
            out[at: at + len(e.begins)] = np.add.reduceat(np.log10(np.abs(p - (1 - e.bit).astype(np.float32))), e.begins, dtype=np.float64)
        return out

    def learn(self, symbols: np.ndarray, first: np.ndarray) -> None:
        """Online steps over a batch; the tables follow the counts when ``refresh`` is called."""
        for _, e in self._stretches(symbols, first):
            gate, inputs, plain, cell, _ = self.predict(e)
            error = e.bit.astype(np.float32) - plain
            seen = np.bincount(gate, minlength=GATES)
            inputs *= error[:, None]
            for k in range(INPUTS):
                self.weights[:, k] += (0.1 * np.bincount(gate, inputs[:, k], minlength=GATES) / (0.5 * seen + 400.0)).astype(np.float32)
            np.clip(self.weights, -4, 4, out=self.weights)
            self.seen += seen
            cell *= 2
            cell += e.bit
            self.cells += np.bincount(cell, minlength=2 * GATES * CELLS)
            one = np.ones(len(gate), np.int32)
            for counts, slots in zip(self.counts, e.slots):
                np.add.at(counts, 2 * slots + e.bit, one)

    # ---- learned numbers as rows of small blocks, so that partitions can be added up by Spark ----
    BLOCK = 8192

    def blocks(self):
        """(block number, numbers) of everything learned; weights come times the bits their gate has seen."""
        parts = [c.astype(np.float64) for c in self.counts] + [(self.weights * self.seen[:, None]).ravel(), self.seen, self.cells]
        number = 0
        for part in parts:
            for at in range(0, len(part), self.BLOCK):
                piece = part[at: at + self.BLOCK]
                if piece.any():
                    yield number, piece
                number += 1

    def load(self, rows: dict[int, np.ndarray]) -> Mixer:
        """The sum of several partitions' blocks."""
        self.start()
        number, parts = 0, []
        for size in [*(len(c) for c in self.counts), GATES * INPUTS, GATES, 2 * GATES * CELLS]:
            part = np.zeros(size)
            for at in range(0, size, self.BLOCK):
                if number in rows:
                    part[at: at + self.BLOCK] = rows[number]
                number += 1
            parts.append(part)
        self.counts = parts[: ORDERS + 1]  # sums of all partitions outgrow 32 bits
        weights, self.seen, cells = parts[-3].reshape(GATES, INPUTS), parts[-2], parts[-1]
        used = self.seen > 0
        self.weights[used] = (weights[used] / self.seen[used, None]).astype(np.float32)
        self.cells = cells
        self.refresh()
        self.counts = []
        return self
