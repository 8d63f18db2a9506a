"""Secret scan: base patterns, and a character convolutional network in numpy over every other candidate."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import pieces, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: What the network looks at: runs of a secret's letters with a digit and a letter.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
KINDS = ("assign", "access", "hex", "model")

LEFT, INSIDE, RIGHT = 32, 48, 16
WIDTH = LEFT + INSIDE + RIGHT


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; a failing match is dropped and not tried again."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs that may be secrets; dots and equal signs at their ends don't belong to them."""
    for m in CANDIDATE.finditer(text):
        run = m.group()
        inner = run.strip(".=-_/+")
        start = m.start() + run.index(inner) if inner else m.start()
        if len(inner) >= 16 and any(c.isdigit() for c in inner) and any(c.isalpha() for c in inner):
            yield start, start + len(inner)


#: One number a letter: digits, lower case, upper case and marks by themselves, all else 2, nothing 0.
LETTERS = np.full(128, 2, np.int8)
for _i, _c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ _-./:=+\"'@#,;()<>\n", 3):
    LETTERS[ord(_c)] = _i
N_LETTERS = int(LETTERS.max()) + 1


def windows(found: list[tuple[str, str, str]]) -> np.ndarray:
    """Number rows of (left context, candidate, right context); a long candidate shows its two ends."""
    out = np.zeros((len(found), WIDTH), np.int8)
    for row, (left, inside, right) in zip(out, found):
        if len(inside) > INSIDE:
            inside = inside[: INSIDE // 2] + inside[-(INSIDE // 2):]
        left, right = left[-LEFT:], right[:RIGHT]
        for at, part in ((LEFT - len(left), left), (LEFT, inside), (LEFT + INSIDE, right)):
            codes = np.array([ord(c) if ord(c) < 128 else 127 for c in part], np.int64)
            row[at: at + len(part)] = LETTERS[codes]
    return out


@dataclass
class Network:
    """Embedding, one convolution of five letters, maxima over context and candidate apart, one hidden layer."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    SPAN = 5
    PARTS = ((0, LEFT), (LEFT, LEFT + INSIDE), (LEFT + INSIDE, WIDTH))

    @classmethod
    def new(cls, seed: int, size: int = 12, filters: int = 24, hidden: int = 24) -> Network:
        random = np.random.default_rng(seed)
        draw = lambda *shape: (random.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        return cls({
            "letters": draw(N_LETTERS, size), "conv": draw(cls.SPAN * size, filters), "conv_bias": np.zeros(filters, np.float32),
            "hidden": draw(2 * 3 * filters, hidden), "hidden_bias": np.zeros(hidden, np.float32),
            "out": draw(hidden, 1), "out_bias": np.zeros(1, np.float32),
        })

    def _forward(self, x: np.ndarray):
        w = self.weights
        embedded = w["letters"][x]
        views = np.concatenate([embedded[:, k: WIDTH - self.SPAN + 1 + k] for k in range(self.SPAN)], axis=2)
        active = np.maximum(views @ w["conv"] + w["conv_bias"], 0)
        pooled, places = [], []
        for a, b in self.PARTS:
            part = active[:, a: min(b, active.shape[1])]
            places.append(part.argmax(axis=1) + a)
            pooled += [part.max(axis=1), part.mean(axis=1)]
        joined = np.concatenate(pooled, axis=1)
        hidden = np.maximum(joined @ w["hidden"] + w["hidden_bias"], 0)
        return views, active, places, joined, hidden, (hidden @ w["out"] + w["out_bias"])[:, 0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k: k + 512])[-1] for k in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -40, 40)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        views, active, places, joined, hidden, logits = self._forward(x)
        error = ((1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y) / len(y)).astype(np.float32)[:, None]
        d_hidden = (error @ w["out"].T) * (hidden > 0)
        d_joined = d_hidden @ w["hidden"].T
        d_active = np.zeros_like(active)
        filters, rows = active.shape[2], np.arange(len(x))[:, None]
        for k, (a, b) in enumerate(self.PARTS):
            b = min(b, active.shape[1])
            top, mean = d_joined[:, 2 * k * filters: (2 * k + 1) * filters], d_joined[:, (2 * k + 1) * filters: (2 * k + 2) * filters]
            d_active[:, a:b] += mean[:, None, :] / (b - a)
            np.add.at(d_active, (rows, places[k], np.arange(filters)[None, :]), top)
        d_active *= active > 0
        d_views = d_active @ w["conv"].T
        size, steps = w["letters"].shape[1], active.shape[1]
        d_letters = np.zeros_like(w["letters"])
        for k in range(self.SPAN):
            np.add.at(d_letters, x[:, k: steps + k], d_views[:, :, k * size: (k + 1) * size])
        flat = views.reshape(-1, views.shape[2])
        return {
            "letters": d_letters, "conv": flat.T @ d_active.reshape(-1, filters), "conv_bias": d_active.sum(axis=(0, 1)),
            "hidden": joined.T @ d_hidden, "hidden_bias": d_hidden.sum(axis=0), "out": hidden.T @ error, "out_bias": error.sum(axis=0),
        }


def labelled_findings(count: int = 3000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """Labelled findings (left, candidate, right, label) made by rule: secrets in common forms, and what looks like them."""
    random = np.random.default_rng(seed)
    pick = lambda options: options[int(random.integers(len(options)))]
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda letters, low, high: "".join(letters[i] for i in random.integers(len(letters), size=int(random.integers(low, high + 1))))
    syllables = "an be con der el fi ga ho in ja ko la me no or pa qua re so ti un ver wi za".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(random.integers(1, 4))))
    prose = lambda n: " ".join(word() for _ in range(n))
    alnum = lower + upper + digits

    def secret() -> tuple[str, str, str]:
        value = pick([
            lambda: draw(alnum, 24, 48), lambda: draw(alnum + "+/", 32, 64), lambda: draw("0123456789abcdef", 32, 64), lambda: "ghp_" + draw(alnum, 36, 36),
            lambda: "sk_live_" + draw(alnum, 24, 32), lambda: "xoxb-" + draw(digits, 10, 12) + "-" + draw(alnum, 24, 24), lambda: "AIza" + draw(alnum + "_-", 35, 35),
            lambda: "AKIA" + draw(upper + digits, 16, 16), lambda: "eyJ" + draw(alnum, 20, 30) + "." + draw(alnum + "_-", 30, 60), lambda: draw(alnum + "_-", 20, 43), lambda: draw(upper + digits, 20, 40),
        ])()
        before, after = pick([
            (prose(3) + ' key = "', '"\n'), (prose(2) + "\nAuthorization: Bearer ", "\n"), ("export " + word().upper() + "_KEY=", "\n"), (prose(4) + " credential: ", " " + prose(2)),
            ('{"access": "', '",'), (prose(5) + " ", " " + prose(3)), ("client_" + word() + ": '", "'"), (prose(2) + " private_key=", " " + prose(2)), ("https://user:", "@" + word() + ".example"),
        ])
        return before, value, after

    def harmless() -> tuple[str, str, str]:
        value = pick([
            lambda: f"{word()}.{word()}{draw(digits, 1, 3)}.example.com{'/' + word()}", lambda: f"mail{draw(digits, 1, 2)}.{word()}-{word()}.example.org", lambda: f"{word()}_{word()}_{word()}_{draw(digits, 1, 4)}",
            lambda: f"20{draw(digits, 2, 2)}-0{draw(digits, 1, 1)}-1{draw(digits, 1, 1)}T1{draw(digits, 1, 1)}.{draw(digits, 2, 6)}Z00", lambda: f"/usr/{word()}/{word()}{draw(digits, 1, 2)}/{word()}.txt", lambda: "".join(word().capitalize() for _ in range(4)) + draw(digits, 1, 2),
            lambda: f"{word()}-{word()}-{word()}-{draw(digits, 1, 4)}.html", lambda: f"{word()}{word()}{word()}{word()}{draw(digits, 1, 3)}", lambda: f"v{draw(digits, 1, 2)}.{draw(digits, 1, 2)}.{draw(digits, 1, 2)}-{word()}-{word()}", lambda: f"{word().upper()}-{draw(digits, 8, 14)}-{word().upper()}",
            lambda: f"{draw('0123456789abcdef', 8, 8)}-{draw('0123456789abcdef', 4, 4)}-4{draw('0123456789abcdef', 3, 3)}-a{draw('0123456789abcdef', 3, 3)}-{draw('0123456789abcdef', 12, 12)}", lambda: f"{draw(digits, 1, 3)}{word()}=={draw(digits, 2, 5)}..{word()}.{word()}",
        ])()
        before, after = pick([(prose(5) + " ", " " + prose(3)), (prose(2) + " see ", "."), (prose(3) + "\n", "\n" + prose(2)), ("<a href=\"https://", '">'), (prose(3) + " @", " " + prose(1)), (prose(2) + "@", " " + prose(2)), (prose(4) + " (", ")")])
        return before, value, after

    return [(*(secret() if k % 2 else harmless()), k % 2) for k in range(count)]


def train(findings: list[tuple[str, str, str, int]], recall: float = 0.97, rounds: int = 6, seed: int = 11) -> Network:
    """Network fitted by Adam on three quarters of the findings; the rest calibrates it and sets the threshold.

    Calibration is logistic in the raw score.  The threshold is the highest that keeps ``recall`` of the held-out
    secrets, so raising ``recall`` trades precision for it.
    """
    x, y = windows([f[:3] for f in findings]), np.array([f[3] for f in findings], np.float32)
    order = np.random.default_rng(seed).permutation(len(y))
    held, own = order[: len(y) // 4], order[len(y) // 4:]
    net = Network.new(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    random, step = np.random.default_rng(seed + 1), 0
    for _ in range(rounds):
        random.shuffle(own)
        for at in range(0, len(own), 64):
            step += 1
            for name, g in net.gradients(x[own[at: at + 64]], y[own[at: at + 64]]).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                net.weights[name] -= (0.004 * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    raw, target = net.logits(x[held]), y[held]
    for _ in range(300):  # one-variable logistic regression by gradient steps
        p = 1 / (1 + np.exp(-np.clip(net.scale * raw + net.shift, -40, 40)))
        net.scale -= 0.1 * float(np.mean((p - target) * raw))
        net.shift -= 0.1 * float(np.mean(p - target))
    scores = np.sort(net.probabilities(x[held])[target == 1])
    net.threshold = float(scores[int(np.floor((1 - recall) * len(scores)))])
    return net


def scan(text: str, net: Network) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those that the network adds; what overlaps a base span isn't added."""
    base = base_spans(text)
    rest, covered = [], [(s, e) for s, _, e in base]
    for start, end in candidates(text):
        if not any(s < end and start < e for s, e in covered):
            rest.append((start, end))
    if not rest:
        return base, base
    scores = net.probabilities(windows([(text[max(0, s - LEFT): s], text[s:e], text[e: e + RIGHT]) for s, e in rest]))
    return base, sorted(base + [(s, 3, e) for (s, e), p in zip(rest, scores) if p >= net.threshold])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in pieces(batch):
                found = [scan(t or "", net) for t in part["_text"].to_pylist()]
                counts = [pa.array([sum(x[1] == k for x in base) for base, _ in found], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], *counts, pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]), pa.array([joined(a) for _, a in found], pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secrets(docs: DataFrame, net: Network | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and ``spans`` (kind:start:end in code points) of every document.

    Null and empty texts have no spans.  Kinds that start together come in the order of KINDS.  Repeated rows are
    scanned as often as they occur; extra columns are left out.  The network is some ten thousand numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net or train(labelled_findings()))
    rows = docs.select(docs[id].alias("doc_id"), docs[text].alias("_text"))
    zero = F.lit(0).cast("long")
    schema = rows.select("doc_id", zero.alias("n_assign"), zero.alias("n_access"), zero.alias("n_hex"), F.lit("").alias("base_sha256"), F.lit("").alias("spans")).schema
    return rows.mapInArrow(_scanner(shared), schema)


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets(table(spark, folder, "documents"))
