"""Language-model scoring by online logistic context mixing over words, with a smoothed unigram base.

Every token is a symbol: the most frequent words by themselves, other frequent words by one of some classes, all other
words by an escape, and the text's end.  Mixing predicts the bits of the symbols.  A word of a class costs its share of
the class besides; an escaped word is spelled, its bytes predicted by a second mixer.  So probabilities of all texts
add up to one.  Word counts, both mixers and all their counts come from every training document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import pieces, staged, table
from sievemark.llm.mixing import BACK, Code, Mixer
from sievemark.llm.op4_near import MULTIPLIER, PLAIN, word_hashes
from sievemark.llm.op9_classifier import held_out

STEP = 60_000  # symbols in memory at a time
CLASSES = 90


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN).split()


def _counter(most: int):
    """Partial word counts of a partition, handed on whenever ``most`` distinct words are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = Counter(), Counter()

        def out():
            words = list(held[0] | held[1])
            rows = [pa.array(words, pa.binary()), *[pa.array([c[w] for w in words], pa.int64()) for c in held]]
            held[0].clear(), held[1].clear()
            return pa.RecordBatch.from_arrays(rows, names=["word", "c", "other"])

        for batch in batches:
            for part in pieces(batch):
                for text, out_of_training in zip(part["_bytes"].to_pylist(), part["held_out"].to_pylist()):
                    held[bool(out_of_training)].update(tokens_of(text))
                if len(held[0]) + len(held[1]) >= most:
                    yield out()
        yield out()

    return run


@dataclass
class Lexicon:
    """Frequent words with their symbols, costs beyond the symbol and base terms; a bounded part of all words.

    A word is found by its 64-bit hash in two tables of slots; the few words that find both slots taken are left out
    (they are spelled, as rare words are).
    """

    hashes: np.ndarray
    slots: list[np.ndarray]
    symbol: np.ndarray
    extra: np.ndarray
    base: np.ndarray
    escape: int
    end: int
    base_end: float
    end_known: bool

    BITS = 20

    @classmethod
    def _slot(cls, hashes: np.ndarray, table: int) -> np.ndarray:
        return ((hashes * (MULTIPLIER if table else np.uint64(1))) >> np.uint64(64 - cls.BITS)).astype(np.int64)

    @classmethod
    def of(cls, words: list[bytes], counts: np.ndarray, own: int, total: int, ends: int, scale: float) -> tuple[Lexicon, np.ndarray, list[bytes], list[bytes]]:
        """The lexicon, how often each symbol occurs, the words in it and those left out; ``scale`` is the base's denominator."""
        order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
        words, counts = [words[k] for k in order], counts[order].astype(np.float64)
        hashes = word_hashes(b" ".join(words))
        slots, left = [], np.arange(len(words))
        for table in (0, 1):
            slots.append(np.full(1 << cls.BITS, len(words), np.int32))
            at = cls._slot(hashes[left], table)
            slots[table][at[::-1]] = left[::-1]  # of several words the most frequent takes the slot
            left = left[slots[table][at] != left]
        inside = np.setdiff1d(np.arange(len(words)), left)
        number = np.full(len(words) + 1, len(inside), np.int32)
        number[inside] = np.arange(len(inside))
        left_out = [words[k] for k in left]
        words, counts, hashes = [words[k] for k in inside], counts[inside], hashes[inside]
        symbol = np.array([k if k < own else own + zlib.crc32(w[-2:]) % CLASSES for k, w in enumerate(words)], np.int64)
        escape, end = own + CLASSES, own + CLASSES + 1
        sums = np.bincount(symbol, counts, minlength=end + 1)
        extra = np.log10(counts / sums[symbol]) if len(words) else np.zeros(0)
        sums[escape], sums[end] = max(0, total - counts.sum()), ends
        lexicon = cls(np.append(hashes, np.uint64(0)), [number[s] for s in slots], symbol, extra, np.log10((counts + 0.1) / scale), escape, end,
                      float(np.log10((ends + 0.1) / scale)), ends > 0)
        return lexicon, sums, words, left_out

    def read(self, texts: list[bytes | None], words: bool = True):
        """Symbols, sequence starts and places in the lexicon (-1 none, -2 the end) of several texts, owners, rare words."""
        plain = b" ".join([(t or b"").translate(PLAIN) + b" \n" for t in texts])  # a line feed stands for an end
        hashes, starts, ends = word_hashes(plain, True)
        data = np.frombuffer(plain, np.uint8)
        is_end = data[starts] == 10
        place = self.slots[0].take(self._slot(hashes, 0))
        miss = np.flatnonzero(self.hashes.take(place) != hashes)
        second = self.slots[1].take(self._slot(hashes[miss], 1))
        place[miss] = np.where(self.hashes.take(second) == hashes[miss], second, -1)
        place[place == len(self.symbol)] = -1
        place[is_end] = -2
        stops = np.flatnonzero(is_end)
        sizes = np.diff(np.concatenate([[-1], stops]))
        owner = np.repeat(np.arange(len(texts)), sizes)
        rare: list[Counter] = [Counter() for _ in texts] if words else []
        if words:
            for k in np.flatnonzero(place == -1).tolist():
                rare[owner[k]][plain[starts[k]: ends[k]]] += 1
        known = np.concatenate([self.symbol, [self.end, self.escape]])  # the last two by places -2 and -1
        return known[place], np.repeat(stops + 1 - sizes, sizes), place, rare, owner


def _steps(symbols: np.ndarray, first: np.ndarray):
    """Overlapping stretches of a long run of symbols, and how many of each stretch only give context."""
    for at in range(0, len(symbols), STEP):
        back = min(at, BACK)
        part = slice(at - back, at + STEP)
        yield symbols[part], np.maximum(first[part] - (at - back), 0), back


def _emit(mixer: Mixer) -> Iterator[pa.RecordBatch]:
    for number, values in mixer.blocks():
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([zlib.compress(values.astype(np.float64).tobytes(), 1)], pa.binary())], names=["block", "numbers"])


def _learner(shared, reader):
    """Learn a partition's symbols online; give what was learned in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, bits, frequent, source = shared.value
        mixer, batch_number = None, 0
        for batch in batches:
            for part in pieces(batch, 256 if reader is _text_symbols else 4096):
                symbols, first = reader(part, source)
                for some, begin, _ in _steps(symbols, first):
                    mixer = mixer or Mixer(code, bits, frequent).start()
                    mixer.learn(some, begin)
                    batch_number += 1
                    if batch_number & (batch_number - 1) == 0 or batch_number % 32 == 0:
                        mixer.refresh()
        if mixer is not None:
            yield from _emit(mixer)

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of blocks that come in order of their number: one block in memory at a time."""
    number, total = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "numbers"])

    for batch in batches:
        for key, data in zip(batch["block"].to_pylist(), batch["numbers"]):
            values = np.frombuffer(zlib.decompress(data.as_py()), np.float64)
            if key != number:
                if number is not None:
                    yield out()
                number, total = key, values.copy()
            else:
                total += values
    if number is not None:
        yield out()


def _learned(rows: DataFrame, code: Code, bits: int, source, reader, frequent: int = 0) -> Mixer:
    """A mixer learned from all rows: each partition by itself, then added up; its size doesn't depend on the input."""
    context = rows.sparkSession.sparkContext
    schema = "block int, numbers binary"
    parts = rows.mapInArrow(_learner(context.broadcast((code, bits, frequent, source)), reader), schema)
    summed = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_adder, schema)
    return Mixer(code, bits, frequent).load({r["block"]: np.frombuffer(bytes(r["numbers"]), np.float64) for r in summed.collect()})


def _text_symbols(part: pa.RecordBatch, lexicon: Lexicon):
    symbols, first, *_ = lexicon.read(part["_bytes"].to_pylist(), False)
    return symbols, first


def _letter_symbols(part: pa.RecordBatch, _=None):
    """Bytes of words as symbols 0 to 255, and 256 for a word's end."""
    words = part["word"].to_pylist()
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    symbols = np.full(int(sizes.sum()), 256, np.int64)
    ends = np.cumsum(sizes) - 1
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(words), np.uint8)
    return symbols, np.repeat(ends + 1 - sizes, sizes)


def _losses(mixer: Mixer, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.concatenate([mixer.losses(s, f)[back:] for s, f, back in _steps(symbols, first)] or [np.zeros(0)])


def _speller(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = shared.value
        for batch in batches:
            for part in pieces(batch, 4096):
                symbols, first = _letter_symbols(part)
                losses = _losses(mixer, symbols, first)
                ends = np.flatnonzero(symbols == 256)
                starts = np.concatenate([[0], ends[:-1] + 1])
                yield pa.RecordBatch.from_arrays([part["word"], part["c"], pa.array(np.add.reduceat(losses, starts) if len(ends) else [], pa.float64())], names=["word", "c", "spelled"])

    return run


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, mixer = shared.value
        extra = np.concatenate([lexicon.extra, [0.0, 0.0]])
        base = np.concatenate([lexicon.base, [lexicon.base_end, 0.0]])
        for batch in batches:
            for part in pieces(batch):
                texts = part["_bytes"].to_pylist()
                symbols, first, place, rare, owner = lexicon.read(texts)
                total = lambda x: np.bincount(owner, x, minlength=len(texts))
                known = (place >= 0) | ((place == -2) & lexicon.end_known)
                words = [[{"word": w, "n": n} for w, n in c.items()] for c in rare]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(np.bincount(owner, minlength=len(texts)), pa.int64()), pa.array(total(known).astype(np.int64)),
                     pa.array(total(base[place])), pa.array(total(_losses(mixer, symbols, first) + extra[place])), pa.array([len(t or b"") for t in texts], pa.int64()),
                     pa.array(words, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "rare"])

    return run


def lm_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", parts: int = 10, lexicon_words: int = 1 << 18, longest: int = 64, least: int = 3,
              own_symbols: int = 160, context_symbols: int = 60, slot_bits: int = 18, most_held: int = 400_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document.

    Null and empty texts are one token, the end.  The driver and the executors hold ``lexicon_words`` words of at most
    ``longest`` bytes and two mixers of a fixed size; counts of all other words are joined.  A null id is never held
    out.  Repeated rows are learned from and scored as often as they occur; extra columns are left out.  Without
    training documents every word is spelled by an untrained mixer and base terms follow the formula.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    source = docs.select(docs[id].alias("doc_id"), held_out(docs[id], parts).alias("held_out"), docs[text].cast("binary").alias("_bytes"))
    partial = source.select("held_out", "_bytes").mapInArrow(_counter(most_held), "word binary, c long, other long")
    words = staged(partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("other").alias("other")))
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = source.where(~F.col("held_out")).count()
    train_tokens, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    scale = train_tokens + 0.1 * (distinct + 1)

    # frequent words, seen often enough to tell them from new ones: whole bands of counts, 64 bands an octave, as long as they fit
    band = F.floor(64 * F.log2(F.col("c"))).cast("int")
    eligible = words.where((F.col("c") >= least) & (F.octet_length("word") <= longest)).withColumn("band", band)
    cut, fit = 1 << 30, 0
    for row in sorted(eligible.groupBy("band").count().collect(), reverse=True):
        fit += row["count"]
        if fit > lexicon_words:
            break
        cut = row["band"]
    frequent = (F.col("c") >= least) & (F.octet_length("word") <= longest) & (F.coalesce(band, F.lit(-1)) >= cut)
    found = words.where(frequent).select("word", "c").toArrow()
    lexicon, uses, names, left_out = Lexicon.of(found["word"].to_pylist(), found["c"].to_numpy(), own_symbols, sums["n"], ends, scale)
    del found

    training = source.where(~F.col("held_out")).select("_bytes")
    text_mixer = _learned(training, Code.of(uses), slot_bits, lexicon, _text_symbols, context_symbols)
    letters = np.bincount(np.frombuffer(b"".join(names), np.uint8), minlength=257)
    letters[256] = len(names)
    del names
    left_out = spark.createDataFrame(pa.table({"word": pa.array(left_out, pa.binary())}))  # a few hundredths of lexicon_words
    rare_words = words.where(~frequent).unionByName(words.where(frequent).join(F.broadcast(left_out), "word", "left_semi"))
    spell_mixer = _learned(rare_words.where("c > 0").select("word"), Code.of(letters), slot_bits, None, _letter_symbols)

    spelled = rare_words.select("word", "c").mapInArrow(_speller(context.broadcast(spell_mixer)), "word binary, c long, spelled double")
    fields = "doc_id {}, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, rare array<struct<word:binary,n:bigint>>"
    scored = source.mapInArrow(_scorer(context.broadcast((lexicon, text_mixer))), fields.format(source.schema["doc_id"].dataType.simpleString()))
    scored = staged(scored).withColumn("_row", F.monotonically_increasing_id())
    each = scored.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.n").join(spelled, "word")
    rest = each.groupBy("_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / F.lit(float(scale)))).alias("rare_base"), F.sum(F.col("n") * F.col("spelled")).alias("rare_score"))
    full = scored.drop("rare").join(rest, "_row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return full.select(
        "doc_id", "held_out", "n_tokens", plus("known", "rare_known").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        plus("base", "rare_base").alias("base_score"), plus("score", "rare_score").alias("score"),
        (-plus("score", "rare_score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents"))
