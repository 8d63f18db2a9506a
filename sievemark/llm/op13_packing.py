"""Packing of token pieces into sequences of a fixed length by minimum bin slack.

A sequence is filled as follows: it takes the longest piece left, and a bitset of reachable sums over the lengths left
tells the fullest combination that can join it; this combination is removed and the next sequence begins.  Which pieces
have a length doesn't matter, so the search sees how many pieces each length has: a table of at most ``capacity`` rows,
whatever the input.  A combination is taken as often as the counts allow, as the search would find it again, so the
number of searches doesn't grow with the input either.  Spark counts the lengths, numbers the pieces of each length and
gives every number its place in the plan.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sievemark.llm.common import pieces, read_local, staged, table

#: Bits for a number within a length, in the key of the plan's table.
BITS = 48


def fullest(counts: dict[int, int], room: int) -> Counter:
    """Lengths, each at most as often as it is left, whose sum is the largest that fits ``room``.

    Bit s of ``reached`` says that sum s can be made.  Longer lengths come first, copies of one in groups of 1, 2, 4 ...,
    and the search ends when ``room`` is filled, so that short pieces stay for later sequences.
    """
    mask, reached, trail = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left:
            take = min(group, left)
            before, reached = reached, (reached | reached << take * length) & mask
            if reached != before:
                trail.append((length, take, before))
            left, group = left - take, 2 * group
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, Counter()
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            chosen[length] += take
            total -= take * length
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Combinations of lengths and how many sequences are filled by each."""
    counts, found = {x: n for x, n in counts.items() if n}, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        chosen = fullest({x: n for x, n in rest.items() if n}, capacity - longest)
        chosen[longest] += 1
        times = min(counts[x] // k for x, k in chosen.items())
        found.append((chosen, times))
        for x, k in chosen.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
    return found


def places_of(found: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """The plan as a sorted table: pieces of a length from number ``n`` on (key: length and n), ``each`` to a sequence, go to
    the sequences from ``sequence`` on, from ``offset`` on in each."""
    rows, taken, sequence = [], Counter(), 0
    for chosen, times in found:
        offset = 0
        for length in sorted(chosen, reverse=True):
            rows.append(((length << BITS) + taken[length], taken[length], chosen[length], sequence, offset))
            taken[length] += chosen[length] * times
            offset += chosen[length] * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "each", "sequence", "offset"), table.T))


class Coder:
    """Token ids of texts: by ranks where there is a table of them, which takes a sixth of the time, else by the tokenizers library.

    The library also takes texts on which the other's pattern fails, such as a million spaces in a row.  The special
    token's string in a text counts as the token in both.
    """

    def __init__(self, file: bytes, ranks: bytes | None = None, pattern: str = "", special: tuple[str, int] = ("", 0)):
        self.file, self.ranks, self.pattern, self.special = file, ranks, pattern, special
        self.plain = self.fast = None

    def __getstate__(self):
        return self.__dict__ | {"plain": None, "fast": None}

    def by_library(self, text: str) -> np.ndarray:
        if self.plain is None:
            self.plain = Tokenizer.from_str(self.file.decode())
            self.plain.no_truncation()
            self.plain.no_padding()
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is None:
            return self.by_library(text)
        if self.fast is None:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            self.fast = tiktoken.Encoding("packing", pat_str=self.pattern, mergeable_ranks=known, special_tokens=dict([self.special]))
        try:
            found = [self.fast.encode_to_numpy(part, allowed_special="all") for part in ([text] if len(text) <= PART else parts_of(text))]
        except ValueError:
            return self.by_library(text)
        return found[0] if len(found) == 1 else np.concatenate(found)


def default_coder() -> Coder:
    """byte_bpe_50k.json with its table of ranks."""
    import public_tokenizers

    path = public_tokenizers.path
    return Coder(read_local(path("byte_bpe_50k.json")), read_local(path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, ("<|endoftext|>", 50256))


#: Texts are encoded in parts of about so many characters, cut where a token can't span the cut.
PART = 50_000


def parts_of(text: str) -> Iterator[str]:
    """Parts of a long text, cut before a space, tab or line break that follows a letter or digit of ASCII and that a letter of
    ASCII follows: words end there in any case, so the parts' ids one after the other are the text's."""
    start = 0
    while len(text) - start > PART:
        cut = start + PART
        while cut + 1 < len(text):
            if text[cut] in " \t\n" and text[cut - 1].isascii() and text[cut - 1].isalnum() and text[cut + 1].isascii() and text[cut + 1].isalpha():
                break
            cut += 1
        else:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but the first, which is what remains."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def _cutter(shared, capacity: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part_id, seen = shared.value, TaskContext.get().partitionId(), Counter()
        last = np.array([end], "<u4")
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for k, text in enumerate(part["text"].to_pylist()):
                    ids = np.concatenate([coder.ids(text or "").astype("<u4"), last])
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        data = ids[start: start + length].tobytes()
                        rows.append((k, piece, start, length, zlib.crc32(data), seen[length], data))
                        seen[length] += 1
                owner, piece, start, length, crc, nth, data = ([r[i] for r in rows] for i in range(7))
                columns = [part["id"].take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                           pa.array([part_id] * len(rows), pa.int32()), pa.array(nth, pa.int64())]
                names = ["id", "piece", "start", "length", "crc", "part", "nth"]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(d, "<u4").astype(np.int32) for d in data], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _placer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            k = np.searchsorted(places["key"], (length << BITS) + number, "right") - 1
            later = number - places["first"][k]
            sequence = places["sequence"][k] + later // places["each"][k]
            offset = places["offset"][k] + later % places["each"][k] * length
            names = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, capacity: int = 2048, end: int = 0, coder: Coder | None = None,
                   id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset (and ``ids``) of every piece of every document.

    A document is its text's ids and then ``end``; null and empty texts are ``end`` alone.  Only documents longer than
    ``capacity`` are cut.  Repeated rows are packed as often as they occur; other columns don't count; an empty table
    gives no pieces.  How many sequences there are depends on the lengths alone; which pieces share one also on how
    the table is split into tasks.

    Pieces are numbered within task and length while they are made, and the counts of earlier tasks are added, so no
    piece is sorted and a hot length stays spread over its tasks.  Driver and broadcast hold the plan only, which is
    bounded by ``capacity``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(coder or default_coder())  # a vocabulary: fixed size
    rows = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    fields = T.StructType.fromDDL("piece int, start long, length long, crc long, part int, nth long" + (", ids array<int>" if keep_ids else ""))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *fields])
    made = staged(rows.mapInArrow(_cutter(shared, capacity, end, keep_ids), schema))
    counts = staged(made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    found = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # at most ``capacity`` rows
    places = spark.sparkContext.broadcast(places_of(found))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    added = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("add"))
    numbered = made.join(added, ["part", "length"]).withColumn("number", F.col("nth") + F.col("add")).drop("part", "nth", "add")
    schema = T.StructType([f for f in numbered.schema if f.name != "number"]).add("sequence_id", T.LongType()).add("offset", T.LongType())
    packed = numbered.mapInArrow(_placer(places), schema).withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))
