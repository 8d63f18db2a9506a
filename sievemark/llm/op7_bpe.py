"""BPE encoding and decoding with forced-boundary splitting."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievemark.llm.common import pieces, read_local, table


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    hidden = [c for c in range(256) if c not in shown]
    letters = {c: chr(c) for c in shown} | {c: chr(256 + i) for i, c in enumerate(hidden)}
    return [letters[c] for c in range(256)]


class Bpe:
    """A byte-level BPE with word ends, read from a tokenizer file.

    Two neighbouring symbols that never stand side by side inside a vocabulary token can't be merged over, so a word is
    cut between them, the fragments are encoded by themselves and their ids are concatenated.
    """

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, file: bytes, cached: int = 200_000):
        spec = json.loads(file)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        #: Rank of a pair of ids, packed into one number, and the id each rank gives.
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for i, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.ids[left] << 32 | self.ids[right]] = i
            self.merged.append(self.ids[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        #: Pairs of bytes' letters seen inside a token; the word end belongs to the letter before it.
        self.joined = {t[i:i + 2] for x in self.ids for t in [x.removesuffix(self.end) if self.end else x] for i in range(len(t) - 1)}
        top = max(self.tokens) + 1
        self.coded = [(i.to_bytes(4, "little"), (self.tokens.get(i, "") + " ").encode()) for i in range(top)]
        #: Codes of words and chunks seen lately; the older half goes when the newer is full.
        self.cached, self.words, self.chunks, self.old_words, self.old_chunks = cached, {}, {}, {}, {}
        self.file, self.prepare = file.decode(), None

    def __getstate__(self):
        return self.__dict__ | {"words": {}, "chunks": {}, "old_words": {}, "old_chunks": {}, "prepare": None}

    def forget(self):
        """Give the caches back: a worker outlives its task, and would hold them while other stages need the memory."""
        self.words, self.chunks, self.old_words, self.old_chunks = {}, {}, {}, {}

    def fragments_of(self, word: str) -> list[str]:
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def _merge(self, fragment: str, last: bool) -> list[int]:
        """Ids of a fragment: merge the best-ranked pair, leftmost first, until none is left."""
        parts = [self.ids[c] for c in fragment[:-1]]
        parts.append(self.ids[fragment[-1] + self.end if last else fragment[-1]])
        get, none = self.ranks.get, 1 << 60
        ranks = [get(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            to = self.merged[best]
            if len(ranks) > 200:  # all places of the pair at once, so that a long run takes few rounds
                found, i = [], 0
                while i < len(parts):
                    here = i < len(ranks) and ranks[i] == best
                    found.append(to if here else parts[i])
                    i += 1 + here
                parts = found
                ranks = [get(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
                continue
            i = ranks.index(best)
            parts[i: i + 2] = [to]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(to << 32 | parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | to, none)
        return parts

    def _shown(self, shown: str) -> tuple[bytes, bytes]:
        """Codes of a word in bytes' letters: its ids as bytes, and its tokens, each followed by a space."""
        if (known := self.words.get(shown)) is not None:
            return known
        if (known := self.old_words.get(shown)) is None:
            parts = self.fragments_of(shown)
            ids = [i for k, part in enumerate(parts) for i in self._merge(part, k + 1 == len(parts))]
            known = b"".join([self.coded[i][0] for i in ids]), b"".join([self.coded[i][1] for i in ids])
        if len(shown) <= 64:
            if len(self.words) >= self.cached:
                self.words, self.old_words = {}, self.words
            self.words[shown] = known
        return known

    def _words(self, chunk: str) -> list[str]:
        """Words, in bytes' letters, of a text without white space at its ends: compose, lower-case each letter, split.

        Latin letters are composed already.  Rarer letters depend on the Unicode version, so the tokenizer file's own
        normaliser and word splitter prepare them.
        """
        if chunk.isascii():
            return [x if x.isalnum() else "".join([self.letters[c] for c in x.encode()]) for x in self.WORDS.findall(chunk.lower())]
        if max(chunk) < "\u0250":
            return ["".join([self.letters[c] for c in x.encode()]) for x in self.WORDS.findall("".join(map(str.lower, chunk)))]
        if self.prepare is None:
            self.prepare = Tokenizer.from_str(self.file)
        return [x for x, _ in self.prepare.pre_tokenizer.pre_tokenize_str(self.prepare.normalizer.normalize_str(chunk))]

    def _coded(self, chunk: str) -> tuple[bytes, bytes]:
        if (known := self.old_chunks.get(chunk)) is None:
            parts = [self._shown(x) for x in self._words(chunk)]
            known = parts[0] if len(parts) == 1 else (b"".join([x[0] for x in parts]), b"".join([x[1] for x in parts]))
        if len(chunk) <= 64:
            if len(self.chunks) >= self.cached:
                self.chunks, self.old_chunks = {}, self.chunks
            self.chunks[chunk] = known
        return known

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the decoded text in UTF-8."""
        parts = [text]
        if self.cut_special and any(s in text for s in self.special):
            parts = self.cut_special.split(text)
        ids, tokens = [], []
        for part in parts:
            if part in self.special:
                found = [(self.special[part].to_bytes(4, "little"), part.encode() + b" ")]
            else:
                found = [self.chunks.get(c) or self._coded(c) for c in part.replace("\n", " ").split(" ") if c]
            ids += [x[0] for x in found]
            tokens += [x[1] for x in found]
        return b"".join(ids), b"".join(tokens)[:-1]

    def ids_of(self, text: str) -> list[int]:
        data = self.encode(text)[0]
        return [int.from_bytes(data[i:i + 4], "little") for i in range(0, len(data), 4)]

    def decode(self, ids: list[int]) -> str:
        """Tokens with a space between them: the tokenizer file names no decoder; unknown ids give nothing."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _coder(shared, digests: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            for part in pieces(batch):
                coded = [bpe.encode(t or "") for t in part["_text"].to_pylist()]
                n = pa.array([len(ids) // 4 for ids, _ in coded], pa.int64())
                if digests:
                    rest = [pa.array([hashlib.sha256(x[k]).hexdigest() for x in coded], pa.string()) for k in (0, 1)]
                else:
                    lists = pa.ListArray.from_arrays(
                        pa.array([0, *accumulate(len(ids) // 4 for ids, _ in coded)], pa.int32()),
                        pa.Array.from_buffers(pa.uint32(), sum(len(ids) // 4 for ids, _ in coded), [None, pa.py_buffer(b"".join(ids for ids, _ in coded))]).cast(pa.int32()))
                    rest = [lists, pa.array([text.decode() for _, text in coded], pa.string())]
                yield pa.RecordBatch.from_arrays([part["_row"], n, *rest], names=["_row", "n_tokens", "ids", "decoded"])
        bpe.forget()
        pa.default_memory_pool().release_unused()

    return code


def _coded(source: DataFrame, file: str | None, digests: bool) -> DataFrame:
    bpe = source.sparkSession.sparkContext.broadcast(Bpe(read_local(file or default_vocabulary())))  # a vocabulary: fixed size
    ids = "string" if digests else "array<int>"
    schema = source.select("_row", F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast(ids).alias("ids"), F.lit("").alias("decoded")).schema
    return source.mapInArrow(_coder(bpe, digests), schema)


def encode_documents(docs: DataFrame, file: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document.

    Null and empty texts have no tokens and decode to an empty text.  ``file`` is the tokenizer file; the driver reads
    it and sends it to the executors.  Repeated rows are coded as often as they occur; extra columns are left out.
    """
    coded = _coded(docs.select(docs[id].alias("_row"), docs[text].alias("_text")), file, False)
    return coded.withColumnRenamed("_row", "doc_id")


def token_digests(docs: DataFrame, file: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, without writing ids or texts."""
    coded = _coded(docs.select(docs[id].alias("_row"), docs[text].alias("_text")), file, True)
    return coded.withColumnsRenamed({"_row": "doc_id", "ids": "ids_sha256", "decoded": "decoded_sha256"})


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(table(spark, folder, "documents"))
