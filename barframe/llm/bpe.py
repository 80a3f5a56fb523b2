"""Byte-level BPE encoding and decoding.

Text is cut into words by the pattern of the vocabulary. A word's bytes are a doubly linked list of
symbols; a priority queue holds the rank and place of every neighbouring pair that can merge. The
pair of the smallest rank, then the leftmost, merges; an entry whose pair has changed since it was
queued is stale and skipped. Words repeat, so every Python worker remembers up to WORDS of them.
Decoding concatenates the vocabulary's strings.

A long text is worked on in slices, cut before white space that follows other characters: no word
reaches over such a place, and no pattern looks back over it.

Defined cases: a null text is an empty one, without tokens; the vocabulary's special strings inside a
text become their token; rows may repeat; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARS = 1_000_000  # of a slice, and of the texts held at once
WORDS = 1 << 20  # words remembered in a worker
LONG = 64  # bytes of a word that is not remembered
PLACE = (1 << 32) - 1
NONE = -(1 << 60)  # what stands after the last symbol

# The pattern of byte-level vocabularies, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in a vocabulary file: visible Latin-1 characters stand
    for themselves, the others follow from 256 on."""
    visible = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in visible else next(others)) for b in range(256)]


class Words(dict):
    """word -> its ids as packed 32-bit integers, computed when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        ids = array("i", self.vocabulary.merged(raw)).tobytes()
        if len(raw) <= LONG and len(self) < WORDS:
            self[word] = ids
        return ids


class Vocabulary:
    """Merge ranks and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec["pre_tokenizer"]
        plain = not spec.get("normalizer") and splitter["type"] == "ByteLevel" and not splitter["add_prefix_space"]
        if model["type"] != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens with context are not supported")
        vocab = model["vocab"]
        letters = byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        of_letter = {c: bytes([b]) for b, c in enumerate(letters)}
        self.token: dict[int, bytes] = {}
        for text, i in [*vocab.items(), *((t["content"], t["id"]) for t in added)]:
            known = all(c in of_letter for c in text)
            self.token[i] = b"".join(of_letter[c] for c in text) if known else text.encode()
        self.size = max(self.token) + 1
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[left] * self.size + vocab[right], rank)
            self.made.append(vocab[left + right])
        self.special = {t["content"]: array("i", [t["id"]]).tobytes() for t in added if t["content"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.words = Words(self)
        self.pattern = regex.compile(PATTERN)

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word after all merges."""
        ids = list(map(self.byte_ids.__getitem__, word))
        n, size, rank_of, made = len(ids), self.size, self.ranks.get, self.made
        queue = []
        left = 0
        for at, x in enumerate(ids, -1):
            rank = rank_of(left + x)
            if rank is not None and at >= 0:
                queue.append(rank << 32 | at)
            left = x * size
        heapify(queue)
        # The links of the list; -1 marks a symbol that went into its left neighbour. Beyond the
        # last symbol and before the first stands one more, which is in no pair.
        links = list if n <= LONG else lambda places: array("q", places)
        after, before = links(range(1, n + 1)), links(range(-1, n))
        ids.append(NONE)
        while queue:
            entry = heappop(queue)
            at = entry & PLACE
            x = ids[at]
            if x < 0:
                continue  # stale: merged into the left
            right = after[at]
            rank = entry >> 32
            if rank_of(x * size + ids[right]) != rank:
                continue  # stale: another pair stands here
            ids[at] = x = made[rank]
            ids[right] = -1
            after[at] = follows = after[right]
            before[follows] = at
            new = rank_of(x * size + ids[follows])
            if new is not None:
                heappush(queue, new << 32 | at)
            leads = before[at]
            if leads >= 0:
                new = rank_of(ids[leads] * size + x)
                if new is not None:
                    heappush(queue, new << 32 | leads)
        ids.pop()
        return [i for i in ids if i >= 0]

    def encode(self, text: str, chars: int = CHARS) -> bytes:
        """The ids of a text as packed 32-bit integers."""
        if self.specials is not None and any(s in text for s in self.special):
            parts = self.specials.split(text)
        else:
            parts = [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
                continue
            for piece in slices(part, chars):
                out.append(b"".join(map(self.words.__getitem__, self.pattern.findall(piece))))
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


BREAK = regex.compile(r"(?<=\S)\s")


def slices(text: str, chars: int) -> Iterator[str]:
    """The text in slices of about `chars` characters that no word spans."""
    start = 0
    while len(text) - start > chars:
        cut = BREAK.search(text, start + chars)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about `most` in all, one at least."""
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if sizes:
        yield first, len(sizes)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every row by the vocabulary file at `path`, which every executor
    can read; with `decoded` also the text that the ids give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            sizes = pc.binary_length(b.column("text")).to_pylist()
            for first, last in groups(sizes, CHARS):
                rows = b.slice(first, last - first)
                packed = [voc.encode(t) for t in rows.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                ids = np.frombuffer(b"".join(packed), dtype=np.int32)
                out = [rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))]
                if decoded:
                    texts = [voc.decode(ids[x:y].tolist()) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    out.append(pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fields = [rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    names = [f.name for f in fields]
    return rows.mapInArrow(run, T.StructType(fields))


def decode(ids: Column, path: str) -> Column:
    """The text of an array<int> of ids; bytes that are no UTF-8 become replacement characters. A
    null array gives null; an id outside the vocabulary is left out, as the library does."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        voc = vocabulary(path)
        for b in batches:
            lists = (x.as_py() for x in b)
            raw = (None if x is None else voc.decode([i for i in x if i in voc.token]) for x in lists)
            yield pa.array([None if r is None else r.decode("utf-8", "replace") for r in raw], pa.string())

    return run(ids)


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode(..., decoded=True)."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
