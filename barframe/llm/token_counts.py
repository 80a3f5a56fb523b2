"""Token counts with overlap resynchronisation for huge documents.

A text longer than a chunk is encoded in overlapping chunks with offsets. Two neighbours are spliced
at a common boundary that is proven stable: inside the overlap there are two places where a single
space stands between non-space characters, and from the first to the second both encodings hold the
same tokens at the same offsets. No word, normal form or special string of these vocabularies
reaches over such a space, so what either chunk saw beyond it cannot matter. If an overlap has no
such pair the left chunk grows, and the overlap with it, until one is found or the text ends.

Defined cases: a null text is an empty one and has 0 tokens; rows may repeat; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 65536, 512
BATCH_CHARS = 1_000_000  # of short texts encoded at once


class Encoder:
    """A tokenizer file, and the same without its normaliser for texts that are normalised already.

    The normaliser of these files may compose characters (NFC), turn runs of white space into a
    space and lower-case. Latin-1 text is composed, its lower case has no context, and where the
    splitter drops white space its kind cannot matter: such text is lower-cased by Python, and the
    costly bookkeeping of the normaliser is left out. A text with "<|" keeps the normaliser, as
    special strings are looked for before it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full, self.bare = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full.no_truncation()
        self.full.no_padding()
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        if kinds == ["NFC", "Replace", "Lowercase"] and splits.get("behavior") == "Removed" and splits.get("invert"):
            self.bare = Tokenizer.from_file(path)
            self.bare.no_truncation()
            self.bare.no_padding()
            self.bare.normalizer = None

    def plain(self, text: str) -> bool:
        if self.bare is None or "<|" in text:
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, text: str):
        if self.plain(text):
            return self.bare.encode(text.lower(), add_special_tokens=False)
        return self.full.encode(text, add_special_tokens=False)

    def sizes(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        plain = [self.plain(t) for t in texts]
        for tok, lower, own in ((self.bare, True, True), (self.full, False, False)):
            at = [i for i, p in enumerate(plain) if p is own]
            if at:
                got = tok.encode_batch_fast([texts[i].lower() if lower else texts[i] for i in at], add_special_tokens=False)
                for i, e in zip(at, got, strict=True):
                    out[i] = len(e)
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Encoder:
    return Encoder(path)


def _between(text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """The first and the last lone space between non-space characters in text[lo:hi]."""
    first = last = -1
    at = text.find(" ", lo, hi)
    while at >= 0:
        if 0 < at < len(text) - 1 and not text[at - 1].isspace() and not text[at + 1].isspace():
            first, last = (at if first < 0 else first), at
        at = text.find(" ", at + 1, hi)
    return (first, last) if first < last else None


def _encode(tok, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    got = tok.encode(text[start:end])
    return [(i, a + start, b + start) for i, (a, b) in zip(got.ids, got.offsets, strict=True)]


def spliced(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of the whole text, from chunks of about `chunk` characters."""
    n, start, taken = len(text), 0, 0
    ids: list[int] = []
    end = min(n, chunk)
    left = _encode(tok, text, start, end)
    while end < n:
        width = overlap
        while True:
            begin = max(taken + 1, end - width)
            span, right = _between(text, begin, end), None
            stop = min(n, begin + max(chunk, 2 * width))
            if span and stop > end:
                right = _encode(tok, text, begin, stop)
                a, b = span
                if [x for x in left if a <= x[1] and x[2] <= b] != [x for x in right if a <= x[1] and x[2] <= b]:
                    right = None
            if right is not None:
                break
            width *= 2  # no agreement: widen the overlap by more text for the left chunk
            end = min(n, end + width)
            left = _encode(tok, text, start, end)
            if end == n:
                break
        if right is None:
            break
        ids += [x[0] for x in left if taken <= x[1] and x[2] <= b]
        left = [x for x in right if x[1] >= b]
        taken, start, end = b, begin, stop
    return ids + [x[0] for x in left if x[1] >= taken]


def counts_of(tok, texts: list[str], chunk: int, overlap: int) -> list[int]:
    out = [0] * len(texts)
    waiting: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for i, n in zip(waiting, tok.sizes([texts[i] for i in waiting]), strict=True):
            out[i] = n
        waiting.clear()
        held = 0

    for i, text in enumerate(texts):
        if len(text) > chunk:
            out[i] = len(spliced(tok, text, chunk, overlap))
            continue
        waiting.append(i)
        held += len(text)
        if held > BATCH_CHARS:
            flush()
    if waiting:
        flush()
    return out


def token_count(text: Column, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Tokens of a string column by the vocabulary file at `path`, which every executor can read."""
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer(path)
        for batch in batches:
            yield pd.Series(counts_of(tok, batch.tolist(), chunk, overlap), dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def token_counts(
    docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"),
        token_count(F.col(text), path, chunk, overlap).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
