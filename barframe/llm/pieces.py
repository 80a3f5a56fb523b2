"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text becomes the model's alphabet: one dummy blank before it, every space a "▁" (U+2581). No piece
holds a "▁" after another character, so the lattice of pieces falls apart into units, runs of "▁" with
the characters up to the next one, and the units of a text are sampled independently. Per unit,
forward filtering sums the weights of all segmentations of each beginning, from left to right;
backward sampling draws the last piece in proportion to forward weight times piece weight, then the
one before it, down to the start. A character that no piece covers passes as its UTF-8 byte pieces.
Piece weights follow their merge rank, (rank + 2) ** -alpha.

The draws of a text come from a counter-based hash of (row key, unit, step): the same key and text
give the same pieces on any partitioning and in any rerun. Decoding joins the pieces' bytes, turns
"▁" into a space and takes the dummy blank away. It gives back every text without U+2581 itself;
that character is spelled in byte pieces, so it survives too.

Everything is array work over the distinct units of a batch, a bounded piece of text at a time.

Defined cases: a null text is an empty one and has no pieces; a null key counts as its own key;
repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.workers import lean

ALPHA = 1.0
BLANK = "▁"
CHARS = 500_000  # of text whose lattice is held at once
RESCALE = 16
_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
OWN_BLANK = "\ud800"  # stands for a U+2581 of the text itself; no valid text holds a lone surrogate


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Vocabulary:
    """Pieces as hashes of their code points, with weights and bytes."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        texts = [sp.id_to_piece(i) for i in plain]
        assert not any(BLANK in t.lstrip(BLANK) for t in texts), "a piece reaches over a word start"
        self.longest = max(map(len, texts))
        self.byte_id = np.zeros(256, dtype=np.int32)
        known = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:-1], 16)
                self.byte_id[b] = i
                known[i] = bytes([b])
        for i, t in zip(plain, texts, strict=True):
            known[i] = t.replace(BLANK, " ").encode()
        self.flat = np.frombuffer(b"".join(known), dtype=np.uint8)
        self.width = np.array([len(k) for k in known], dtype=np.int64)
        self.offset = np.cumsum(self.width) - self.width
        rank = np.maximum(-np.array([min(0.0, sp.get_score(i)) for i in plain]), 0.0)
        rank = np.where(rank > n, float(n), rank)  # pieces outside the merge order come last
        self.ids = np.array(plain, dtype=np.int32)
        self.weight = np.append((rank + 2.0) ** -alpha, (n + 2.0) ** -alpha)  # the last: a byte piece
        # Every beginning of a piece by its hash, and the piece that it is, or -1.
        place = {t: k for k, t in enumerate(texts)}
        heads = sorted({t[:k] for t in texts for k in range(1, len(t) + 1)})
        hashes = np.array([self._of(t) for t in heads], dtype=_U)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.whole = np.array([place.get(t, -1) for t in heads], dtype=np.int32)[order]
        assert (self.hashes[1:] != self.hashes[:-1]).all()
        self.bits = 18  # of a direct table: leading bits -> first place in `hashes`
        top = (self.hashes >> _U(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max())

    def _of(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
        return int(mixed(np.array([h], dtype=_U))[0])

    def lookup(self, raw: np.ndarray) -> np.ndarray:
        """The place of each substring hash, or -1."""
        h = mixed(raw)
        slot = (h >> _U(64 - self.bits)).astype(np.int64)
        at, end = self.first[slot].astype(np.int64), self.first[slot + 1]
        found = np.full(len(h), -1, dtype=np.int32)
        live = np.flatnonzero(at < end)
        for _ in range(self.deepest):
            same = self.hashes[at[live]] == h[live]
            found[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return found


@lru_cache(maxsize=4)
def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattices:
    """The lattices of distinct units, forward-filtered. Node (unit, j) has the edges that end at j."""

    def __init__(self, units: list[str], voc: Vocabulary):
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        n = len(points)
        unit = np.repeat(np.arange(len(units)), sizes)
        place = np.arange(n) - self.offset[unit]  # of the character in its unit
        codes = points.astype(_U) + _U(1)
        left = np.repeat(sizes, sizes) - place  # characters up to the end of the unit
        at = np.arange(n)
        rolling = np.zeros(n, dtype=_U)
        nth = np.zeros(n, dtype=np.int32)  # edges found so far by end
        found = []
        for size in range(1, voc.longest + 1):
            if size > 1:  # go on where the characters so far begin a piece
                keep = left[at] >= size
                at, rolling = at[keep], rolling[keep]
            if not len(at):
                break
            rolling = rolling * BASE + codes[at + (size - 1)]
            head = voc.lookup(rolling)
            live = np.flatnonzero(head >= 0)
            at, rolling, piece = at[live], rolling[live], voc.whole[head[live]]
            hit = np.flatnonzero(piece >= 0)
            end, piece = at[hit] + (size - 1), piece[hit]
            if size == 1:  # a character without a piece of its own gets a byte edge
                bare = np.ones(n, dtype=bool)
                bare[end] = False
                bare = np.flatnonzero(bare)
                end = np.concatenate([end, bare])
                piece = np.concatenate([piece, np.full(len(bare), -1, dtype=np.int32)])
            found.append((end, nth[end], piece, size))
            nth[end] += 1
        self.first_edge = np.concatenate([[0], np.cumsum(nth)])
        count = int(self.first_edge[-1])
        self.end = np.empty(count, dtype=np.int32)
        self.start = np.empty(count, dtype=np.int32)
        self.piece = np.empty(count, dtype=np.int32)
        for end, number, piece, size in found:  # every edge straight to its place in order of end
            to = self.first_edge[end] + number
            self.end[to], self.start[to], self.piece[to] = end, end - (size - 1), piece
        weight = voc.weight[self.piece]  # place -1: one byte piece
        wide = np.flatnonzero(self.piece < 0)
        if len(wide):
            code = points[self.end[wide]]
            weight[wide] **= 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        self.points = points
        # Forward filtering by place in the unit, all units at once. `upto` of an edge is the share of
        # its node's weight that it and the node's earlier edges have.
        forward = np.ones(n + 1)  # of the beginnings that end at a character; n stands for the start
        self.upto = np.empty(count, dtype=np.float32)
        depth = place[self.end].astype(np.int16 if n == 0 or place.max() < 32767 else np.int64)
        by_place = np.argsort(depth, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(depth))]) if count else np.zeros(1, dtype=np.int64)
        came = np.where(place[self.start] == 0, n, self.start - 1)
        for j in range(len(bounds) - 1):
            edges = by_place[bounds[j]:bounds[j + 1]]  # in order of end
            own = weight[edges] * forward[came[edges]]
            at = self.end[edges]
            head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            total, size = np.add.reduceat(own, head), np.diff(np.append(head, len(at)))
            forward[at[head]] = total
            run = np.cumsum(own / np.repeat(total, size))  # of shares, so that nodes do not blur each other
            self.upto[edges] = run - np.repeat(np.arange(len(head)), size)
            if j >= voc.longest - 1 and j % RESCALE == 0:  # only ratios matter: keep long units near 1
                for back in range(voc.longest):
                    forward[at[head] - back] /= total

    def sample(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of every occurrence. Returns (occurrence, edge) in text order."""
        floor = self.offset[unit]
        at = self.offset[unit + 1] - 1
        live = np.flatnonzero(at >= floor)
        who, what = [], []
        step = 0
        while len(live):
            node = at[live]
            u = (mixed(seed[live] + _U(step * int(BASE) & (2**64 - 1))) >> _U(11)).astype(np.float64) * 2.0**-53
            lo, hi = self.first_edge[node].astype(np.int64), self.first_edge[node + 1].astype(np.int64) - 1
            open_ = np.flatnonzero(lo < hi)
            while len(open_):  # the first edge whose cumulative share exceeds u
                over = self.upto[lo[open_]] <= u[open_]
                lo[open_[over]] += 1
                open_ = open_[over]
                open_ = open_[lo[open_] < hi[open_]]
            who.append(live)
            what.append(lo)
            at[live] = self.start[lo] - 1
            live = live[at[live] >= floor[live]]
            step += 1
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who_all, what_all = np.concatenate(who)[::-1], np.concatenate(what)[::-1]
        order = np.argsort(who_all, kind="stable")
        return who_all[order], what_all[order]


def units_of(text: str) -> list[str]:
    """Runs of blanks with the characters up to the next blank; the first has the dummy blank."""
    text = text.replace(BLANK, OWN_BLANK)
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return (BLANK + text.replace(" ", " " + BLANK)).split(" ")
    units, blanks = [], 1
    for w in text.split(" "):
        if w:
            units.append(BLANK * blanks + w)
            blanks = 1
        else:
            blanks += 1
    if blanks > 1:
        units.append(BLANK * (blanks - 1))
    return units


def encode_batch(keys: np.ndarray, texts: list[str], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The sampled ids of all texts in a row, and how many each text has; keys are 64-bit numbers of
    the rows. Callers pass about CHARS characters at once."""
    lists = [units_of(t) if t else [] for t in texts]
    counts = np.array([len(x) for x in lists])
    flat = [u for x in lists for u in x]
    if not flat:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    if any(BLANK in t for t in texts):  # pandas cannot tell lone surrogates apart
        number: dict[str, int] = {}
        codes, distinct = np.array([number.setdefault(u, len(number)) for u in flat]), list(number)
    else:
        codes, distinct = pd.factorize(np.array(flat, dtype=object))
    del lists, flat
    own = Lattices(list(distinct), voc)
    row = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    who, edge = own.sample(codes, mixed(mixed(keys.astype(_U))[row] + within.astype(_U) * BASE))
    place = own.piece[edge]
    ids = voc.ids[place]
    bare = np.flatnonzero(place < 0)
    if len(bare):  # spell in bytes
        chars = [chr(c) for c in own.points[own.end[edge[bare]]]]
        spelled = [list((BLANK if c == OWN_BLANK else c).encode("utf-8", "surrogatepass")) for c in chars]
        width = np.ones(len(ids), dtype=np.int64)
        width[bare] = [len(b) for b in spelled]
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), dtype=np.int32)
        out[at[place >= 0]] = ids[place >= 0]
        where = np.concatenate([np.arange(a, a + len(b)) for a, b in zip(at[bare], spelled, strict=True)])
        out[where] = voc.byte_id[np.concatenate(spelled)]
        who, ids = np.repeat(who, width), out
    return ids, np.bincount(row[who], minlength=len(texts))


def decode_batch(ids: np.ndarray, sizes: np.ndarray, voc: Vocabulary) -> list[bytes]:
    """The UTF-8 texts of consecutive runs of ids: the pieces' bytes without the dummy blank."""
    width = voc.width[ids]
    upto = np.concatenate([[0], np.cumsum(width)])
    raw = voc.flat[np.arange(int(upto[-1])) + np.repeat(voc.offset[ids] - upto[:-1], width)].tobytes()
    ends = upto[np.cumsum(sizes)].tolist()
    return [raw[a + 1:b] if b > a else b"" for a, b in zip([0, *ends], ends)]


def parts(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices of about `most`, of one row at least."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield slice(first, i)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def encode(docs: DataFrame, path: str, alpha: float = ALPHA, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, lossless) of every row; the id seeds the draws. lossless: decoding
    the ids gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path, alpha)
        for b in batches:
            lengths = pc.utf8_length(b.column("text")).to_pylist()
            for part in parts(lengths, CHARS):
                rows = b.slice(part.start, part.stop - part.start)
                texts = rows.column("text").to_pylist()
                ids, sizes = encode_batch(rows.column("seed").to_numpy().view(_U), texts, voc)
                same = [a == t.encode() for a, t in zip(decode_batch(ids, sizes, voc), texts, strict=True)]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(same)],
                    names=["doc_id", "ids", "lossless"],
                )

    rows = docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(key).alias("seed"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    shape = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])
    return rows.mapInArrow(lean(run), shape)


def decode(ids: Column, path: str) -> Column:
    """The text of an array<int> of piece ids."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voc = vocabulary(path)
        for b in batches:
            out: list[str] = []
            for part in parts([len(x) for x in b], CHARS):
                rows = [np.asarray(x, dtype=np.int32) for x in b.iloc[part]]
                texts = decode_batch(np.concatenate(rows), np.array([len(x) for x in rows]), voc)
                out += [t.decode("utf-8", "replace") for t in texts]
            yield pd.Series(out, index=b.index, dtype=object)

    return run(ids)


def sampled_pieces(docs: DataFrame, path: str, alpha: float = ALPHA, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_pieces, and whether decoding gives the text back."""
    made = encode(docs, path, alpha, key, text)
    return made.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "lossless")
