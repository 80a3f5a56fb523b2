"""Groups of spelling variants by pivotal grams.

Bigrams of a word are ranked rare first, by the number of words' places that hold them. A word's
prefix is its three rarest places, and as many further places of the third's bigram as an edit could
bring among them. One edit cannot touch two disjoint bigrams, so two disjoint ones of the three
places, the pivots, are chosen by dynamic programming: the pair of least total frequency. If two words are one edit apart, a pivot of the
one whose prefix ends first stands in the prefix of the other, at most one place aside, and moved or
not as their lengths tell: five keys (bigram, length, place) a pivot. Pivots meet the prefixes of
their key; a pair must differ in at most two bits of a signature (letters that occur, letters that occur
twice), and then in exactly one edit. A task streams the pivots of a key past its prefixes; a key with
many words is split into a grid of cells of bounded size.

A word's form is its most frequent near word if that is at least RATIO times as frequent; roots
follow forms by pointer jumping. Along forms the count grows by RATIO, so chains are short.

Defined cases: null texts have no words; a null id of a document is an empty one; rows may repeat and
count as often as they stand; an empty table gives an empty result; distinct
words of fewer than four code points are refused with a ValueError; ties go to the smallest word in
code-point order; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.session import written

LETTERS = "a-zÀ-ÿ"
LEAST, TIMES, RATIO = 7, 2, 10  # code points of a word, its occurrences, counts of form and word
SHORTEST = 4  # three bigrams, so that two are disjoint
SLOTS = 1 << 16  # of bigrams; exact for Latin-1, beyond it bigrams share a slot
PREFIX = 3  # rarest places: bigram size x edits + 1
# Of the bigram that ends a prefix, five places are kept: a pivot is among the first three of its bigram,
# and one edit makes two new bigrams at most. With up to two rarer places that is so many in all.
REACH = PREFIX + 2 + PREFIX - 1
# (length, place) of a near word's bigram against the pivot's own.
MOVES = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CELL = 1 << 18  # code points of the prefixes, and of the pivots, that meet in one cell
PAIRS = 1 << 22  # compared at once
ENTRY = "key long, pivot boolean, word string, n long, mask long, ends int"


def runs(docs: DataFrame, least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run): maximal runs of letters of at least `least` code points, A-Z in lower case."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    found = F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(F.col(key).alias("doc_id"), F.explode(found).alias("run"))


def dropped_letter(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run, or where its checksum with the id is divisible by `every`, the run without one letter."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, without).otherwise(run)


def word_counts(words: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(word, n) of the column `word`."""
    counted = words.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= times)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points as rows) of the words of each length."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        flat = "".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass")
        yield at, np.frombuffer(flat, np.uint32).reshape(len(at), n).astype(np.int64)


def bigrams(points: np.ndarray) -> np.ndarray:
    return (points[:, :-1] * 256 + points[:, 1:]) % SLOTS


def signature(points: np.ndarray) -> np.ndarray:
    """Per word 32 bits for letters that occur and 32 for those that occur twice: changing how often
    one letter occurs by one moves one bit at most."""
    letter = points % 32
    out = np.zeros(len(points), dtype=np.uint64)
    for c in range(32):
        times = (letter == c).sum(axis=1)
        out |= (times >= 1).astype(np.uint64) << np.uint64(c)
        out |= (times >= 2).astype(np.uint64) << np.uint64(32 + c)
    return out.view(np.int64)


def pivots(place: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row two of its places (ascending) at least two apart of least total cost, by dynamic
    programming: the best single place up to each one, and on it the best pair that ends there."""
    n, m = place.shape
    rows = np.arange(n)
    upto = [np.zeros(n, dtype=np.int64)]  # index of the best of the places so far
    best, first, second = np.full(n, np.inf), upto[0], upto[0]
    for j in range(1, m):
        clear = place[:, j] - place[:, j - 1] >= 2  # else only places before the last can be disjoint
        single = np.where(clear, upto[j - 1], upto[max(j - 2, 0)])
        total = np.where(clear | (j > 1), cost[rows, single] + cost[:, j], np.inf)
        better = total < best
        best, first, second = np.where(better, total, best), np.where(better, single, first), np.where(better, j, second)
        upto.append(np.where(cost[:, j] < cost[rows, upto[j - 1]], j, upto[j - 1]))
    return place[rows, first], place[rows, second]


def keyed(slot: np.ndarray, length: int, place: np.ndarray) -> np.ndarray:
    """One number of bigram, length and place; a clash only adds a candidate."""
    k = slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(length)
    return (k * np.uint64(0xC2B2AE3D27D4EB4F) + place.astype(np.uint64)).view(np.int64)


def bigram_places(words: DataFrame) -> np.ndarray:
    """How often each slot occurs in the words; at most SLOTS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            for _, points in by_length(b.column("word").to_pylist()):
                total += np.bincount(bigrams(points).ravel(), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "places"])

    found = words.select("word").mapInArrow(run, "slot long, places long").groupBy("slot").agg(F.sum("places").alias("places"))
    places = np.zeros(SLOTS, dtype=np.int64)
    for r in found.collect():
        places[r["slot"]] = r["places"]
    return places


def entries(words: DataFrame, places: np.ndarray) -> DataFrame:
    """A row for each place of each prefix, and for each key of each pivot."""
    order = np.empty(SLOTS, dtype=np.int32)
    order[np.lexsort((np.arange(SLOTS), places))] = np.arange(SLOTS, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, points in by_length(b.column("word").to_pylist()):
                slot, length = bigrams(points), points.shape[1]
                if length < SHORTEST:
                    raise ValueError(f"words of fewer than {SHORTEST} code points have no two disjoint bigrams")
                rank, every = order[slot], np.arange(len(at))
                rare = np.argsort(rank, axis=1, kind="stable")[:, :REACH]
                ends = rank[every, rare[:, PREFIX - 1]]
                row, nth = np.nonzero(rank[every[:, None], rare] <= ends[:, None])
                place = rare[row, nth]
                keys, rows, pivot = [keyed(slot[row, place], length, place)], [row], [np.zeros(len(row), dtype=bool)]
                own = np.sort(rare[:, :PREFIX], axis=1)
                for p in pivots(own, places[slot[every[:, None], own]].astype(np.float64)):
                    for longer, aside in MOVES:
                        keys.append(keyed(slot[every, p], length + longer, p + aside))
                        rows.append(every)
                        pivot.append(np.ones(len(at), dtype=bool))
                rows = np.concatenate(rows)
                take = pa.array(at[rows])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys)), pa.array(np.concatenate(pivot)), b.column("word").take(take),
                    b.column("n").take(take), pa.array(signature(points)[rows]), pa.array(ends[rows].astype(np.int32)),
                ], names=[c.split()[0] for c in ENTRY.split(", ")])

    return words.select("word", "n").mapInArrow(run, ENTRY)


class Held:
    """Words of one cell: counts, signatures, ends of prefixes and code points, by ends."""

    def __init__(self, words: pa.Array, n: np.ndarray, mask: np.ndarray, ends: np.ndarray):
        order = np.argsort(ends, kind="stable")
        self.words, self.n, self.mask, self.ends = words.take(pa.array(order)), n[order], mask[order].view(np.uint64), ends[order]
        texts = self.words.to_pylist()
        self.sizes = np.array([len(w) for w in texts])
        self.points = np.array(texts, dtype=f"U{self.sizes.max() + 1}").view(np.uint32).reshape(len(texts), -1)

    def widened(self, width: int) -> np.ndarray:
        return np.pad(self.points, ((0, 0), (0, width - self.points.shape[1])))


def one_edit(long: np.ndarray, short: np.ndarray, sizes: np.ndarray, inserted: np.ndarray) -> np.ndarray:
    """Row by row (zeros fill up, at least one): whether exactly one code point is replaced, or where
    `inserted`, is in `long` but not in `short`. sizes: of `short`."""
    rows, width = np.arange(len(sizes)), long.shape[1]
    same = long == short
    replaced = (~same).sum(axis=1) == 1
    same[:, -1] = False
    head = np.argmin(same, axis=1)  # the first difference
    moved = long[:, 1:] == short[:, :-1]
    moved &= np.arange(width - 1) < sizes[:, None]
    last = np.cumsum(moved, axis=1)[:, -1] - np.where(head > 0, np.cumsum(moved, axis=1)[rows, np.maximum(head - 1, 0)], 0)
    return np.where(inserted, last >= sizes - head, replaced)


def close_pairs(pivot: Held, prefix: Held) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words one edit apart, where the pivot's prefix does not end after the other's."""
    width = max(pivot.points.shape[1], prefix.points.shape[1])
    own, other = pivot.widened(width), prefix.widened(width)
    step = max(1, PAIRS // len(prefix.ends))
    for at in range(0, len(pivot.ends), step):
        begin = int(np.searchsorted(prefix.ends, pivot.ends[at], "left"))
        part = slice(at, at + step)
        differ = np.bitwise_count(pivot.mask[part, None] ^ prefix.mask[None, begin:])
        i, j = np.nonzero(differ <= 2)
        i, j = i + at, j + begin
        fits = (pivot.ends[i] <= prefix.ends[j]) & (np.abs(pivot.sizes[i] - prefix.sizes[j]) <= 1)
        i, j = i[fits], j[fits]
        for x in range(0, len(i), PAIRS // width + 1):
            p, q = i[x:x + PAIRS // width + 1], j[x:x + PAIRS // width + 1]
            swap = (pivot.sizes[p] < prefix.sizes[q])[:, None]
            long, short = np.where(swap, other[q], own[p]), np.where(swap, own[p], other[q])
            sizes = np.minimum(pivot.sizes[p], prefix.sizes[q])
            near = one_edit(long, short, sizes, pivot.sizes[p] != prefix.sizes[q])
            yield p[near], q[near]


def celled(keys: DataFrame) -> DataFrame:
    """Entries with their cell (key, i, j). A key whose prefixes or pivots hold more than CELL code
    points is split: prefixes are dealt to i and copied for each j, pivots the other way round."""
    size = F.sum(F.when(F.col("pivot"), F.length("word")).otherwise(0)), F.sum(F.when(F.col("pivot"), 0).otherwise(F.length("word")))
    big = keys.groupBy("key").agg(size[0].alias("pivots"), size[1].alias("prefixes")).filter(f"greatest(pivots, prefixes) > {CELL} AND least(pivots, prefixes) > 0")
    big = written(big.select(
        F.col("key").alias("_key"), F.ceil(F.col("prefixes") / CELL).alias("rows"), F.ceil(F.col("pivots") / CELL).alias("columns"),
    ), "spelling-big-keys")
    known = keys.join(big, F.col("key") == F.col("_key"), "left")
    rows, columns = F.coalesce("rows", F.lit(1)), F.coalesce("columns", F.lit(1))
    deal = F.xxhash64("word")
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    known = known.withColumn("i", F.explode(F.when(F.col("pivot"), every(rows)).otherwise(F.array(F.pmod(deal, rows)))))
    known = known.withColumn("j", F.explode(F.when(F.col("pivot"), F.array(F.pmod(deal, columns))).otherwise(every(columns))))
    return known.select("key", "i", "j", "pivot", "word", "n", "mask", "ends")


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, n, other_n) of all words one edit apart, both ways. `words`: distinct `word` of at
    least SHORTEST code points, and n."""
    keys = written(entries(words, bigram_places(words)), "spelling-keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, prefix = None, [], None
        for b in batches:
            at = np.column_stack([b.column(c).to_numpy() for c in ("key", "i", "j")])
            flag = b.column("pivot").to_numpy(zero_copy_only=False)
            numbers = [b.column(c).to_numpy() for c in ("n", "mask", "ends")]
            starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(axis=1))) if len(at) else np.zeros(0, dtype=np.int64)
            for x, y in zip(starts.tolist(), np.append(starts[1:], len(at)).tolist(), strict=True):
                if cell != (now := tuple(at[x].tolist())):
                    cell, waiting, prefix = now, [], None
                split = x + int(np.searchsorted(flag[x:y], True))
                if split > x:
                    waiting.append((b.column("word").slice(x, split - x), *[c[x:split] for c in numbers]))
                if split == y or not (waiting or prefix):
                    continue
                if prefix is None:
                    texts, *rest = zip(*waiting, strict=True)
                    prefix, waiting = Held(pa.concat_arrays(texts), *map(np.concatenate, rest)), []
                pivot = Held(b.column("word").slice(split, y - split), *[c[split:y] for c in numbers])
                for p, q in close_pairs(pivot, prefix):
                    if len(p):
                        yield pa.RecordBatch.from_arrays([
                            pivot.words.take(pa.array(p)), prefix.words.take(pa.array(q)), pa.array(pivot.n[p]), pa.array(prefix.n[q]),
                        ], names=["a", "b", "a_n", "b_n"])

    met = celled(keys).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "pivot")
    met = met.mapInArrow(run, "a string, b string, a_n long, b_n long")
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("a_n").alias("n"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("b_n").alias("n"), F.col("a_n").alias("other_n")),
    )
    return met.select(F.explode(both).alias("p")).select("p.*").distinct()


def roots(forms: DataFrame, most: int = 64) -> DataFrame:
    """(word, root): the last of the forms that follow each word of `forms` (word, form), by pointer
    jumping; every round doubles the steps taken."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots-0")
    for step in range(1, most + 1):
        onward = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = at.join(onward, F.col("root") == F.col("_word"), "left")
        at = written(
            moved.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")),
            f"spelling-roots-{step}",
        )
        if at.filter("moved").limit(1).count() == 0:
            return at.select("word", "root")
        at = at.select("word", "root")
    raise RuntimeError("forms run in a circle")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n)."""
    words = written(words.select("word", "n"), "spelling-words")
    near = near_words(words).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("down"), F.col("other").alias("other"))).alias("first"),
    )
    is_form = -F.col("first.down") >= ratio * F.col("n")
    near = written(near.select(
        F.col("word").alias("_word"), "n_near", F.when(is_form, F.col("first.other")).alias("form"),
        F.when(is_form, -F.col("first.down")).alias("form_n"),
    ), "spelling-near")
    root = roots(near.filter("form IS NOT NULL").select(F.col("_word").alias("word"), "form"))
    root = root.select(F.col("word").alias("_from"), "root")
    out = words.join(near, F.col("word") == F.col("_word"), "left").join(root, F.col("word") == F.col("_from"), "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )


def document_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The variants among the words of documents, some of which lose a letter by their checksum."""
    found = runs(docs, LEAST, key, text)
    return variants(word_counts(found.select(dropped_letter(F.col("doc_id"), F.col("run")).alias("word"))))
