"""N-gram Jaccard self-join with size-banded tiles and bitmap signatures.

Two texts link when their shingle sets x, y satisfy 100 |x n y| >= percent |x u y|. All such links
decide the components; which of them are looked at is reduced without losing one:

1. Equal sets form a class, and one row stands for the class from there on.
2. Shingles are put in one order, rare ones first (the RANKED most repeated ones come last, by their
   count, the rest in order of hash). Linked sets share one of their first |x| - ceil(t |x|) + 1
   shingles, t = percent / 100, in any such order; these are a class's keys. The smaller of the two
   has it among its first |x| - ceil(2 t / (1 + t) |x|) + 1; these are its near keys.
3. The classes of a key, in order of size, fall into runs of compatible sizes; one without another
   of compatible size (and a near key where that is the smaller) goes. Every run names its most
   central class, the one with the smallest share of unranked shingles, as its pivot. (pivot, class)
   pairs are the first candidates; components of the links among them are the first components.
   Before their texts meet, a bitmap of a quarter of their hashes bounds the overlap as in 4.
4. A pair that shares a key also shares a pivot. Classes around a pivot that are not yet in its
   component meet all others around it in tiles: by bands of size, so that only compatible sizes
   meet, and in blocks, so that no group is held by one task. In a tile every class has a bitmap of
   hashed shingles. A bit that only x has set stands for a shingle outside y, so
   |x n y| <= |x| - bits(x & ~y), and likewise for y; pairs below the needed overlap are dropped.
5. All remaining pairs are decided by intersecting the sorted hash arrays of both texts.

The HOT most repeated shingles may be keys of very many classes: their pivots are summed in part
before the shuffle and there are at most HOT of them, so they return by a broadcast. Other keys meet
in a window.

Defined cases: null and empty texts have no shingles and are linked with nothing, texts shorter than
a shingle count as one; repeated rows are linked by being equal; rows with a null id belong to their
class but never name it (a class of such rows only has a null component); an empty table gives an
empty result. Sets are compared by 64-bit hashes, classes by a 64-bit hash and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm import slots
from barframe.llm.components import components
from barframe.llm.shingles import ROWS, batch_sets, mixed, shingle_sets
from barframe.llm.workers import lean
from barframe.session import written

SIZE, PERCENT = 4, 85
RANKED, HOT = 1 << 20, 65_536
HELD = 1 << 22  # hashes of a task among which repeated ones are counted
SEEN = 10_000  # classes of a task that are remembered
TILE = 512  # classes on either side of a tile
FEW = 24  # classes around a pivot that pair directly
LEAST_BITS, MOST_BITS, WIDTH = 64, 32_768, 4
_U = np.uint64


def class_of(shingles: np.ndarray) -> int:
    """A hash of the set, as a signed 64-bit number."""
    total = np.add.reduce(mixed(shingles ^ _U(0xA0761D6478BD642F))) if len(shingles) else _U(0)
    return int(mixed(np.array([total], dtype=_U) + _U(len(shingles))).view(np.int64)[0])


def n_keys(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def needed(a, b, percent: int):
    """The least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap(shingles: np.ndarray, top: bool = False) -> bytes:
    """One bit per shingle in a power of two of bits, WIDTH for each shingle and up to twice that;
    with top, of the shingles in the first quarter of all hashes only."""
    if top:
        shingles = shingles[:np.searchsorted(shingles, _U(1 << 62))]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (WIDTH * max(len(shingles), 1) - 1).bit_length()))
    made = np.zeros(bits, dtype=np.uint8)
    made[(shingles & _U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(made, bitorder="little").tobytes()


def profile(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """Two kinds of rows: (doc_id, n, cls) for every document, and (shingle, times) for the shingles
    that several documents share, counted over as many of a task's documents as HELD hashes have room for."""

    names = ["doc_id", "n", "cls", "shingle", "times"]

    def repeated(values: np.ndarray) -> pa.RecordBatch:
        values.sort()
        again, times = np.unique(values[1:][values[1:] == values[:-1]], return_counts=True)
        none = pa.nulls(len(again), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(again.view(np.int64)), pa.array(times + 1)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, end = np.empty(HELD, dtype=_U), 0  # pages that are not reached take no memory
        for b in batches:
            n, cls = [], []
            for s in batch_sets(b.column("text"), size):
                n.append(len(s))
                cls.append(class_of(s))
                if end + len(s) > len(values):
                    yield repeated(values[:end])
                    values, end = (values if len(s) <= len(values) else np.empty(len(s), dtype=_U)), 0
                values[end:end + len(s)] = s
                end += len(s)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), none, none], names=names)
        yield repeated(values[:end])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n long, cls long, shingle long, times long")


def ranked_list(profiled: DataFrame) -> np.ndarray:
    """At most RANKED of the most repeated shingles, most repeated last; all the driver holds."""
    counted = profiled.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times"))
    counted = written(counted, "join-counts")
    # A count is as good as its rank: the least one that at most RANKED shingles reach.
    step = F.least("times", F.lit(100_000)).alias("times")
    least, total = 100_001, 0
    for r in counted.groupBy(step).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("times")).collect():
        total += r["n"]
        if total > RANKED:
            break
        least = r["times"]
    top = counted.filter(F.col("times") >= least).select("shingle", F.least("times", F.lit(2**31 - 1)).cast("int").alias("times")).toArrow()
    values, times = top.column("shingle").to_numpy(), top.column("times").to_numpy()
    return values[np.lexsort((values, times))].view(_U).copy()


class Order:
    """Rare first: unranked shingles by hash, then the ranked ones by rank."""

    def __init__(self, heavy: np.ndarray):
        self.by_value = np.argsort(heavy, kind="stable")
        self.values = heavy[self.by_value]

    def ranks(self, shingles: np.ndarray) -> np.ndarray:
        """The rank from 1, or 0 for an unranked shingle."""
        if not len(self.values):
            return np.zeros(len(shingles), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.values, shingles), len(self.values) - 1)
        return np.where(self.values[at] == shingles, self.by_value[at] + 1, 0)


def class_keys(docs: DataFrame, ranked: np.ndarray, size: int, percent: int, text: str) -> DataFrame:
    """Rows (cls, n, quick, bits) for classes and (cls, n, centre, key, near, hot) for their keys. A class
    may come again, once SEEN others of its task have come."""

    names = ["cls", "n", "quick", "bits", "centre", "key", "near", "hot"]

    def some(sets: Iterator[np.ndarray], seen: set[int], order: Order, hottest: int) -> Iterator[pa.RecordBatch]:
        """The rows of the classes among `sets` that are not in `seen`, which they join."""
        cls, n, quick, bits, centre, keys, near, hot = [], [], [], [], [], [], [], []
        for s in sets:
            if not len(s) or (c := class_of(s)) in seen:
                continue
            seen.add(c)
            rank = order.ranks(s)
            plain = rank == 0
            unranked = int(plain.sum())
            want = n_keys(len(s), percent)
            first, at = s[np.flatnonzero(plain)[:want]], np.zeros(min(unranked, want), dtype=np.int64)
            if len(first) < want:
                last = np.flatnonzero(~plain)
                last = last[np.argsort(rank[last])[:want - len(first)]]
                first, at = np.concatenate([first, s[last]]), np.concatenate([at, rank[last]])
            cls.append(c)
            n.append(len(s))
            quick.append(bitmap(s, True))
            bits.append(bitmap(s))
            centre.append(unranked * 10_000 // len(s))
            keys.append(first)
            near.append(np.arange(want) < len(s) - needed(len(s), len(s), percent) + 1)
            hot.append(at > max(hottest, 0))
        if not cls:
            return
        m, per = len(cls), [len(k) for k in keys]
        ids, sizes = np.array(cls, dtype=np.int64), np.array(n, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(sizes), pa.array(quick, pa.binary()), pa.array(bits, pa.binary()), pa.nulls(m, pa.int16()),
             pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.bool_())], names=names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, per)), pa.array(np.repeat(sizes, per)), *[pa.nulls(sum(per), pa.binary())] * 2,
             pa.array(np.repeat(np.array(centre, dtype=np.int16), per)), pa.array(np.concatenate(keys).view(np.int64)),
             pa.array(np.concatenate(near)), pa.array(np.concatenate(hot))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, hottest = Order(ranked), len(ranked) - HOT
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                if len(seen) > SEEN:
                    seen = set()
                yield from some(batch_sets(b.column("text").slice(at, ROWS), size), seen, order, hottest)

    rows = docs.select(F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), "cls long, n int, quick binary, bits binary, centre short, key long, near boolean, hot boolean")


def pivots(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (pivot, cls) with their sizes p and n, pivot <> cls, over all runs of all keys."""
    keys = rows.filter("key IS NOT NULL").select("key", "cls", F.col("n").cast("long").alias("n"), "centre", "near", "hot")
    by_size = Window.partitionBy("key").orderBy("n", "cls")
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    fits = lambda small, large: F.coalesce(100 * small >= percent * large, F.lit(False))
    cold = keys.filter("not hot").withColumns({
        "_smaller": F.max(F.when(F.col("near"), F.col("n"))).over(before), "_larger": F.lead("n").over(by_size),
    })
    cold = cold.filter(fits(F.col("_smaller"), F.col("n")) | (F.col("near") & fits(F.col("n"), F.col("_larger"))))
    gap = F.when(fits(F.lag("n").over(by_size), F.col("n")), 0).otherwise(1)
    cold = cold.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(by_size))
    centre = Window.partitionBy("key", "_run").orderBy("centre", "cls")
    cold = cold.withColumns({"pivot": F.first("cls").over(centre), "p": F.first("n").over(centre)})
    hot = keys.filter("hot").select("key", "cls", "n", "centre")
    middle = hot.groupBy("key").agg(F.min(F.struct("centre", "cls", "n")).alias("_m")).select(
        F.col("key").alias("_key"), F.col("_m.cls").alias("pivot"), F.col("_m.n").alias("p")
    )
    # At most HOT keys.
    warm = hot.join(F.broadcast(middle), F.col("key") == F.col("_key"))
    both = cold.select("pivot", "p", "cls", "n").unionByName(warm.select("pivot", "p", "cls", "n"))
    return both.filter("pivot <> cls").distinct()


def _matrix(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the narrowest among them."""
    width = min(map(len, bits)) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, dtype=_U).reshape(-1, width), axis=0) for b in bits])


def bounded(n_x: np.ndarray, x: np.ndarray, n_y: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bit counts leave room for the needed overlap; all against all."""
    only_x = np.zeros((len(x), len(y)), dtype=np.int32)
    only_y = np.zeros((len(x), len(y)), dtype=np.int32)
    for w in range(x.shape[1]):
        a, b = x[:, w][:, None], y[:, w][None, :]
        both = np.bitwise_count(a & b).astype(np.int32)
        only_x += np.bitwise_count(a).astype(np.int32) - both
        only_y += np.bitwise_count(b).astype(np.int32) - both
    a, b = n_x[:, None], n_y[None, :]
    return np.minimum(a - only_x, b - only_y) >= needed(a, b, percent)


def _room(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """bounded() for one pair."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    while len(x) != len(y):  # fold the wider one
        if len(x) > len(y):
            half = len(x) // 2
            a, x = (a >> (8 * half)) | (a & ((1 << (8 * half)) - 1)), x[:half]
        else:
            half = len(y) // 2
            b, y = (b >> (8 * half)) | (b & ((1 << (8 * half)) - 1)), y[:half]
    return min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count()) >= needed(n, m, percent)


def paired(pairs: DataFrame, quick: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, x_n, y, y_n) those (x, y) whose sizes and quick bit counts allow a link."""
    side = lambda p: quick.select(F.col("cls").alias(f"{p}_cls"), F.col("quick").alias(f"{p}_bits"))
    met = pairs.filter((100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")))
    met = met.join(side("x"), F.col("x") == F.col("x_cls")).join(side("y"), F.col("y") == F.col("y_cls"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = np.zeros(len(b), dtype=bool)
            for i, (n, p, m, q) in enumerate(zip(b["x_n"], b["x_bits"], b["y_n"], b["y_bits"], strict=True)):
                ok[i] = _room(n, p, m, q, percent)
            yield b.loc[ok, ["x", "y"]]

    return met.select("x", "y", "x_n", "x_bits", "y_n", "y_bits").mapInPandas(lean(run), "x long, y long")


def _rows_of(docs: DataFrame, ids: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(_doc, text as `name`) of the rows whose id may be among `ids` (one column): a filter, no join."""
    count = slots.slot_count(ids.count())
    bits = slots.as_filter(ids.select(F.explode(slots.slots(F.col(ids.columns[0]), count)).alias("slot")))
    rows = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias(name))
    return slots.hits(rows, F.col("_doc"), written(bits, "join-wanted"), count, "_seen").filter("_seen").drop("_seen")


def verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """The pairs that are linked: sorted hash arrays of both texts, intersected. `names` has a
    document for each class. Only the texts of the pairs are shuffled, each side once."""
    name = lambda p: names.select(F.col("cls").alias(f"_{p}"), F.col("first").alias(f"{p}_id"))
    met = pairs.join(name("x"), F.col("x") == F.col("_x")).join(name("y"), F.col("y") == F.col("_y"))
    met = written(met.select("x", "y", "x_id", "y_id"), "join-to-verify")
    for p in ("y", "x"):
        rows = _rows_of(docs, met.select(f"{p}_id").distinct(), key, text, f"{p}_text").withColumnRenamed("_doc", f"_{p}")
        met = met.join(rows, F.col(f"{p}_id") == F.col(f"_{p}")).drop(f"_{p}", f"{p}_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ok = np.zeros(part.num_rows, dtype=bool)
            x_text, y_text = (part.column(c).to_pylist() for c in ("x_text", "y_text"))
            named = zip(part.column("x").to_pylist(), part.column("y").to_pylist(), x_text, shingle_sets(y_text, size), strict=True)
            for i, (x, y, text, other) in enumerate(named):
                if held is None or text != last:
                    last, held = text, next(shingle_sets([text], size))
                both = len(np.intersect1d(held, other, assume_unique=True))
                near = both > 0 and 100 * both >= percent * (len(held) + len(other) - both)
                # A repeated id may bring a text of another class.
                ok[i] = near and class_of(held) == x and class_of(other) == y
            yield part.select(["x", "y"]).filter(pa.array(ok))

    return met.select("x", "y", "x_text", "y_text").mapInArrow(lean(run), "x long, y long").distinct()


def _starts(rows: pa.Table, tile: list[str]) -> np.ndarray:
    """Where a new tile begins."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for c in tile:
        v = rows.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _tile_pairs(rows: pa.Table, starts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of all tiles of `rows` that sizes, labels and bit counts leave."""
    probe, cls, label, n = (rows.column(c).to_numpy() for c in ("probe", "cls", "label", "n"))
    bits = rows.column("bits").to_pylist()
    xs, ys = [], []
    for s, e in zip(starts, np.append(starts[1:], rows.num_rows), strict=True):
        own = probe[s:e]
        a, b = s + np.flatnonzero(own), s + np.flatnonzero(~own)
        if not len(a) or not len(b):
            continue
        n_a, n_b = n[a][:, None], n[b][None, :]
        ok = (label[a][:, None] != label[b][None, :]) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
        i, j = np.nonzero(ok)
        if not len(i):
            continue
        if len(i) > len(a) + len(b):
            every = _matrix([bits[k] for k in (*a, *b)])
            i, j = np.nonzero(ok & bounded(n[a], every[:len(a)], n[b], every[len(a):], percent))
            xs.append(cls[a[i]])
            ys.append(cls[b[j]])
            continue
        for p, q in zip(a[i], b[j], strict=True):
            if _room(int(n[p]), bits[p], int(n[q]), bits[q], percent):
                xs.append(cls[p:p + 1])
                ys.append(cls[q:q + 1])
    if xs:
        x, y = np.concatenate(xs), np.concatenate(ys)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["x", "y"])


def of_members(keyed: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """(cls, column) of the class rows of `members` (one column, cls), once each. A filter over the
    members clears the other classes before anything is shuffled."""
    members = written(members.distinct(), "join-members")
    count = slots.slot_count(members.count())
    some = slots.as_filter(members.select(F.explode(slots.slots(F.col("cls"), count)).alias("slot")))
    rows = keyed.filter("key IS NULL").select("cls", column)
    rows = slots.hits(rows, F.col("cls"), written(some, "join-member-filter"), count, "_seen").filter("_seen")
    return rows.groupBy("cls").agg(F.first(column).alias(column))


def tiles(around: DataFrame, keyed: DataFrame, quick: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (x, y) of different components that share a pivot and pass the bit counts.

    around: (pivot, p, cls, n), labels: (id, component) of classes. Groups of at most FEW classes
    pair directly and their pairs meet the quick bitmaps; larger ones are laid out in tiles."""
    label = labels.select(F.col("id").alias("_id"), "component")
    named = around.join(label, F.col("cls") == F.col("_id"), "left").select(
        "pivot", "cls", "n", F.coalesce("component", "cls").alias("label")
    )
    own = label.select(F.col("_id").alias("_p"), F.col("component").alias("_pc"))
    named = named.join(own, F.col("pivot") == F.col("_p"), "left").select(
        "pivot", "cls", "n", "label", (F.col("label") != F.coalesce("_pc", "pivot")).alias("apart")
    )
    named = written(named, "join-around")
    # The pivot itself has met everybody. Alone outside its component, a class has nobody left to meet.
    groups = named.groupBy("pivot").agg(F.count(F.lit(1)).alias("_n"), F.count_if("apart").alias("_apart"))
    groups = groups.filter("_apart > 0 and _n > 1").select(F.col("pivot").alias("_g"), (F.col("_n") > FEW).alias("many"))
    grouped = written(named.join(groups, F.col("pivot") == F.col("_g")).drop("_g"), "join-grouped")
    some = grouped.filter("not many")
    a = some.filter("apart").select("pivot", F.col("cls").alias("x"), F.col("n").alias("x_n"), F.col("label").alias("x_label"))
    b = some.select(F.col("pivot").alias("_p"), F.col("cls").alias("y"), F.col("n").alias("y_n"), F.col("label").alias("y_label"), "apart")
    fits = 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
    met = a.join(b, (F.col("pivot") == F.col("_p")) & (F.col("x_label") != F.col("y_label")) & (~F.col("apart") | (F.col("x") < F.col("y"))) & fits)
    swap = F.col("x") > F.col("y")
    met = met.select(*[F.when(swap, F.col(v)).otherwise(F.col(u)).alias(u) for u, v in (("x", "y"), ("x_n", "y_n"), ("y", "x"), ("y_n", "x_n"))])
    direct = paired(met.distinct(), quick, percent)
    rows = grouped.filter("many")
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent) + 1e-9).cast("int")
    rows = written(rows.select("pivot", "cls", "label", "apart", "n", band.alias("band")), "join-tile-rows")
    bits = of_members(keyed, rows.select("cls"), "bits").withColumnRenamed("cls", "_c")
    deal = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "cls"), of).cast("int")
    sizes = rows.groupBy("pivot", "band").agg(F.count_if("apart").alias("_a"), F.count(F.lit(1)).alias("_b"))
    sizes = sizes.select(F.col("pivot").alias("_g"), F.col("band").alias("_band"), *[
        F.greatest(F.lit(1), F.ceil(F.col(v) / TILE)).cast("long").alias(v) for v in ("_a", "_b")
    ], (F.col("_a") > 0).alias("_live"))
    # A tile is (pivot, band, i, band of the others, j): block i of the apart ones against block j.
    upto = lambda v: F.explode(F.sequence(F.lit(0), (F.col(v) - 1).cast("int")))
    probe = rows.filter("apart").withColumn("to", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    mine = sizes.select("_g", "_band", "_a")
    theirs = sizes.select(F.col("_g").alias("_h"), F.col("_band").alias("_to"), "_b")
    probe = probe.join(mine, (F.col("pivot") == F.col("_g")) & (F.col("band") == F.col("_band"))).join(
        theirs, (F.col("pivot") == F.col("_h")) & (F.col("to") == F.col("_to"))
    )
    probe = probe.select("pivot", F.col("band").alias("p"), deal(3, F.col("_a")).alias("i"), "to", upto("_b").alias("j"), F.lit(True).alias("probe"), "cls", "label", "n")
    build = rows.withColumn("p", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    mine = sizes.select(F.col("_g").alias("_h"), F.col("_band").alias("_to"), "_b")
    theirs = sizes.filter("_live").select("_g", "_band", "_a")
    build = build.join(mine, (F.col("pivot") == F.col("_h")) & (F.col("band") == F.col("_to"))).join(
        theirs, (F.col("pivot") == F.col("_g")) & (F.col("p") == F.col("_band"))
    )
    build = build.select("pivot", "p", upto("_a").alias("i"), F.col("band").alias("to"), deal(4, F.col("_b")).alias("j"), F.lit(False).alias("probe"), "cls", "label", "n")
    tile = ["pivot", "p", "i", "to", "j"]
    # Tiles are whole in a partition and one after the other; a task holds one tile at a time.
    laid = probe.unionByName(build).join(bits, F.col("cls") == F.col("_c")).drop("_c").repartition(*tile).sortWithinPartitions(*tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            now = pa.Table.from_batches([b])
            now = now if rest is None else pa.concat_tables([rest, now])
            starts = _starts(now, tile)
            if len(starts) > 1:
                yield from _tile_pairs(now.slice(0, starts[-1]), starts[:-1], percent)
            rest = now.slice(starts[-1]) if len(starts) else None
        if rest is not None:
            yield from _tile_pairs(rest, np.zeros(1, dtype=np.int64), percent)

    return laid.mapInArrow(lean(run), "x long, y long").unionByName(direct).distinct()


def ngram_links(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, key: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, n, cls of every row; linked class pairs x, y whose components are
    those of all links."""
    profiled = written(profile(docs, size, key, text), "join-profile")
    rows = profiled.filter("shingle IS NULL").select("doc_id", "n", "cls")
    names = written(rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first")), "join-classes")
    keyed = written(class_keys(docs, ranked_list(profiled), size, percent, text), "join-keys")
    around = written(pivots(keyed, percent), "join-pivots")
    # Bitmaps only of the classes that have somebody to meet.
    members = around.select("cls").unionByName(around.select(F.col("pivot").alias("cls")))
    quick = written(of_members(keyed, members, "quick"), "join-quick")
    first = around.select(F.col("pivot").alias("x"), F.col("p").alias("x_n"), F.col("cls").alias("y"), F.col("n").alias("y_n"))
    first = paired(first, quick, percent)
    links = written(verified(written(first, "join-first"), docs, names, size, percent, key, text), "join-links-1")
    labels = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    left = written(tiles(around, keyed, quick, labels, percent), "join-second")
    more = written(verified(left, docs, names, size, percent, key, text), "join-links-2")
    return rows, links.unionByName(more)


def ngram_groups(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest id reachable)."""
    rows, links = ngram_links(docs, size, percent, key, text)
    first = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    labels = components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("id").alias("_c"), "component")
    named = first.join(labels, F.col("cls") == F.col("_c"), "left").select("cls", "first", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id")).withColumnRenamed("component", "_k")
    by_class = named.join(least, F.col("component") == F.col("_k")).select(F.col("cls").alias("_c"), "component_id")
    by_class = written(by_class, "join-named")
    met = rows.filter("n > 0").join(by_class, F.col("cls") == F.col("_c")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return met.unionByName(empty)


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that a smaller id is linked with, directly or by others."""
    gone = ngram_groups(docs, size, percent, key, text).filter("doc_id <> component_id").select(F.col("doc_id").alias(key))
    return slots.without(docs, gone, key)


def keep_single(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component, that of the smallest id (null ids last; of rows that tie
    any one); rows without a shingle all stay. Rows are told apart by a hash of id and text, so a
    repeated or null id neither takes another row along nor keeps a near copy."""
    rows = slots.boxed(docs, _key=key, _text=text).withColumn("_k", F.xxhash64("_key", "_text"))
    groups = ngram_groups(rows, size, percent, "_k", "_text").filter("n_shingles > 0").select(F.col("doc_id").alias("_k"), "component_id")
    ids = rows.groupBy("_k").agg(F.first("_key").alias("_id"))
    members = written(groups.groupBy("_k").agg(F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")).join(ids, "_k"), "single-members")
    first = members.groupBy("component_id").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_k")).alias("_first"), F.sum("n").alias("size")
    )
    first = written(first.filter("size > 1").select("component_id", F.col("_first._k").alias("_stays")), "single-first")
    met = members.join(first, "component_id")
    left = slots.without(rows, met.filter("_k <> _stays").select("_k"), "_k")
    ties = written(met.filter("n > 1 AND _k = _stays").select(F.col("_k").alias("_tie")), "single-ties")
    if not ties.isEmpty():
        twice = left.join(ties, F.col("_k") == F.col("_tie"), "left_semi").dropDuplicates(["_k"])
        left = slots.without(left, ties, "_k").unionByName(twice)
    return slots.opened(left)
