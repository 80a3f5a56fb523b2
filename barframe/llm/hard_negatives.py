"""Hard negatives by segment summaries.

A vector is cut into segments of two components; of each its mean and its deviation are stored beside
the vector. Summaries of neighbouring segments merge into those of the segment that holds both, up to
the whole vector. The inner product of two vectors is the sum over their segments of
length * (mean * mean), give or take length * (deviation * deviation) by Cauchy and Schwarz. A search
starts with the widest segments and halves them: rows whose upper bound falls below what is known to
be reached, or whose bounds lie outside the wanted range, go; only what is left at the narrowest
segments is scored exactly. Scores are inner products of whole numbers, and bounds are widened by more
than the rounding of doubles, so results are exact.

Vectors are packed into blocks of BLOCK rows, anchors into chunks. Every block gets a copy of each
chunk after itself in one sorted partition, so a task holds one block and one chunk at a time. Tiles
return at most k rows for an anchor (positives) or for an anchor and positive (negatives); windows
merge them.

Defined cases: rows with a null id, label or vector, or with null or non-finite components take no
part, nor do those whose vector's length is not the most frequent one (the smaller on a tie); of rows
that repeat an id the one with the smallest vector, then label, counts; equal scores go by smaller id;
an anchor without other rows of its label gives no row, nor does a positive without a negative in its
range; an empty table gives an empty result; other columns are not looked at. Scores beyond 63 bits
raise an OverflowError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.session import written

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  # percent of the positive's score that a negative's score lies between
BLOCK, CHUNK = 4096, 128
FEW = 32  # rows that are scored without further bounds
NARROWEST = 2  # components of the narrowest segments


def edges_of(d: int) -> np.ndarray:
    """Starts of the narrowest segments of d components, and d."""
    return np.append(np.arange(0, max(d, 1), NARROWEST), d)


def summary(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every narrowest segment, rows x segments."""
    edges = edges_of(vectors.shape[1])
    width = np.diff(edges)
    mean = np.add.reduceat(vectors, edges[:-1], axis=1) / width
    off = vectors - np.repeat(mean, width, axis=1)
    return mean, np.sqrt(np.add.reduceat(off * off, edges[:-1], axis=1) / width)


def levels(mean: np.ndarray, dev: np.ndarray, d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the widest to the narrowest segments: means and deviations, each times the root of its
    segment's length, so that bounds are plain inner products."""
    width = np.diff(edges_of(d)).astype(np.float64)
    found = [(mean * np.sqrt(width), dev * np.sqrt(width))]
    while len(width) > 1:
        if len(width) % 2:  # the last stays alone
            width, zero = np.append(width, 0.0), np.zeros((len(mean), 1))
            mean, dev = np.hstack([mean, zero]), np.hstack([dev, zero])
        a, b = width[::2], width[1::2]
        both = a + b
        apart = mean[:, ::2] - mean[:, 1::2]
        square = (a * dev[:, ::2] ** 2 + b * dev[:, 1::2] ** 2) / both + a * b / both**2 * apart**2
        mean, dev, width = (a * mean[:, ::2] + b * mean[:, 1::2]) / both, np.sqrt(square), both
        found.append((mean * np.sqrt(width), dev * np.sqrt(width)))
    return found[::-1]


class Rows:
    """Packed vectors with the summaries of all levels."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, means: bytes, devs: bytes, d: int):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.whole = np.frombuffer(vectors, np.int64).reshape(-1, d)
        self.exact = self.whole.astype(np.float64)
        n = len(self.ids)
        self.levels = levels(np.frombuffer(means, np.float64).reshape(n, -1), np.frombuffer(devs, np.float64).reshape(n, -1), d)
        self.most = int(np.abs(self.whole).max(initial=0))
        self.reach = np.sqrt((self.exact * self.exact).sum(axis=1).max(initial=0.0))


class Tile:
    """A block met by one anchor of a chunk."""

    def __init__(self, block: Rows, chunk: Rows, at: int):
        self.block, self.chunk, self.at = block, chunk, at
        d = block.whole.shape[1]
        bits = block.most * chunk.most * d
        if bits >= 1 << 63:
            raise OverflowError("inner products beyond 63 bits")
        self.in_doubles = bits < 1 << 53
        self.slack = 1e-9 * block.reach * float(np.sqrt((chunk.exact[at] ** 2).sum())) + 1e-6

    def bounds(self, level: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, dev = self.block.levels[level]
        own_mean, own_dev = self.chunk.levels[level]
        centre, spread = mean[rows] @ own_mean[self.at], dev[rows] @ own_dev[self.at] + self.slack
        return centre - spread, centre + spread

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.in_doubles:
            return (self.block.exact[rows] @ self.chunk.exact[self.at]).astype(np.int64)
        return self.block.whole[rows] @ self.chunk.whole[self.at]

    def ranked(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of rows, best first."""
        found, ids = self.scores(rows), self.block.ids[rows]
        order = np.lexsort((ids, -found))
        return ids[order], found[order]

    def best(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of rows: a row goes when k others are sure to score more."""
        for level in range(len(self.block.levels)):
            if len(rows) <= max(k, FEW):
                break
            low, high = self.bounds(level, rows)
            rows = rows[high >= np.partition(low, len(rows) - k)[len(rows) - k]]
        ids, found = self.ranked(rows)
        return ids[:k], found[:k]

    def within(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores, best first, among which are the k best of rows in each range."""
        for level in range(len(self.block.levels)):
            if len(rows) <= FEW or not len(low):
                break
            least, most = self.bounds(level, rows)
            wanted = np.zeros(len(rows), dtype=bool)
            for a, b in zip(low, high, strict=True):
                sure = least[(least >= a) & (most <= b)]
                reached = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else a
                wanted |= (most >= max(a, reached)) & (least <= b)
            rows = rows[wanted]
        return self.ranked(rows if len(low) else rows[:0])


def same_label(block: Rows, label: int) -> slice:
    return slice(*np.searchsorted(block.labels, [label, label + 1]))


def positives_in(block: Rows, chunk: Rows, k: int) -> Iterator[tuple]:
    for at, (anchor, label) in enumerate(zip(chunk.ids.tolist(), chunk.labels.tolist(), strict=True)):
        part = same_label(block, label)
        rows = np.arange(part.start, part.stop)
        ids, found = Tile(block, chunk, at).best(rows[block.ids[rows] != anchor], k)
        for i, s in zip(ids.tolist(), found.tolist(), strict=True):
            yield anchor, i, s


def negatives_in(block: Rows, chunk: Rows, ranges: pd.DataFrame, k: int, low: int, high: int) -> Iterator[tuple]:
    """ranges: per anchor of the chunk its positives' ids and scores."""
    for at, (anchor, label) in enumerate(zip(chunk.ids.tolist(), chunk.labels.tolist(), strict=True)):
        part = same_label(block, label)
        rows = np.concatenate([np.arange(part.start), np.arange(part.stop, len(block.ids))])
        held = [(i, s) for i, s in zip(*ranges[at], strict=True) if low * s <= high * s]
        floor = np.array([low * s / 100 for _, s in held])
        ceiling = np.array([high * s / 100 for _, s in held])
        ids, found = Tile(block, chunk, at).within(rows, floor - 1e-6 * abs(floor), ceiling + 1e-6 * abs(ceiling), k)
        down = -found
        for positive, score in held:  # best first: those at or below the upper end, down to the lower
            first = int(np.searchsorted(down, -(high * score // 100), "left"))
            last = int(np.searchsorted(down, (-low * score) // 100, "right"))
            for j in range(first, min(last, first + k)):
                yield anchor, positive, score, int(ids[j]), int(found[j])


def usable(vectors: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, label, v array<long>) of the rows that take part; components times `scale`, rounded down."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))


PACKED = "ids binary, labels binary, vectors binary, means binary, devs binary, positives binary, scores binary"


def packed(rows: DataFrame, group: str) -> DataFrame:
    """A row per group with its ids, labels, vectors and summaries as bytes, by label and id. Rows of
    an id are in one group. Columns `positives` and `scores` (arrays of one length within a row) are
    packed with their lengths in front."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        if part["vec_id"].duplicated().any():
            part = part.assign(_v=part["v"].map(tuple)).sort_values(["vec_id", "_v", "label"]).drop_duplicates("vec_id")
        part = part.sort_values(["label", "vec_id"])
        v = np.stack(part["v"].to_list()).astype(np.int64)
        mean, dev = summary(v.astype(np.float64))
        out = {
            group: [key[0]], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
            "labels": [part["label"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()],
            "means": [mean.tobytes()], "devs": [dev.tobytes()], "positives": [b""], "scores": [b""],
        }
        for name in ("positives", "scores"):
            if name in part:
                lists = [np.asarray(x, dtype=np.int64) for x in part[name]]
                sizes = np.array([len(x) for x in lists], dtype=np.int64)
                out[name] = [np.concatenate([sizes, *lists]).tobytes()]
        return pd.DataFrame(out)

    return rows.groupBy(group).applyInPandas(pack, f"{group} long, {PACKED}")


def unpacked(raw: bytes, n: int) -> list[list[int]]:
    flat = np.frombuffer(raw, np.int64)
    ends = n + np.cumsum(flat[:n])
    return [flat[b - s:b].tolist() for b, s in zip(ends, flat[:n], strict=True)]


def met(blocks: DataFrame, asked: DataFrame, d: int, count: int, tile: Callable[..., Iterator[tuple]], shape: str) -> DataFrame:
    """tile(block, chunk, row of the chunk) of every block and chunk; rows of the given shape."""
    columns = [c.split()[0] for c in PACKED.split(", ")]
    names = [c.split()[0] for c in shape.split(", ")]
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    rows = blocks.select("block", F.lit(0).alias("kind"), *columns).unionByName(
        asked.select(everywhere.alias("block"), F.lit(1).alias("kind"), *columns)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block = None, None
        for b in batches:
            for row in b.itertuples(index=False):
                held = Rows(row.ids, row.labels, row.vectors, row.means, row.devs, d)
                if row.kind == 0:
                    at, block = row.block, held
                elif at == row.block:  # a block that got no rows has no tiles
                    yield pd.DataFrame(list(tile(block, held, row)), columns=names)

    return rows.repartition(count, "block").sortWithinPartitions("block", "kind").mapInPandas(run, shape)


def hard_negatives(
    vectors: DataFrame, anchors_every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = 256, key: str = "vec_id", label: str = "label",
    vector: str = "embedding", block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `anchors_every`; their positives the first rows of
    the same label. For each, the first `negatives` rows of other labels whose score lies between
    `low` and `high` percent of the positive's."""
    rows = written(usable(vectors, key, label, vector, scale), "negatives-rows")
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    d, n = (common["d"], common["n"]) if common else (1, 0)
    rows = rows.filter((F.size("v") == d) & (F.size("v") > 0))
    count = max(1, -(-n // block))
    blocks = written(packed(rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count))), "block"), "negatives-blocks")
    first = F.min(F.struct("v", "label")).alias("_first")
    anchors = rows.filter(F.col("vec_id") % anchors_every == 0).groupBy("vec_id").agg(first)
    anchors = written(anchors.select("vec_id", "_first.label", "_first.v"), "negatives-anchors")
    chunks = max(1, -(-anchors.count() // chunk))
    dealt = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(chunks))

    found = met(
        blocks, packed(anchors.withColumn("chunk", dealt), "chunk"), d, count,
        lambda b, c, row: positives_in(b, c, positives), "anchor_id long, positive_id long, positive_score long",
    )
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= positives)
    lists = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("_rank", "positive_id", "positive_score"))).alias("_held")
    )
    held = anchors.join(lists, "vec_id").select(
        "vec_id", "label", "v", F.col("_held.positive_id").alias("positives"), F.col("_held.positive_score").alias("scores")
    )

    def tile(b: Rows, c: Rows, row) -> Iterator[tuple]:
        n = len(c.ids)
        ranges = list(zip(unpacked(row.positives, n), unpacked(row.scores, n), strict=True))
        return negatives_in(b, c, ranges, negatives, low, high)

    mined = met(
        blocks, written(packed(held.withColumn("chunk", dealt), "chunk"), "negatives-asked"), d, count, tile,
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return mined.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
