"""Sums over all ordered pairs of assets, by products of small date matrices.

Values are packed into matrices of CHUNK dates times BLOCK assets (missing: NaN). A follower's matrix
reaches over the lags asked for. Every leader block meets every follower block of its universe and
chunk once; all counts, sums and cross-products of their pairs and lags are matrix products, so one row
for each pair, lag and chunk leaves a task, and chunks merge by addition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, CHUNK = 64, 1024
PAIR = ("universe_id", "leader", "follower", "lag_days")

# tile(chunk, leaders, followers, extra) -> per lag a dict of sums, each leaders x followers
Tile = Callable[[int, np.ndarray, np.ndarray, list], Iterator[tuple[int, dict[str, np.ndarray]]]]


def packed(
    rows: DataFrame, values: Sequence[str], low: int = 0, high: int = 0, extra: str | None = None,
    block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """(universe_id, chunk, assets, cells) of blocks of assets: `cells` hold `values` of
    universe_id, asset, asset_ord, pos. Chunk c holds the dates from c * chunk + low to before
    (c + 1) * chunk + high. `extra` is an array<bigint> column that is the same on all rows of an asset."""
    own = F.col(extra) if extra else F.array()
    last = F.floor((F.col("pos") - low) / chunk)
    chunks = F.array(last)
    if high > low:
        first = F.greatest(F.lit(0), F.floor((F.col("pos") - high) / chunk))
        chunks = F.when(first <= last, F.sequence(first, last))
    spread = rows.select("*", F.explode(chunks).alias("chunk"), F.floor(F.col("asset_ord") / block).alias("_block"))
    asset = F.struct((F.col("asset_ord") % block).cast("int").alias("column"), "asset", own.cast("array<bigint>").alias("extra"))
    cell = F.struct(
        asset["column"].alias("column"), (F.col("pos") - F.col("chunk") * chunk - low).cast("int").alias("row"),
        *[F.col(v).cast("double").alias(v) for v in values],
    )
    return spread.filter("chunk >= 0").groupBy("universe_id", "_block", "chunk").agg(
        F.array_sort(F.collect_set(asset)).alias("assets"), F.collect_list(cell).alias("cells")
    ).drop("_block")


def matrices(cells: pa.StructArray, columns: np.ndarray, values: Sequence[str], width: int) -> np.ndarray:
    """values x dates x assets of one block; missing cells are NaN."""
    place = np.zeros(int(columns.max()) + 1, dtype=np.int64)
    place[columns] = np.arange(len(columns))
    row, column = cells.field("row").to_numpy(), place[cells.field("column").to_numpy()]
    data = np.full((len(values), width, len(columns)), np.nan)
    for k, v in enumerate(values):
        data[k, row, column] = cells.field(v).to_numpy(zero_copy_only=False)
    return data


def pair_sums(
    leaders: DataFrame, followers: DataFrame, values: tuple[Sequence[str], Sequence[str]], tile: Tile, sums: Sequence[str],
    width: tuple[int, int],
) -> DataFrame:
    """universe_id, leader, follower, lag_days and the sums over all chunks; pairs without a common
    date are left out. values and width: columns and dates of a leader's and of a follower's matrices."""
    right = followers.select(
        F.col("universe_id").alias("_universe"), F.col("chunk").alias("_chunk"), F.col("assets").alias("f_assets"), F.col("cells").alias("f_cells")
    )
    met = leaders.join(right, (F.col("universe_id") == F.col("_universe")) & (F.col("chunk") == F.col("_chunk")))
    met = met.select("universe_id", "chunk", "assets", "cells", "f_assets", "f_cells")
    names = list(sums)

    def side(b: pa.RecordBatch, k: int, prefix: str, of: int) -> tuple[list[dict], np.ndarray]:
        assets = b.column(f"{prefix}assets")[k].as_py()
        columns = np.array([a["column"] for a in assets])
        return assets, matrices(b.column(f"{prefix}cells")[k].values, columns, values[of], width[of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                leads, x = side(b, k, "", 0)
                follows, y = side(b, k, "f_", 1)
                lead = np.array([a["asset"] for a in leads], dtype=object)
                follow = np.array([a["asset"] for a in follows], dtype=object)
                other = lead[:, None] != follow[None, :]
                for lag, found in tile(b.column("chunk")[k].as_py(), x, y, [a["extra"] for a in leads]):
                    i, j = np.nonzero(other & (sum(found[n] for n in names if n.startswith("n")) > 0))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([b.column("universe_id")[k].as_py()] * len(i), pa.string()), pa.array(lead[i], pa.string()),
                            pa.array(follow[j], pa.string()), pa.array(np.full(len(i), lag, dtype=np.int32)),
                            *[pa.array(found[n][i, j]) for n in names],
                        ], names=[*PAIR, *names])

    shape = "universe_id string, leader string, follower string, lag_days int, " + ", ".join(f"{n} double" for n in names)
    return met.mapInArrow(run, shape).groupBy(*PAIR).agg(*[F.sum(n).alias(n) for n in names])


def moments(x: np.ndarray, y: np.ndarray, tag: str) -> dict[str, np.ndarray]:
    """Counts, sums and products of all column pairs of two matrices with the same dates."""
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(np.float64), my.astype(np.float64)
    return {
        f"n{tag}": mx.T @ my, f"x{tag}": x.T @ my, f"y{tag}": mx.T @ y, f"xx{tag}": (x * x).T @ my,
        f"yy{tag}": mx.T @ (y * y), f"xy{tag}": x.T @ y,
    }


def class_moments(member: np.ndarray, y: np.ndarray, tag: str) -> dict[str, np.ndarray]:
    """Count, sum and squares of y over the dates on which each leader is in a class."""
    my = ~np.isnan(y)
    y, m = np.where(my, y, 0.0), member.astype(np.float64)
    return {f"n{tag}": m.T @ my.astype(np.float64), f"y{tag}": m.T @ y, f"yy{tag}": m.T @ (y * y)}


def corr(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Pearson's correlation from sums; NULL where a side does not vary."""
    vx, vy = xx - x * x / n, yy - y * y / n
    varies = (n >= 2) & (vx > 1e-13 * xx) & (vy > 1e-13 * yy)
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (xy - x * y / n) / F.sqrt(vx * vy))))


def variance(n: Column, y: Column, yy: Column) -> Column:
    return F.when(n >= 2, F.greatest(F.lit(0.0), yy - y * y / n) / (n - 1))
