"""Seeded resampling of daily returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barframe.functions.windows import Keys

PRIME = 2147483647
PATHS = 500
CHUNKS = 16


def draw(path, step, seed: int, n):
    """A repeatable index in [0, n): a quadratic hash of path and step, exact in 64-bit integers.
    Works on integer columns and on numpy integers alike."""
    x = (path * 48271 + step * 69621 + seed * 7919) % PRIME
    y = (x * x) % PRIME
    return ((y * y + x * 3 + step) % PRIME) % n


def resample(
    returns: DataFrame,
    keys: Keys = ("run_id",),
    order: str = "pos",
    ret: str = "ret",
    paths: int = PATHS,
    seed: int = 42,
    min_obs: int = 60,
) -> DataFrame:
    """keys, path, terminal, max_drawdown for every resampled path.

    The returns of a run (one per date) travel as one array, repeated once per chunk of paths
    rather than once per path. A task turns the paths of a chunk into one block of numbers; there
    is no join and no row per step.
    """
    packed = (
        returns.filter(F.col(ret).isNotNull())
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(order, ret)))[ret].alias("rets"))
        .filter(F.size("rets") >= min_obs)
    )
    per_chunk = -(-paths // CHUNKS)
    chunked = packed.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.lit((paths - 1) // per_chunk)))
    ).repartition(*keys, "_chunk")
    schema = StructType([packed.schema[k] for k in keys])
    for name, kind in (("path", "bigint"), ("terminal", "double"), ("max_drawdown", "double")):
        schema = schema.add(name, "long" if kind == "bigint" else kind)

    def walk(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                rets = np.asarray(row.rets, dtype=float)
                n = len(rets)
                first = row[len(keys) + 1] * per_chunk
                path = np.arange(first, min(first + per_chunk, paths), dtype=np.int64)
                idx = draw(path[:, None], np.arange(n, dtype=np.int64)[None, :], seed, n)
                curve = np.cumprod(1 + rets[idx], axis=1)
                worst = (curve / np.maximum.accumulate(curve, axis=1) - 1).min(axis=1)
                head = {k: [row[i]] * len(path) for i, k in enumerate(keys)}
                yield pd.DataFrame({**head, "path": path, "terminal": curve[:, -1] - 1, "max_drawdown": worst})

    return chunked.select(*keys, "rets", "_chunk").mapInPandas(walk, schema)


def summarize(paths: DataFrame, keys: Keys = ("run_id",)) -> DataFrame:
    p = F.avg((F.col("terminal") > 0).cast("double"))
    low = F.percentile("terminal", F.lit(0.05)) * 100
    return paths.groupBy(*keys).agg(
        F.count("*").alias("n_paths"), p.alias("probability_positive"), low.alias("return_p5_pct"),
        (F.percentile("max_drawdown", F.lit(0.05)) * 100).alias("drawdown_p5_pct"),
    ).withColumn("passed", (F.col("probability_positive") >= 0.6) & (F.col("return_p5_pct") > -20))
