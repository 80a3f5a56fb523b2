"""Event-time bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(
    ticks: DataFrame, width: str, lateness: str = "10 minutes", tie_break: tuple[str, ...] = ()
) -> DataFrame:
    """The streaming form of resample: one row per asset and window, emitted once the watermark
    has passed the end of the window; ticks later than that are dropped."""
    rank = F.struct("ts", *tie_break)
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("asset", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", rank).alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", rank).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        .select("asset", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
