"""Bars from ticks, row gates and the aligned panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.windows import full

BAR_COLUMNS = ("asset", "ts", "open", "high", "low", "close", "volume")


def require_columns(df: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resample(
    ticks: DataFrame,
    period: Column,
    tie_break: tuple[str, ...],
    price: str = "price",
    qty: str | Column = "qty",
    rank: Column | None = None,
) -> DataFrame:
    """Ticks to bars. One aggregation: rows shrink to one per key and period before the
    shuffle, so an asset that holds most of the ticks costs no more than the others.

    rank puts the ticks of a period in order. As one number (packed_key) it lives in the hash
    aggregation's buffer; without it, ts and tie_break form a struct, for which Spark sorts all
    ticks first."""
    p = F.col(price)
    q = F.col(qty) if isinstance(qty, str) else qty
    rank = F.struct("ts", *tie_break) if rank is None else rank
    return (
        ticks.withColumn("_period", period)
        .groupBy("asset", F.col("_period").alias("bar_ts"))
        .agg(
            F.min_by(p, rank).alias("open"),
            F.max(p).alias("high"),
            F.min(p).alias("low"),
            F.max_by(p, rank).alias("close"),
            F.sum(q).alias("volume"),
            F.avg(p).alias("avg_price"),
        )
        .withColumnRenamed("bar_ts", "ts")
    )


def drop_incomplete(bars: DataFrame) -> DataFrame:
    return bars.na.drop(subset=["open", "high", "low", "close"])


def minimum_history(bars: DataFrame, min_rows: int) -> DataFrame:
    """Keep the assets that have enough rows."""
    enough = bars.groupBy("asset").count().filter(F.col("count") >= min_rows)
    return bars.join(enough.select("asset"), "asset", "left_semi")


def date_slice(df: DataFrame, start: str | Column, end: str | Column, ts: str = "ts") -> DataFrame:
    lo, hi = (F.to_date(F.lit(v)) if isinstance(v, str) else v for v in (start, end))
    return df.filter(F.col(ts).between(lo, hi))


def month_end(bars: DataFrame, col: str = "close") -> DataFrame:
    return bars.groupBy("asset", F.last_day("ts").alias("month")).agg(
        F.max_by(col, "ts").alias(col)
    )


def smoothed_close(bars: DataFrame, n: int, col: str = "avg_price") -> DataFrame:
    """Replace close by the mean of the last n values; rows before a full window go."""
    return (
        bars.withColumn("close", full(F.avg, col, n))
        .filter(F.col("close").isNotNull())
        .select("asset", "ts", "close")
    )


def aligned_panel(closes: DataFrame, universe: DataFrame, min_rows: int = 0) -> DataFrame:
    """Long-form panel of the dates on which every asset of the universe has a close.

    universe(universe_id, asset, asset_ord) is a list of names, small beside the closes.
    Completeness is a count over one date (as many rows as assets). Since all assets then
    share the same dates, the position in the calendar is each asset's own row number.
    """
    sized = universe.withColumn(
        "n_assets", F.count(F.lit(1)).over(Window.partitionBy("universe_id"))
    )
    day = Window.partitionBy("universe_id", "ts")
    own = Window.partitionBy("universe_id", "asset").orderBy("ts")
    panel = (
        closes.filter(F.col("close").isNotNull())
        .join(sized, "asset")
        .withColumn("_present", F.count(F.lit(1)).over(day))
        .filter(F.col("_present") == F.col("n_assets"))
        .withColumn("pos", F.row_number().over(own) - 1)
    )
    if min_rows:
        every = Window.partitionBy("universe_id", "asset")
        panel = panel.withColumn("_rows", F.count(F.lit(1)).over(every)).filter(
            F.col("_rows") >= min_rows
        )
    return panel.select("universe_id", "ts", "pos", "asset", "asset_ord", "n_assets", "close")


def calendar(panel: DataFrame) -> DataFrame:
    """universe_id, ts, pos: one row per date, taken from the first asset."""
    return panel.filter(F.col("asset_ord") == 0).select("universe_id", "ts", "pos")
