"""Per-run metrics over equity, NAV and trade tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.functions.windows import ASSET, Keys, cumulative, series


def buy_and_hold(bars: DataFrame, keys: Keys = ASSET, order: str = "ts") -> DataFrame:
    first = F.min_by("close", order)
    last = F.max_by("close", order)
    return (
        bars.filter(F.col("close").isNotNull())
        .groupBy(*keys)
        .agg(F.count("*").alias("n_rows"), ((last / first - 1) * 100).alias("buy_and_hold_pct"))
        .filter(F.col("n_rows") >= 2)
        .drop("n_rows")
    )


def equal_weight_benchmark(panel: DataFrame, runs: DataFrame) -> DataFrame:
    """Equal-weight buy and hold of each run's assets between its ends, in percent; of the core
    asset alone for a crisis hedge. Fetches two prices per asset instead of the whole path."""
    ends = runs.select(
        "run_id", "universe_id", "family", F.posexplode("assets").alias("_ord", "asset"),
        "pos0", "pos1",
    ).select("*", F.explode(F.array("pos0", "pos1")).alias("pos"))
    prices = ends.join(panel.select("universe_id", "asset", "pos", "close"), ["universe_id", "asset", "pos"])
    growth = prices.groupBy("run_id", "family", "asset", "_ord").agg(
        (F.max(F.when(F.col("pos") == F.col("pos1"), F.col("close")))
         / F.max(F.when(F.col("pos") == F.col("pos0"), F.col("close")))).alias("g")
    )
    counted = (F.col("family") != "crisis_hedge") | (F.col("_ord") == 0)
    return growth.groupBy("run_id").agg(
        ((F.avg(F.when(counted, F.col("g"))) - 1) * 100).alias("benchmark_pct")
    )


# Replays are annualised by calendar days; daily strategy returns elsewhere by TRADING_DAYS.
REPLAY_YEAR = 365


def sharpe(mean: Column, std: Column, periods: int = REPLAY_YEAR) -> Column:
    return mean / F.nullif(std, F.lit(0.0)) * math.sqrt(periods)


def equity_metrics(
    equity: DataFrame,
    cash: float,
    keys: Keys,
    order: str,
    value: str = "equity",
    exposure: str | Column = "pos",
    periods: int = REPLAY_YEAR,
    extra: tuple[Column, ...] = (),
) -> DataFrame:
    """Total return, Sharpe, max drawdown, Ulcer index, exposure and final value per key, with
    any further aggregates of the same rows."""
    w = series(keys, order)
    exp = F.col(exposure) if isinstance(exposure, str) else exposure
    marked = (
        equity.withColumn("_ret", F.col(value) / F.coalesce(F.lag(value).over(w), F.lit(cash)) - 1)
        .withColumn("_dd", F.col(value) / F.max(value).over(cumulative(keys, order)) - 1)
        .withColumn("_exp", exp)
    )
    return marked.groupBy(*keys).agg(
        F.count("*").alias("n_obs"),
        ((F.max_by(value, order) / cash - 1) * 100).alias("total_return_pct"),
        sharpe(F.avg("_ret"), F.stddev_samp("_ret"), periods).alias("sharpe_ratio"),
        (F.min("_dd") * 100).alias("max_drawdown_pct"),
        (F.sqrt(F.avg(F.pow(F.col("_dd") * 100, 2)))).alias("ulcer_index"),
        (F.avg("_exp") * 100).alias("exposure_pct"),
        F.max_by(value, order).alias("final_equity"),
        *extra,
    )


def trade_stats(trades: DataFrame, keys: Keys, ret: str = "trade_return") -> DataFrame:
    """Count, win rate, profit factor with a loss floor, population skew from 3 trades."""
    r = F.col(ret)
    won = F.sum(F.when(r > 0, r).otherwise(0.0))
    lost = F.sum(F.when(r < 0, -r).otherwise(0.0))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("num_trades"),
        (F.avg(F.when(r > 0, 1.0).otherwise(0.0)) * 100).alias("win_rate_pct"),
        (won / F.when(lost > 0, lost).otherwise(1e-4)).alias("profit_factor"),
        F.when(F.count("*") >= 3, F.skewness(r)).alias("return_skew"),
    )


def signal_metrics(
    equity: DataFrame,
    trades: DataFrame,
    bars: DataFrame,
    cash: float,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    """The full metrics record of each signal replay."""
    return (
        equity_metrics(equity, cash, keys, order)
        .join(trade_stats(trades, keys), list(keys), "left")
        .join(buy_and_hold(bars, keys, order), list(keys), "left")
        .withColumn("num_trades", F.coalesce("num_trades", F.lit(0)))
        .withColumn("beats_benchmark", F.col("total_return_pct") > F.col("buy_and_hold_pct"))
    )


def nav_metrics(
    nav: DataFrame, benchmark: DataFrame, cash: float, run_keys: Keys = ("run_id",), periods: int = REPLAY_YEAR
) -> DataFrame:
    """The metrics record of each weight replay. A trade is a sale or a position open at the end."""
    counts = (
        (F.sum("sells") + F.max_by("holdings", "pos")).alias("num_trades"),
        F.sum(F.when(F.col("is_order"), 1).otherwise(0)).alias("rebalances"),
    )
    return (
        equity_metrics(nav, cash, run_keys, "pos", "nav", "exposure", periods, counts)
        .drop("ulcer_index")
        .join(benchmark, list(run_keys))
        .withColumn("beats_benchmark", F.col("total_return_pct") > F.col("benchmark_pct"))
    )
