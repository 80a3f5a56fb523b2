"""Rolling and recursive indicators over bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.windows import ASSET, Keys, cumulative, full, safe, series


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sma(col: str | Column, n: int, keys: Keys = ASSET, order: str = "ts") -> Column:
    return full(F.avg, col, n, keys, order)


def rolling_std(
    col: str | Column, n: int, keys: Keys = ASSET, order: str = "ts", ddof: int = 1
) -> Column:
    return full(F.stddev_samp if ddof else F.stddev_pop, col, n, keys, order)


def rolling_max(col: str | Column, n: int, keys: Keys = ASSET, order: str = "ts") -> Column:
    return full(F.max, col, n, keys, order)


def rolling_min(col: str | Column, n: int, keys: Keys = ASSET, order: str = "ts") -> Column:
    return full(F.min, col, n, keys, order)


def _shifted(agg, col, n: int, keys: Keys, order: str) -> Column:
    w = series(keys, order).rowsBetween(-n, -1)
    return F.when(F.count(_c(col)).over(w) == n, agg(_c(col)).over(w))


def donchian_high(
    n: int, col: str | Column = "high", keys: Keys = ASSET, order: str = "ts"
) -> Column:
    """Highest value of the n bars before this one."""
    return _shifted(F.max, col, n, keys, order)


def donchian_low(
    n: int, col: str | Column = "low", keys: Keys = ASSET, order: str = "ts"
) -> Column:
    return _shifted(F.min, col, n, keys, order)


def true_range(keys: Keys = ASSET, order: str = "ts") -> Column:
    prev = F.lag("close").over(series(keys, order))
    high, low = F.col("high"), F.col("low")
    return F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))


def with_atr(
    df: DataFrame, n: int, out: str = "atr", keys: Keys = ASSET, order: str = "ts"
) -> DataFrame:
    return (
        df.withColumn("_tr", true_range(keys, order))
        .withColumn(out, sma("_tr", n, keys, order))
        .drop("_tr")
    )


def with_close_range(df: DataFrame, keys: Keys = ASSET, order: str = "ts") -> DataFrame:
    """High and low estimated from the last two closes."""
    return df.withColumn("high", rolling_max("close", 2, keys, order)).withColumn(
        "low", rolling_min("close", 2, keys, order)
    )


def trailing_return(
    k: int, col: str | Column = "close", keys: Keys = ASSET, order: str = "ts"
) -> Column:
    return _c(col) / F.lag(_c(col), k).over(series(keys, order)) - 1


def forward_return(
    h: int, col: str | Column = "close", keys: Keys = ASSET, order: str = "ts"
) -> Column:
    return F.lead(_c(col), h).over(series(keys, order)) / _c(col) - 1


def with_event_zscore(
    df: DataFrame,
    event_window: int = 20,
    lookback: int = 252,
    min_periods: int = 80,
    out: str = "zscore",
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    """z-score of the k-bar return against its own trailing window."""
    std = full(F.stddev_samp, "_r", lookback, keys, order, min_periods)
    mean = full(F.avg, "_r", lookback, keys, order, min_periods)
    return (
        df.withColumn("_r", trailing_return(event_window, "close", keys, order))
        .withColumn(out, (F.col("_r") - mean) / F.nullif(std, F.lit(0.0)))
        .drop("_r")
    )


def running_peak(col: str | Column, keys: Keys = ASSET, order: str = "ts") -> Column:
    return F.max(_c(col)).over(cumulative(keys, order))


def drawdown(col: str | Column, keys: Keys = ASSET, order: str = "ts") -> Column:
    return _c(col) / running_peak(col, keys, order) - 1


def compounded(ret: str | Column, keys: Keys = ASSET, order: str = "ts") -> Column:
    """Running product of 1 + r."""
    return F.exp(F.sum(F.log1p(_c(ret))).over(cumulative(keys, order)))


SPAN = 70.0  # of a block's decay, in logarithms


def with_ema(
    df: DataFrame,
    col: str,
    out: str,
    span: int | None = None,
    alpha: float | None = None,
    min_periods: int = 0,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    """y = c*x + (1-c)*y_prev, starting at the first value, without leaving the JVM.

    c is a after a step of one row. A NULL row repeats y, and the weight of the past decays over
    it: k rows after the last value c = a / (a + (1-a)^k). Leading NULLs stay NULL.

    Within a block of rows the recursion is a weighted running sum. Blocks are cut where the decay
    since the start, in logarithms, passes multiples of SPAN: inside one the weights stay within
    double range, and what reaches a row from beyond the previous block is below exp(-SPAN).
    """
    a = alpha if alpha is not None else 2.0 / (span + 1)
    d = 1.0 - a
    every, valid = cumulative(keys, order), F.col(col).isNotNull()
    warm = F.count(col).over(every) >= max(min_periods, 1)
    if d <= 0:
        return df.withColumn(out, F.when(warm, F.last(col, ignorenulls=True).over(every)))
    before = series(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    after = series(keys, order).rowsBetween(1, Window.unboundedFollowing)
    in_block = (
        Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    gap = F.col("_n") - F.last(F.when(valid, F.col("_n")), ignorenulls=True).over(before)
    past = F.pow(F.lit(d), F.col("_gap"))
    share = F.when(F.col("_gap").isNull(), 1.0).otherwise(a / (a + past))
    step = F.coalesce(F.col("_gap") == 1, F.lit(False)) & valid
    wide = F.when(valid & (F.col("_gap") > 1), F.ln(a + past) - F.col("_gap") * math.log(d))
    fade = F.count_if(step).over(every) * -math.log(d) + F.coalesce(F.sum(wide).over(every), F.lit(0.0))
    inside = F.col("_fade") - F.col("_block") * SPAN
    ends = F.coalesce(F.first(F.when(valid, F.col("_block")), ignorenulls=True).over(after) > F.col("_block"), F.lit(True))
    carried = F.last(F.when(valid & F.col("_ends"), F.struct("_local", "_fade")), ignorenulls=True).over(before)
    value = F.col("_local") + F.coalesce(
        F.col("_carry._local") * F.exp(F.col("_carry._fade") - F.col("_fade")), F.lit(0.0)
    )
    return (
        df.withColumn("_n", F.row_number().over(series(keys, order)))
        .withColumn("_gap", gap)
        .withColumn("_fade", fade)
        .withColumn("_block", F.floor(F.col("_fade") / SPAN))
        .withColumn("_ends", ends)
        .withColumn("_local", F.sum(F.when(valid, F.col(col) * share * F.exp(inside))).over(in_block) * F.exp(-inside))
        .withColumn("_carry", carried)
        .withColumn(out, F.when(warm, F.last(F.when(valid, value), ignorenulls=True).over(every)))
        .drop("_n", "_gap", "_fade", "_block", "_ends", "_local", "_carry")
    )


def _gain_loss(df: DataFrame, keys: Keys, order: str) -> DataFrame:
    diff = F.col("close") - F.lag("close").over(series(keys, order))
    return (
        df.withColumn("_diff", diff)
        .withColumn("_gain", F.when(F.col("_diff").isNotNull(), F.greatest("_diff", F.lit(0.0))))
        .withColumn("_loss", F.when(F.col("_diff").isNotNull(), -F.least("_diff", F.lit(0.0))))
    )


def with_rsi(
    df: DataFrame, n: int = 14, out: str = "rsi", keys: Keys = ASSET, order: str = "ts"
) -> DataFrame:
    """RSI with Wilder smoothing. No loss gives 100; no gain gives 0, also when both are 0."""
    g = with_ema(_gain_loss(df, keys, order), "_gain", "_ag", None, 1.0 / n, n, keys, order)
    g = with_ema(g, "_loss", "_al", None, 1.0 / n, n, keys, order)
    rs = F.col("_ag") / F.nullif(F.col("_al"), F.lit(0.0))
    return g.withColumn(
        out,
        F.when(F.col("_ag") == 0, 0.0).when(F.col("_al") == 0, 100.0).otherwise(100 - 100 / (1 + rs)),
    ).drop("_diff", "_gain", "_loss", "_ag", "_al")


def with_rsi_simple(
    df: DataFrame, n: int, out: str = "rsi", keys: Keys = ASSET, order: str = "ts"
) -> DataFrame:
    """RSI with plain means; NULL when there was no loss."""
    g = _gain_loss(df, keys, order)
    rs = sma("_gain", n, keys, order) / F.nullif(sma("_loss", n, keys, order), F.lit(0.0))
    return g.withColumn(out, 100 - 100 / (1 + rs)).drop("_diff", "_gain", "_loss")


def with_macd(
    df: DataFrame,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    out = with_ema(df, "close", "_ef", fast, keys=keys, order=order)
    out = with_ema(out, "close", "_es", slow, keys=keys, order=order)
    out = out.withColumn("macd", F.col("_ef") - F.col("_es"))
    return with_ema(out, "macd", "macd_signal", signal, keys=keys, order=order).drop("_ef", "_es")


def with_bollinger(
    df: DataFrame, n: int, n_std: float = 2.0, keys: Keys = ASSET, order: str = "ts"
) -> DataFrame:
    mid, std = sma("close", n, keys, order), rolling_std("close", n, keys, order)
    return (
        df.withColumn("bb_mid", mid)
        .withColumn("_sd", std)
        .withColumn("bb_upper", F.col("bb_mid") + n_std * F.col("_sd"))
        .withColumn("bb_lower", F.col("bb_mid") - n_std * F.col("_sd"))
        .drop("_sd")
    )


def with_keltner(
    df: DataFrame,
    ema_period: int = 20,
    atr_period: int = 10,
    atr_mult: float = 2.0,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    """Keltner channel of a close-only series."""
    out = with_atr(with_close_range(df, keys, order), atr_period, "_atr", keys, order)
    out = with_ema(out, "close", "kc_mid", ema_period, keys=keys, order=order)
    return (
        out.withColumn("kc_upper", F.col("kc_mid") + atr_mult * F.col("_atr"))
        .withColumn("kc_lower", F.col("kc_mid") - atr_mult * F.col("_atr"))
        .drop("_atr")
    )


def crossed_over(a: str, b: str, keys: Keys = ASSET, order: str = "ts") -> Column:
    w = series(keys, order)
    return safe((F.col(a) > F.col(b)) & (F.lag(a).over(w) <= F.lag(b).over(w)))


def crossed_under(a: str, b: str, keys: Keys = ASSET, order: str = "ts") -> Column:
    w = series(keys, order)
    return safe((F.col(a) < F.col(b)) & (F.lag(a).over(w) >= F.lag(b).over(w)))
