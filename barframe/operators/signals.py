"""Entry and exit rules. Each function adds boolean columns entry and exit to the bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.windows import ASSET, Keys, cumulative, safe, series
from barframe.operators import indicators as I
from barframe.operators.stops import FAN, LEAVES_BAND, PICK, chained, first_hits
from barframe.session import written


def _with_smas(df: DataFrame, windows: dict[str, int], keys: Keys, order: str) -> DataFrame:
    return df.withColumns({name: I.sma("close", n, keys, order) for name, n in windows.items()})


def _cross(df: DataFrame, a: str, b: str, keys: Keys, order: str) -> DataFrame:
    return df.withColumns({
        "entry": I.crossed_over(a, b, keys, order), "exit": I.crossed_under(a, b, keys, order)
    })


def sma_crossover(
    bars: DataFrame, fast: int = 50, slow: int = 200, keys: Keys = ASSET, order: str = "ts"
) -> DataFrame:
    df = _with_smas(bars, {"_f": fast, "_s": slow}, keys, order)
    return _cross(df, "_f", "_s", keys, order).drop("_f", "_s")


def donchian_breakout(
    bars: DataFrame, entry: int = 55, exit_: int = 20, keys: Keys = ASSET, order: str = "ts"
) -> DataFrame:
    return bars.withColumns({
        "entry": safe(F.col("close") > I.donchian_high(entry, "high", keys, order)),
        "exit": safe(F.col("close") < I.donchian_low(exit_, "low", keys, order)),
    })


def filtered_donchian_breakout(
    bars: DataFrame,
    entry: int = 55,
    exit_: int = 20,
    atr_window: int = 14,
    atr_ma: int = 20,
    regime: int = 200,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    """Breakout only in expanding volatility and an uptrend. Leaving the uptrend also exits,
    and the warm-up of the trend counts as no uptrend."""
    df = donchian_breakout(I.with_atr(bars, atr_window, "_atr", keys, order), entry, exit_, keys, order)
    expanding = safe(F.col("_atr") > I.sma("_atr", atr_ma, keys, order))
    up = safe(F.col("close") > I.sma("close", regime, keys, order))
    return (
        df.withColumns({"_exp": expanding, "_up": up})
        .withColumn("entry", F.col("entry") & F.col("_exp") & F.col("_up"))
        .withColumn("exit", F.col("exit") | ~F.col("_up"))
        .drop("_atr", "_exp", "_up")
    )


def rsi_mean_reversion(
    bars: DataFrame,
    n: int = 14,
    oversold: float = 30.0,
    exit_above: float = 50.0,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    df = I.with_rsi(bars, n, "_rsi", keys, order)
    return df.withColumns({
        "entry": safe(F.col("_rsi") < oversold), "exit": safe(F.col("_rsi") > exit_above)
    }).drop("_rsi")


def filtered_rsi_mean_reversion(
    bars: DataFrame,
    n: int = 14,
    oversold: float = 30.0,
    exit_above: float = 50.0,
    atr_window: int = 14,
    atr_ma: int = 20,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    """Buys dips only while volatility is below its own mean; exits are not filtered."""
    df = I.with_atr(bars, atr_window, "_atr", keys, order)
    df = rsi_mean_reversion(df, n, oversold, exit_above, keys, order)
    calm = safe(F.col("_atr") < I.sma("_atr", atr_ma, keys, order))
    return df.withColumn("_calm", calm).withColumn("entry", F.col("entry") & F.col("_calm")).drop(
        "_atr", "_calm"
    )


def close_donchian(
    bars: DataFrame, entry: int = 20, exit_: int = 10, keys: Keys = ASSET, order: str = "ts"
) -> DataFrame:
    """Channel of closes, with its own exit window."""
    return bars.withColumns({
        "entry": safe(F.col("close") > I.donchian_high(entry, "close", keys, order)),
        "exit": safe(F.col("close") < I.donchian_low(exit_, "close", keys, order)),
    })


def ema_crossover(
    bars: DataFrame, fast: int, slow: int, keys: Keys = ASSET, order: str = "ts"
) -> DataFrame:
    df = I.with_ema(bars, "close", "_f", fast, keys=keys, order=order)
    df = I.with_ema(df, "close", "_s", slow, keys=keys, order=order)
    return _cross(df, "_f", "_s", keys, order).drop("_f", "_s")


def rsi_reversion_simple(
    bars: DataFrame,
    n: int,
    oversold: float = 30.0,
    overbought: float = 70.0,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    df = I.with_rsi_simple(bars, n, "_rsi", keys, order)
    return df.withColumns({
        "entry": safe(F.col("_rsi") < oversold), "exit": safe(F.col("_rsi") > overbought)
    }).drop("_rsi")


def bollinger_reversion(
    bars: DataFrame, n: int, n_std: float = 2.0, keys: Keys = ASSET, order: str = "ts"
) -> DataFrame:
    df = I.with_bollinger(bars, n, n_std, keys, order)
    return df.withColumns({
        "entry": safe(F.col("close") <= F.col("bb_lower")),
        "exit": safe(F.col("close") >= F.col("bb_upper")),
    }).drop("bb_mid", "bb_upper", "bb_lower")


def bollinger_breakout(
    bars: DataFrame, n: int, n_std: float = 2.0, keys: Keys = ASSET, order: str = "ts"
) -> DataFrame:
    df = I.with_bollinger(bars, n, n_std, keys, order)
    return df.withColumns({
        "entry": I.crossed_over("close", "bb_upper", keys, order),
        "exit": I.crossed_under("close", "bb_lower", keys, order),
    }).drop("bb_mid", "bb_upper", "bb_lower")


def macd_crossover(
    bars: DataFrame,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    df = I.with_macd(bars, fast, slow, signal, keys, order)
    return _cross(df, "macd", "macd_signal", keys, order).drop("macd", "macd_signal")


def keltner_reversion(
    bars: DataFrame,
    ema_period: int = 20,
    atr_period: int = 10,
    atr_mult: float = 2.0,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    df = I.with_keltner(bars, ema_period, atr_period, atr_mult, keys, order)
    return df.withColumns({
        "entry": safe(F.col("close") < F.col("kc_lower")),
        "exit": safe(F.col("close") > F.col("kc_upper")),
    }).drop("kc_mid", "kc_upper", "kc_lower", "high", "low")


def sma_trend_filter(
    bars: DataFrame, fast: int, slow: int, trend: int = 200, keys: Keys = ASSET, order: str = "ts"
) -> DataFrame:
    df = sma_crossover(bars, fast, slow, keys, order)
    up = safe(F.col("close") > I.sma("close", trend, keys, order))
    return (
        df.withColumn("_up", up)
        .withColumn("entry", F.col("entry") & F.col("_up"))
        .withColumn("exit", F.col("exit") & ~F.col("_up"))
        .drop("_up")
    )


def sma_dual(
    bars: DataFrame,
    entry_fast: int,
    entry_slow: int,
    exit_fast: int,
    exit_slow: int,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    """One pair of averages to enter, another to exit."""
    df = _with_smas(
        bars, {"_ef": entry_fast, "_es": entry_slow, "_xf": exit_fast, "_xs": exit_slow}, keys, order
    )
    return df.withColumns({
        "entry": I.crossed_over("_ef", "_es", keys, order),
        "exit": I.crossed_under("_xf", "_xs", keys, order),
    }).drop("_ef", "_es", "_xf", "_xs")


def sma_atr_trail(
    bars: DataFrame,
    fast: int,
    slow: int,
    atr_period: int = 14,
    atr_mult: float = 2.0,
    stop_from: str = "bar",
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    """Average cross to enter, ATR distance below the highest close since entry to exit.

    Each entry signal starts a new leg (it resets the high), and only the first stop of a leg
    counts, so a leg is a group of rows and the rule is two running windows. stop_from="bar"
    uses the ATR of the current bar and may stop on the entry bar; stop_from="high" keeps the
    stop set at the last new high and never stops on the entry bar.
    """
    ranged = I.with_atr(I.with_close_range(bars, keys, order), atr_period, "_atr", keys, order)
    df = sma_crossover(ranged, fast, slow, keys, order).withColumn(
        "_leg", F.sum(F.col("entry").cast("int")).over(cumulative(keys, order))
    )
    leg = (*keys, "_leg")
    so_far = cumulative(leg, order)
    df = df.withColumn("_high", F.max("close").over(so_far))
    if stop_from == "bar":
        hit = safe(F.col("close") < F.col("_high") - atr_mult * F.col("_atr"))
    else:
        new_high = F.col("entry") | (F.col("close") > F.lag("_high").over(series(leg, order)))
        stop = F.last(
            F.when(new_high, F.struct((F.col("close") - atr_mult * F.col("_atr")).alias("s"))),
            ignorenulls=True,
        ).over(so_far)["s"]
        hit = safe(F.col("close") <= stop) & ~F.col("entry")
    return (
        df.withColumn("_hit", hit & (F.col("_leg") > 0))
        .withColumn("exit", F.col("_hit") & (F.sum(F.col("_hit").cast("int")).over(so_far) == 1))
        .drop("_leg", "_high", "_atr", "_hit", "high", "low")
    )


def sma_multi_timeframe(
    bars: DataFrame,
    fast: int = 5,
    slow: int = 15,
    filter_fast: int = 20,
    filter_slow: int = 50,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    df = _with_smas(sma_crossover(bars, fast, slow, keys, order),
                    {"_ff": filter_fast, "_fs": filter_slow}, keys, order)
    up = safe(F.col("_ff") > F.col("_fs"))
    return df.withColumns({"entry": F.col("entry") & up, "exit": F.col("exit") & ~up}).drop("_ff", "_fs")


def sma_rsi_filter(
    bars: DataFrame,
    fast: int = 5,
    slow: int = 15,
    rsi_window: int = 14,
    entry_max: float = 70.0,
    exit_min: float = 30.0,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    df = I.with_rsi_simple(sma_crossover(bars, fast, slow, keys, order), rsi_window, "_rsi", keys, order)
    return df.withColumns({
        "entry": F.col("entry") & safe(F.col("_rsi") < entry_max),
        "exit": F.col("exit") & safe(F.col("_rsi") > exit_min),
    }).drop("_rsi")


def sma_volatility_gate(
    bars: DataFrame,
    fast: int = 5,
    slow: int = 15,
    vol_lookback: int = 20,
    threshold: float = 0.8,
    vol_ma: int = 100,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    """Exits are ignored while volatility is high against its own mean."""
    df = sma_crossover(bars, fast, slow, keys, order)
    df = df.withColumn("_r", I.trailing_return(1, "close", keys, order))
    df = df.withColumn("_vol", I.rolling_std("_r", vol_lookback, keys, order))
    ratio = F.col("_vol") / F.nullif(I.sma("_vol", vol_ma, keys, order), F.lit(0.0))
    return df.withColumn("_hot", safe(ratio > threshold)).withColumn(
        "exit", F.col("exit") & ~F.col("_hot")
    ).drop("_r", "_vol", "_hot")


def sma_late_exit(
    bars: DataFrame,
    entry_fast: int = 5,
    entry_slow: int = 15,
    exit_slow: int = 50,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    df = _with_smas(sma_crossover(bars, entry_fast, entry_slow, keys, order), {"_xs": exit_slow}, keys, order)
    prev = F.lag("_xs").over(series(keys, order))
    return df.withColumn("exit", safe(F.col("close") < prev)).drop("_xs")


def sma_partial_exit(
    bars: DataFrame,
    fast: int = 5,
    slow: int = 15,
    cash_share: float = 0.5,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    """Adds level: invested share. A sell signal keeps 1 - cash_share instead of nothing."""
    df = sma_crossover(bars, fast, slow, keys, order)
    event = F.when(F.col("entry"), 1.0).when(F.col("exit"), 1.0 - cash_share)
    return df.withColumn(
        "level",
        F.coalesce(F.last(event, ignorenulls=True).over(cumulative(keys, order)), F.lit(0.0)),
    )


def trend_strength_filter(
    bars: DataFrame,
    fast: int = 5,
    slow: int = 15,
    strength_period: int = 50,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    df = _with_smas(bars, {"_f": fast, "_s": slow}, keys, order)
    df = _cross(df, "_f", "_s", keys, order)
    df = df.withColumn("_str", F.abs(F.col("_f") - F.col("_s")) / F.col("close") * 100)
    df = df.withColumn("_strong", safe(F.col("_str") > I.sma("_str", strength_period, keys, order)))
    return df.withColumns({
        "entry": F.col("entry") & F.col("_strong"), "exit": F.col("exit") & F.col("_strong")
    }).drop("_f", "_s", "_str", "_strong")


def ratchet(bands: DataFrame, keys: Keys, fan: int = FAN, pick: int = PICK) -> DataFrame:
    """bands(keys, i, band, before) with `held`: the band of the bar before stays while the close
    before it is at or below it and it is lower than the bar's own; else the bar's own is taken.

    Which bar gives up the band taken on bar j depends on that band alone, so every bar searches for
    it by descent through blocks, and the chain of these links from the first bar are the bars whose
    own band is taken. A missing band or close takes the own band."""
    w = series(keys, "i")
    known = F.col("band").isNotNull() & F.col("before").isNotNull()
    bars = written(bands.select(
        *keys, "i", "before", F.when(known, F.col("band")).otherwise(float("-inf")).alias("band"), F.col("band").alias("own"),
        F.max("i").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last_i"),
    ), "ratchet-bars")
    last = bars.agg(F.max("last_i")).first()[0] or 0
    searches = bars.select(
        *keys, F.col("i").alias("signal_i"), (F.col("i") + 1).alias("fill_i"), "last_i", F.coalesce("own", F.lit(float("inf"))).alias("anchor")
    )
    found = first_hits(searches, bars, keys, fan, last, LEAVES_BAND)
    links = found.select(*keys, F.col("signal_i").cast("bigint").alias("k"), F.coalesce("hit.exit_i", F.lit(last + 1).cast("bigint")).alias("next"))
    taken = chained(links, keys, last + 1, pick).select(*keys, F.col("k").alias("i"), F.lit(True).alias("_taken"))
    marked = bars.join(taken, [*keys, "i"], "left")
    own = F.last(F.when(F.col("_taken"), F.struct("own")), ignorenulls=True).over(cumulative(keys, "i"))
    return marked.select(*keys, "i", own["own"].alias("held"))


def supertrend(
    bars: DataFrame, period: int = 10, mult: float = 3.0, keys: Keys = ASSET, order: str = "ts"
) -> DataFrame:
    """Stop-and-reverse bands that each depend on the band before. The lower band is an upper one
    of negated prices. Entries and exits set the state, a bar that does both flips it."""
    prepared = I.with_atr(I.with_close_range(bars, keys, order), period, "_atr", keys, order)
    w = series(keys, order)
    mid, nothing = (F.col("high") + F.col("low")) / 2, F.lit(None).cast("double")
    rows = written(prepared.select(
        *keys, order, "close", F.nanvl(mid + mult * F.col("_atr"), nothing).alias("upper"),
        F.nanvl(mid - mult * F.col("_atr"), nothing).alias("lower"), F.nanvl("close", nothing).alias("_c"),
        (F.row_number().over(w) - 1).alias("i"),
    ), "bands")
    before = F.lag("_c").over(w)
    sides = F.array(
        F.struct(F.lit(True).alias("_up"), F.col("upper").alias("band"), F.col("_b").alias("before")),
        F.struct(F.lit(False).alias("_up"), (-F.col("lower")).alias("band"), (-F.col("_b")).alias("before")),
    )
    held = ratchet(rows.withColumn("_b", before).select(*keys, "i", F.inline(sides)), (*keys, "_up"))
    bands = held.groupBy(*keys, "i").agg(
        F.max(F.when(F.col("_up"), F.col("held"))).alias("_high"), F.max(F.when(~F.col("_up"), -F.col("held"))).alias("_low")
    )
    w = series(keys, "i")
    out = rows.join(bands, [*keys, "i"]).withColumns({
        "_in": safe(F.col("_c") > F.lag("_high").over(w)), "_out": safe(F.col("_c") < F.lag("_low").over(w)),
    })
    flips = F.count(F.when(F.col("_in") & F.col("_out"), 1)).over(cumulative(keys, "i"))
    out = out.withColumn("_flips", flips)
    told = F.when(F.col("_in") != F.col("_out"), F.struct(F.col("_in").alias("on"), F.col("_flips").alias("flips")))
    out = out.withColumn("_told", F.last(told, ignorenulls=True).over(cumulative(keys, "i")))
    odd = (F.col("_flips") - F.coalesce("_told.flips", F.lit(0))) % 2 == 1
    out = out.withColumn("_on", F.coalesce("_told.on", F.lit(False)) != odd)
    was = F.coalesce(F.lag("_on").over(w), F.lit(False))
    return out.select(*keys, order, "close", (~was & F.col("_on")).alias("entry"), (was & ~F.col("_on")).alias("exit"))


def trend_pullback_entry(
    bars: DataFrame,
    side: str = "long",
    ema_period: int = 150,
    channel_window: int = 21,
    delay: int = 2,
    atr_window: int = 20,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    """Adds ema, atr, channel and raw_entry: price on the right side of its EMA, back inside a
    channel whose edge it touched some bars ago."""
    df = I.with_ema(bars, "close", "ema", ema_period, min_periods=ema_period, keys=keys, order=order)
    df = I.with_atr(df, atr_window, "atr", keys, order)
    w = series(keys, order)
    if side == "long":
        df = df.withColumn("channel", I.rolling_min("low", channel_window, keys, order))
        touched = F.lag("low", delay).over(w) <= F.lag("channel", delay).over(w)
        rule = (F.col("close") > F.col("ema")) & (F.col("close") > F.col("channel"))
    elif side == "short":
        df = df.withColumn("channel", I.rolling_max("high", channel_window, keys, order))
        touched = F.lag("high", delay).over(w) >= F.lag("channel", delay).over(w)
        rule = (F.col("close") < F.col("ema")) & (F.col("close") < F.col("channel"))
    else:
        raise ValueError("side must be 'long' or 'short'")
    return df.withColumn("raw_entry", safe(rule & touched))


def holding_from_events(
    event: Column | str, lag: int, hold: int, keys: Keys = ASSET, order: str = "ts"
) -> Column:
    """1 while any event lies between lag and lag + hold - 1 bars back, else 0."""
    e = F.col(event) if isinstance(event, str) else event
    w = series(keys, order).rowsBetween(-(lag + hold - 1), -lag)
    return F.coalesce(F.max(safe(e).cast("int")).over(w), F.lit(0))
