"""Two-leg rules: aligned pairs, rolling hedge ratio, spread states, monthly lag rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.windows import Keys, cumulative, safe, series
from barframe.operators import indicators as I

PAIR: Keys = ("pair_id",)


def align_pairs(closes: DataFrame, pairs: DataFrame, order: str = "ts") -> DataFrame:
    """pair_id, date, l1, l2 for each pair(pair_id, leg1, leg2), dates where both exist."""
    one = closes.select(F.col("asset").alias("leg1"), order, F.col("close").alias("l1"))
    two = closes.select(F.col("asset").alias("leg2"), order, F.col("close").alias("l2"))
    return (
        pairs.join(one, "leg1")
        .join(two, ["leg2", order])
        .filter(F.col("l1").isNotNull() & F.col("l2").isNotNull())
        .select("pair_id", order, "l1", "l2")
    )


MOMENTS = ("n", "x", "y", "xx", "xy")


def with_cross_sums(df: DataFrame, keys: Keys = PAIR, order: str = "ts") -> DataFrame:
    """Running sums `_sum_*` of the moments of log leg 2 (x) and log leg 1 (y), each taken from the
    pair's first value so that little is lost in differences. One pass serves windows of any length."""
    w = series(keys, order)
    x, y = F.ln("l2"), F.ln("l1")
    both = x.isNotNull() & y.isNotNull()
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumns({
        "_x": F.when(both, x - F.first(F.when(both, x), ignorenulls=True).over(first)),
        "_y": F.when(both, y - F.first(F.when(both, y), ignorenulls=True).over(first)),
    })
    x, y = F.coalesce("_x", F.lit(0.0)), F.coalesce("_y", F.lit(0.0))
    terms = {"n": F.when(both, 1.0).otherwise(0.0), "x": x, "y": y, "xx": x * x, "xy": x * y}
    return out.withColumns({f"_sum_{k}": F.sum(terms[k]).over(cumulative(keys, order)) for k in MOMENTS}).drop("_x", "_y")


def windowed(lookback: int, keys: Keys = PAIR, order: str = "ts") -> dict[str, Column]:
    """The moments over the `lookback` bars before this one, as differences of running sums."""
    w = series(keys, order)
    return {k: F.lag(f"_sum_{k}").over(w) - F.coalesce(F.lag(f"_sum_{k}", lookback + 1).over(w), F.lit(0.0)) for k in MOMENTS}


def with_hedge_spread(df: DataFrame, lookback: int = 60, keys: Keys = PAIR, order: str = "ts") -> DataFrame:
    """Least-squares slope of log leg 1 on log leg 2 over the bars before this one, and the
    residual of the last of those bars. NULL until the bars are there and where leg 2 does not vary."""
    w = series(keys, order)
    ready = F.count("l1").over(w.rowsBetween(-lookback, -1)) == lookback
    m = windowed(lookback, keys, order)
    sums = with_cross_sums(df, keys, order).withColumns({f"_{k}": m[k] for k in MOMENTS})
    vary = F.col("_xx") - F.col("_x") * F.col("_x") / F.col("_n")
    slope = (F.col("_xy") - F.col("_x") * F.col("_y") / F.col("_n")) / vary
    flat = vary <= 1e-12 * F.greatest(F.col("_xx"), F.lit(1e-12))
    return sums.withColumn("beta", F.when(ready & ~flat, slope)).withColumn(
        "spread", F.lag(F.ln("l1")).over(w) - F.col("beta") * F.lag(F.ln("l2")).over(w)
    ).drop(*[f"_{k}" for k in MOMENTS], *[f"_sum_{k}" for k in MOMENTS])


def _with_z(df: DataFrame, col: str, lookback: int, keys: Keys, order: str) -> DataFrame:
    std = F.nullif(I.rolling_std(col, lookback, keys, order), F.lit(0.0))
    return df.withColumn("zscore", (F.col(col) - I.sma(col, lookback, keys, order)) / std)


def hedge_ratio_signals(
    df: DataFrame,
    lookback: int = 60,
    entry_z: float = 2.0,
    exit_z: float = 0.5,
    keys: Keys = PAIR,
    order: str = "ts",
) -> DataFrame:
    out = _with_z(with_hedge_spread(df, lookback, keys, order), "spread", lookback, keys, order)
    z = F.col("zscore")
    return out.withColumns({
        "entry": safe((z < -entry_z) | (z > entry_z)), "exit": safe((z > -exit_z) | (z < exit_z))
    })


def with_log_ratio_z(df: DataFrame, lookback: int = 60, keys: Keys = PAIR, order: str = "ts") -> DataFrame:
    out = df.withColumn("log_ratio", F.ln("l1") - F.ln("l2"))
    return _with_z(out, "log_ratio", lookback, keys, order)


STATES = (-1, 0, 1)
BLOCK = 256  # bars of a pair that are folded together


def spread_state_signals(
    df: DataFrame,
    lookback: int = 60,
    entry_z: float = 2.0,
    exit_z: float = 0.5,
    keys: Keys = PAIR,
    order: str = "ts",
) -> DataFrame:
    """Short, flat or long on the spread; the next state depends on the current one.

    A bar is a map of the three states. Blocks of bars compose their maps on their own; a pair's
    short list of block maps gives the state that each block begins with, and the blocks replay
    their bars from there."""
    z, row = F.col("zscore"), F.row_number().over(series(keys, order)) - 1
    leaves = {-1: z < exit_z, 1: z > -exit_z}
    to = {s: F.when(leaves[s], 0).otherwise(s) if s else F.when(z < -entry_z, 1).when(z > entry_z, -1).otherwise(0) for s in STATES}
    bars = with_log_ratio_z(df, lookback, keys, order).select(
        *keys, order, "zscore", F.floor(row / BLOCK).alias("_block"), F.array(*[to[s].cast("int") for s in STATES]).alias("_to")
    )
    blocks = bars.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct(order, "zscore", "_to"))).alias("_bars"))

    def step(state: Column, bar: Column) -> Column:
        return F.get(bar["_to"], state + 1)

    ends = F.array(*[F.aggregate("_bars", F.lit(s), step) for s in STATES])
    # One map of three numbers for every BLOCK bars.
    chain = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", ends.alias("_to")))).alias("_maps"))

    def follow(start: Column, maps: Column) -> Column:
        """The state before each map, and after the last one."""
        return F.aggregate(maps, F.array(start), lambda seen, m: F.concat(seen, F.array(step(F.element_at(seen, -1), m))))

    starts = chain.withColumn("_at", follow(F.lit(0), F.col("_maps"))).select(
        *keys, F.inline(F.arrays_zip(F.col("_maps._block").alias("_block"), F.slice("_at", F.lit(1), F.size("_maps")).alias("_start")))
    )
    held = blocks.join(starts, [*keys, "_block"]).withColumn("_at", follow(F.col("_start"), F.col("_bars")))
    n = F.size("_bars")
    out = held.select(*keys, F.inline(F.arrays_zip(
        F.col("_bars").alias("_bar"), F.slice("_at", F.lit(1), n).alias("_before"), F.slice("_at", F.lit(2), n).alias("state")
    )))
    before, state = F.col("_before"), F.col("state")
    return out.select(
        *keys, F.col(f"_bar.{order}").alias(order), "_bar.zscore", "state",
        ((before == 0) & (state != 0)).alias("entry"), ((before != 0) & (state == 0)).alias("exit"),
    )


def spread_extreme_signals(
    df: DataFrame,
    lookback: int = 60,
    entry_z: float = 2.0,
    exit_z: float = 0.0,
    keys: Keys = PAIR,
    order: str = "ts",
) -> DataFrame:
    """Enter on any extreme; exit inside exit_z or when the sign changes."""
    out = with_log_ratio_z(df, lookback, keys, order)
    z = F.col("zscore")
    before = F.coalesce(F.lag("zscore").over(series(keys, order)), F.lit(0.0))
    changed = z.isNull() | (F.signum(z) != F.signum(before))
    return out.withColumns({
        "entry": safe(F.abs(z) > entry_z), "exit": safe(F.abs(z) < exit_z) | changed
    })


def monthly_lag_signals(
    months: DataFrame, lag_months: int = 1, keys: Keys = PAIR, order: str = "month"
) -> DataFrame:
    """l1 follows l2: enter leg 1 a month after leg 2 turns up, leave one month later."""
    w = series(keys, order)
    up = safe(I.trailing_return(lag_months, "l2", keys, order) > 0)
    out = months.withColumn("_up", up)
    fresh = F.coalesce(F.lag("_up").over(w), F.lit(False)) & ~F.coalesce(
        F.lag("_up", 2).over(w), F.lit(False)
    )
    return (
        out.withColumn("entry", fresh)
        .withColumn("exit", F.coalesce(F.lag("entry").over(w), F.lit(False)))
        .drop("_up")
    )


def below_average_short(
    bars: DataFrame, n: int = 200, hold_months: int = 3, keys: Keys = ("asset",)
) -> DataFrame:
    """Month-end rule: close falls below its average; leave some months later."""
    months = (
        bars.withColumn("_sma", I.sma("close", n, keys))
        .groupBy(*keys, F.last_day("ts").alias("month"))
        .agg(F.max_by("close", "ts").alias("close"), F.max_by("_sma", F.when(F.col("_sma").isNotNull(), F.col("ts"))).alias("_sma"))
    )
    w = series(keys, "month")
    out = months.withColumn("_below", safe(F.col("close") < F.col("_sma")))
    return (
        out.withColumn("entry", F.col("_below") & ~F.coalesce(F.lag("_below").over(w), F.lit(True)))
        .withColumn("exit", F.coalesce(F.lag("entry", hold_months).over(w), F.lit(False)))
        .drop("_below", "_sma")
    )


def monthly_ratio(months: DataFrame, keys: Keys = PAIR, order: str = "month") -> DataFrame:
    """Ratio of the legs, entered anew every month."""
    w = series(keys, order)
    n = F.row_number().over(w)
    return months.select(
        *keys, order, (F.col("l1") / F.col("l2")).alias("close"),
        (n > 1).alias("entry"), (n > 2).alias("exit"),
    )
