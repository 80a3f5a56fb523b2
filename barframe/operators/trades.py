"""Trades with a hard and a trailing stop, their summaries and validation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.windows import ASSET, Keys, cumulative, series
from barframe.operators.stops import FAN, PICK, chained, first_hits
from barframe.session import written



def indexed(df: DataFrame, keys: Keys = ASSET, order: str = "ts") -> DataFrame:
    """Adds i (row of the series, from 0) and last_i."""
    return df.withColumn("i", F.row_number().over(series(keys, order)) - 1).withColumn(
        "last_i", F.count(F.lit(1)).over(Window.partitionBy(*keys)) - 1
    )


def stop_trades(
    prepared: DataFrame,
    settings: Sequence[tuple[str, float, float]],
    side: str = "long",
    keys: Keys = ASSET,
    order: str = "ts",
    fan: int = FAN,
    pick: int = PICK,
) -> DataFrame:
    """Trades of each series under each stop setting (param_id, sl_atr, trail_atr).

    prepared has open, high, low, close, atr and raw_entry. A signal on bar i fills at the next
    open. Where a fill would exit depends on that fill alone, so all candidates descend to their
    first hit at once (`stops.first_hits`). The stop on a bar uses closes before that bar. A trade
    is taken when its signal comes after the exit bar of the trade before it: entries of a series
    are numbered, the number of entries up to the exit bar is the next one's, and the chain of these
    links from the first entry is the pick (`stops.chained`).
    """
    sign = 1 if side == "long" else -1
    group = (*keys, "param_id")
    grid = F.array(*[
        F.struct(
            F.lit(name).alias("param_id"), F.lit(sl).alias("sl_atr"), F.lit(trail).alias("trail_atr")
        )
        for name, sl, trail in settings
    ])
    w = series(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill_ok = (F.col("fill") > 0) & (F.col("atr") > 0) & ~F.isnan("atr") & ~F.isnan("fill")
    is_entry = F.coalesce(F.col("raw_entry") & F.col("fill").isNotNull() & fill_ok, F.lit(False))
    edge = "low" if side == "long" else "high"
    marked = (
        prepared.select(*keys, order, "open", edge, "close", "atr", "raw_entry")
        .withColumns({"i": F.row_number().over(w) - 1, "fill": F.lead("open").over(w), "fill_ts": F.lead(order).over(w)})
        .withColumn("entry", is_entry)
        .withColumns({
            "upto": F.count(F.when(F.col("entry"), 1)).over(cumulative(keys, order)), "last_i": F.max("i").over(whole),
            "end_ts": F.last(order).over(whole), "end_close": F.last("close").over(whole),
        })
    )
    # Entries and blocks read the bars.
    bars = written(marked.select(
        *keys, "i", F.col(order).alias("at"), (sign * F.col("open")).alias("o"), (sign * F.col(edge)).alias("l"),
        (sign * F.col("close")).alias("c"), "atr", "entry", "fill", "fill_ts", "upto", "last_i", "end_ts", "end_close",
    ), "trade-bars")
    most = bars.agg(F.max("last_i").alias("last"), F.max("upto").alias("entries")).first()
    entries = (
        bars.filter("entry")
        .select(
            *keys, (F.col("upto") - 1).alias("k"), F.col("i").alias("signal_i"), F.col("at").alias("signal_ts"), "fill", "fill_ts",
            F.col("atr").alias("entry_atr"), "last_i", "end_ts", "end_close", F.inline(grid),
        )
        .withColumns({
            "fill_i": F.col("signal_i") + 1, "anchor": sign * F.col("fill"), "wide": F.col("trail_atr") * F.col("entry_atr"),
            "hard": sign * F.col("fill") - F.col("sl_atr") * F.col("entry_atr"),
        })
    )
    exits = first_hits(entries, bars, keys, fan, most["last"] or 0)
    links = exits.select(*group, "k", F.coalesce("hit.upto", F.lit(most["entries"] or 0).cast("bigint")).alias("next"))
    taken = exits.join(chained(links, group, most["entries"] or 0, pick), [*group, "k"])
    exit_price = F.coalesce(sign * F.col("hit.exit_price"), "end_close")
    return taken.select(
        *group, "signal_ts", F.col("fill_ts").alias("entry_ts"), F.coalesce("hit.exit_ts", "end_ts").alias("exit_ts"),
        F.col("fill").alias("entry_price"), exit_price.alias("exit_price"), "entry_atr", "sl_atr", "trail_atr",
        (F.coalesce("hit.exit_i", "last_i") - F.col("fill_i")).cast("int").alias("bars_held"),
        F.when(F.col("hit").isNotNull(), "stop_or_trail").otherwise("end_of_data").alias("exit_reason"),
        (sign * (exit_price - F.col("fill")) / F.col("fill") * 100).alias("gross_return_pct"),
    )


def with_costs(trades: DataFrame, cost_bps: Column | float) -> DataFrame:
    """Net return and R multiple for a cost in basis points per side. Costs do not change which
    trades happen, so a cost grid is a projection of one trade table."""
    c = cost_bps if isinstance(cost_bps, Column) else F.lit(cost_bps)
    risk = F.col("sl_atr") * F.col("entry_atr") / F.col("entry_price") * 100
    return trades.withColumn("net_return_pct", F.col("gross_return_pct") - 2 * c / 100).withColumn(
        "r_multiple", F.col("net_return_pct") / F.nullif(risk, F.lit(0.0))
    )


def with_notional_costs(trades: DataFrame, cost_bps: Column | float) -> DataFrame:
    """Net return where each side pays basis points of its own notional: the exit pays on what it
    sells for, not on the entry."""
    c = (cost_bps if isinstance(cost_bps, Column) else F.lit(cost_bps)) / 10000
    paid = c * (F.col("entry_price") + F.col("exit_price")) / F.col("entry_price") * 100
    return trades.withColumn("net_return_pct", F.col("gross_return_pct") - paid)


def cost_stress(trades: DataFrame, keys: Keys, order: str = "entry_ts") -> DataFrame:
    """Summary of trades after costs on notional: returns are summed as R, a table without losing
    trades divides its gains by 0.0001."""
    net = F.col("net_return_pct")
    marked = trades.withColumn("_eq", F.product(1 + net / 100).over(cumulative(keys, order)))
    marked = marked.withColumn("_dd", (F.col("_eq") / F.max("_eq").over(cumulative(keys, order)) - 1) * 100)
    gain, loss = F.sum(F.when(net > 0, net).otherwise(0.0)), F.abs(F.sum(F.when(net <= 0, net)))
    loss = F.coalesce(loss, F.lit(0.0001))
    return marked.groupBy(*keys).agg(
        F.count("*").alias("trades"), ((F.product(1 + net / 100) - 1) * 100).alias("net_return_pct"),
        ((F.product(1 + F.col("gross_return_pct") / 100) - 1) * 100).alias("gross_return_pct"),
        (F.avg((net > 0).cast("double")) * 100).alias("win_rate"), F.avg(net).alias("avg_r"), F.sum(net).alias("total_r"),
        F.min("_dd").alias("max_dd_pct"), F.when(loss > 0, gain / loss).otherwise(float("inf")).alias("profit_factor"),
        F.avg("bars_held").alias("avg_hold_bars"),
    )


def summarize_trades(trades: DataFrame, keys: Keys, order: str = "entry_ts") -> DataFrame:
    """Trade count, compounded returns, R totals, win rate, profit factor (infinite without
    losses), drawdown of the trade curve, mean holding time."""
    net = F.col("net_return_pct")
    curve = F.product(1 + net / 100).over(cumulative(keys, order))
    marked = trades.withColumn("_eq", curve).withColumn(
        "_dd", (F.col("_eq") / F.max("_eq").over(cumulative(keys, order)) - 1) * 100
    )
    gains = F.sum(F.when(net > 0, net).otherwise(0.0))
    losses = F.sum(F.when(net < 0, -net).otherwise(0.0))
    return marked.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        ((F.product(1 + net / 100) - 1) * 100).alias("net_return_pct"),
        ((F.product(1 + F.col("gross_return_pct") / 100) - 1) * 100).alias("gross_return_pct"),
        F.coalesce(F.sum("r_multiple"), F.lit(0.0)).alias("total_r"),
        F.avg("r_multiple").alias("avg_r"),
        (F.avg((net > 0).cast("double")) * 100).alias("win_rate"),
        F.when(losses > 0, gains / losses).when(gains > 0, float("inf")).alias("profit_factor"),
        F.min("_dd").alias("max_dd_pct"),
        F.avg("bars_held").alias("avg_hold_bars"),
    )


def r_metrics(trades: DataFrame, keys: Keys, cap: float = 999.99) -> DataFrame:
    """R-based summary with a capped profit factor, rounded as reported."""
    r = F.col("r_multiple")
    ret = F.col("gross_return_pct")
    gain = F.sum(F.when(r > 0, r).otherwise(0.0))
    loss = F.abs(F.sum(F.when(r <= 0, r).otherwise(0.0)))
    pf = F.when(loss < 1e-10, F.when(gain > 0, cap).otherwise(0.0)).otherwise(gain / loss)
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.sum((r > 0).cast("int")).alias("wins"),
        F.round(F.sum(r), 4).alias("total_r"),
        F.round(F.avg(r), 4).alias("avg_r"),
        F.round(F.avg((r > 0).cast("double")) * 100, 2).alias("win_rate"),
        F.round(pf, 4).alias("profit_factor"),
        F.round(F.min(ret), 4).alias("max_mae_pct"),
        F.round(F.avg("bars_held"), 2).alias("avg_bars_held"),
        F.round(F.avg(ret), 4).alias("avg_return_pct"),
        F.round((F.product(1 + ret / 100) - 1) * 100, 4).alias("total_return_pct"),
    )


def positive_years(yearly: DataFrame, keys: Keys) -> DataFrame:
    """yearly(keys, year, trades, total_r) -> share of traded years with a positive total R."""
    won = F.sum((F.col("total_r") > 0).cast("int"))
    return yearly.filter(F.col("trades") > 0).groupBy(*keys).agg(
        (won / F.count("*") * 100).alias("positive_year_pct"),
        won.alias("positive_years"),
        F.count("*").alias("tested_years"),
    )


def lockbox_gate(cost_bps: Column, pos_year_pct: Column) -> Column:
    """Needs lockbox columns trades, total_r, profit_factor."""
    return F.coalesce(
        (cost_bps == 10)
        & (F.col("trades") >= 8)
        & (F.col("total_r") > 0)
        & (F.col("profit_factor") > 1.1)
        & (pos_year_pct >= 50),
        F.lit(False),
    )


def cost_survivorship(by_cost: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """by_cost(keys, cost_bps, trades, net_return_pct) -> survivors per level, erosion per key."""
    survives = (F.col("net_return_pct") > 0) & (F.col("trades") >= 5)
    levels = by_cost.groupBy("cost_bps").agg(
        F.count("*").alias("candidates"),
        F.sum(F.coalesce(survives, F.lit(False)).cast("int")).alias("survivors"),
    )

    def at(level: int) -> Column:
        return F.max(F.when(F.col("cost_bps") == level, F.col("net_return_pct")))

    erosion = by_cost.groupBy(*keys).agg(
        at(0).alias("net_0bps"), at(20).alias("net_20bps"), (at(0) - at(20)).alias("erosion_pct")
    )
    return levels, erosion


def open_stops(trades: DataFrame, prepared: DataFrame, keys: Keys = ASSET, order: str = "ts") -> DataFrame:
    """The last trade of each series and setting; for one still open, its stops as of the
    latest bar (the trailing stop uses closes before that bar). Every bar knows the highest close
    from itself to the bar before the last, so a trade needs the bar of its entry only."""
    group = (*keys, "param_id")
    w = series(keys, order)
    last = trades.groupBy(*group).agg(F.max_by(F.struct("*"), "entry_ts").alias("t")).select("t.*")
    before_last = F.when(F.lead(order).over(w).isNotNull(), F.col("close"))
    path = prepared.select(*keys, order, "close").withColumn("_c", before_last).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col(order).alias("_ts"),
        F.max("_c").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_high"),
    )
    on = F.col("_ts") == F.col("entry_ts")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    high = last.join(path, on, "left")
    anchor = F.greatest("entry_price", "_high")
    is_open = F.col("exit_reason") == "end_of_data"
    hard = F.col("entry_price") - F.col("sl_atr") * F.col("entry_atr")
    trail = anchor - F.col("trail_atr") * F.col("entry_atr")
    return high.select(
        *group, "entry_ts", "entry_price", is_open.alias("is_open"),
        F.when(is_open, hard).alias("hard_stop"), F.when(is_open, trail).alias("trailing_stop"),
        F.when(is_open, F.greatest(hard, trail)).alias("active_stop"),
    )


# A walk-forward window has TRAIN parts of training rows and TEST of test rows; about WINDOWS fit a series.
TRAIN, TEST, WINDOWS = 3, 2, 8
LEAST_STEP, LEAST_TRAIN, LEAST_TEST = 20, 50, 10


def _share(rows: Column, part: int, of: int) -> Column:
    return F.floor(rows * part / of).cast("int")


def window_sizes(n: Column) -> Column:
    """struct(total, test) of a series of n rows: trained on its share of an even step, or on a
    quarter of the series where that window would pass half of it."""
    step = F.greatest(_share(n, 1, WINDOWS), F.lit(LEAST_STEP))

    def window(train: Column) -> Column:
        t = F.greatest(train, F.lit(LEAST_TRAIN))
        s = F.greatest(_share(t, TEST, TRAIN), F.lit(LEAST_TEST))
        return F.struct((t + s).alias("total"), s.alias("test"))

    even, quarter = window(_share(step, TRAIN, TRAIN + TEST)), window(_share(n, 1, 4))
    return F.when(even["total"] <= _share(n, 1, 2), even).otherwise(quarter)


def walk_forward_windows(
    sizes: DataFrame, year_starts: DataFrame, keys: Keys = ASSET, bars_per_day: int = 1
) -> DataFrame:
    """Train and test row ranges of each series: sliding windows and calendar years, without
    repeats, dropping a window when more than half of its test rows overlap the last one kept.

    sizes(keys, n); year_starts(keys, year, at): first row of each year after the first.
    Row ends are exclusive. A series has a handful of windows, so they are folded as one array.
    """
    sized = sizes.withColumn("_w", window_sizes(F.col("n"))).withColumn(
        "_train", (F.col("_w.total") - F.col("_w.test")).cast("int")
    )
    train = F.col("_train")
    step = F.greatest(_share(train, 1, 4), F.lit(1))
    need, test = _share(train, TRAIN + TEST, TRAIN), _share(train, TEST, TRAIN)

    def window(a: Column, b: Column, c: Column, d: Column) -> Column:
        return F.struct(
            c.cast("int").alias("test_from"), a.cast("int").alias("train_from"),
            b.cast("int").alias("train_to"), d.cast("int").alias("test_to"),
        )

    starts = F.when(F.col("n") >= need, F.sequence(F.lit(0), F.col("n") - need, step)).otherwise(
        F.array().cast("array<int>")
    )
    sliding = F.filter(
        F.transform(
            starts,
            lambda s: window(s, s + train, s + train, F.least(s + train + test, F.col("n"))),
        ),
        lambda x: x["test_to"] - x["test_from"] >= 5,
    )
    years = year_starts.groupBy(*keys).agg(F.array_sort(F.collect_set("at")).alias("_years"))
    annual = F.filter(
        F.transform(
            F.coalesce("_years", F.array().cast("array<int>")),
            lambda y: window(F.lit(0), y - 1, y, F.least(y + 252 * bars_per_day, F.col("n") - 1)),
        ),
        lambda x: (F.col("n") >= 252 * 3) & (x["train_to"] >= 100) & (x["test_to"] - x["test_from"] >= 10),
    )
    whole = _share(F.col("n"), TRAIN, TRAIN + TEST)
    both = F.array_distinct(F.concat(sliding, annual))
    found = F.when(F.size(both) > 0, both).otherwise(
        F.array(window(F.lit(0), whole, whole, F.col("n")))
    )

    def keep(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        overlap = F.least(last["test_to"], x["test_to"]) - F.greatest(last["test_from"], x["test_from"])
        crowded = F.greatest(F.lit(0), overlap) > 0.5 * (x["test_to"] - x["test_from"])
        return F.when((F.size(acc) > 0) & crowded, acc).otherwise(F.concat(acc, F.array(x)))

    ordered = F.array_sort(
        found,
        lambda p, q: F.when(p["test_from"] < q["test_from"], -1).when(p["test_from"] > q["test_from"], 1).otherwise(0),
    )
    kept = F.aggregate("_found", F.slice("_found", 1, 0), keep)
    return (
        sized.join(years, list(keys), "left")
        .withColumn("_found", ordered)
        .select(*keys, F.posexplode(kept).alias("window", "_x"))
        .select(*keys, "window", "_x.train_from", "_x.train_to", "_x.test_from", "_x.test_to")
    )


def stability(windows: DataFrame, keys: Keys) -> DataFrame:
    """windows(keys, window, train_return, test_return, test_pf, test_trades) -> score, decay and
    verdict over the windows in order."""
    w = Window.partitionBy(*keys).orderBy("window")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    early = F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
    marked = windows.withColumn("_k", F.row_number().over(w)).withColumn("_n", n)

    def share(cond: Column) -> Column:
        return F.avg(cond.cast("double")) * 100

    positive = F.col("test_return") > 0
    late_avg = F.coalesce(F.avg(F.when(~early, F.col("test_return"))), F.lit(0.0))
    out = marked.groupBy(*keys).agg(
        F.count("*").alias("n_windows"),
        share(positive).alias("_pos"),
        share(F.col("test_pf") > 1).alias("_pf"),
        share(positive & (F.col("train_return") > 0)).alias("_both"),
        (late_avg - F.avg(F.when(early, F.col("test_return")))).alias("_decay"),
        F.sum("test_trades").alias("total_test_trades"),
    )
    score = F.round(F.col("_pos") * 0.4 + F.col("_pf") * 0.3 + F.col("_both") * 0.3, 2)
    return out.select(
        *keys, "n_windows", score.alias("score"), F.round("_pos", 1).alias("test_positive_pct"),
        F.round("_pf", 1).alias("test_pf_above_1_pct"), F.round("_both", 1).alias("consistency_pct"),
        F.round("_decay", 4).alias("decay"), "total_test_trades",
        F.when(F.round("_decay", 4) < -30, "DECAY")
        .when((F.round("_pos", 1) >= 50) & (score >= 30), "PASS")
        .otherwise("FAIL")
        .alias("verdict"),
    )
