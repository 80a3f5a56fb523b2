"""Equity from signals and NAV from target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.costs import cost_factor
from barframe.functions.windows import ASSET, Keys, cumulative, series

INITIAL_CASH = 10_000.0
COMMISSION = 0.001
SLIPPAGE = 0.0005
POS_BLOCK = 256


def position(entry: str = "entry", exit_: str = "exit", keys: Keys = ASSET, order: str = "ts") -> Column:
    """Long or flat: the last event holds; a bar with both events is ignored."""
    e, x = F.col(entry), F.col(exit_)
    event = F.when(e & ~x, 1).when(x & ~e, 0)
    return F.coalesce(F.last(event, ignorenulls=True).over(cumulative(keys, order)), F.lit(0))


def replay_signals(
    signals: DataFrame,
    commission: float | Column = COMMISSION,
    slippage: float | Column = SLIPPAGE,
    cash: float = INITIAL_CASH,
    keys: Keys = ASSET,
    order: str = "ts",
) -> DataFrame:
    """All-in, all-out equity, filled at the close of the signal bar.

    Adds pos, factor (equity growth of the bar), equity and trade_id (0 outside trades; the
    exit bar belongs to its trade).
    """
    f, s = (v if isinstance(v, Column) else F.lit(v) for v in (commission, slippage))
    w = series(keys, order)
    buy = 1 / ((1 + s) * (1 + f))
    sell = (1 - s) * (1 - f)
    held = F.col("_prev") == 1
    return (
        signals.withColumn("pos", position(keys=keys, order=order))
        .withColumn("_prev", F.coalesce(F.lag("pos").over(w), F.lit(0)))
        .withColumn("_growth", F.when(held, F.col("close") / F.lag("close").over(w)).otherwise(1.0))
        .withColumn(
            "factor",
            F.col("_growth")
            * F.when(~held & (F.col("pos") == 1), buy)
            .when(held & (F.col("pos") == 0), sell)
            .otherwise(1.0),
        )
        .withColumn("equity", F.lit(cash) * F.exp(F.sum(F.ln("factor")).over(cumulative(keys, order))))
        .withColumn(
            "_opened",
            F.sum(F.when(~held & (F.col("pos") == 1), 1).otherwise(0)).over(cumulative(keys, order)),
        )
        .withColumn(
            "trade_id", F.when((F.col("pos") == 1) | held, F.col("_opened")).otherwise(0)
        )
        .drop("_prev", "_growth", "_opened")
    )


def signal_trades(equity: DataFrame, keys: Keys = ASSET, order: str = "ts") -> DataFrame:
    """One row per trade; a trade still open at the end counts with its value so far."""
    return (
        equity.filter(F.col("trade_id") > 0)
        .groupBy(*keys, "trade_id")
        .agg(
            F.min(order).alias("entry_ts"),
            F.max(order).alias("last_ts"),
            (F.exp(F.sum(F.ln("factor"))) - 1).alias("trade_return"),
            (F.min("pos") == 1).alias("is_open"),
        )
    )


def run_bars(panel: DataFrame, runs: DataFrame) -> DataFrame:
    """The panel rows of each run. The position range is joined block by block, so the join
    key spreads a long or busy universe over many partitions."""
    blocks = F.sequence(
        F.floor(F.col("pos0") / POS_BLOCK).cast("int"), F.floor(F.col("pos1") / POS_BLOCK).cast("int")
    )
    wanted = runs.select(
        "run_id", "universe_id", "pos0", "pos1",
        F.posexplode("assets").alias("_ord", "asset"),
    ).select("*", F.explode(blocks).alias("_block"))
    held = panel.select(
        "universe_id", "asset", "pos", "ts", "close",
        F.floor(F.col("pos") / POS_BLOCK).cast("int").alias("_block"),
    )
    return (
        wanted.join(held, ["universe_id", "asset", "_block"])
        .filter(F.col("pos").between(F.col("pos0"), F.col("pos1")))
        .select("run_id", "universe_id", "asset", F.col("_ord").alias("asset_ord"), "pos", "ts", "close")
    )


def replay_weights(
    bars: DataFrame,
    weights: DataFrame,
    cost: float | Column = COMMISSION + SLIPPAGE,
    cash: float = INITIAL_CASH,
    run_keys: Keys = ("run_id",),
) -> DataFrame:
    """NAV of each run from its target weights.

    bars(run keys, asset, pos, ts, close) are the run's dates; weights(run keys, exec_pos, asset,
    weight) hold one row per asset on each order date. Between orders the value of a book depends
    only on the weights of the last order and the price ratios since, so each bar is computed
    from its own row; the rebalance cost is a fixed point per order; the rest is one running
    product per run.

    Output: run keys, pos, ts, nav, is_order, cost_paid, traded, sells, holdings, exposure.
    """
    keys = tuple(run_keys)
    c = cost if isinstance(cost, Column) else F.lit(cost)
    orders = weights.select(*keys, F.col("exec_pos").alias("pos"), "asset", "weight")
    own = cumulative((*keys, "asset"), "pos")
    lagged = series((*keys, "asset"), "pos")
    legs = (
        bars.select(*keys, "asset", "pos", "ts", "close")
        .join(orders, [*keys, "asset", "pos"], "left")
        .withColumn("w", F.last("weight", ignorenulls=True).over(own))
        .withColumn(
            "p0", F.last(F.when(F.col("weight").isNotNull(), F.col("close")), ignorenulls=True).over(own)
        )
        .withColumn("w_prev", F.coalesce(F.lag("w").over(lagged), F.lit(0.0)))
        .withColumn("value", F.coalesce(F.col("w") * F.col("close") / F.col("p0"), F.lit(0.0)))
        .withColumn(
            "value_prev",
            F.coalesce(F.col("w_prev") * F.col("close") / F.lag("p0").over(lagged), F.lit(0.0)),
        )
    )
    is_order = F.col("weight").isNotNull()
    daily = legs.groupBy(*keys, "pos").agg(
        F.first("ts").alias("ts"),
        F.max(is_order).alias("is_order"),
        (1 - F.sum(F.coalesce("w", F.lit(0.0))) + F.sum("value")).alias("g"),
        (1 - F.sum("w_prev") + F.sum("value_prev")).alias("g_prev"),
        F.sum("value").alias("invested"),
        F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("holdings"),
        F.collect_list(
            F.when(is_order, F.struct(F.col("weight").alias("w"), F.col("value_prev").alias("v")))
        ).alias("legs"),
    )
    by_run = series(keys, "pos")
    x = F.when(F.col("is_order"), cost_factor(F.col("legs"), F.col("g_prev"), c)).otherwise(1.0)
    return (
        daily.withColumn("x", x)
        .withColumn(
            "_traded",
            F.when(
                F.col("is_order"),
                F.aggregate(
                    "legs", F.lit(0.0),
                    lambda a, leg: a + F.abs(leg["w"] * F.col("x") - leg["v"] / F.col("g_prev")),
                ),
            ).otherwise(0.0),
        )
        .withColumn(
            "sells",
            F.when(
                F.col("is_order"),
                F.size(F.filter(
                    "legs",
                    lambda leg: leg["w"] * F.col("x") < leg["v"] / F.col("g_prev") - 1e-12,
                )),
            ).otherwise(0),
        )
        .withColumn("_growth", F.coalesce(F.col("g_prev") / F.lag("g").over(by_run), F.lit(1.0)))
        .withColumn(
            "nav",
            F.lit(cash)
            * F.exp(F.sum(F.ln(F.col("_growth") * F.col("x"))).over(cumulative(keys, "pos"))),
        )
        .select(
            *keys, "pos", "ts", "nav", "is_order",
            (F.col("nav") / F.col("x") * F.col("_traded")).alias("traded"),
            (F.col("nav") / F.col("x") * (1 - F.col("x"))).alias("cost_paid"),
            "sells", "holdings", (F.col("invested") / F.col("g")).alias("exposure"),
        )
    )
