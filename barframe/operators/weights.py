"""Target weights for a batch of portfolio runs.

A run is one row: run_id, universe_id, assets (ordered names), family, lookback, top_k,
rebalance, skip, hedge_weight, pos0, pos1. Positions count dates of the aligned panel and a
run only looks inside [pos0, pos1], so a train segment, a lockbox, a walk-forward chunk or a
universe with one asset left out is just another row.

Every parameter-dependent window (moving average, variance, mean carry) is the difference of
two running sums of the panel. A rebalance therefore needs the panel at no more than four
positions per asset, fetched by one equi-join, whatever the lookback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.windows import cumulative, safe, series

# Family names as users write them.
FAMILIES = (
    "cross_sectional_momentum",
    "dual_momentum",
    "equal_weight_trend",
    "time_series_momentum",
    "volatility_scaled_momentum",
    "crisis_hedge",
    "cross_sectional_reversal",
    "fx_carry",
)
VOLATILITY_WINDOW = 60

RUN_COLUMNS = (
    "run_id", "universe_id", "assets", "family", "lookback", "top_k", "rebalance", "skip",
    "hedge_weight", "pos0", "pos1",
)


def running_sums(panel: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """The panel with running sums of close, return, squared return and carry.

    carry(universe_id, pos, asset, carry) is joined where a carry family is wanted.
    """
    keys = ("universe_id", "asset")
    if carry is not None:
        panel = panel.join(carry.select(*keys, "pos", "carry"), [*keys, "pos"], "left")
    else:
        panel = panel.withColumn("carry", F.lit(None).cast("double"))
    cum = cumulative(keys, "pos")
    ret = F.col("close") / F.lag("close").over(series(keys, "pos")) - 1
    return (
        panel.withColumn("ret", ret)
        .withColumn("s_close", F.sum("close").over(cum))
        .withColumn("s_ret", F.coalesce(F.sum("ret").over(cum), F.lit(0.0)))
        .withColumn("s_ret2", F.coalesce(F.sum(F.col("ret") * F.col("ret")).over(cum), F.lit(0.0)))
        .withColumn("s_carry", F.coalesce(F.sum("carry").over(cum), F.lit(0.0)))
        .withColumn("n_carry", F.count("carry").over(cum))
        .select(
            *keys, "pos", "close", "s_close", "s_ret", "s_ret2", "s_carry", "n_carry"
        )
    )


def rebalance_positions(pos0: Column, pos1: Column, lookback: Column, every: Column) -> Column:
    """lookback, lookback + every, ... within the run; empty when the run is too short."""
    return F.when(pos0 + lookback <= pos1, F.sequence(pos0 + lookback, pos1, every)).otherwise(
        F.array().cast("array<int>")
    )


def target_weights(sums: DataFrame, runs: DataFrame) -> DataFrame:
    """weights(run_id, universe_id, exec_pos, asset, asset_ord, weight).

    The decision uses data up to the rebalance bar and executes on the next bar, so an
    order decided on the last bar is dropped. Unselected assets appear with weight 0.
    """
    names = runs.select(*RUN_COLUMNS).withColumn("n", F.size("assets"))
    asks = names.select(
        "*", F.explode(rebalance_positions(
            F.col("pos0"), F.col("pos1") - 1, F.col("lookback"), F.col("rebalance")
        )).alias("pos")
    ).select("*", F.posexplode("assets").alias("asset_ord", "asset"))
    vol_n = F.least(F.lit(VOLATILITY_WINDOW), F.col("lookback"))
    roles = F.array(
        F.struct(F.lit("now").alias("role"), F.col("pos").alias("at")),
        F.struct(F.lit("back").alias("role"), (F.col("pos") - F.col("lookback")).alias("at")),
        F.struct(F.lit("skip").alias("role"), (F.col("pos") - F.col("skip")).alias("at")),
        F.struct(F.lit("vol").alias("role"), (F.col("pos") - vol_n).alias("at")),
    )
    needed = F.filter(
        roles,
        lambda r: r["role"].isin("now", "back")
        | ((r["role"] == "skip") & (F.col("family") == "cross_sectional_reversal"))
        | ((r["role"] == "vol") & (F.col("family") == "volatility_scaled_momentum")),
    )
    asks = asks.select("*", F.inline(needed)).drop("assets", "pos0", "pos1")
    found = asks.join(
        sums.withColumnRenamed("pos", "at"), ["universe_id", "asset", "at"]
    )

    def at(role: str, col: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(col)))

    keys = ("run_id", "universe_id", "family", "lookback", "top_k", "hedge_weight", "n", "pos",
            "asset", "asset_ord")
    score = found.groupBy(*keys).agg(
        at("now", "close").alias("c"),
        at("back", "close").alias("c_back"),
        at("skip", "close").alias("c_skip"),
        (at("now", "s_close") - at("back", "s_close")).alias("d_close"),
        (at("now", "s_ret") - at("vol", "s_ret")).alias("d_ret"),
        (at("now", "s_ret2") - at("vol", "s_ret2")).alias("d_ret2"),
        (at("now", "s_carry") - at("back", "s_carry")).alias("d_carry"),
        (at("now", "n_carry") - at("back", "n_carry")).alias("d_n"),
    )
    family = F.col("family")
    trailing = F.col("c") / F.col("c_back") - 1
    above = safe(F.col("c") > F.col("d_close") / F.col("lookback"))
    vn = F.least(F.lit(VOLATILITY_WINDOW), F.col("lookback"))
    variance = F.col("d_ret2") / vn - F.pow(F.col("d_ret") / vn, 2)
    inverse_vol = F.when(variance > 0, 1 / F.sqrt(variance))
    score = (
        score.withColumn("up", above)
        .withColumn("trailing", trailing)
        .withColumn(
            "score",
            F.when(family == "cross_sectional_reversal", 1 - F.col("c_skip") / F.col("c_back"))
            .when(family == "fx_carry", F.col("d_carry") / F.nullif(F.col("d_n"), F.lit(0)))
            .when(family == "dual_momentum", F.when(F.col("trailing") > 0, F.col("trailing")))
            .when(family == "cross_sectional_momentum", F.col("trailing")),
        )
        .withColumn("inverse_vol", F.when(F.col("trailing") > 0, inverse_vol))
    )
    one_day = Window.partitionBy("run_id", "pos")
    ranked = one_day.orderBy(F.col("score").desc_nulls_last(), "asset_ord")
    core_up = F.max(F.when(F.col("asset_ord") == 0, F.col("up"))).over(one_day)
    weight = (
        F.when(family == "equal_weight_trend", F.when(F.col("up"), 1.0 / F.col("n")))
        .when(family == "time_series_momentum", F.when(F.col("trailing") > 0, 1.0 / F.col("n")))
        .when(
            family == "volatility_scaled_momentum",
            F.col("inverse_vol") / F.sum("inverse_vol").over(one_day),
        )
        .when(
            family == "crisis_hedge",
            F.when(core_up & (F.col("asset_ord") == 0), 1.0).when(
                ~core_up & (F.col("asset_ord") == 1), F.col("hedge_weight")
            ),
        )
        .otherwise(
            F.when(
                F.col("score").isNotNull() & (F.row_number().over(ranked) <= F.col("top_k")),
                1.0 / F.col("top_k"),
            )
        )
    )
    return score.withColumn("weight", F.coalesce(weight, F.lit(0.0))).select(
        "run_id", "universe_id", (F.col("pos") + 1).alias("exec_pos"), "asset", "asset_ord", "weight"
    )


def mapped_weights(choice: DataFrame, mapping: DataFrame) -> DataFrame:
    """Frozen state -> basket allocation.

    choice(run_id, universe_id, pos, state, assets) says which state holds at each rebalance;
    mapping(state, asset) is the committed basket. Weight is 1 / basket size.
    """
    sized = mapping.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("state")))
    wanted = choice.select("*", F.posexplode("assets").alias("asset_ord", "asset"))
    return wanted.join(sized, ["state", "asset"], "left").select(
        "run_id", "universe_id", (F.col("pos") + 1).alias("exec_pos"), "asset", "asset_ord",
        F.coalesce(1.0 / F.col("size"), F.lit(0.0)).alias("weight"),
    )


def book_weights(sums: DataFrame, books: DataFrame) -> DataFrame:
    """Core book with a hedge overlay, and the core alone, over the same rebalances.

    books: run_id, universe_id, core, overlay (ordered names), overlay_weight, rule (static or
    regime), lookback, rebalance, pos0, pos1. Output runs are run_id with a variant column.
    The core composite is the mean of close / first close, so its moving average is again a
    difference of running sums.
    """
    asks = books.select(
        "*", F.explode(rebalance_positions(
            F.col("pos0"), F.col("pos1") - 1, F.col("lookback"), F.col("rebalance")
        )).alias("pos")
    )
    roles = F.array(
        F.struct(F.lit("now").alias("role"), F.col("pos").alias("at")),
        F.struct(F.lit("back").alias("role"), (F.col("pos") - F.col("lookback")).alias("at")),
        F.struct(F.lit("base").alias("role"), F.col("pos0").alias("at")),
    )
    core = asks.select("*", F.explode("core").alias("asset")).select("*", F.inline(roles))
    found = core.join(sums.withColumnRenamed("pos", "at"), ["universe_id", "asset", "at"])

    def at(role: str, col: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(col)))

    keys = ("run_id", "universe_id", "core", "overlay", "overlay_weight", "rule", "lookback", "pos")
    state = (
        found.groupBy(*keys, "asset")
        .agg(
            (at("now", "close") / at("base", "close")).alias("rel"),
            ((at("now", "s_close") - at("back", "s_close")) / at("base", "close")).alias("d_rel"),
        )
        .groupBy(*keys)
        .agg(F.avg("rel").alias("composite"), F.avg("d_rel").alias("d_composite"))
        .withColumn("trend_up", F.col("composite") > F.col("d_composite") / F.col("lookback"))
    )
    variants = state.withColumn("variant", F.explode(F.array(F.lit("core"), F.lit("combined"))))
    overlaid = (F.col("variant") == "combined") & ((F.col("rule") == "static") | ~F.col("trend_up"))
    ow = F.when(overlaid, F.col("overlay_weight")).otherwise(0.0)
    n_core = F.size("core")
    return variants.select(
        "run_id", "variant", "universe_id", (F.col("pos") + 1).alias("exec_pos"),
        F.posexplode(F.concat("core", "overlay")).alias("asset_ord", "asset"),
        ow.alias("_ow"), n_core.alias("_nc"), F.size("overlay").alias("_no"),
    ).select(
        "run_id", "variant", "universe_id", "exec_pos", "asset", "asset_ord",
        F.when(F.col("asset_ord") < F.col("_nc"), (1 - F.col("_ow")) / F.col("_nc"))
        .otherwise(F.col("_ow") / F.col("_no"))
        .alias("weight"),
    )
