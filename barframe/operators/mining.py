"""Cross-asset scans: lead/lag correlation, event follow-through and regime splits.

All three compare a leader with a follower on the same calendar. Means, variances and
correlations are algebraic, so pairs of asset blocks meet as date matrices (`pair_blocks`) and no
row of a pair and date is ever made. The panel is aligned, hence the half of the sample a row belongs
to follows from its position or from the leader's own event count. NaN counts as missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.normal import two_sided_p
from barframe.functions.windows import Keys, full, series
from barframe.operators.pair_blocks import (
    BLOCK, CHUNK, PAIR, class_moments, corr, moments, packed, pair_sums, variance,
)

LAGS = (5, 10, 20, 40, 60)
SERIES: Keys = ("universe_id", "asset")
FACT_COLUMNS = (
    "universe_id", "kind", "leader", "follower", "lag_days", "score", "effect", "n_obs", "trials",
    "p_value", "adjusted_p_value", "train_score", "holdout_score",
)


def forward_returns(panel: DataFrame, horizon: int) -> DataFrame:
    w = series(SERIES, "pos")
    return panel.withColumn("fwd", F.lead("close", horizon).over(w) / F.col("close") - 1)


def same_direction(full_: Column, first: Column, second: Column) -> Column:
    return (full_ != 0) & (F.signum(first) == F.signum(full_)) & (F.signum(second) == F.signum(full_))


def sign_stability(full_: Column, first: Column, second: Column) -> Column:
    ratio = F.least(F.abs(first), F.abs(second)) / F.greatest(F.abs(full_), F.lit(1e-12))
    return F.when(same_direction(full_, first, second), F.least(F.lit(1.0), ratio)).otherwise(0.0)


def rank_score() -> Column:
    """Ranking of facts. The stability bonus compares the score, which is never negative, with
    the signed half scores, so a negative effect earns none."""
    p_bonus = 1 + F.greatest(F.lit(0.0), -F.ln(F.greatest(F.col("adjusted_p_value"), F.lit(1e-12)))) / 10
    bonus = sign_stability(F.col("score"), F.col("train_score"), F.col("holdout_score"))
    return F.abs("score") * (1 + bonus) * F.coalesce(p_bonus, F.lit(1.0))


def top_facts(facts: DataFrame, n: int) -> DataFrame:
    """The n best facts of every universe."""
    best = Window.partitionBy("universe_id").orderBy(F.desc("rank_score"), "kind", "leader", "follower", "lag_days")
    ranked = facts.withColumn("rank_score", rank_score()).withColumn("_n", F.row_number().over(best))
    return ranked.filter(F.col("_n") <= n).drop("_n")


def _spans(panel: DataFrame) -> DataFrame:
    """universe_id, t (dates), n_assets."""
    return panel.groupBy("universe_id").agg(
        (F.max("pos") + 1).alias("t"), (F.max("asset_ord") + 1).alias("n_assets")
    )


def corr_p_value(corr: Column, n: Column) -> Column:
    c = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), corr))
    z = 0.5 * F.ln((1 + c) / (1 - c)) * F.sqrt(n - 3)
    return F.when(n <= 3, 1.0).otherwise(two_sided_p(z))


def welch_p_value(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    denom = F.sqrt(var_a / n_a + var_b / n_b)
    ok = (n_a >= 2) & (n_b >= 2) & (denom != 0)
    return F.when(ok, two_sided_p((mean_a - mean_b) / denom)).otherwise(1.0)


def lead_lag_stats(
    panel: DataFrame, lags: tuple[int, ...] = LAGS, horizon: int = 20, block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """n_obs, corr and half-sample corr of leader and lagged follower returns, 80 rows at least. A
    side that does not vary has no corr."""
    fwd = forward_returns(panel, horizon).filter("fwd is not null")
    spans = _spans(panel)
    low, high = min(lags), max(lags)
    ends = fwd.join(spans.select("universe_id", "t"), "universe_id").withColumn("t", F.array(F.col("t").cast("long")))
    leaders = packed(ends, ["fwd"], extra="t", block=block, chunk=chunk)
    followers = packed(fwd, ["fwd"], low, high, block=block, chunk=chunk)

    def tile(c: int, x: np.ndarray, y: np.ndarray, extra: list) -> Iterator[tuple[int, dict]]:
        for lag in lags:
            later = y[0, lag - low:lag - low + chunk]
            cut = min(max((int(extra[0][0]) - horizon - lag) // 2 - c * chunk, 0), chunk)
            yield lag, moments(x[0, :cut], later[:cut], "_1") | moments(x[0, cut:], later[cut:], "_2")

    names = [f"{k}_{h}" for h in (1, 2) for k in ("n", "x", "y", "xx", "yy", "xy")]
    sums = pair_sums(leaders, followers, (["fwd"], ["fwd"]), tile, names, (chunk, chunk + high - low))

    def of(*halves: int) -> list[Column]:
        return [sum((F.col(f"{k}_{h}") for h in halves[1:]), F.col(f"{k}_{halves[0]}")) for k in ("n", "x", "y", "xx", "yy", "xy")]

    def half(h: int) -> Column:
        return F.when(F.col(f"n_{h}") >= 20, F.coalesce(corr(*of(h)), F.lit(0.0))).otherwise(0.0)

    return (
        sums.join(spans.select("universe_id", "n_assets"), "universe_id")
        .select(
            *PAIR, "n_assets", of(1, 2)[0].cast("long").alias("n_obs"), corr(*of(1, 2)).alias("effect"),
            half(1).alias("train_score"), half(2).alias("holdout_score"),
        )
        .filter("n_obs >= 80")
    )


def lead_lag_facts(
    panel: DataFrame,
    lags: tuple[int, ...] = LAGS,
    horizon: int = 20,
    min_abs_corr: float = 0.18,
    max_adjusted_p: float = 0.25,
) -> DataFrame:
    stats = lead_lag_stats(panel, lags, horizon).filter(F.abs("effect") >= min_abs_corr)
    e, a, b = F.col("effect"), F.col("train_score"), F.col("holdout_score")
    trials = F.greatest(F.lit(1), F.col("n_assets") * (F.col("n_assets") - 1) * len(lags))
    stable = F.when(same_direction(e, a, b), F.least(F.abs(e), F.abs(a), F.abs(b))).otherwise(0.0)
    return (
        stats.withColumn("trials", trials)
        .withColumn("p_value", corr_p_value(e, F.col("n_obs")))
        .withColumn("adjusted_p_value", F.least(F.lit(1.0), F.col("p_value") * F.col("trials")))
        .filter(F.col("adjusted_p_value") <= max_adjusted_p)
        .withColumn("score", F.abs(e) * (0.5 + stable))
        .withColumn("kind", F.lit("lead_lag"))
        .select(*FACT_COLUMNS)
    )


def signed_spreads(
    marks: DataFrame, panel: DataFrame, lags: tuple[int, ...], horizon: int, block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """Per pair and lag the counts, means, variances and spreads (in points) of the follower's forward
    returns after the leader's marks(universe_id, asset, pos, side +1/-1).

    The sample of a pair ends where the follower has no forward return, which depends on the lag
    alone; so the half of the sample a mark is in follows from the leader's running count."""
    spans = _spans(panel)
    low, high = min(lags), max(lags)
    counted = marks.withColumn("_rank", F.row_number().over(series(SERIES, "pos"))).join(spans.select("universe_id", "t"), "universe_id")
    usable = [F.count(F.when(F.col("pos") <= F.col("t") - 1 - horizon - v, 1)) for v in lags]
    halves = marks.join(spans.select("universe_id", "t"), "universe_id").groupBy(*SERIES).agg(
        F.array(*[F.floor(n / 2) for n in usable]).alias("_halves")
    )
    order = panel.select(*SERIES, "pos", "asset_ord")
    leaders = packed(
        counted.join(halves, list(SERIES)).join(order, [*SERIES, "pos"]), ["side", "_rank"], extra="_halves", block=block, chunk=chunk
    )
    fwd = forward_returns(panel, horizon).filter("fwd is not null")
    followers = packed(fwd, ["fwd"], low, high, block=block, chunk=chunk)

    def tile(c: int, x: np.ndarray, y: np.ndarray, extra: list) -> Iterator[tuple[int, dict]]:
        side, rank = x
        for k, lag in enumerate(lags):
            later = y[0, lag - low:lag - low + chunk]
            first = rank <= np.array([e[k] for e in extra])[None, :]
            found: dict = {}
            for name, here in (("up", side > 0), ("down", side < 0)):
                found |= class_moments(here & first, later, f"_{name}_1") | class_moments(here & ~first, later, f"_{name}_2")
            yield lag, found

    names = [f"{k}_{s}_{h}" for s in ("up", "down") for h in (1, 2) for k in ("n", "y", "yy")]
    sums = pair_sums(leaders, followers, (["side", "_rank"], ["fwd"]), tile, names, (chunk, chunk + high - low))

    def whole(k: str, s: str) -> Column:
        return F.col(f"{k}_{s}_1") + F.col(f"{k}_{s}_2")

    def spread(up: tuple[Column, Column], down: tuple[Column, Column]) -> Column:
        apart = up[0] / F.nullif(up[1], F.lit(0.0)) - down[0] / F.nullif(down[1], F.lit(0.0))
        return F.coalesce(apart * 100, F.lit(0.0))

    def at(h: int) -> Column:
        return spread(*[(F.col(f"y_{s}_{h}"), F.col(f"n_{s}_{h}")) for s in ("up", "down")])

    both = {s: (whole("n", s), whole("y", s), whole("yy", s)) for s in ("up", "down")}
    return sums.join(spans.select("universe_id", "n_assets"), "universe_id").select(
        *PAIR, "n_assets", *[both[s][0].cast("long").alias(f"n_{s}") for s in both],
        *[(both[s][1] / F.nullif(both[s][0], F.lit(0.0))).alias(f"mean_{s}") for s in both],
        *[variance(*[both[s][i] for i in range(3)]).alias(f"var_{s}") for s in both],
        spread(both["up"][1::-1], both["down"][1::-1]).alias("effect"), at(1).alias("train_score"), at(2).alias("holdout_score"),
    )


def event_marks(
    panel: DataFrame, event_window: int = 20, z_threshold: float = 1.0, lookback: int = 252, min_periods: int = 80
) -> DataFrame:
    """Rows where the leader's trailing return is unusually high (+1) or low (-1)."""
    w = series(SERIES, "pos")
    r = panel.withColumn("_r", F.col("close") / F.lag("close", event_window).over(w) - 1)
    mean = full(F.avg, "_r", lookback, SERIES, "pos", min_periods)
    std = full(F.stddev_samp, "_r", lookback, SERIES, "pos", min_periods)
    z = r.withColumn("zscore", (F.col("_r") - mean) / F.nullif(std, F.lit(0.0)))
    side = F.when(F.col("zscore") >= z_threshold, 1).when(F.col("zscore") <= -z_threshold, -1)
    return z.withColumn("side", side).filter("side is not null").select(*SERIES, "pos", "side")


def event_stats(
    panel: DataFrame, lags: tuple[int, ...] = LAGS, horizon: int = 20, event_window: int = 20,
    z_threshold: float = 1.0, min_events: int = 18,
) -> DataFrame:
    stats = signed_spreads(event_marks(panel, event_window, z_threshold), panel, lags, horizon)
    return stats.filter((F.col("n_up") >= min_events) & (F.col("n_down") >= min_events))


def _spread_facts(stats: DataFrame, kind: str, trials: Column) -> DataFrame:
    e, a, b = F.col("effect"), F.col("train_score"), F.col("holdout_score")
    p = welch_p_value(
        F.col("mean_up"), F.col("var_up"), F.col("n_up"), F.col("mean_down"), F.col("var_down"), F.col("n_down")
    )
    return (
        stats.withColumn("trials", trials)
        .withColumn("p_value", p)
        .withColumn("adjusted_p_value", F.least(F.lit(1.0), F.col("p_value") * F.col("trials")))
        .withColumn("score", F.abs(e) * (0.5 + sign_stability(e, a, b)))
        .withColumn("kind", F.lit(kind))
        .withColumn("n_obs", F.col("n_up") + F.col("n_down"))
        .select(*FACT_COLUMNS)
    )


def event_facts(panel: DataFrame, lags: tuple[int, ...] = LAGS, horizon: int = 20, min_spread_pct: float = 1.0, **kw) -> DataFrame:
    e, a, b = F.col("effect"), F.col("train_score"), F.col("holdout_score")
    stats = event_stats(panel, lags, horizon, **kw).filter(
        (F.abs(e) >= min_spread_pct) & same_direction(e, a, b)
    )
    n = F.col("n_assets")
    return _spread_facts(stats, "event_followthrough", F.greatest(F.lit(1), n * (n - 1) * len(lags)))


def regime_stats(panel: DataFrame, trend_window: int = 63, horizon: int = 20, min_side: int = 40) -> DataFrame:
    w = series(SERIES, "pos")
    trend = F.col("close") / F.lag("close", trend_window).over(w) - 1
    marks = (
        panel.withColumn("_t", trend)
        .withColumn("side", F.when(F.col("_t") > 0, 1).when(F.col("_t") <= 0, -1))
        .filter("side is not null")
        .select(*SERIES, "pos", "side")
    )
    stats = signed_spreads(marks, panel, (0,), horizon).drop("lag_days")
    return stats.filter((F.col("n_up") >= min_side) & (F.col("n_down") >= min_side))


def regime_facts(
    panel: DataFrame, trend_window: int = 63, horizon: int = 20, min_spread_pct: float = 2.0, max_adjusted_p: float = 0.35
) -> DataFrame:
    stats = regime_stats(panel, trend_window, horizon).filter(F.abs("effect") >= min_spread_pct)
    n = F.col("n_assets")
    facts = _spread_facts(stats.withColumn("lag_days", F.lit(None).cast("int")), "regime_split", n * (n - 1))
    return facts.filter(F.col("adjusted_p_value") <= max_adjusted_p)


def mine(panel: DataFrame, top_n: int = 12, lags: tuple[int, ...] = LAGS, horizon: int = 20, **kw) -> DataFrame:
    """The three scans together, best facts first. Mine on train dates only, or the lockbox is
    no longer held out."""
    facts = (
        top_facts(lead_lag_facts(panel, lags, horizon), top_n)
        .unionByName(top_facts(event_facts(panel, lags, horizon), top_n))
        .unionByName(top_facts(regime_facts(panel, **kw), top_n))
    )
    return top_facts(facts.drop("rank_score"), top_n)


def tests_scanned(n_assets: int, n_lags: int) -> int:
    pairs = n_assets * (n_assets - 1)
    return 2 * max(1, pairs * n_lags) + pairs


def fact_text() -> Column:
    """One sentence per fact."""
    lead = F.format_string(
        "%s returns lead %s returns at lag %d with corr %+.2f.", "leader", "follower", "lag_days", "effect"
    )
    event = F.format_string(
        "After a strong or weak move of %s, %s differs by %+.2f points after lag %d.",
        "leader", "follower", "effect", "lag_days",
    )
    regime = F.format_string(
        "%s differs by %+.2f points between up and down trends of %s.", "follower", "effect", "leader"
    )
    return F.when(F.col("kind") == "lead_lag", lead).when(
        F.col("kind") == "event_followthrough", event
    ).otherwise(regime)


def candidate_specs(facts: DataFrame, n: int, z_threshold: float = 1.0, hold: int = 20, cost: float = 0.001) -> DataFrame:
    """Freeze the first n distinct (leader, follower, direction, lag) event facts of every universe
    as specs."""
    direction = F.when(F.col("train_score") + F.col("holdout_score") >= 0, "strength").otherwise("weakness")
    keyed = (
        facts.filter("kind = 'event_followthrough' and lag_days is not null")
        .withColumn("rank_score", rank_score())
        .withColumn("direction", direction)
        .groupBy("universe_id", "leader", F.col("follower").alias("target"), "direction", F.col("lag_days").alias("lag"))
        .agg(F.max("rank_score").alias("rank_score"))
    )
    name = F.concat_ws(
        " ", "leader", "direction", F.lit("->"), "target", F.concat(F.lit("lag"), F.col("lag").cast("string"))
    )
    best = Window.partitionBy("universe_id").orderBy(F.desc("rank_score"), "leader", "target", "lag")
    return keyed.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= n).select(
        name.alias("spec_id"), "universe_id", "leader", "target", "direction",
        F.lit(z_threshold).alias("z_threshold"), "lag", F.lit(hold).alias("hold"), F.lit(cost).alias("cost"),
        "rank_score",
    )
