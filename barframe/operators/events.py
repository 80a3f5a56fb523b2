"""Delayed event strategies: positions, daily returns, segment metrics, stress and gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.session import written
from barframe.functions.windows import Keys, cumulative, full, series

SERIES: Keys = ("universe_id", "asset")


def event_daily(panel: DataFrame, specs: DataFrame, event_window: int = 20, lookback: int = 252) -> DataFrame:
    """Daily position and returns of each spec over the whole panel.

    specs: spec_id, universe_id, leader, target, direction (strength or weakness), z_threshold,
    lag, hold, cost. A bar is held when the latest event at or before pos - lag is no more than
    hold - 1 bars older, so one running maximum and one shifted equi-join serve every lag and
    hold. The return of a bar uses the position of the bar before; cost falls on the bar where
    the position changes.
    """
    w = series(SERIES, "pos")
    z = panel.withColumn("_r", F.col("close") / F.lag("close", event_window).over(w) - 1)
    mean = full(F.avg, "_r", lookback, SERIES, "pos", 80)
    std = full(F.stddev_samp, "_r", lookback, SERIES, "pos", 80)
    z = z.withColumn("z", (F.col("_r") - mean) / F.nullif(std, F.lit(0.0))).select(
        "universe_id", F.col("asset").alias("leader"), "pos", "z"
    )
    hit = ((F.col("direction") == "strength") & (F.col("z") >= F.col("z_threshold"))) | (
        (F.col("direction") == "weakness") & (F.col("z") <= -F.col("z_threshold"))
    )
    by_spec = ("spec_id",)
    latest = (
        z.join(specs.select("spec_id", "universe_id", "leader", "direction", "z_threshold", "lag"),
               ["universe_id", "leader"])
        .withColumn("event_pos", F.max(F.when(hit, F.col("pos"))).over(cumulative(by_spec, "pos")))
        .select("spec_id", (F.col("pos") + F.col("lag")).alias("pos"), "event_pos")
    )
    prices = panel.select("universe_id", F.col("asset").alias("target"), "pos", "ts", "close")
    own = series(by_spec, "pos")
    held = F.col("event_pos") + F.col("lag") + F.col("hold") > F.col("pos")
    return (
        prices.join(specs, ["universe_id", "target"])
        .join(latest, ["spec_id", "pos"], "left")
        .withColumn("position", F.coalesce(held, F.lit(False)).cast("double"))
        .withColumn("ret", F.coalesce(F.col("close") / F.lag("close").over(own) - 1, F.lit(0.0)))
        .withColumn("_prev", F.lag("position").over(own))
        .withColumn(
            "strategy_ret",
            F.coalesce("_prev", F.lit(0.0)) * F.col("ret")
            - F.coalesce(F.abs(F.col("position") - F.col("_prev")), F.lit(0.0)) * F.col("cost"),
        )
        .select("spec_id", "universe_id", "pos", "ts", "position", "ret", "strategy_ret")
    )


def daily_metrics(daily: DataFrame, keys: Keys, order: str = "pos") -> DataFrame:
    """Metrics of each segment: strategy beside buy and hold of its target."""
    w, cum = series(keys, order), cumulative(keys, order)

    def curve(col: str) -> Column:
        return F.product(1 + F.col(col)).over(cum)

    marked = (
        daily.withColumn("_eq", curve("strategy_ret"))
        .withColumn("_bh", curve("ret"))
        .withColumn("_dd", F.col("_eq") / F.max("_eq").over(cum) - 1)
        .withColumn("_bh_dd", F.col("_bh") / F.max("_bh").over(cum) - 1)
        .withColumn("_new", (F.col("position") > 0) & (F.coalesce(F.lag("position").over(w), F.lit(0.0)) <= 0))
    )

    def sharpe(col: str) -> Column:
        return F.avg(col) / F.nullif(F.stddev_samp(col), F.lit(0.0)) * math.sqrt(252)

    def annual(total: Column) -> Column:
        return F.when(total > 0, F.pow(total, 252 / F.count("*")) - 1).otherwise(0.0) * 100

    end, bh_end = F.max_by("_eq", order), F.max_by("_bh", order)
    out = marked.groupBy(*keys).agg(
        ((end - 1) * 100).alias("total_return_pct"),
        annual(end).alias("annualized_return_pct"),
        sharpe("strategy_ret").alias("sharpe"),
        (F.min("_dd") * 100).alias("max_drawdown_pct"),
        (F.avg((F.col("position") > 0).cast("double")) * 100).alias("exposure_pct"),
        F.sum(F.col("_new").cast("int")).alias("num_entries"),
        ((bh_end - 1) * 100).alias("buy_hold_return_pct"),
        annual(bh_end).alias("buy_hold_annualized_pct"),
        sharpe("ret").alias("buy_hold_sharpe"),
        (F.min("_bh_dd") * 100).alias("buy_hold_max_drawdown_pct"),
    )
    return out.withColumn("beats_buy_hold_sharpe", known_sharpe("sharpe") > known_sharpe("buy_hold_sharpe"))


def known_sharpe(col: str) -> Column:
    """A Sharpe of exactly 0 counts as missing, as does NULL."""
    return F.coalesce(F.nullif(F.col(col), F.lit(0.0)), F.lit(-999.0))


def passes_train() -> Column:
    return (
        (F.col("total_return_pct") > 0)
        & (known_sharpe("sharpe") >= 0.50)
        & (F.col("max_drawdown_pct") > -75)
        & (F.col("num_entries") >= 5)
    )


def passes_lockbox() -> Column:
    return (
        (F.col("total_return_pct") > 0)
        & (known_sharpe("sharpe") >= 0.80)
        & F.col("beats_buy_hold_sharpe")
        & (F.col("max_drawdown_pct") > -50)
        & (F.col("num_entries") >= 2)
    )


def stress_variants(
    specs: DataFrame,
    lag_offsets: tuple[int, ...] = (-20, -10, 0, 10, 20),
    holds: tuple[int, ...] = (10, 20, 40),
    thresholds: tuple[float, ...] = (0.75, 1.0, 1.25),
) -> DataFrame:
    """The neighbourhood of each spec; base_id names the spec it came from."""
    grid = F.array(*[
        F.struct(F.lit(o).alias("_o"), F.lit(h).alias("_h"), F.lit(float(z)).alias("_z"))
        for o in lag_offsets for h in holds for z in thresholds if h >= 1
    ])
    lag = F.col("lag") + F.col("_o")
    name = F.concat_ws(
        " ", "spec_id", F.concat(F.lit("lag="), lag.cast("string")),
        F.concat(F.lit("hold="), F.col("_h").cast("string")), F.concat(F.lit("z="), F.col("_z").cast("string")),
    )
    return specs.select("*", F.inline(grid)).filter(lag >= 1).select(
        F.col("spec_id").alias("base_id"), name.alias("spec_id"), "universe_id", "leader", "target",
        "direction", F.col("_z").alias("z_threshold"), lag.alias("lag"), F.col("_h").alias("hold"), "cost",
    )


def stress_verdict(metrics: DataFrame, variants: DataFrame) -> DataFrame:
    """metrics per variant -> tested, passed, pass_rate, verdict per base spec."""
    passed = F.coalesce(passes_lockbox(), F.lit(False)).cast("int")
    out = (
        metrics.withColumn("_p", passed)
        .join(variants.select("spec_id", "base_id"), "spec_id")
        .groupBy("base_id")
        .agg(F.count("*").alias("tested"), F.sum("_p").alias("passed"), F.avg("_p").alias("pass_rate"))
    )
    robust = (F.col("tested") >= 6) & (F.col("pass_rate") >= 0.5)
    return out.withColumn("verdict", F.when(robust, "ROBUST").otherwise("FRAGILE"))


def learning_status() -> Column:
    """Needs train_pass, lockbox_pass, robust_pass."""
    return (
        F.when(F.col("robust_pass"), "winner")
        .when(F.col("lockbox_pass"), "fragile_lockbox_survivor")
        .when(F.col("train_pass"), "lockbox_loser")
        .otherwise("train_loser")
    )


def lab_context(panel: DataFrame, split: Column) -> DataFrame:
    """Per universe its assets in order, its dates and where the lockbox begins."""
    listed = F.array_sort(F.collect_set(F.struct("asset_ord", "asset")))
    return panel.groupBy("universe_id").agg(
        F.transform(listed, lambda x: x["asset"]).alias("assets"), F.min("ts").alias("start_date"), F.max("ts").alias("end_date"),
        F.max(F.when(F.col("ts") < split, F.col("ts"))).alias("train_end"), F.min(F.when(F.col("ts") >= split, F.col("ts"))).alias("lockbox_start"),
    )


def learning_log(
    results: DataFrame, specs: DataFrame, context: DataFrame, at: Column | None = None, event_window: int = 20, z_lookback: int = 252,
) -> DataFrame:
    """learning_records with everything a later reader needs: parameters, metrics of both segments,
    stress summary, dates and gate denominators, nested as the log keeps them."""
    learned = learning_records(results, specs).withColumnRenamed("verdict", "_verdict")
    own = ["spec_id", "universe_id", "leader", "target", "direction", "z_threshold", "lag", "hold", "cost"]
    extra = F.col("hypothesis") if "hypothesis" in specs.columns else F.lit(None).cast("string")
    asked = specs.select(*own, extra.alias("mechanism")).join(context, "universe_id")
    numbers = results.select("spec_id", *[c for c in results.columns if c not in learned.columns and c not in asked.columns])
    rows = learned.join(asked, "spec_id").join(numbers, "spec_id")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    gates = ("candidates", "train_survivors", "lockbox_survivors", "robust_survivors")
    return rows.select(
        stamp.alias("timestamp"), "mode", "is_lockbox", "asset", "strategy_family", F.col("_verdict").alias("verdict"), "learning_status",
        "lesson", "mechanism", *[day(c) for c in ("start_date", "end_date", "train_end", "lockbox_start")],
        F.struct(
            "assets", "leader", "target", "direction", "z_threshold", F.lit(event_window).alias("event_window"),
            F.lit(z_lookback).alias("z_lookback_days"), F.col("lag").alias("lag_days"), F.col("hold").alias("hold_days"),
            F.col("cost").alias("cost_per_turnover"),
        ).alias("params"),
        F.struct(
            "train_annualized_return_pct", "train_sharpe", "train_max_drawdown_pct",
            *[F.col(c).alias(f"lockbox_{c}") for c in ("annualized_return_pct", "sharpe", "max_drawdown_pct")],
            F.col("buy_hold_annualized_pct").alias("lockbox_buy_hold_annualized_pct"), F.col("buy_hold_sharpe").alias("lockbox_buy_hold_sharpe"),
            "exposure_pct", "num_entries",
        ).alias("metrics"),
        F.struct("tested", "passed", "pass_rate", F.col("stress_verdict").alias("verdict")).alias("stress_summary"),
        F.struct(*gates, F.col("slate_verdict").alias("verdict")).alias("gate_denominators"), "spec_id",
    )


def learning_records(results: DataFrame, specs: DataFrame) -> DataFrame:
    """One log row per candidate of a lab: status, lesson and the gate counts of its whole slate."""
    counts = funnel(results).withColumn("_all", F.lit(1))
    rule = F.format_string("%s %s -> %s lag %d hold %d", "leader", "direction", "target", "lag", "hold")
    status = F.col("learning_status")
    number = lambda c: F.coalesce(F.format_string("%.2f", c), F.lit("n/a"))
    lesson = (
        F.when(status == "winner", F.concat(rule, F.lit(" passed every gate; watch it forward, do not tune it.")))
        .when(
            status == "fragile_lockbox_survivor",
            F.concat(rule, F.lit(" passed the lockbox but only "), F.col("passed").cast("string"), F.lit(" of "),
                     F.col("tested").cast("string"), F.lit(" neighbours; parameter-fragile.")),
        )
        .when(
            status == "lockbox_loser",
            F.concat(rule, F.lit(" failed the lockbox: Sharpe "), number("sharpe"), F.lit(" against "), number("buy_hold_sharpe"), F.lit(".")),
        )
        .otherwise(F.concat(rule, F.lit(" failed the train gate.")))
    )
    return (
        results.join(specs.select("spec_id", "leader", "target", "direction", "lag", "hold"), "spec_id")
        .withColumn("_all", F.lit(1))
        .join(counts.withColumnRenamed("verdict", "slate_verdict"), "_all")
        .select(
            F.lit("event_followthrough").alias("mode"), F.lit(False).alias("is_lockbox"), F.col("target").alias("asset"),
            F.lit("event_followthrough").alias("strategy_family"), status.alias("verdict"), "learning_status",
            lesson.alias("lesson"), "spec_id", "candidates", "train_survivors", "lockbox_survivors", "robust_survivors", "slate_verdict",
        )
    )


def funnel(results: DataFrame, slate: str = "EVENT") -> DataFrame:
    """results(train_pass, lockbox_pass, robust_pass) -> one row of gate counts and the verdict."""
    t = F.col("train_pass")
    lb = t & F.col("lockbox_pass")
    rb = lb & F.col("robust_pass")
    empty = "REJECTED_NO_EVENT_CANDIDATES" if slate == "EVENT" else "REJECTED_NO_RUNNABLE_CANDIDATES"
    out = results.agg(
        F.count("*").alias("candidates"), F.count_if(t).alias("train_survivors"),
        F.count_if(lb).alias("lockbox_survivors"), F.count_if(rb).alias("robust_survivors"),
    )
    return out.withColumn(
        "verdict",
        F.when(F.col("candidates") == 0, empty)
        .when(F.col("train_survivors") == 0, "REJECTED_NO_TRAIN_SURVIVORS")
        .when(F.col("lockbox_survivors") == 0, "REJECTED_NO_LOCKBOX_SURVIVORS")
        .when(F.col("robust_survivors") == 0, "REJECTED_FRAGILE_LOCKBOX_SURVIVORS")
        .otherwise("PAPER_TRADE_CANDIDATE"),
    )


def lab_winner(results: DataFrame) -> DataFrame:
    """The robust survivor with the best (pass_rate, lockbox sharpe, lockbox annual return)."""
    survivors = results.filter("train_pass and lockbox_pass and robust_pass")
    rank = F.struct("pass_rate", known_sharpe("sharpe").alias("s"), "annualized_return_pct")
    return survivors.agg(F.max_by("spec_id", rank).alias("winner"))


def lab(panel: DataFrame, specs: DataFrame, split: Column) -> DataFrame:
    """Train, lockbox and stress results of each spec, with gates, status and lesson.

    split is the first lockbox date. Every spec is stressed; robust_pass also needs both gates.
    The metrics of the segments feed four branches and are written once.
    """
    segment = F.when(F.col("ts") < split, "train").otherwise("lockbox")
    keys = ("spec_id", "segment")
    m = written(daily_metrics(event_daily(panel, specs).withColumn("segment", segment), keys), "lab-metrics")
    train = m.filter("segment = 'train'").select(
        "spec_id", passes_train().alias("train_pass"), F.col("sharpe").alias("train_sharpe"),
        F.col("annualized_return_pct").alias("train_annualized_return_pct"), F.col("max_drawdown_pct").alias("train_max_drawdown_pct"),
    )
    box = m.filter("segment = 'lockbox'").withColumn("lockbox_pass", passes_lockbox()).drop("segment")
    gated = box.join(train, "spec_id")
    variants = stress_variants(specs)
    tail = event_daily(panel, variants).filter(F.col("ts") >= split)
    stress = stress_verdict(daily_metrics(tail, ("spec_id",)), variants).withColumnsRenamed(
        {"base_id": "spec_id", "verdict": "stress_verdict"}
    )
    out = gated.join(stress, "spec_id", "left").withColumn(
        "robust_pass", F.col("train_pass") & F.col("lockbox_pass") & F.coalesce(F.col("stress_verdict") == "ROBUST", F.lit(False))
    )
    return out.withColumn("learning_status", learning_status())
