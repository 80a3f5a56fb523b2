"""Held-out segments, walk-forward chunks, perturbations, checks and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.normal import norm_cdf
from barframe.functions.scalars import TRADING_DAYS, dedupe_assets, neighbours, split_date_range
from barframe.functions.windows import Keys, series
from barframe.operators.rules import portfolio_sound

PSR_PASS = 0.95


def date_positions(calendar: DataFrame) -> DataFrame:
    """universe_id, day, pos_from, pos_to for every calendar day between the first and last
    date: the first position on or after the day and the last one on or before it."""
    ends = calendar.groupBy("universe_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = ends.select("universe_id", F.explode(F.sequence("a", "b")).alias("day"))
    w = series(("universe_id",), "day")
    joined = days.join(
        calendar.select("universe_id", F.col("ts").alias("day"), "pos"), ["universe_id", "day"], "left"
    )
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    return joined.select(
        "universe_id", "day",
        F.first("pos", ignorenulls=True).over(ahead).alias("pos_from"),
        F.last("pos", ignorenulls=True).over(back).alias("pos_to"),
    )


def locate_runs(runs: DataFrame, calendar: DataFrame) -> DataFrame:
    """Replace start and end dates by pos0 and pos1, clipped to the calendar; runs whose range
    holds no date are dropped. Two equi-joins with the dense calendar."""
    dense = date_positions(calendar)
    ends = calendar.groupBy("universe_id").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    return (
        runs.join(ends, "universe_id")
        .filter((F.col("start") <= F.col("_b")) & (F.col("end") >= F.col("_a")))
        .withColumn("_s", F.greatest("start", "_a"))
        .withColumn("_e", F.least("end", "_b"))
        .join(dense.select("universe_id", F.col("day").alias("_s"), F.col("pos_from").alias("pos0")), ["universe_id", "_s"])
        .join(dense.select("universe_id", F.col("day").alias("_e"), F.col("pos_to").alias("pos1")), ["universe_id", "_e"])
        .filter(F.col("pos0") <= F.col("pos1"))
        .drop("_a", "_b", "_s", "_e")
    )


def segments(runs: DataFrame, pct: str | Column) -> DataFrame:
    """Each run as a train row and a lockbox row (columns start, end, segment)."""
    p = F.col(pct) if isinstance(pct, str) else pct
    split = runs.withColumn("_s", split_date_range(F.col("start"), F.col("end"), p)).filter("_s is not null")
    pair = F.array(
        F.struct(F.lit("train").alias("segment"), F.col("start").alias("from"), F.col("_s.train_end").alias("to")),
        F.struct(F.lit("lockbox").alias("segment"), F.col("_s.lockbox_start").alias("from"), F.col("end").alias("to")),
    )
    return (
        split.select("*", F.inline(pair))
        .drop("start", "end", "_s")
        .withColumnsRenamed({"from": "start", "to": "end"})
    )


def chunk_bounds(n: Column, k: Column) -> Column:
    """array(struct(chunk, first, last)): k near-equal contiguous chunks of n rows; the first
    n mod k chunks hold one more."""
    size, extra = F.floor(n / k), n % k

    def bound(c: Column) -> Column:
        return (c * size + F.least(c, extra)).cast("int")

    return F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda c: F.struct(
            c.alias("chunk"), bound(c).alias("first"), (bound(c + 1) - 1).alias("last")
        ),
    )


def walk_forward_chunks(runs: DataFrame, min_rows: int = TRADING_DAYS, most: int = 4) -> DataFrame:
    """Runs split into chunks, each with its own positions; runs that are too short give none."""
    n = F.col("pos1") - F.col("pos0") + 1
    k = F.least(F.lit(most), F.floor(n / min_rows)).cast("int")
    long_enough = runs.filter(n >= 2 * min_rows)
    return (
        long_enough.select("*", F.inline(chunk_bounds(n, k)))
        .withColumn("pos1", F.col("pos0") + F.col("last"))
        .withColumn("pos0", F.col("pos0") + F.col("first"))
        .drop("first", "last")
    )


def walk_forward_check(chunks: DataFrame, keys: Keys) -> DataFrame:
    """chunks(keys, total_return_pct, benchmark_pct) -> share positive and share ahead."""
    positive = F.avg((F.col("total_return_pct") > 0).cast("double"))
    beat = F.avg((F.col("total_return_pct") > F.col("benchmark_pct")).cast("double"))
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("n_windows"), positive.alias("positive_rate"), beat.alias("beat_rate")
    ).withColumn("passed", (F.col("positive_rate") >= 0.5) & (F.col("beat_rate") >= 0.5))


def expanding_prefixes(rows: DataFrame, keys: Keys, n_rows: str, folds: int = 5, in_sample: float = 0.8) -> DataFrame:
    """Fold sizes of an expanding walk-forward over the in-sample share of each series."""
    split = F.floor(F.col(n_rows) * in_sample)
    size = F.floor(split / folds)
    return rows.select(
        *keys, split.cast("int").alias("split"),
        F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"),
        size.cast("int").alias("_size"),
    ).withColumn("fold_rows", F.col("_size") * F.col("fold")).drop("_size")


def probabilistic_sharpe(sharpe: Column, n_obs: Column, threshold: Column | float = 0.0) -> Column:
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    daily = sharpe / (TRADING_DAYS ** 0.5)
    return F.when(n_obs < 2, 0.0).otherwise(norm_cdf((daily - t) * F.sqrt(n_obs - 1)))


def metric_rules(benchmark: str, min_trades: int | None = None) -> list[tuple[str, Column]]:
    """Name and outcome of each check on a metrics row; n_days serves the PSR check."""
    psr = probabilistic_sharpe(F.col("sharpe_ratio"), F.col("n_days"))
    rules = [
        ("Benchmark comparison", F.col("total_return_pct") > F.col(benchmark)),
        ("Positive return", F.col("total_return_pct") > 0),
        ("Drawdown sanity", F.col("max_drawdown_pct") > -50),
        ("Sharpe ratio significance (PSR)", F.coalesce(psr >= PSR_PASS, F.lit(False))),
    ]
    if min_trades is not None:
        rules.insert(0, ("Minimum trade count", F.col("num_trades") >= min_trades))
    return rules


def metric_checks(
    metrics: DataFrame, benchmark: str, keys: Keys, min_trades: int | None = None
) -> DataFrame:
    """One row per check: keys, test_name, passed."""
    checks = F.array(*[
        F.struct(F.lit(name).alias("test_name"), ok.alias("passed"))
        for name, ok in metric_rules(benchmark, min_trades)
    ])
    return metrics.select(*keys, F.inline(checks))


def check_summary(checks: DataFrame, keys: Keys) -> DataFrame:
    """keys, n_checks, n_passed, walk_forward_failed, failed_checks."""
    failed = ~F.col("passed")
    return checks.groupBy(*keys).agg(
        F.count("*").alias("n_checks"),
        F.sum(F.col("passed").cast("int")).alias("n_passed"),
        F.max(failed & F.lower("test_name").contains("walk-forward")).alias("walk_forward_failed"),
        F.array_sort(F.collect_list(F.when(failed, F.col("test_name")))).alias("failed_checks"),
    )


def research_verdict(
    has_errors: Column, approved: Column, has_result: Column, benchmark: str = "beats_benchmark"
) -> Column:
    """The ordered gates over a metrics row joined with its check summary."""
    strong = (
        (F.col("total_return_pct") > 0)
        & F.col(benchmark)
        & (F.col("num_trades") >= 20)
        & (F.col("max_drawdown_pct") > -50)
        & (F.col("n_passed") > F.col("n_checks") / 2)
    )
    return (
        F.when(has_errors, "error")
        .when(~F.coalesce(approved, F.lit(False)) | ~has_result, "reject")
        .when(F.col("total_return_pct") < 0, "reject")
        .when(F.col("max_drawdown_pct") <= -50, "reject")
        .when(F.col("num_trades") < 10, "reject")
        .when(strong & F.col("walk_forward_failed"), "needs_more_testing")
        .when(strong, "worth_paper_trading")
        .otherwise("needs_more_testing")
    )


def forward_status(days: Column, realized_ann: Column, expected_ann: Column, realized_dd: Column, backtest_dd: Column) -> Column:
    return (
        F.when(realized_dd < backtest_dd, "DRAWDOWN_BREACH")
        .when(days < 63, "TOO_EARLY")
        .when((realized_ann < 0) & (expected_ann > 0), "DIVERGING")
        .otherwise("TRACKING")
    )


def compare_books(metrics: DataFrame) -> DataFrame:
    """Core and combined rows of each book side by side, with the overlay verdict."""

    def of(variant: str, col: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(col)))

    names = ("total_return_pct", "sharpe_ratio", "max_drawdown_pct")
    wide = metrics.groupBy("run_id").agg(
        *[of(v, c).alias(f"{v}_{c}") for v in ("core", "combined") for c in names]
    )
    delta = F.coalesce("combined_sharpe_ratio", F.lit(0.0)) - F.coalesce("core_sharpe_ratio", F.lit(0.0))
    core_dd, dd = F.col("core_max_drawdown_pct"), F.col("combined_max_drawdown_pct")
    return wide.select(
        "run_id",
        (F.col("core_total_return_pct") - F.col("combined_total_return_pct")).alias("return_cost_pct"),
        (dd - core_dd).alias("drawdown_improvement_pct"),
        delta.alias("sharpe_delta"),
        F.when(delta > 0, "IMPROVES_RISK_ADJUSTED")
        .when((core_dd < 0) & (dd / core_dd <= 0.8), "REDUCES_DRAWDOWN_AT_COST")
        .otherwise("NOT_WORTH_IT")
        .alias("verdict"),
    )


def perturbations(specs: DataFrame, base_pct: float = 0.20, grid: tuple[float, ...] = (0.15, 0.20, 0.25, 0.30)) -> DataFrame:
    """Each spec with its lockbox cuts, parameter neighbours and leave-one-out universes.

    specs: spec_id, assets, family, lookback, top_k, rebalance (more columns pass through).
    Adds category, label and lockbox_pct; invalid variants are left out.
    """
    def variant(category, label, pct=None, lookback=None, rebalance=None, top_k=None, assets=None):
        return F.struct(
            F.lit(category).alias("category"), label.alias("label"),
            (pct if pct is not None else F.lit(base_pct)).cast("double").alias("lockbox_pct"),
            (lookback if lookback is not None else F.col("lookback")).cast("int").alias("v_lookback"),
            (rebalance if rebalance is not None else F.col("rebalance")).cast("int").alias("v_rebalance"),
            (top_k if top_k is not None else F.col("top_k")).cast("int").alias("v_top_k"),
            (assets if assets is not None else F.col("assets")).alias("v_assets"),
        )

    def label(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), value.cast("string"))

    cuts = F.array(*[
        variant("lockbox", F.lit(f"lockbox_pct={p:.2f}"), pct=F.lit(p)) for p in sorted({base_pct, *grid})
    ])
    # A neighbour that comes twice is null the second time, which is no change.
    nearby = neighbours(F.col("lookback"), (0.8, 1.25))
    halved = F.array_distinct(F.array(
        F.greatest(F.lit(1), (F.col("rebalance") * 0.5).cast("int")), F.col("rebalance") * 2
    ))
    lookbacks = F.array(*[
        variant("parameter", label("lookback", v), lookback=v) for v in (F.get(nearby, F.lit(i)) for i in (0, 1))
    ])
    rebalances = F.array(*[
        variant("parameter", label("rebalance", v), rebalance=v) for v in (F.get(halved, F.lit(i)) for i in (0, 1))
    ])
    ranked = F.col("family").isin("cross_sectional_momentum", "dual_momentum")
    top_ks = F.array(*[
        variant("parameter", label("top_k", v), top_k=v) for v in (F.col("top_k") - 1, F.col("top_k") + 1)
    ])
    drops = F.transform(
        F.col("assets"),
        lambda a: variant(
            "universe", F.concat(F.lit("drop "), a),
            assets=F.array_remove("assets", a),
            top_k=F.least(F.col("top_k"), F.size("assets") - 1),
        ),
    )
    none = F.slice(cuts, 1, 0)
    every = F.concat(
        cuts, lookbacks, rebalances,
        F.when(ranked, top_ks).otherwise(none),
        F.when(F.size("assets") >= 3, drops).otherwise(none),
    )
    changed = (
        (F.col("category") != "parameter")
        | (F.col("v_lookback") != F.col("lookback"))
        | (F.col("v_rebalance") != F.col("rebalance"))
        | (F.col("v_top_k") != F.col("top_k"))
    )
    varied = (
        specs.withColumn("assets", dedupe_assets(F.col("assets")))
        # As a column of its own the array is made by code that Spark splits into short methods; inside
        # the generator it becomes one that is too long for the JVM to compile.
        .withColumn("_every", every)
        .select("*", F.inline_outer("_every"))
        .filter(changed)
        .drop("lookback", "rebalance", "top_k", "assets", "_every")
        .withColumnsRenamed({
            "v_lookback": "lookback", "v_rebalance": "rebalance", "v_top_k": "top_k", "v_assets": "assets"
        })
    )
    # The rules of the specification itself, for some assets of a list without repeats; columns a caller left out count as not given.
    given = [c for c in ("skip", "hedge_weight") if c not in varied.columns]
    checked = varied.withColumns({c: F.lit(0 if c == "skip" else 0.1) for c in given})
    return checked.filter(portfolio_sound(F.size("assets"))).drop(*given)


def stress_summary(results: DataFrame, keys: Keys, base_label: str = "lockbox_pct=0.20") -> DataFrame:
    """results(keys, category, label, runnable, confirms) -> survival rates and verdict."""
    ok = F.col("runnable")
    confirmed = F.col("confirms") & ok
    per_category = results.groupBy(*keys, "category").agg(
        F.sum(ok.cast("int")).alias("_n"),
        F.sum(confirmed.cast("int")).alias("_c"),
        F.sum((~ok).cast("int")).alias("_bad"),
        F.max(F.when(F.col("label") == base_label, confirmed)).alias("_base"),
    )
    rate = F.when(F.col("_n") > 0, F.col("_c") / F.col("_n"))
    out = per_category.groupBy(*keys).agg(
        F.coalesce(F.max("_base"), F.lit(False)).alias("base_confirms"),
        F.sum("_c").alias("confirmed"),
        F.sum("_n").alias("n_runnable"),
        F.sum("_bad").alias("unrunnable"),
        F.min(rate).alias("worst_category_rate"),
    )
    overall = F.coalesce(F.col("confirmed") / F.nullif(F.col("n_runnable"), F.lit(0)), F.lit(0.0))
    return out.withColumn("overall_rate", overall).withColumn(
        "verdict",
        F.when(~F.col("base_confirms"), "BROKEN")
        .when((F.col("overall_rate") >= 0.70) & (F.col("worst_category_rate") >= 0.50), "ROBUST")
        .otherwise("FRAGILE"),
    )


def plateau(entries: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Longest contiguous run of confirming values (the first of equal length) and the verdict
    PLATEAU, SPIKE or NONE. entries(keys, value, ok, confirms): one small grid per key."""
    w = series(keys, value)
    hit = F.coalesce(F.col("ok") & F.col("confirms"), F.lit(False))
    marked = (
        entries.withColumn("_hit", hit)
        .withColumn("_n", F.row_number().over(w))
        .withColumn("_island", F.col("_n") - F.sum(F.col("_hit").cast("int")).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    islands = marked.groupBy(*keys, "_island").agg(
        F.sum(F.col("_hit").cast("int")).alias("run"),
        F.min(F.when(F.col("_hit"), F.col(value))).alias("from_value"),
        F.max(F.when(F.col("_hit"), F.col(value))).alias("to_value"),
    )
    best = islands.groupBy(*keys).agg(
        F.sum("run").alias("n_confirmed"),
        F.max_by(F.struct("run", "from_value", "to_value"), F.struct("run", -F.col("from_value"))).alias("_b"),
    )
    return best.select(
        *keys, "n_confirmed", F.col("_b.run").alias("longest_run"),
        F.col("_b.from_value").alias("from_value"), F.col("_b.to_value").alias("to_value"),
        F.when(F.col("n_confirmed") == 0, "NONE").when(F.col("_b.run") >= 3, "PLATEAU").otherwise("SPIKE").alias("verdict"),
    )
