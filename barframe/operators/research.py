"""Whole evaluations of portfolio runs: weights, NAV, metrics, checks and verdict in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.scalars import TRADING_DAYS, annualize, trading_days
from barframe.functions.windows import series
from barframe.operators import bootstrap, events, log, metrics, replay, rules, validate, weights
from barframe.session import written

CHECK_WALK = "Portfolio walk-forward stability"
CHECK_REBALANCE = "Portfolio rebalance count"
CHECK_RESAMPLE = "Portfolio resampled returns"
CHECK_SERIES_WALK = "Walk-forward stability"
CHECK_SERIES_RESAMPLE = "Resampled returns"
CHECK_DSR = "Deflated Sharpe ratio (DSR)"


def evaluate(
    sums: DataFrame,
    panel: DataFrame,
    runs: DataFrame,
    cost: float = replay.COMMISSION + replay.SLIPPAGE,
    cash: float = replay.INITIAL_CASH,
    min_rows: int = 300,
    paths: int = bootstrap.PATHS,
    chunk_rows: int = 252,
) -> DataFrame:
    """One row per run: metrics, failed checks, verdict.

    runs are weights.RUN_COLUMNS plus start and end dates. Walk-forward chunks are extra runs in
    the same plan and fold into their parent's row. paths > 0 adds the resampling check; the NAV
    then feeds two branches and is written once.
    """
    whole = runs.withColumns({"parent": F.col("run_id"), "chunk": F.lit(-1)})
    chunks = validate.walk_forward_chunks(whole.drop("chunk"), chunk_rows).withColumns({
        "run_id": F.concat_ws("#", "parent", F.col("chunk").cast("string")),
        # A chunk is compared with the equal-weight basket, whatever the family.
        "_short": F.col("pos1") - F.col("pos0") + 1 < F.col("lookback") + F.col("rebalance"),
    }).filter("not _short").drop("_short")
    every = whole.unionByName(chunks)
    nav = replay.replay_weights(
        replay.run_bars(panel, every), weights.target_weights(sums, every), cost, cash
    )
    against = every.withColumn("family", F.when(F.col("chunk") < 0, F.col("family")).otherwise("chunk"))
    benchmark = metrics.equal_weight_benchmark(panel, against)
    extra_check = ()
    if paths:
        nav = written(nav, "run-nav")
        own = series(("run_id",), "pos")
        daily = nav.filter(~F.col("run_id").contains("#")).withColumn(
            "ret", F.col("nav") / F.coalesce(F.lag("nav").over(own), F.lit(cash)) - 1
        )
        boot = bootstrap.summarize(bootstrap.resample(daily, paths=paths))
        extra_check = (boot.select(F.col("run_id").alias("parent"), F.col("passed").alias("_boot")),)
    label = every.select("run_id", "parent", "chunk", "start", "end")
    scored = metrics.nav_metrics(nav, benchmark, cash).join(label, "run_id")
    top = F.col("chunk") < 0
    names = [c for c in scored.columns if c not in ("run_id", "parent", "chunk")]
    walked = [F.avg(F.when(~top, ok.cast("double"))) for ok in (
        F.col("total_return_pct") > 0, F.col("total_return_pct") > F.col("benchmark_pct")
    )]
    one = scored.groupBy("parent").agg(
        *[F.max(F.when(top, F.col(c))).alias(c) for c in names],
        F.coalesce((walked[0] >= 0.5) & (walked[1] >= 0.5), F.lit(False)).alias("_walk"),
    )
    for boot in extra_check:
        one = one.join(boot, "parent", "left")
    one = one.withColumn("n_days", trading_days(F.col("start"), F.col("end")))
    checks = [
        *validate.metric_rules("benchmark_pct"),
        (CHECK_WALK, F.col("_walk")),
        (CHECK_REBALANCE, F.col("rebalances") >= 6),
    ]
    if paths:
        checks.append((CHECK_RESAMPLE, F.coalesce("_boot", F.lit(False))))
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]))
    verdict = validate.research_verdict(F.col("n_obs") < min_rows, F.lit(True), F.lit(True))
    return (
        one.withColumn("failed_checks", F.array_sort(failed))
        .withColumns({
            "n_checks": F.lit(len(checks)),
            "n_passed": F.lit(len(checks)) - F.size("failed_checks"),
            "walk_forward_failed": ~F.col("_walk"),
        })
        .withColumn("verdict", verdict)
        .withColumnRenamed("parent", "run_id")
        .drop("_walk", "_boot")
    )


def with_segments(specs: DataFrame, calendar: DataFrame, pct: float | str = 0.2) -> DataFrame:
    """specs(run_id, ..., start, end) -> located train and lockbox runs; run_id gets the segment,
    spec_id keeps the old one."""
    p = F.lit(pct) if isinstance(pct, float) else F.col(pct)
    split = validate.segments(specs.withColumn("spec_id", F.col("run_id")), p)
    named = split.withColumn("run_id", F.concat_ws("|", "spec_id", "segment"))
    return validate.locate_runs(named, calendar)


def confirmations(results: DataFrame, located: DataFrame, specs: DataFrame) -> DataFrame:
    """Train and lockbox verdicts of each spec side by side, and whether it is confirmed.

    Every row of specs (run_id, ...) comes back, with all its columns: status is ok or unrunnable,
    and reason says why there is no held-out result."""
    tagged = results.join(located.select("run_id", "spec_id", "segment"), "run_id")

    def of(segment: str, col: str):
        return F.max(F.when(F.col("segment") == segment, F.col(col)))

    out = tagged.groupBy("spec_id").agg(
        of("train", "verdict").alias("train_verdict"), of("lockbox", "verdict").alias("lockbox_verdict"),
        of("train", "sharpe_ratio").alias("train_sharpe"), of("lockbox", "sharpe_ratio").alias("lockbox_sharpe"),
        of("lockbox", "total_return_pct").alias("lockbox_return_pct"),
        of("lockbox", "benchmark_pct").alias("lockbox_benchmark_pct"),
    )
    # A segment that begins after its end, or off the calendar, has not been located.
    tried = located.filter("segment = 'lockbox'").select(F.col("spec_id").alias("_tried")).distinct()
    every = specs.withColumnRenamed("run_id", "spec_id").join(out, "spec_id", "left")
    every = every.join(tried, F.col("spec_id") == F.col("_tried"), "left")
    reason = F.when(F.col("_tried").isNull(), "no held-out dates").when(
        F.col("lockbox_verdict").isNull() | (F.col("lockbox_verdict") == "error"), "too few held-out rows"
    )
    return every.withColumn("reason", reason).withColumns({
        "status": F.when(F.col("reason").isNull(), "ok").otherwise("unrunnable"),
        "confirms": F.col("reason").isNull() & F.coalesce(F.col("lockbox_verdict") == "worth_paper_trading", F.lit(False)),
    }).drop("_tried")


def critiqued(specs: DataFrame) -> DataFrame:
    """Adds problems (of the specification and its critique), warnings, required_changes, approved."""
    found = F.array_union(rules.portfolio_critique_problems(), F.coalesce(rules.portfolio_problems(), F.array().cast("array<string>")))
    return specs.withColumns({
        "problems": found, "warnings": rules.portfolio_critique_warnings(), "required_changes": rules.required_changes(),
    }).withColumn("approved", F.size("problems") == 0)


def outcome(asked: DataFrame, located: DataFrame, results: DataFrame) -> DataFrame:
    """The ledger of a gate: every row of asked(spec_id, approved, problems, ...) with status, reason
    and the columns of its result, if it has one. located(spec_id), results(spec_id, verdict, ...)."""
    tried = located.select(F.col("spec_id").alias("_tried")).distinct()
    got = results.withColumnRenamed("spec_id", "_got")
    every = asked.join(tried, F.col("spec_id") == F.col("_tried"), "left").join(got, F.col("spec_id") == F.col("_got"), "left")
    reason = (
        F.when(~F.col("approved"), F.array_join("problems", "; "))
        .when(F.col("_tried").isNull(), "no dates in the calendar")
        .when(F.col("_got").isNull() | (F.col("verdict") == "error"), "too few rows")
    )
    status = F.when(~F.col("approved"), "rejected").when(F.col("reason").isNotNull(), "error").otherwise("ok")
    verdict = F.when(F.col("status") == "rejected", "reject").when(F.col("status") == "error", "error").otherwise(F.col("verdict"))
    return every.withColumn("reason", reason).withColumn("status", status).withColumn("verdict", verdict).drop("_tried", "_got")


RESULT = (
    "total_return_pct", "benchmark_pct", "sharpe_ratio", "max_drawdown_pct", "num_trades", "rebalances", "beats_benchmark",
    "failed_checks", "n_checks", "n_passed", "verdict",
)


def slate_research(
    sums: DataFrame, panel: DataFrame, specs: DataFrame, calendar: DataFrame, pct: float = 0.2,
    min_rows: int = 300, paths: int = bootstrap.PATHS,
) -> DataFrame:
    """Slates from critique to lockbox, one row for every spec, whatever becomes of it.

    specs: slate_id, run_id, idx (place in its slate), universe_id, assets, family, ..., start, end
    (dates or text). Approved specs are evaluated on train; of those with a result the deflated Sharpe
    against their slate is one more check (trials: how many the slate had), and the winner is picked;
    only winners see the lockbox (columns lockbox_*), and a lockbox without a result says why."""
    asked = written(critiqued(specs).withColumnRenamed("run_id", "spec_id"), "slate-asked")
    dated = asked.filter("approved").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    dated = dated.select(F.col("spec_id").alias("run_id"), *[c for c in specs.columns if c not in ("run_id", "idx", "slate_id")])
    located = written(with_segments(dated, calendar, pct), "slate-runs")

    def judged(segment: str, runs: DataFrame) -> DataFrame:
        spans = runs.select("run_id", "spec_id", F.col("start").alias("start_date"), F.col("end").alias("end_date"))
        out = evaluate(sums, panel, runs, min_rows=min_rows, paths=paths).join(spans, "run_id")
        return written(out.select("spec_id", "start_date", "end_date", *RESULT), f"slate-{segment}")

    train_runs = located.filter("segment = 'train'")
    train = judged("train", train_runs).join(asked.select("spec_id", "slate_id", "idx"), "spec_id")
    tried = written(log.slate_dsr(train.filter("verdict <> 'error'")).select(
        "spec_id", "slate_id", "idx", *RESULT, F.col("n_sharpes").alias("trials"), "dsr", "dsr_passed",
    ), "slate-tried")
    failed = F.when(F.col("dsr_passed"), F.col("failed_checks")).otherwise(F.array_append("failed_checks", F.lit(CHECK_DSR)))
    best = log.slate_winner(tried, idx="idx").select("slate_id", F.col("winner").alias("idx"), F.col("reason").alias("winner_reason"))
    winners = written(tried.join(best, ["slate_id", "idx"]).select("spec_id", "winner_reason"), "slate-winners")
    box_runs = located.filter("segment = 'lockbox'").join(winners, "spec_id", "left_semi")
    box = outcome(
        winners.withColumns({"approved": F.lit(True), "problems": F.array().cast("array<string>")}), box_runs, judged("lockbox", box_runs)
    ).select("spec_id", "winner_reason", *[
        F.col(c).alias(f"lockbox_{c}") for c in ("status", "reason", "verdict", "total_return_pct", "benchmark_pct", "sharpe_ratio", "failed_checks")
    ])
    results = tried.withColumns({
        "failed_checks": failed, "n_checks": F.col("n_checks") + 1, "n_passed": F.col("n_passed") + F.col("dsr_passed").cast("int"),
    }).drop("slate_id", "idx")
    out = outcome(asked, train_runs, results).join(box.withColumnRenamed("spec_id", "_won"), F.col("spec_id") == F.col("_won"), "left")
    return out.withColumn("is_winner", F.col("_won").isNotNull()).drop("_won")


def batch_research(
    sums: DataFrame, panel: DataFrame, specs: DataFrame, calendar: DataFrame, min_rows: int = 300, paths: int = bootstrap.PATHS,
) -> DataFrame:
    """Specs of a batch (as slate_research, without a slate) over their whole range, one row for every
    spec with its problems, warnings, status, reason and result."""
    asked = written(critiqued(specs).withColumnRenamed("run_id", "spec_id"), "batch-asked")
    dated = asked.filter("approved").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    runs = validate.locate_runs(dated.select(F.col("spec_id").alias("run_id"), *[c for c in specs.columns if c != "run_id"]), calendar)
    runs = written(runs, "batch-runs")
    results = evaluate(sums, panel, runs, min_rows=min_rows, paths=paths).withColumnRenamed("run_id", "spec_id")
    return outcome(asked, runs.select(F.col("run_id").alias("spec_id")), results.select("spec_id", *RESULT))


def forward_evaluation(nav: DataFrame, positions: DataFrame) -> DataFrame:
    """Realized against expected performance since inception.

    nav(run_id, ts, nav); positions(run_id, inception, expected_annualized_pct,
    backtest_max_drawdown_pct).
    """
    since = nav.join(positions, "run_id").filter(F.col("ts") >= F.col("inception"))
    peak = F.max("nav").over(series(("run_id",), "ts").rowsBetween(Window.unboundedPreceding, 0))
    since = since.withColumn("_dd", F.col("nav") / peak - 1)
    out = since.groupBy("run_id", "inception", "expected_annualized_pct", "backtest_max_drawdown_pct").agg(
        F.count("*").alias("forward_days"),
        ((F.max_by("nav", "ts") / F.min_by("nav", "ts") - 1) * 100).alias("realized_return_pct"),
        (F.min("_dd") * 100).alias("realized_max_drawdown_pct"),
        F.datediff(F.max("ts"), F.min("ts")).alias("_span"),
    ).filter("forward_days >= 2")
    out = out.withColumn("realized_annualized_pct", annualize(F.col("realized_return_pct"), F.col("_span")))
    return out.withColumn(
        "status",
        validate.forward_status(
            F.col("forward_days"), F.col("realized_annualized_pct"), F.col("expected_annualized_pct"),
            F.col("realized_max_drawdown_pct"), F.col("backtest_max_drawdown_pct"),
        ),
    ).drop("_span")


def gated_lab(
    sums: DataFrame, panel: DataFrame, specs: DataFrame, calendar: DataFrame, pct: float = 0.25, paths: int = 500
) -> tuple[DataFrame, DataFrame]:
    """A pre-registered slate through train, lockbox and stress gates.

    specs(run_id, universe_id, assets, family, ..., start, end) are judged on train only; the
    survivors see the lockbox; the survivors of that are perturbed. Every gate is written, so a
    later gate evaluates only what passed. Returns the per-spec gates and the one-row funnel
    with the winner (best survival rate, then confirmations, then name).
    """
    located = with_segments(specs, calendar, pct)
    train_runs = located.filter("segment = 'train'")
    train = written(
        evaluate(sums, panel, train_runs, paths=paths).join(train_runs.select("run_id", "spec_id"), "run_id")
        .select("spec_id", (F.col("verdict") == "worth_paper_trading").alias("train_pass")), "gate-train"
    )
    passed = train.filter("train_pass").select("spec_id")
    box_runs = located.filter("segment = 'lockbox'").join(passed, "spec_id", "left_semi")
    box = written(
        evaluate(sums, panel, box_runs, paths=paths).join(box_runs.select("run_id", "spec_id"), "run_id")
        .select("spec_id", (F.col("verdict") == "worth_paper_trading").alias("lockbox_pass")), "gate-lockbox"
    )
    named = specs.withColumnRenamed("run_id", "spec_id").join(
        box.filter("lockbox_pass").select("spec_id"), "spec_id", "left_semi"
    )
    varied = validate.perturbations(named).withColumn("base_id", F.col("spec_id")).withColumn(
        "run_id", F.concat_ws("/", "spec_id", "category", "label")
    ).drop("spec_id")
    runs = with_segments(varied, calendar, "lockbox_pct")
    results = confirmations(evaluate(sums, panel, runs, paths=paths), runs, varied).select(
        "base_id", "category", "label", (F.col("status") == "ok").alias("runnable"), "confirms"
    )
    stress = validate.stress_summary(results, ("base_id",)).select(
        F.col("base_id").alias("spec_id"), (F.col("verdict") == "ROBUST").alias("robust_pass"), "overall_rate", "confirmed"
    )
    # Every spec comes back: one that no gate could evaluate says so.
    tried = located.select("spec_id", F.lit(True).alias("_tried")).distinct()
    gates = specs.select(F.col("run_id").alias("spec_id")).join(tried, "spec_id", "left").join(train, "spec_id", "left")
    gates = gates.join(box, "spec_id", "left").join(stress, "spec_id", "left")
    reason = F.when(F.col("_tried").isNull(), "no dates in the calendar").when(F.col("train_pass").isNull(), "no train result")
    gates = gates.withColumn("reason", reason).drop("_tried").na.fill(False, ["train_pass", "lockbox_pass", "robust_pass"])
    gates = written(gates, "gates")
    best = gates.filter("train_pass and lockbox_pass and robust_pass").agg(
        F.max_by("spec_id", F.struct("overall_rate", "confirmed", "spec_id")).alias("winner")
    ).withColumn("_all", F.lit(1))
    summary = events.funnel(gates, "LAB").withColumn("_all", F.lit(1)).join(best, "_all").drop("_all")
    return gates, summary


def campaign(
    bars: DataFrame, rules: dict, split, cash: float = replay.INITIAL_CASH, min_trades: int = 20,
    paths: int = bootstrap.PATHS, chunk_rows: int = TRADING_DAYS,
) -> DataFrame:
    """Signal rules across a universe: each asset's candidates on train, its winner on the
    lockbox. rules maps a name to a function(bars, keys) that adds entry and exit; split is the
    first lockbox date. Output rows feed log.campaign_summary and log.failure_tally.

    Walk-forward chunks are series of their own in the same plan: a rule sees a chunk's rows only.
    """
    keys = ("asset", "rule", "segment", "chunk")
    run = keys[:-1]
    tagged = bars.withColumn("segment", F.when(F.col("ts") < split, "train").otherwise("lockbox"))
    whole = tagged.withColumn("chunk", F.lit(-1))
    part = ("asset", "segment")
    i, n = F.row_number().over(series(part)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*part))
    k = F.least(F.lit(4), F.floor(F.col("_n") / chunk_rows))
    size, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    head = extra * (size + 1)
    chunk = F.when(F.col("_i") < head, F.floor(F.col("_i") / (size + 1))).otherwise(extra + F.floor((F.col("_i") - head) / size))
    chunks = tagged.withColumns({"_i": i, "_n": n}).filter(F.col("_n") >= 2 * chunk_rows).withColumn("chunk", chunk.cast("int"))
    cut = written(whole.unionByName(chunks.drop("_i", "_n")), "campaign-bars")
    every = None
    for name, rule in rules.items():
        one = rule(cut.withColumn("rule", F.lit(name)), keys).select(*keys, "ts", "close", "entry", "exit")
        every = one if every is None else every.unionByName(one)
    equity = written(replay.replay_signals(every, cash=cash, keys=keys), "campaign-equity")
    scored = metrics.signal_metrics(equity, replay.signal_trades(equity, keys), equity, cash, keys)
    scored = written(scored, "campaign-metrics")
    walked = scored.filter("chunk >= 0").groupBy(*run).agg(*[F.avg(ok.cast("double")).alias(n) for n, ok in (
        ("_up", F.col("total_return_pct") > 0), ("_ahead", F.col("total_return_pct") > F.col("buy_and_hold_pct"))
    )])
    daily = equity.filter("chunk < 0").withColumn(
        "ret", F.col("equity") / F.coalesce(F.lag("equity").over(series(run)), F.lit(cash)) - 1
    )
    boot = bootstrap.summarize(bootstrap.resample(daily, run, "ts", paths=paths), run)
    spans = bars.groupBy("asset").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    train = F.col("segment") == "train"
    m = scored.filter("chunk < 0").drop("chunk").join(spans, "asset")
    m = m.join(walked, list(run), "left").join(boot.select(*run, F.col("passed").alias("_boot")), list(run), "left")
    m = m.withColumn(
        "n_days",
        trading_days(F.when(train, F.col("_a")).otherwise(split), F.when(train, F.date_sub(split, 1)).otherwise(F.col("_b"))),
    )
    walk = F.coalesce((F.col("_up") >= 0.5) & (F.col("_ahead") >= 0.5), F.lit(False))
    checks = [
        *validate.metric_rules("buy_and_hold_pct", min_trades), (CHECK_SERIES_WALK, walk),
        (CHECK_SERIES_RESAMPLE, F.coalesce(F.col("_boot") & (F.col("n_obs") >= 60), F.lit(False))),
    ]
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]))
    judged = m.withColumn("failed_checks", failed).withColumns({
        "n_checks": F.lit(len(checks)), "n_passed": F.lit(len(checks)) - F.size("failed_checks"), "walk_forward_failed": ~walk,
    }).withColumn("verdict", validate.research_verdict(F.lit(False), F.lit(True), F.lit(True)))
    place = F.create_map(*[F.lit(x) for i, name in enumerate(rules) for x in (name, i)])
    judged = written(judged.withColumn("idx", place[F.col("rule")]), "campaign-judged")
    best = log.slate_winner(judged.filter(train), ("asset",), "idx").select("asset", F.col("winner").alias("_idx"))
    best = best.join(judged.select("asset", F.col("idx").alias("_idx"), "rule").distinct(), ["asset", "_idx"]).select("asset", "rule")
    shown = judged.join(best.withColumn("_won", F.lit(True)), ["asset", "rule"], "left").filter(
        train | F.coalesce("_won", F.lit(False))
    )
    return shown.select(
        "asset", "rule", (~train).alias("is_lockbox"), "verdict", "failed_checks", "sharpe_ratio", "total_return_pct",
        "num_trades", "beats_benchmark",
    )
