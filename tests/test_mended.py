"""Runs that cannot be evaluated, large and several universes, missing prices and gaps."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barframe.functions.scalars import packed_key
from barframe.operators import indicators as I
from barframe.operators import mining as Mi
from barframe.operators import research as Re
from barframe.operators import validate as V
from barframe.operators import weights as Wt
from barframe.operators.bars import calendar
from barframe.plans.portfolio_q import whole_span_runs
from barframe.session import work_path
from barframe.streaming import books as Bk

D0 = dt.date(2015, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def test_every_variant_comes_back_with_a_status(spark, make_panel):
    rng = np.random.default_rng(4)
    panel = make_panel({a: 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.01, 2200))) for a in "AB"})
    spans = {"good": (D0, day(2199)), "outside": (day(9000), day(9900)), "short": (D0, day(500)), "one_day": (D0, D0)}
    rows = [(n, "U", ["A", "B"], "equal_weight_trend", 30, 1, 10, 0, None, a, b) for n, (a, b) in spans.items()]
    specs = spark.createDataFrame(rows, "run_id string, universe_id string, assets array<string>, family string, lookback int, top_k int, "
                                        "rebalance int, skip int, hedge_weight double, start date, end date")
    located = Re.with_segments(specs, calendar(panel), 0.25)
    results = Re.evaluate(Wt.running_sums(panel), panel, located, paths=50)
    out = {r.spec_id: (r.status, r.reason) for r in Re.confirmations(results, located, specs).collect()}
    assert out == {"good": ("ok", None), "outside": ("unrunnable", "no held-out dates"), "short": ("unrunnable", "too few held-out rows"),
                   "one_day": ("unrunnable", "no held-out dates")}


def test_unrunnable_variants_leave_the_rates(spark):
    rows = [("s", "lockbox", "lockbox_pct=0.20", True, True), ("s", "lockbox", "lockbox_pct=0.15", False, False), ("s", "parameter", "x", True, True)]
    df = spark.createDataFrame(rows, "spec_id string, category string, label string, runnable boolean, confirms boolean")
    r = V.stress_summary(df, ("spec_id",)).first()
    assert (r.n_runnable, r.unrunnable, r.overall_rate, r.verdict) == (2, 1, 1.0, "ROBUST")


def test_perturbations_follow_the_rules_of_the_specification(spark):
    spec = spark.createDataFrame([("s", ["A", "B"], "cross_sectional_reversal", 252, 1, 21, 220, None)],
                                 "spec_id string, assets array<string>, family string, lookback int, top_k int, rebalance int, skip int, hedge_weight double")
    kept = {(r.lookback, r.skip) for r in V.perturbations(spec).filter("category = 'parameter'").collect()}
    assert kept and all(skip < lookback for lookback, skip in kept) and (201, 220) not in kept


def test_a_universe_of_120_assets_is_whole(make_panel):
    panel = make_panel({f"A{i:03d}": [100.0 + i, 101.0, 102.0] for i in range(120)})
    runs = whole_span_runs(panel, ("r", "equal_weight_trend", 2, 1, 1, 0, None), ("three", "equal_weight_trend", 2, 1, 1, 0, None, 3)).collect()
    assert {r.run_id: len(r.assets) for r in runs} == {"r": 120, "three": 3}


def test_best_facts_and_specs_of_every_universe(spark):
    rows = [(u, "event_followthrough", "L", f"F{i}", 5, 1.0 + i * w, 1.0, 100, 10, 0.01, 0.02, 1.0, 1.0) for u, w in (("U", 0.1), ("V", 0.001)) for i in range(6)]
    facts = spark.createDataFrame(rows, "universe_id string, kind string, leader string, follower string, lag_days int, score double, effect double, n_obs int, "
                                        "trials int, p_value double, adjusted_p_value double, train_score double, holdout_score double")
    for out in (Mi.top_facts(facts, 2), Mi.candidate_specs(facts, 2)):
        assert sorted(r.universe_id for r in out.collect()) == ["U", "U", "V", "V"]


def test_a_held_asset_needs_a_price(spark):
    rows = [("b", day(0), {"A": 10.0, "B": 10.0}, {"A": 0.5, "B": 0.5}), ("b", day(1), {"A": 10.0}, {"A": 1.0}), ("b", day(2), {"A": 10.0, "B": 10.0}, None)]
    landing, out = work_path(spark, "bars"), work_path(spark, "ledger")
    spark.createDataFrame(rows, Bk.BOOK_BAR).coalesce(1).write.parquet(landing)
    stream = spark.readStream.schema(Bk.BOOK_BAR).parquet(landing)
    Bk.run_available(Bk.ledger_stream(stream, 0.0, 10_000.0), out, work_path(spark, "state"))
    got = spark.read.parquet(out).orderBy("ts").collect()
    assert [r.problem for r in got] == [None, "no price for held B", None] and [r.post_nav for r in got] == [10_000.0, None, 10_000.0]


@pytest.mark.parametrize("span", [1, 3, 26, 400])
def test_ema_over_gaps_equals_pandas(spark, span):
    rng = np.random.default_rng(span)
    x = rng.normal(100, 5, 3000)
    x[rng.random(3000) < 0.3] = np.nan
    x[:4] = np.nan
    x[500:1400] = np.nan
    rows = [("A", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = I.with_ema(spark.createDataFrame(rows, "asset string, ts int, x double"), "x", "y", span, min_periods=5)
    got = np.array([np.nan if r.y is None else r.y for r in df.orderBy("ts").collect()])
    want = pd.Series(x).ewm(span=span, adjust=False, min_periods=5).mean().to_numpy()
    assert np.allclose(got, want, equal_nan=True, rtol=1e-9)


def test_packed_key_sorts_like_the_tuple(spark):
    rows = [(2, 10**11, 7), (1, 999, 9), (1, 10**11, 0), (2, 3, 1)]
    df = spark.createDataFrame(rows, "a int, b long, c int").withColumn("k", packed_key((F.col("a"), 6), (F.col("b"), 12), (F.col("c"), 2)))
    assert [tuple(r)[:3] for r in df.orderBy("k").collect()] == sorted(rows)


def test_campaign_checks_equal_separate_replays(spark):
    from barframe.operators import metrics as M
    from barframe.operators import replay as R
    from barframe.operators import signals as S

    rng = np.random.default_rng(8)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0008, 0.01, 1500)))
    bars = spark.createDataFrame([("A", day(i), float(c)) for i, c in enumerate(close)], "asset string, ts date, close double")
    rules = {"x 3/7": lambda b, k: S.sma_crossover(b, 3, 7, k), "x 5/15": lambda b, k: S.sma_crossover(b, 5, 15, k)}
    out = {r.rule: r for r in Re.campaign(bars, rules, F.lit(day(1100)).cast("date"), paths=50).filter("not is_lockbox").collect()}
    parts = np.array_split(np.arange(1100), 4)
    cut = spark.createDataFrame([(str(c), day(int(i)), float(close[i])) for c, p in enumerate(parts) for i in p], "asset string, ts date, close double")
    assert set(out) == set(rules)
    for name, rule in rules.items():
        equity = R.replay_signals(rule(cut, ("asset",)))
        m = M.signal_metrics(equity, R.signal_trades(equity), equity, R.INITIAL_CASH).collect()
        ok = np.mean([r.total_return_pct > 0 for r in m]) >= 0.5 and np.mean([r.total_return_pct > r.buy_and_hold_pct for r in m]) >= 0.5
        assert (Re.CHECK_SERIES_WALK in out[name].failed_checks) == (not ok)


def test_pair_states_equal_a_walk_over_the_bars(spark):
    from barframe.operators import pairs as P

    rng = np.random.default_rng(6)
    rows = [(p, day(i), float(np.exp(a)), float(np.exp(b))) for p in ("x", "y")
            for i, (a, b) in enumerate(zip(rng.normal(0, 0.1, 900), rng.normal(0, 0.1, 900)))]
    df = spark.createDataFrame(rows, "pair_id string, ts date, l1 double, l2 double")
    out = P.spread_state_signals(df, 20, 1.2, 0.4).orderBy("pair_id", "ts").collect()
    assert len(out) == 1800 and {r.state for r in out} == {-1, 0, 1}
    pair, held = None, 0
    for r in out:
        held, pair = (held if r.pair_id == pair else 0), r.pair_id
        before, z = held, r.zscore
        if z is not None:
            if held == 0:
                held = 1 if z < -1.2 else -1 if z > 1.2 else 0
            elif (held == 1 and z > -0.4) or (held == -1 and z < 0.4):
                held = 0
        assert (r.state, r.entry, r.exit) == (held, before == 0 and held != 0, before != 0 and held == 0)


def test_variants_are_made_once_a_spec_by_compiled_code(spark):
    """Lambdas run uncompiled: they belong below the generator, once a spec and not once a variant, and
    what the generator repeats is a finished column."""
    rows = [(1, ["SPY", "TLT", " spy", "", "GLD"], "dual_momentum", 40, 2, 1), (2, ["A", "B"], "equal_weight_trend", 20, 1, 21),
            (3, ["A", None, "a"], "dual_momentum", 40, 1, 1), (4, None, "dual_momentum", 40, 1, 1), (5, ["A", "B"], None, None, None, None)]
    specs = spark.createDataFrame(rows, "spec_id long, assets array<string>, family string, lookback int, top_k int, rebalance int")
    out = V.perturbations(specs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate")]
    assert "lambda" not in above and "lambda" not in plan[plan.index("Generate"):].splitlines()[0]
    found = sorted((r.spec_id, r.category, r.label, r.lookback, r.rebalance, r.top_k, tuple(r.assets or ())) for r in out.filter("spec_id < 5").collect())
    three, cuts = ("SPY", "TLT", "GLD"), ("0.15", "0.20", "0.25", "0.30")
    want = [(1, "lockbox", f"lockbox_pct={p}", 40, 1, 2, three) for p in cuts]
    want += [(1, "parameter", f"lookback={v}", v, 1, 2, three) for v in (32, 50)]
    want += [(1, "parameter", "rebalance=2", 40, 2, 2, three)] + [(1, "parameter", f"top_k={k}", 40, 1, k, three) for k in (1, 3)]
    want += [(1, "universe", f"drop {a}", 40, 1, 2, tuple(x for x in three if x != a)) for a in three]
    want += [(2, "lockbox", f"lockbox_pct={p}", 20, 21, 1, ("A", "B")) for p in cuts] + [(2, "parameter", "lookback=25", 25, 21, 1, ("A", "B"))]
    want += [(2, "parameter", f"rebalance={v}", 20, v, 1, ("A", "B")) for v in (10, 42)]
    assert [r for r in found if r[0] < 4] == sorted(want)
    assert [r.label for r in out.filter("spec_id = 5").collect()] == [f"lockbox_pct={p}" for p in cuts]
