import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barframe.operators import metrics as M
from barframe.operators import replay as R
from barframe.operators import research as Re
from barframe.operators import validate as V
from barframe.operators import weights as Wt
from barframe.operators.bars import calendar
from barframe.session import written

N = 1200


@pytest.fixture(scope="module")
def located(spark, make_panel):
    rng = np.random.default_rng(2)
    panel = make_panel({a: 100 * np.exp(np.cumsum(rng.normal(0.0004, 0.01, N))) for a in "ABC"})
    d0 = dt.date(2015, 1, 1)
    rows = [(f, "U", list("ABC"), f, 30, 1, 10, 0, None, d0, d0 + dt.timedelta(days=N + 50)) for f in ("dual_momentum", "equal_weight_trend")]
    specs = spark.createDataFrame(rows, "run_id string, universe_id string, assets array<string>, family string, lookback int, top_k int, rebalance int, "
                                        "skip int, hedge_weight double, start date, end date")
    return panel, specs, written(Re.with_segments(specs, calendar(panel), 0.25), "located")


def test_segments_are_disjoint_and_cover_the_range(located):
    _, _, runs = located
    got = {r.segment: (r.pos0, r.pos1) for r in runs.filter("spec_id = 'dual_momentum'").collect()}
    assert got["train"][0] == 0 and got["lockbox"] == (got["train"][1] + 1, N - 1)


def test_evaluation_equals_separate_replays(located):
    """Parents and chunks replayed on their own give the metrics and the walk-forward outcome."""
    panel, _, runs = located
    sums = Wt.running_sums(panel)
    whole = {r.run_id: r for r in Re.evaluate(sums, panel, runs).collect()}
    chunks = V.walk_forward_chunks(runs).withColumn("run_id", F.concat_ws("#", "run_id", F.col("chunk").cast("string")))
    alone = written(runs.unionByName(chunks.drop("chunk")), "alone")
    nav = R.replay_weights(R.run_bars(panel, alone), Wt.target_weights(sums, alone))
    m = {r.run_id: r for r in M.nav_metrics(nav, M.equal_weight_benchmark(panel, alone), R.INITIAL_CASH).collect()}
    assert len(whole) == 4
    for key, got in whole.items():
        want = m[key]
        for c in ("total_return_pct", "benchmark_pct", "sharpe_ratio", "max_drawdown_pct"):
            assert got[c] == pytest.approx(want[c])
        parts = [r for k, r in m.items() if k.startswith(key + "#")]
        share = [np.mean([f(p) for p in parts]) >= 0.5 if parts else False
                 for f in (lambda p: p.total_return_pct > 0, lambda p: p.total_return_pct > p.benchmark_pct)]
        assert got.walk_forward_failed == (not all(share))
        assert got.n_checks == 7 and got.n_passed == 7 - len(got.failed_checks)


def test_verdict_of_a_short_run_is_an_error(located):
    panel, _, runs = located
    out = Re.evaluate(Wt.running_sums(panel), panel, runs.filter("segment = 'lockbox'"), min_rows=500).collect()
    assert {r.verdict for r in out} == {"error"}


def test_slate_comes_back_whole(spark, located):
    """Every spec has a row, an outcome and a reason; the winner alone sees the lockbox."""
    panel, specs, runs = located
    text = specs.withColumns({c: F.col(c).cast("string") for c in ("start", "end")})
    one = text.filter("run_id = 'dual_momentum'")

    def bad(name, **cols):
        return one.withColumn("run_id", F.lit(name)).withColumns({k: v if not isinstance(v, str) else F.lit(v) for k, v in cols.items()})

    slate = (
        text.unionByName(bad("one asset", assets=F.array(F.lit("A")))).unionByName(bad("backwards", start="2020-01-02", end="2019-01-01"))
        .unionByName(bad("unread", start="soon")).unionByName(bad("early", start="1990-01-01", end="1995-01-01"))
        .unionByName(bad("short", start="2017-01-01", end="2017-06-01")).unionByName(bad("no lookback", lookback=F.lit(5)))
        .unionByName(bad("twice", assets=F.array(F.lit("A"), F.lit("a"), F.lit("A"))))
    )
    slate = slate.withColumns({"slate_id": F.lit("s"), "idx": F.when(F.col("run_id") == "dual_momentum", 2).otherwise(F.when(F.col("run_id") == "equal_weight_trend", 1).otherwise(9))})
    sums = Wt.running_sums(panel)
    out = {r.spec_id: r for r in Re.slate_research(sums, panel, slate, calendar(panel), 0.25, paths=100).collect()}
    assert len(out) == slate.count() == 9
    status = {k: (r.status, r.verdict) for k, r in out.items()}
    assert {k for k, v in status.items() if v == ("rejected", "reject")} == {"one asset", "backwards", "unread", "no lookback", "twice"}
    assert {k for k, v in status.items() if v == ("error", "error")} == {"early", "short"}
    assert (out["early"].reason, out["short"].reason, out["unread"].reason) == ("no dates in the calendar", "too few rows", "invalid ISO date")
    assert out["unread"].required_changes == ["use YYYY-MM-DD dates"] and out["backwards"].required_changes == ["choose an end date after the start date"]
    assert out["short"].warnings == ["backtest period is less than 3 years", "portfolio rotates across 3 assets only"]
    good = ("dual_momentum", "equal_weight_trend")
    alone = {r.run_id: r for r in Re.evaluate(sums, panel, runs, paths=100).collect()}
    for name in good:
        want, got = alone[f"{name}|train"], out[name]
        assert got.status == "ok" and got.trials == 2 and got.n_checks == want.n_checks + 1
        assert got.failed_checks == want.failed_checks + ([] if got.dsr_passed else [Re.CHECK_DSR])
        assert (got.verdict, got.n_passed) == (want.verdict, want.n_passed + int(got.dsr_passed))
    best = max(good, key=lambda n: (out[n].beats_benchmark, out[n].sharpe_ratio))
    assert [k for k, r in out.items() if r.is_winner] == [best] == [k for k, r in out.items() if r.lockbox_status is not None]
    box = alone[f"{best}|lockbox"]
    if box.verdict == "error":
        assert out[best].lockbox_reason == "too few rows"
    else:
        assert out[best].lockbox_verdict == box.verdict and out[best].lockbox_total_return_pct == pytest.approx(box.total_return_pct)


def test_slate_without_a_runnable_spec(spark, located):
    panel, specs, _ = located
    slate = specs.withColumns({"slate_id": F.lit("s"), "idx": F.lit(1), "assets": F.array(F.lit("A"))})
    out = Re.slate_research(Wt.running_sums(panel), panel, slate, calendar(panel), paths=0).collect()
    assert len(out) == 2 and {(r.status, r.is_winner) for r in out} == {("rejected", False)}


def test_batch_comes_back_whole(spark, located):
    panel, specs, _ = located
    lone = specs.filter("run_id = 'dual_momentum'").withColumns({"run_id": F.lit("lone"), "assets": F.array(F.lit("A"))})
    old = lone.withColumns({"run_id": F.lit("old"), "assets": F.array(F.lit("A"), F.lit("B")), "start": F.lit("1990-01-01").cast("date"), "end": F.lit("1994-01-01").cast("date")})
    out = {r.spec_id: r for r in Re.batch_research(Wt.running_sums(panel), panel, specs.unionByName(lone).unionByName(old), calendar(panel), paths=0).collect()}
    assert {k: r.status for k, r in out.items()} == {"dual_momentum": "ok", "equal_weight_trend": "ok", "lone": "rejected", "old": "error"}
    assert out["old"].reason == "no dates in the calendar" and out["dual_momentum"].n_checks == 6 and out["lone"].sharpe_ratio is None
