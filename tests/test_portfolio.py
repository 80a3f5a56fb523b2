import numpy as np
import pytest
from pyspark.sql import functions as F

from barframe.operators import metrics as M
from barframe.operators import replay as R
from barframe.operators import validate as V
from barframe.operators import weights as Wt

N = 300
UP = np.linspace(100, 400, N)
FLAT = np.full(N, 100.0)
DOWN = np.linspace(100, 40, N)


def weights_of(panel, run):
    rows = Wt.target_weights(Wt.running_sums(panel), run).collect()
    out = {}
    for r in rows:
        out.setdefault(r.exec_pos, {})[r.asset] = r.weight
    return out


def test_momentum_holds_the_strongest_on_the_next_bar(make_panel, make_run):
    panel = make_panel({"AAA": UP, "BBB": FLAT, "CCC": DOWN})
    w = weights_of(panel, make_run(["AAA", "BBB", "CCC"], "cross_sectional_momentum", 50, N))
    assert min(w) == 51 and set(np.diff(sorted(w))) == {21}
    assert all(row == {"AAA": 1.0, "BBB": 0.0, "CCC": 0.0} for row in w.values())


def test_dual_momentum_leaves_the_shortfall_in_cash(make_panel, make_run):
    panel = make_panel({"AAA": UP, "BBB": DOWN})
    w = weights_of(panel, make_run(["AAA", "BBB"], "dual_momentum", 50, N, top_k=2))
    assert all(row == {"AAA": 0.5, "BBB": 0.0} for row in w.values())
    falling = make_panel({"AAA": np.linspace(100, 50, N), "BBB": np.linspace(100, 60, N)})
    w = weights_of(falling, make_run(["AAA", "BBB"], "dual_momentum", 50, N))
    assert all(sum(row.values()) == 0 for row in w.values())


def test_trend_and_hedge_families(make_panel, make_run):
    panel = make_panel({"AAA": UP, "BBB": np.linspace(400, 100, N)})
    assets = ["AAA", "BBB"]
    trend = weights_of(panel, make_run(assets, "equal_weight_trend", 60, N))
    assert all(row == {"AAA": 0.5, "BBB": 0.0} for row in trend.values())
    calm = weights_of(panel, make_run(assets, "crisis_hedge", 60, N, hedge=0.3))
    assert all(row == {"AAA": 1.0, "BBB": 0.0} for row in calm.values())
    crash = make_panel({"AAA": np.linspace(400, 100, N), "BBB": UP})
    w = weights_of(crash, make_run(assets, "crisis_hedge", 60, N, hedge=0.3))
    assert all(row == {"AAA": 0.0, "BBB": 0.3} for row in w.values())


def test_reversal_ignores_the_recent_gap(make_panel, make_run):
    fell = np.concatenate([np.linspace(200, 80, 250), np.linspace(80, 300, 50)])
    panel = make_panel({"AAA": fell, "BBB": FLAT})
    w = weights_of(panel, make_run(["AAA", "BBB"], "cross_sectional_reversal", 240, N, skip=50, rebalance=10))
    assert w[max(w)] == {"AAA": 1.0, "BBB": 0.0}


def test_volatility_scaling_prefers_the_quiet_asset(make_panel, make_run):
    t = np.arange(N)
    panel = make_panel({"AAA": 100 * 1.002 ** t * (1 + 0.001 * (-1) ** t), "BBB": 100 * 1.002 ** t * (1 + 0.01 * (-1) ** t)})
    for row in weights_of(panel, make_run(["AAA", "BBB"], "volatility_scaled_momentum", 100, N)).values():
        assert row["AAA"] > row["BBB"] > 0 and sum(row.values()) == pytest.approx(1)


@pytest.mark.parametrize("family", ["cross_sectional_momentum", "equal_weight_trend", "volatility_scaled_momentum", "cross_sectional_reversal"])
def test_weights_do_not_see_the_future(make_panel, make_run, family):
    rng = np.random.default_rng(5)
    closes = {a: 100 * np.exp(np.cumsum(rng.normal(0, 0.02, N))) for a in "ABC"}
    cut = {a: c[:200] for a, c in closes.items()}
    whole = weights_of(make_panel(closes), make_run("ABC", family, 60, N, skip=10))
    part = weights_of(make_panel(cut), make_run("ABC", family, 60, 200, skip=10))
    assert part and all(whole[p] == pytest.approx(row) for p, row in part.items())


def book(closes, weights, cost, cash=10_000.0):
    """A plain cash-and-shares book."""
    assets = list(closes)
    shares, money, navs = dict.fromkeys(assets, 0.0), cash, []
    for i in range(len(closes[assets[0]])):
        px = {a: closes[a][i] for a in assets}
        nav = money + sum(shares[a] * px[a] for a in assets)
        if i in weights:
            post = nav
            for _ in range(60):
                post = nav - cost * sum(abs(weights[i].get(a, 0) * post - shares[a] * px[a]) for a in assets)
            shares = {a: weights[i].get(a, 0) * post / px[a] for a in assets}
            money, nav = post * (1 - sum(weights[i].values())), post
        navs.append(nav)
    return navs


@pytest.mark.parametrize("family,top_k", [("cross_sectional_momentum", 2), ("time_series_momentum", 1), ("volatility_scaled_momentum", 1)])
def test_nav_equals_a_sequential_book(spark, make_panel, make_run, family, top_k):
    rng = np.random.default_rng(11)
    closes = {a: 100 * np.exp(np.cumsum(rng.normal(0, 0.03, N))) for a in "ABCD"}
    panel, run = make_panel(closes), make_run("ABCD", family, 30, N, top_k=top_k, rebalance=7)
    w = Wt.target_weights(Wt.running_sums(panel), run)
    nav = R.replay_weights(R.run_bars(panel, run), w, 0.01).orderBy("pos").collect()
    want = book(closes, weights_of(panel, run), 0.01)
    assert [r.nav for r in nav] == pytest.approx(want, rel=1e-9)
    paid = sum(r.cost_paid for r in nav)
    assert paid > 0 and all(r.exposure <= 1 + 1e-9 for r in nav)


def test_first_full_order_pays_exactly_its_cost(spark, make_panel):
    panel = make_panel({"AAA": [100, 100, 100, 110, 120], "BBB": [50] * 5})
    run = spark.createDataFrame([("r", "U", ["AAA", "BBB"], 0, 4)], "run_id string, universe_id string, assets array<string>, pos0 int, pos1 int")
    w = spark.createDataFrame([("r", 2, "AAA", 1.0), ("r", 2, "BBB", 0.0)], "run_id string, exec_pos int, asset string, weight double")
    free = [r.nav for r in R.replay_weights(R.run_bars(panel, run), w, 0.0).orderBy("pos").collect()]
    assert free == pytest.approx([10000, 10000, 10000, 11000, 12000])
    paid = R.replay_weights(R.run_bars(panel, run), w, 0.0015).orderBy("pos").collect()
    assert paid[2].nav == pytest.approx(10000 / 1.0015)


def test_benchmark_uses_the_core_for_a_hedge(make_panel, make_run):
    panel = make_panel({"AAA": UP, "BBB": DOWN})
    both = M.equal_weight_benchmark(panel, make_run(["AAA", "BBB"], "dual_momentum", 50, N)).first()
    core = M.equal_weight_benchmark(panel, make_run(["AAA", "BBB"], "crisis_hedge", 50, N)).first()
    assert both.benchmark_pct == pytest.approx((300 - 60) / 2) and core.benchmark_pct == pytest.approx(300)


def test_chunks_match_array_split(spark):
    for n, k in ((10, 3), (1009, 4), (7, 7)):
        got = spark.range(1).select(F.inline(V.chunk_bounds(F.lit(n), F.lit(k)))).collect()
        want = [(int(c[0]), int(c[-1])) for c in np.array_split(np.arange(n), k)]
        assert [(r["first"], r["last"]) for r in got] == want


def test_plateau_spike_none(spark):
    grids = {"flat": [0, 1, 1, 1, 0], "lone": [0, 1, 0, 1, 0], "dead": [0] * 5}
    rows = [(k, i * 10, True, bool(v)) for k, vs in grids.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "sweep string, value int, ok boolean, confirms boolean")
    got = {r.sweep: (r.verdict, r.longest_run, r.from_value, r.to_value) for r in V.plateau(df, ("sweep",)).collect()}
    assert got == {"flat": ("PLATEAU", 3, 10, 30), "lone": ("SPIKE", 1, 10, 10), "dead": ("NONE", 0, None, None)}


def test_stress_verdicts(spark):
    def rows(key, base, share):
        out = [(key, "lockbox", "lockbox_pct=0.20", True, base)]
        return out + [(key, c, f"{c}{i}", True, i < share * 10) for c in ("parameter", "universe") for i in range(10)]

    df = spark.createDataFrame(rows("good", True, 0.8) + rows("weak", True, 0.4) + rows("gone", False, 0.9),
                               "k string, category string, label string, runnable boolean, confirms boolean")
    got = {r.k: r.verdict for r in V.stress_summary(df, ("k",)).collect()}
    assert got == {"good": "ROBUST", "weak": "FRAGILE", "gone": "BROKEN"}
