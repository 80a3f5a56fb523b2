import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barframe.functions.normal import norm_cdf, norm_ppf
from barframe.operators import indicators as I
from barframe.operators import replay as R
from barframe.operators import signals as S
from barframe.operators import trades as Tr
from barframe.operators.log import deflated_threshold
from barframe.operators.validate import probabilistic_sharpe

SCHEMA = "asset string, ts date, open double, high double, low double, close double, volume double"


def random_bars(n=400, seed=3, assets=("A", "B")):
    rng = np.random.default_rng(seed)
    rows = []
    for a in assets:
        close = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, n)))
        open_ = close * np.exp(rng.normal(0, 0.01, n))
        high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.02, n))
        low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.02, n))
        for i in range(n):
            rows.append((a, dt.date(2010, 1, 1) + dt.timedelta(days=i), *map(float, (open_[i], high[i], low[i], close[i])), 1.0))
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(random_bars(), SCHEMA).cache()


def frame(df, asset="A"):
    return df.filter(F.col("asset") == asset).orderBy("ts").toPandas()


@pytest.mark.parametrize("span", [1, 2, 3, 20, 150])
def test_ema_equals_the_recursion(spark, bars, span):
    out = frame(I.with_ema(bars, "close", "e", span))
    want = out["close"].ewm(span=span, adjust=False).mean()
    np.testing.assert_allclose(out["e"], want, rtol=1e-12)


def test_ema_over_many_blocks(spark):
    n = 3000
    x = np.random.default_rng(1).uniform(50, 150, n)
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "asset string, ts int, close double")
    for span in (2, 5, 60):
        out = frame(I.with_ema(df, "close", "e", span, min_periods=span))
        want = pd.Series(x).ewm(span=span, adjust=False, min_periods=span).mean()
        np.testing.assert_allclose(out["e"].to_numpy(float), want, rtol=1e-12)


def test_rsi_extremes_and_warm_up(spark):
    up = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), 100.0 + i) for i in range(30)]
    flat = [("B", d, 100.0) for _, d, _ in up]
    df = spark.createDataFrame(up + flat, "asset string, ts date, close double")
    out = I.with_rsi(df, 14)
    a, b = frame(out, "A"), frame(out, "B")
    assert a["rsi"].isna().sum() == 14 and set(a["rsi"].dropna()) == {100.0}
    assert set(b["rsi"].dropna()) == {0.0}


def test_rolling_indicators_against_pandas(bars):
    out = frame(I.with_atr(bars, 14).withColumns({
        "sma": I.sma("close", 20), "dh": I.donchian_high(20), "sd": I.rolling_std("close", 20, ddof=0)}))
    c = out["close"]
    np.testing.assert_allclose(out["sma"], c.rolling(20).mean(), rtol=1e-10)
    np.testing.assert_allclose(out["sd"], c.rolling(20).std(ddof=0), rtol=1e-8)
    np.testing.assert_allclose(out["dh"], out["high"].rolling(20).max().shift(1))
    tr = pd.concat([out["high"] - out["low"], (out["high"] - c.shift()).abs(), (out["low"] - c.shift()).abs()], axis=1).max(axis=1)
    np.testing.assert_allclose(out["atr"], tr.rolling(14).mean(), rtol=1e-10)


SIGNALS = [
    lambda b: S.sma_crossover(b, 5, 15), lambda b: S.donchian_breakout(b, 20, 10), lambda b: S.filtered_donchian_breakout(b, 20, 10, 14, 20, 50),
    lambda b: S.rsi_mean_reversion(b), lambda b: S.ema_crossover(b, 5, 15), lambda b: S.bollinger_breakout(b, 20, 1.0),
    lambda b: S.sma_atr_trail(b, 5, 15), lambda b: S.macd_crossover(b), lambda b: S.supertrend(b, 10, 1.0), lambda b: S.sma_volatility_gate(b),
]


@pytest.mark.parametrize("rule", SIGNALS)
def test_signals_do_not_see_the_future(bars, rule):
    cut = dt.date(2010, 9, 1)
    key = ["asset", "ts", "entry", "exit"]
    whole = rule(bars).filter(F.col("ts") < F.lit(cut)).select(*key)
    part = rule(bars.filter(F.col("ts") < F.lit(cut))).select(*key)
    assert whole.exceptAll(part).count() == 0 and part.count() > 0


def test_filter_only_removes_entries(bars):
    plain = S.donchian_breakout(bars, 20, 10).filter("entry").select("asset", "ts")
    filtered = S.filtered_donchian_breakout(bars, 20, 10, 14, 20, 50).filter("entry").select("asset", "ts")
    assert filtered.exceptAll(plain).count() == 0 and 0 < filtered.count() < plain.count()


def test_warm_up_of_the_trend_counts_as_exit(bars):
    first = frame(S.filtered_donchian_breakout(bars, 20, 10, 14, 20, 200)).head(100)
    assert first["exit"].all() and not first["entry"].any()


def test_holding_window(spark):
    df = spark.createDataFrame([("A", i, i == 2) for i in range(20)], "asset string, ts int, event boolean")
    out = df.select("ts", S.holding_from_events("event", 3, 4).alias("p")).orderBy("ts").collect()
    assert [r.ts for r in out if r.p] == [5, 6, 7, 8]


def test_replay_equals_a_cash_book(bars):
    out = R.replay_signals(S.sma_crossover(bars, 5, 15), 0.001, 0.0005)
    got = frame(out)
    cash, shares, want = 10_000.0, 0.0, []
    for r in got.itertuples():
        if shares == 0 and r.entry and not r.exit:
            shares, cash = cash / (r.close * 1.0005 * 1.001), 0.0
        elif shares > 0 and r.exit and not r.entry:
            cash, shares = shares * r.close * 0.9995 * 0.999, 0.0
        want.append(cash + shares * r.close)
    np.testing.assert_allclose(got["equity"], want, rtol=1e-10)
    total = R.signal_trades(out).filter("asset = 'A'").agg(F.product(1 + F.col("trade_return")).alias("p")).first().p
    assert total == pytest.approx(want[-1] / 10_000)


def walk(pdf, side, sl, trail):
    """The stop rules one bar at a time."""
    rows, held = [], None
    n = len(pdf)
    for i, b in enumerate(pdf.itertuples()):
        if held:
            sign = 1 if side == "long" else -1
            best, worst = (max, min) if side == "long" else (min, max)
            level = best(held["hard"], held["trail"])
            if (b.low <= level) if side == "long" else (b.high >= level):
                rows.append((held["at"], b.ts, worst(b.open, level), "stop_or_trail"))
                held = None
                continue
            held["anchor"] = best(held["anchor"], b.close)
            held["trail"] = best(held["trail"], held["anchor"] - sign * trail * held["atr"])
            continue
        if b.raw_entry and i + 1 < n and b.atr > 0:
            nxt = pdf.iloc[i + 1]
            sign = 1 if side == "long" else -1
            held = {"at": nxt.ts, "atr": b.atr, "anchor": nxt.open, "hard": nxt.open - sign * sl * b.atr, "trail": nxt.open - sign * trail * b.atr}
    if held:
        rows.append((held["at"], pdf.ts.iloc[-1], pdf.close.iloc[-1], "end_of_data"))
    return rows


@pytest.mark.parametrize("side,fan,pick", [("long", 64, 256), ("short", 5, 3)])
def test_stop_trades_equal_the_walk(bars, side, fan, pick):
    """Small blocks send most candidates up and down several levels, small runs double pointers."""
    p = S.trend_pullback_entry(bars, side, 20, 10, 2, 10).cache()
    got = Tr.stop_trades(p, (("s", 1.5, 3.0),), side, fan=fan, pick=pick).orderBy("asset", "entry_ts").collect()
    for a in ("A", "B"):
        want = walk(frame(p, a), side, 1.5, 3.0)
        mine = [(r.entry_ts, r.exit_ts, r.exit_price, r.exit_reason) for r in got if r.asset == a]
        assert len(want) > 3 and [m[:2] + m[3:] for m in mine] == [w[:2] + w[3:] for w in want]
        assert [m[2] for m in mine] == pytest.approx([w[2] for w in want])


def test_ten_basis_points_per_side_cost_a_fifth_of_a_percent(spark):
    t = spark.createDataFrame([(5.0, 1.0, 2.0, 100.0)], "gross_return_pct double, sl_atr double, entry_atr double, entry_price double")
    r = Tr.with_costs(t, 10.0).first()
    assert r.net_return_pct == pytest.approx(4.8) and r.r_multiple == pytest.approx(2.4)


def test_normal_functions(spark):
    from statistics import NormalDist

    nd = NormalDist()
    zs = [-9.0, -7.2, -3.3, -1.0, -0.01, 0.0, 0.5, 2.0, 6.9, 7.5]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", norm_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(nd.cdf(r.z), rel=1e-6, abs=1e-15)
    ps = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", norm_ppf(F.col("p")).alias("x")).collect():
        assert r.x == pytest.approx(nd.inv_cdf(r.p), abs=1e-9)


def test_sharpe_significance(spark):
    from statistics import NormalDist

    nd = NormalDist()
    r = spark.range(1).select(
        probabilistic_sharpe(F.lit(1.0), F.lit(500)).alias("a"), probabilistic_sharpe(F.lit(1.0), F.lit(1000)).alias("b"),
        deflated_threshold(F.lit(0.0004), F.lit(10)).alias("t")).first()
    assert r.a == pytest.approx(nd.cdf(1 / math.sqrt(252) * math.sqrt(499))) and r.b > r.a
    g = 0.5772156649015329
    want = 0.02 * ((1 - g) * nd.inv_cdf(0.9) + g * nd.inv_cdf(1 - 1 / (10 * math.e)))
    assert r.t == pytest.approx(want, abs=1e-10)
