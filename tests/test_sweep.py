import datetime as dt
import random

from barframe.operators import signals as S
from barframe.operators import sweep as Sw
from barframe.operators.metrics import signal_metrics
from barframe.operators.replay import INITIAL_CASH, replay_signals, signal_trades
from pyspark.sql import functions as F

START = dt.date(2015, 1, 1)


def walk(spark, n=400, assets=("A", "B"), seed=3):
    rng = random.Random(seed)
    rows = []
    for a in assets:
        p = 100.0
        for i in range(n):
            p = max(5.0, round(p + rng.choice([-2, -1, 0, 0, 1, 2.25]), 2))
            rows.append((a, START + dt.timedelta(days=i), p))
            if i % 50 == 7:
                rows.append((a, START + dt.timedelta(days=n + i), None))
    rows += [("flat", START + dt.timedelta(days=i), 7.1) for i in range(60)]
    return spark.createDataFrame(rows, "asset string, ts date, close double")


def test_lattice_equals_one_crossover_a_value(spark):
    bars = walk(spark)
    lattice = Sw.crossover_lattice(bars, [1, 2, 5, 9], 12).filter("asset <> 'flat'")
    for n in (1, 2, 5, 9):
        one = S.sma_crossover(bars.filter("close is not null and asset <> 'flat'"), n, 12)
        got = lattice.filter(F.col("value") == n).select("asset", "ts", "entry", "exit")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.select("asset", "ts", "entry", "exit").collect()))
    assert Sw.crossover_lattice(bars, [1, 2, 5, 9], 12).filter("asset = 'flat' and (entry or exit)").count() == 0


def test_lattice_takes_one_exchange(spark, tmp_path):
    walk(spark).write.parquet(f"{tmp_path}/bars")
    lattice = Sw.crossover_lattice(spark.read.parquet(f"{tmp_path}/bars"), list(range(2, 40)), 50)
    plan = replay_signals(lattice, keys=("asset", "value"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_entries_and_surface(spark):
    bars, held_out = walk(spark), START + dt.timedelta(days=280)
    entries = Sw.sweep_entries(bars, (9, 2, 5, 12, 0, 2), 12, str(held_out))
    out = {(r.asset, r.value): r for r in entries.collect()}
    assert sorted(v for a, v in out if a == "A") == [0, 2, 5, 9, 12] and len(out) == 15
    for v in (0, 12):
        assert out["A", v].status == "invalid" and not out["A", v].confirms and out["A", v].train_verdict is None
    alone = bars.filter((F.col("ts") >= F.lit(held_out)) & F.col("close").isNotNull() & (F.col("asset") == "A"))
    for v in (2, 5, 9):
        eq = replay_signals(S.sma_crossover(alone, v, 12))
        m = signal_metrics(eq, signal_trades(eq), eq, INITIAL_CASH).first()
        r = out["A", v]
        assert abs(r.held_out_return_pct - m.total_return_pct) < 1e-9 and abs(r.held_out_benchmark_pct - m.buy_and_hold_pct) < 1e-9
        assert r.lockbox_verdict in ("reject", "needs_more_testing", "worth_paper_trading") and r.train_verdict is not None
    assert out["flat", 2].lockbox_verdict is None and out["flat", 2].train_verdict == "reject"
    surface = {r.asset: r for r in Sw.sweep_surface(entries).collect()}
    assert set(surface) == {"A", "B", "flat"}
    for a, r in surface.items():
        assert r.n_confirmed == sum(o.confirms for k, o in out.items() if k[0] == a)


def test_surface_of_known_entries(spark):
    rows = [("x", v, True, c, s, 200) for v, c, s in ((2, True, 1.0), (3, True, 2.0), (4, False, 0.1), (5, True, 0.5), (6, True, 0.4), (7, True, 0.3))]
    rows += [("y", 2, True, True, 1.0, 200), ("y", 3, False, False, None, None), ("y", 4, True, True, 0.2, 200), ("z", 2, True, False, None, 200)]
    entries = spark.createDataFrame(rows, "asset string, value int, ok boolean, confirms boolean, held_out_sharpe double, n_days int")
    out = {r.asset: r for r in Sw.sweep_surface(entries).collect()}
    assert (out["x"].verdict, out["x"].longest_run, out["x"].from_value, out["x"].to_value, out["x"].best_sharpe) == ("PLATEAU", 3, 5, 7, 2.0)
    assert (out["y"].verdict, out["y"].longest_run, out["y"].from_value) == ("SPIKE", 1, 2) and 0 < out["y"].sweep_dsr < 1
    assert (out["z"].verdict, out["z"].sweep_dsr) == ("NONE", None)


def test_no_valid_value_and_no_bars(spark):
    bars = walk(spark, 30)
    assert {r.status for r in Sw.sweep_entries(bars, (12, 13), 12, "2015-02-01").collect()} == {"invalid"}
    assert Sw.sweep_surface(Sw.sweep_entries(bars.limit(0), (2, 3), 12, "2015-02-01")).count() == 0
