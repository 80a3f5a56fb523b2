import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barframe.operators import indicators as I
from barframe.operators import signals as S
from barframe.operators import stops
from barframe.operators import trades as Tr

DAY = dt.date(2000, 1, 1)


def prepared(spark, bars):
    """bars: (asset, open, high, low, close, raw_entry), one after the other; atr is 1."""
    rows, n = [], {}
    for a, o, h, lo, c, e in bars:
        n[a] = n.get(a, -1) + 1
        rows.append((a, DAY + dt.timedelta(days=n[a]), o, h, lo, c, 1.0, e))
    return spark.createDataFrame(rows, "asset string, ts date, open double, high double, low double, close double, atr double, raw_entry boolean")


def walk(bars, sl, trail):
    out, held = [], None
    for i, (_, o, _h, lo, c, e) in enumerate(bars):
        if held is not None:
            at, price, anchor = held
            stop = max(price - sl, anchor - trail)
            if lo is not None and lo <= stop:
                out.append((at, i, min(o, stop), "stop_or_trail"))
                held = None
                continue
            held = (at, price, anchor if c is None else max(anchor, c))
        elif e and i + 1 < len(bars):
            held = (i + 1, bars[i + 1][1], bars[i + 1][1])
    if held is not None:
        out.append((held[0], len(bars) - 1, bars[-1][4], "end_of_data"))
    return out


def taken(df, asset):
    rows = df.filter(F.col("asset") == asset).orderBy("entry_ts").collect()
    return [((r.entry_ts - DAY).days, (r.exit_ts - DAY).days, r.exit_price, r.exit_reason) for r in rows]


def test_a_stop_that_is_never_hit_and_a_late_one(spark):
    rising = [("up", 10.0 + i, 10.5 + i, 9.5 + i, 10.0 + i, i == 0) for i in range(3000)]
    late = [("late", 10.0 + i, 10.5 + i, 9.5 + i, 10.0 + i, i % 700 == 3) for i in range(2900)]
    late += [("late", 100.0, 100.0, 100.0, 100.0, False)] * 5
    got = Tr.stop_trades(prepared(spark, rising + late), (("s", 5.0, 6.0),), fan=8).cache()
    assert taken(got, "up") == walk(rising, 5.0, 6.0) and got.filter("asset = 'up'").first().exit_reason == "end_of_data"
    assert taken(got, "late") == walk(late, 5.0, 6.0)


def test_blocks_in_doubt_are_passed(spark):
    """Falls a hair short of the trail look like hits to a block, not to a bar."""
    wide = 10.0 * (1 + 1e-11)
    wave = [("w", 100.0, 100.0, 90.0, 100.0, i == 0) for i in range(120)] + [("w", 100.0, 100.0, 89.0, 95.0, False)]
    got = Tr.stop_trades(prepared(spark, wave), (("s", 50.0, wide),), fan=4)
    assert taken(got, "w") == walk(wave, 50.0, wide) == [(1, 120, 100.0 - wide, "stop_or_trail")]


@pytest.mark.parametrize("seed", [1])
def test_random_series_with_holes_and_many_entries(spark, seed):
    rnd = random.Random(seed)
    bars = []
    for a, n in (("a", 400), ("b", 1), ("c", 65), ("d", 64)):
        price = 50.0
        for _ in range(n):
            o, price = price, max(1.0, price + rnd.gauss(0, 1))
            lo = None if rnd.random() < 0.05 else min(o, price) - rnd.random()
            bars.append((a, o, max(o, price), lo, None if rnd.random() < 0.05 else price, rnd.random() < 0.6))
    got = Tr.stop_trades(prepared(spark, bars), (("s", 1.5, 2.5),), fan=8, pick=4).cache()
    for a in "abcd":
        assert taken(got, a) == walk([b for b in bars if b[0] == a], 1.5, 2.5)


def test_no_bars_and_no_entries(spark):
    assert Tr.stop_trades(prepared(spark, []), (("s", 1.0, 1.0),)).count() == 0
    assert Tr.stop_trades(prepared(spark, [("a", 1.0, 1.0, 1.0, 1.0, False)] * 3), (("s", 1.0, 1.0),)).count() == 0


@pytest.mark.parametrize("pick", [2, 5])
def test_chain_by_doubling(spark, pick):
    rnd = random.Random(pick)
    rows, want = [], []
    for key in range(4):
        n = rnd.choice([1, 7, 40, 60])
        links = [min(n, k + rnd.randint(1, 4)) for k in range(n)]
        rows += [(key, k, t) for k, t in enumerate(links)]
        at = 0
        while at < n:
            want.append((key, at))
            at = links[at]
    df = spark.createDataFrame(rows, "key int, k long, next long")
    assert sorted(map(tuple, stops.chained(df, ["key"], 60, pick).collect())) == sorted(want)


@pytest.mark.parametrize("fan, pick", [(4, 3)])
def test_ratchet_equals_the_walk(spark, fan, pick):
    rnd = random.Random(fan)
    rows, want = [], []
    for key, n in (("a", 300), ("b", 1), ("c", 64), ("d", 65)):
        mid, held = 50.0, None
        before = None
        for i in range(n):
            mid += rnd.gauss(0, 1)
            band = None if rnd.random() < 0.04 else float(round(mid + 3))
            held = held if None not in (held, band, before) and before <= held < band else band
            rows.append((key, i, band, before))
            want.append((key, i, held))
            before = None if rnd.random() < 0.04 else float(round(mid))
    df = spark.createDataFrame(rows, "asset string, i int, band double, before double")
    got = S.ratchet(df, ("asset",), fan, pick).collect()
    assert sorted((r.asset, r.i, -1.0 if r.held is None else r.held) for r in got) == [(a, i, -1.0 if h is None else h) for a, i, h in want]


def test_supertrend_state_flips_and_holes(spark):
    """Against a walk over each bar, with missing closes and bars that cross both bands."""
    rnd = random.Random(5)
    rows, price = [], 100.0
    for i in range(400):
        price = max(5.0, price + rnd.gauss(0, 2))
        close = None if rnd.random() < 0.03 else price
        rows.append(("a", DAY + dt.timedelta(days=i), price, price + rnd.random() * 3, price - rnd.random() * 3, close))
    bars = spark.createDataFrame(rows, "asset string, ts date, open double, high double, low double, close double")
    prepared = I.with_atr(I.with_close_range(bars, ("asset",), "ts"), 7, "_atr", ("asset",), "ts").orderBy("ts").collect()
    up, low, on, want = None, None, False, []
    last = None
    for r in prepared:
        high = None if r._atr is None else (r.high + r.low) / 2 + 0.3 * r._atr
        floor = None if r._atr is None else (r.high + r.low) / 2 - 0.3 * r._atr
        enters = r.close is not None and up is not None and r.close > up
        leaves = r.close is not None and low is not None and r.close < low
        want.append((r.ts, not on and enters, on and leaves))
        on = (on or enters) if not (on and leaves) else False
        up = up if None not in (up, high, last) and last <= up < high else high
        low = low if None not in (low, floor, last) and last >= low > floor else floor
        last = r.close
    got = [(r.ts, r.entry, r.exit) for r in S.supertrend(bars, 7, 0.3).orderBy("ts").collect()]
    assert got == want and sum(e for _, e, _ in want) > 10


def test_supertrend_stays_in_the_jvm(spark):
    bars = spark.createDataFrame([("a", DAY, 1.0, 1.0, 1.0, 1.0)], "asset string, ts date, open double, high double, low double, close double")
    plan = S.supertrend(bars)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
