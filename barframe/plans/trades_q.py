"""Queries on stop trades and their validation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.operators import signals as S
from barframe.operators import trades as Tr
from barframe.plans.registry import cte, query, rounded
from barframe.plans.series_q import W, nation_bars, roll

COSTS = (0.0, 2.0, 5.0, 10.0, 20.0)


ONE = (("t1", 1.0, 3.0),)
TWO = (("t1", 1.0, 3.0), ("t2", 2.0, 4.0))


def prepared(spark, sf, side="long"):
    bars = nation_bars(spark, sf).withColumn("year", F.year("ts"))
    return S.trend_pullback_entry(bars, side, ema_period=12, channel_window=8, delay=2, atr_window=10)


def trades(spark, sf, side="long"):
    return Tr.stop_trades(prepared(spark, sf, side), TWO, side)


for _side, _agg, _col, _cmp in (("long", "min", "low", "<="), ("short", "max", "high", ">=")):
    _better = ">" if _side == "long" else "<"
    cte(f"pull_{_side}", f"""SELECT asset, i, ts, open, high, low, close, atr, count(*) OVER (PARTITION BY asset) - 1 AS last_i,
      coalesce(close {_better} ema AND close {_better} channel AND lag({_col}, 2) OVER ({W}) {_cmp} lag(channel, 2) OVER ({W}), false) AS raw_entry
    FROM (SELECT b.*, CASE WHEN b.i >= 11 THEN e.ema END AS ema, {roll(_agg, 'b.' + _col, 8).replace('PARTITION BY asset ORDER BY ts', 'PARTITION BY b.asset ORDER BY b.ts')} AS channel
      FROM nb_atr10 b JOIN ema12 e ON e.asset = b.asset AND e.i = b.i)""")
# One bar at a time: flat, or in a position with its stop levels.
cte("walk_src_l", """SELECT p.*, g.param_id, g.sl, g.tr FROM pull_long p, (VALUES ('t1', 1.0, 3.0), ('t2', 2.0, 4.0)) g(param_id, sl, tr)""")
cte("walk_src_s", """SELECT p.*, g.param_id, g.sl, g.tr FROM pull_short p, (VALUES ('t1', 1.0, 3.0), ('t2', 2.0, 4.0)) g(param_id, sl, tr)""")
_WALK = """(asset, param_id, i, ts, pending, sig_ts, sig_atr, held, entry_ts, entry_i, price, a, anchor, trail, hard, x_price, done)
SELECT asset, param_id, i, ts, raw_entry AND atr > 0, ts, atr, false, ts, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false
FROM {src} WHERE i = 0
UNION ALL
SELECT asset, param_id, i, ts,
  NOT inpos AND raw_entry AND coalesce(atr > 0, false) AND i < last_i,
  CASE WHEN inpos THEN psig ELSE ts END, CASE WHEN inpos THEN a2 ELSE atr END,
  inpos AND NOT hit, e_ts, e_i, price2, a2,
  CASE WHEN hit THEN anchor2 ELSE {best}(anchor2, close) END,
  CASE WHEN hit THEN trail2 ELSE {best}(trail2, {best}(anchor2, close) {minus} tr * a2) END, hard2,
  CASE WHEN hit THEN {worst}(open, {best}(hard2, trail2)) ELSE close END, inpos AND (hit OR i = last_i)
FROM (SELECT *, inpos AND {edge} {cmp} {best}(hard2, trail2) AS hit FROM (
  SELECT s.*, w.held OR w.pending AS inpos, CASE WHEN w.pending THEN s.ts ELSE w.entry_ts END AS e_ts, w.sig_ts AS psig,
    CASE WHEN w.pending THEN s.i ELSE w.entry_i END AS e_i, CASE WHEN w.pending THEN s.open ELSE w.price END AS price2,
    CASE WHEN w.pending THEN w.sig_atr ELSE w.a END AS a2, CASE WHEN w.pending THEN s.open ELSE w.anchor END AS anchor2,
    CASE WHEN w.pending THEN s.open {minus} s.tr * w.sig_atr ELSE w.trail END AS trail2,
    CASE WHEN w.pending THEN s.open {minus} s.sl * w.sig_atr ELSE w.hard END AS hard2
  FROM {name} w JOIN {src} s ON s.asset = w.asset AND s.param_id = w.param_id AND s.i = w.i + 1))"""
cte("walk_long", _WALK.format(src="walk_src_l", name="walk_long", best="greatest", worst="least", minus="-", edge="low", cmp="<="))
cte("walk_short", _WALK.format(src="walk_src_s", name="walk_short", best="least", worst="greatest", minus="+", edge="high", cmp=">="))
for _side, _s in (("long", 1), ("short", -1)):
    cte(f"tr_{_side}", f"""SELECT w.asset, w.param_id, w.sig_ts AS signal_ts, w.entry_ts, w.ts AS exit_ts, w.price AS entry_price, w.x_price AS exit_price,
      w.a AS entry_atr, CAST(w.i - w.entry_i AS INTEGER) AS bars_held, CASE WHEN w.held THEN 'end_of_data' ELSE 'stop_or_trail' END AS exit_reason,
      {_s} * (w.x_price - w.price) / w.price * 100 AS gross, CASE w.param_id WHEN 't1' THEN 1.0 ELSE 2.0 END AS sl, w.anchor, w.hard, w.trail
    FROM walk_{_side} w WHERE w.done""")

_TRADE_SQL = """SELECT asset, param_id, signal_ts, entry_ts, exit_ts, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price,
round(gross, 6) AS gross_return_pct, bars_held, exit_reason FROM tr_{side}"""


def _shown(df):
    cols = ("asset", "param_id", "signal_ts", "entry_ts", "exit_ts", "entry_price", "exit_price",
            "gross_return_pct", "bars_held", "exit_reason")
    return rounded(df.select(*cols), 6, "entry_price", "exit_price", "gross_return_pct")


@query("g28_trend_pullback_entry", "SELECT asset, ts, raw_entry FROM pull_long")
def g28(spark, sf):
    return prepared(spark, sf).select("asset", "ts", "raw_entry")


@query("v4_stop_trades_long", _TRADE_SQL.format(side="long"))
def v4(spark, sf):
    return _shown(trades(spark, sf))


@query("v4_stop_trades_short", _TRADE_SQL.format(side="short"))
def v4s(spark, sf):
    return _shown(trades(spark, sf, "short"))


cte("tr_cost", """SELECT asset, param_id, c.cost_bps, entry_ts, gross, bars_held, gross - 2 * c.cost_bps / 100 AS net,
(gross - 2 * c.cost_bps / 100) / (sl * entry_atr / entry_price * 100) AS r
FROM tr_long, (VALUES (0.0::DOUBLE), (2.0), (5.0), (10.0), (20.0)) c(cost_bps)""")
_SUMMARY = """SELECT {keys}, count(*) AS trades, (product(1 + net / 100) - 1) * 100 AS net_return_pct, (product(1 + gross / 100) - 1) * 100 AS gross_return_pct,
  sum(r) AS total_r, avg(r) AS avg_r, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) * 100 AS win_rate,
  CASE WHEN sum(-least(net, 0)) > 0 THEN sum(greatest(net, 0)) / sum(-least(net, 0)) WHEN sum(greatest(net, 0)) > 0 THEN 'Infinity'::DOUBLE END AS profit_factor,
  min(dd) AS max_dd_pct, avg(bars_held) AS avg_hold_bars
FROM (SELECT *, (eq / max(eq) OVER (PARTITION BY {keys} ORDER BY entry_ts) - 1) * 100 AS dd FROM (
  SELECT *, product(1 + net / 100) OVER (PARTITION BY {keys} ORDER BY entry_ts) AS eq FROM {src})) GROUP BY {keys}"""
cte("tr_summary", _SUMMARY.format(keys="asset, param_id, cost_bps", src="tr_cost"))
_NUM = ("net_return_pct", "gross_return_pct", "total_r", "avg_r", "win_rate", "profit_factor", "max_dd_pct", "avg_hold_bars")


def costed(spark, sf):
    levels = F.explode(F.array(*[F.lit(c) for c in COSTS])).alias("cost_bps")
    return Tr.with_costs(trades(spark, sf).select("*", levels), F.col("cost_bps"))


def summary(spark, sf):
    return Tr.summarize_trades(costed(spark, sf), ("asset", "param_id", "cost_bps"))


@query("a9_v16_trade_summary_by_cost", "SELECT asset, param_id, cost_bps, trades, " + ", ".join(
    f"round({c}, 5) AS {c}" for c in _NUM) + " FROM tr_summary")
def a9(spark, sf):
    return rounded(summary(spark, sf), 5, *_NUM)


@query("a10_r_metrics", """SELECT asset, param_id, count(*) AS trades, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
  round(sum(r), 4) AS total_r, round(avg(r), 4) AS avg_r, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) * 100, 2) AS win_rate,
  round(CASE WHEN abs(sum(CASE WHEN r <= 0 THEN r ELSE 0 END)) < 1e-10 THEN CASE WHEN sum(greatest(r, 0)) > 0 THEN 999.99 ELSE 0 END
    ELSE sum(greatest(r, 0)) / abs(sum(least(r, 0))) END, 4) AS profit_factor, round(min(gross), 4) AS max_mae_pct,
  round(avg(bars_held), 2) AS avg_bars_held, round(avg(gross), 4) AS avg_return_pct, round((product(1 + gross / 100) - 1) * 100, 4) AS total_return_pct
FROM tr_cost WHERE cost_bps = 5.0 GROUP BY 1, 2""")
def a10(spark, sf):
    return Tr.r_metrics(Tr.with_costs(trades(spark, sf), 5.0), ("asset", "param_id"))


@query("a40_cost_survivorship", """SELECT cost_bps, count(*) AS candidates, CAST(sum(CASE WHEN net_return_pct > 0 AND trades >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS survivors
FROM tr_summary GROUP BY 1""")
def a40(spark, sf):
    return Tr.cost_survivorship(summary(spark, sf), ("asset", "param_id"))[0]


@query("a40_cost_erosion", """SELECT asset, param_id, round(max(net_return_pct) FILTER (cost_bps = 0), 5) AS net_0bps,
round(max(net_return_pct) FILTER (cost_bps = 20), 5) AS net_20bps,
round(max(net_return_pct) FILTER (cost_bps = 0) - max(net_return_pct) FILTER (cost_bps = 20), 5) AS erosion_pct FROM tr_summary GROUP BY 1, 2""")
def a40b(spark, sf):
    return rounded(Tr.cost_survivorship(summary(spark, sf), ("asset", "param_id"))[1], 5, "net_0bps", "net_20bps", "erosion_pct")


_STRESS = ("net_return_pct", "gross_return_pct", "win_rate", "avg_r", "total_r", "max_dd_pct", "profit_factor", "avg_hold_bars")


@query("a10_notional_cost_stress", "WITH t AS (SELECT asset, param_id, cost_bps, entry_ts, gross, bars_held, gross - c.cost_bps / 10000 * (entry_price + exit_price) / entry_price * 100 AS net "
       "FROM tr_long, (VALUES (0.0::DOUBLE), (2.0), (5.0), (10.0), (20.0)) c(cost_bps)), e AS (SELECT *, product(1 + net / 100) OVER (PARTITION BY asset, param_id, cost_bps ORDER BY entry_ts) AS eq FROM t), "
       "d AS (SELECT *, (eq / max(eq) OVER (PARTITION BY asset, param_id, cost_bps ORDER BY entry_ts) - 1) * 100 AS dd FROM e) "
       "SELECT asset, param_id, cost_bps, trades, " + ", ".join(f"round({c}, 5) AS {c}" for c in _STRESS) + " FROM (SELECT asset, param_id, cost_bps, count(*) AS trades, "
       "(product(1 + net / 100) - 1) * 100 AS net_return_pct, (product(1 + gross / 100) - 1) * 100 AS gross_return_pct, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) * 100 AS win_rate, avg(net) AS avg_r, "
       "sum(net) AS total_r, min(dd) AS max_dd_pct, sum(greatest(net, 0)) / coalesce(abs(sum(CASE WHEN net <= 0 THEN net END)), 0.0001) AS profit_factor, avg(bars_held) AS avg_hold_bars FROM d GROUP BY 1, 2, 3)")
def a10_notional(spark, sf):
    """The cost grid with each side paying on its own notional."""
    levels = F.explode(F.array(*[F.lit(c) for c in COSTS])).alias("cost_bps")
    t = Tr.with_notional_costs(trades(spark, sf).select("*", levels), F.col("cost_bps"))
    return rounded(Tr.cost_stress(t, ("asset", "param_id", "cost_bps")), 5, *_STRESS)


@query("v17_open_position_stops", """SELECT t.asset, t.param_id, t.entry_ts, round(t.entry_price, 6) AS entry_price, t.exit_reason = 'end_of_data' AS is_open,
CASE WHEN exit_reason = 'end_of_data' THEN round(t.hard, 6) END AS hard_stop,
CASE WHEN exit_reason = 'end_of_data' THEN round(greatest(entry_price, m) - CASE param_id WHEN 't1' THEN 3 ELSE 4 END * entry_atr, 6) END AS trailing_stop,
CASE WHEN exit_reason = 'end_of_data' THEN round(greatest(t.hard, greatest(entry_price, m) - CASE param_id WHEN 't1' THEN 3 ELSE 4 END * entry_atr), 6) END AS active_stop
FROM (SELECT *, row_number() OVER (PARTITION BY asset, param_id ORDER BY entry_ts DESC) AS rn,
  (SELECT max(close) FROM nb WHERE nb.asset = tr_long.asset AND nb.ts >= tr_long.entry_ts AND nb.i < (SELECT max(i) FROM nb n2 WHERE n2.asset = tr_long.asset)) AS m
  FROM tr_long) t WHERE rn = 1""")
def v17(spark, sf):
    p = prepared(spark, sf)
    t = Tr.stop_trades(p, TWO)
    return rounded(Tr.open_stops(t, p), 6, "entry_price", "hard_stop", "trailing_stop", "active_stop")


# Years evaluated on their own: the year is part of the series key, so indicators restart.
def yearly_trades(spark, sf):
    bars = nation_bars(spark, sf).withColumn("year", F.year("ts"))
    keys = ("asset", "year")
    p = S.trend_pullback_entry(bars, "long", 5, 4, 1, 3, keys=keys)
    return Tr.with_costs(Tr.stop_trades(p, ONE, keys=keys), 10.0)


def _year(sql: str) -> str:
    return sql.replace("PARTITION BY asset ORDER BY ts", "PARTITION BY asset, yr ORDER BY ts")


cte("yb", "SELECT asset, year(ts) AS yr, ts, open, high, low, close, row_number() OVER (PARTITION BY asset, year(ts) ORDER BY ts) - 1 AS i FROM bars_nw")
cte("yema", f"""(asset, yr, i, ema) SELECT asset, yr, i, close FROM yb WHERE i = 0
UNION ALL SELECT b.asset, b.yr, b.i, b.close / 3 + e.ema * 2 / 3 FROM yema e JOIN yb b ON b.asset = e.asset AND b.yr = e.yr AND b.i = e.i + 1""")
_ytr = "greatest(high - low, abs(high - lag(close) OVER (PARTITION BY asset, yr ORDER BY ts)), abs(low - lag(close) OVER (PARTITION BY asset, yr ORDER BY ts)))"
cte("walk_src_y", _year(f"""SELECT asset, yr, asset || '/' || yr AS sk, 't1' AS param_id, 1.0 AS sl, 3.0 AS tr, i, ts, open, high, low, close, atr, count(*) OVER (PARTITION BY asset, yr) - 1 AS last_i,
  coalesce(close > ema AND close > channel AND lag(low) OVER ({W}) <= lag(channel) OVER ({W}), false) AS raw_entry
FROM (SELECT x.*, CASE WHEN x.i >= 4 THEN e.ema END AS ema, {roll('min', 'low', 4)} AS channel, {roll('avg', 'trr', 3)} AS atr
  FROM (SELECT *, {_ytr} AS trr FROM yb) x JOIN (SELECT asset AS ea, yr AS ey, i AS ei, ema FROM yema) e ON e.ea = x.asset AND e.ey = x.yr AND e.ei = x.i)"""))
cte("walk_year", _WALK.format(src="walk_src_y", name="walk_year", best="greatest", worst="least", minus="-", edge="low", cmp="<=")
    .replace("(asset, param_id, i", "(sk, param_id, i", 1).replace("SELECT asset, param_id", "SELECT sk, param_id").replace("s.asset = w.asset", "s.sk = w.sk"))
cte("tr_year", """SELECT split_part(sk, '/', 1) AS asset, CAST(split_part(sk, '/', 2) AS INTEGER) AS year, param_id, entry_ts, i - entry_i AS bars_held,
(x_price - price) / price * 100 AS gross, (x_price - price) / price * 100 - 0.2 AS net, ((x_price - price) / price * 100 - 0.2) / (a / price * 100) AS r FROM walk_year WHERE done""")
cte("year_summary", _SUMMARY.format(keys="asset, year, param_id", src="tr_year"))


@query("a38_yearly_table", "SELECT asset, year, param_id, trades, " + ", ".join(f"round({c}, 5) AS {c}" for c in _NUM) + " FROM year_summary")
def a38(spark, sf):
    return rounded(Tr.summarize_trades(yearly_trades(spark, sf), ("asset", "year", "param_id")), 5, *_NUM)


@query("a38_positive_years", """SELECT asset, param_id, round(sum(CASE WHEN total_r > 0 THEN 1 ELSE 0 END) / count(*) * 100, 5) AS positive_year_pct,
CAST(sum(CASE WHEN total_r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_years, count(*) AS tested_years FROM year_summary GROUP BY 1, 2""")
def a38b(spark, sf):
    y = Tr.summarize_trades(yearly_trades(spark, sf), ("asset", "year", "param_id"))
    return rounded(Tr.positive_years(y, ("asset", "param_id")), 5, "positive_year_pct")


@query("p18_lockbox_gate", """SELECT s.asset, s.param_id, s.trades, s.trades >= 8 AND s.total_r > 0 AND s.profit_factor > 1.1 AND y.pct >= 50 AS passed
FROM tr_summary s JOIN (SELECT asset, sum(CASE WHEN total_r > 0 THEN 1 ELSE 0 END) / count(*) * 100 AS pct FROM year_summary GROUP BY 1) y ON y.asset = s.asset
WHERE s.cost_bps = 10.0""")
def p18(spark, sf):
    y = Tr.summarize_trades(yearly_trades(spark, sf), ("asset", "year", "param_id"))
    years = Tr.positive_years(y, ("asset",)).select("asset", "positive_year_pct")
    box = Tr.summarize_trades(Tr.with_costs(trades(spark, sf), 10.0), ("asset", "param_id"))
    gate = Tr.lockbox_gate(F.lit(10), F.col("positive_year_pct"))
    return box.join(years, "asset").select("asset", "param_id", "trades", gate.alias("passed"))


def wf_windows(spark, sf):
    bars = Tr.indexed(nation_bars(spark, sf))
    sizes = bars.groupBy("asset").agg(F.count("*").cast("int").alias("n"))
    firsts = bars.groupBy("asset", F.year("ts").alias("year")).agg(F.min("i").alias("at")).filter("at > 0")
    return Tr.walk_forward_windows(sizes, firsts.select("asset", "year", "at"))


@query("w21_walk_forward_windows")
def w21(spark, sf):
    return wf_windows(spark, sf)


@query("w21b_expanding_prefixes", """SELECT asset, CAST(floor(n * 0.8) AS INTEGER) AS split, CAST(f AS INTEGER) AS fold, CAST(floor(floor(n * 0.8) / 5) * f AS INTEGER) AS fold_rows
FROM (SELECT asset, count(*) AS n FROM nb GROUP BY 1), range(1, 6) t(f)""")
def w21b(spark, sf):
    from barframe.operators.validate import expanding_prefixes

    sizes = nation_bars(spark, sf).groupBy("asset").agg(F.count("*").alias("n"))
    return expanding_prefixes(sizes, ("asset",), "n")


def window_results(spark, sf):
    """Train and test rows of every walk-forward window as series of their own."""
    bars = Tr.indexed(nation_bars(spark, sf)).drop("last_i")
    part = F.array(
        F.struct(F.lit("train").alias("part"), F.col("train_from").alias("a"), F.col("train_to").alias("b")),
        F.struct(F.lit("test").alias("part"), F.col("test_from").alias("a"), F.col("test_to").alias("b")))
    spans = wf_windows(spark, sf).select("asset", "window", F.inline(part))
    rows = bars.join(spans, "asset").filter((F.col("i") >= F.col("a")) & (F.col("i") < F.col("b"))).drop("i", "a", "b")
    keys = ("asset", "window", "part")
    p = S.trend_pullback_entry(rows, "long", 5, 4, 1, 3, keys=keys)
    t = Tr.with_costs(Tr.stop_trades(p, ONE, keys=keys), 0.0)
    m = Tr.r_metrics(t, keys)

    def of(side, col):
        return F.coalesce(F.max(F.when(F.col("part") == side, F.col(col))), F.lit(0.0))

    wide = m.groupBy("asset", "window").agg(
        of("train", "total_return_pct").alias("train_return"), of("test", "total_return_pct").alias("test_return"),
        of("test", "profit_factor").alias("test_pf"), of("test", "trades").cast("bigint").alias("test_trades"))
    return spans.select("asset", "window").distinct().join(wide, ["asset", "window"], "left").na.fill(0)


@query("a39_walk_forward_stability")
def a39(spark, sf):
    return Tr.stability(window_results(spark, sf), ("asset",))


cte("stab_src", "SELECT o_custkey AS k, CAST(o_orderkey AS INTEGER) AS w, o_totalprice / 5000 - 45 AS te, (o_orderkey % 41) / 10.0::DOUBLE - 1 AS tr, o_custkey % 3 + (o_orderkey % 7) / 7.0::DOUBLE AS pf, o_orderkey % 12 AS n_tr FROM orders")


@query("a39_stability_score", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w) AS i, count(*) OVER (PARTITION BY k) AS n FROM stab_src),
g AS (SELECT k, count(*) AS n_windows, avg(CASE WHEN te > 0 THEN 1.0 ELSE 0.0 END) * 100 AS pos, avg(CASE WHEN pf > 1 THEN 1.0 ELSE 0.0 END) * 100 AS pfp, avg(CASE WHEN te > 0 AND tr > 0 THEN 1.0 ELSE 0.0 END) * 100 AS bo,
  coalesce(avg(te) FILTER (i > greatest(1, n // 2)), 0) - avg(te) FILTER (i <= greatest(1, n // 2)) AS decay, sum(n_tr) AS tt FROM n GROUP BY 1)
SELECT k AS custkey, n_windows, round(round(pos * 0.4 + pfp * 0.3 + bo * 0.3, 2) + 1e-7, 1) AS score, round(round(decay, 4) + 1e-7, 2) AS decay, CAST(tt AS BIGINT) AS total_test_trades,
  CASE WHEN round(decay, 4) < -30 THEN 'DECAY' WHEN round(pos, 1) >= 50 AND round(pos * 0.4 + pfp * 0.3 + bo * 0.3, 2) >= 30 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g""")
def a39_score(spark, sf):
    from barframe.plans import tables as T

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = T.table(spark, sf, "orders").select(
        cust.alias("custkey"), key.cast("int").alias("window"), (F.col("o_totalprice") / 5000 - 45).alias("test_return"), ((key % 41) / 10 - 1).alias("train_return"),
        (cust % 3 + (key % 7) / 7).alias("test_pf"), (key % 12).alias("test_trades"))
    out = Tr.stability(rows, ("custkey",)).select("custkey", "n_windows", "score", "decay", "total_test_trades", "verdict")
    return out.withColumns({"score": F.round(F.col("score") + 1e-7, 1), "decay": F.round(F.col("decay") + 1e-7, 2)})
