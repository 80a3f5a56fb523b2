"""Queries on indicators, signals and signal replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barframe.functions.windows import full, safe
from barframe.operators import bars as B
from barframe.operators import indicators as I
from barframe.operators import metrics as M
from barframe.operators import pairs as P
from barframe.operators import replay as R
from barframe.operators import signals as S
from barframe.plans import tables as T
from barframe.plans.registry import cte, query, rounded


def nation_bars(spark, sf):
    """Weekly bars of the nations."""
    return T.bars(spark, sf, "week", "nation").drop("avg_price")


# --- SQL pieces -----------------------------------------------------------------------------

W = "PARTITION BY asset ORDER BY ts"


def frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, col: str, n: int, at_least: int | None = None) -> str:
    return f"CASE WHEN count({col}) OVER {frame(n)} >= {at_least or n} THEN {agg}({col}) OVER {frame(n)} END"


def before(agg: str, col: str, n: int) -> str:
    fr = f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({col}) OVER {fr} = {n} THEN {agg}({col}) OVER {fr} END"


def lag(col: str, n: int = 1) -> str:
    return f"lag({col}, {n}) OVER ({W})"


def up(a: str, b: str) -> str:
    return f"coalesce({a} > {b} AND {lag(a)} <= {lag(b)}, false)"


def down(a: str, b: str) -> str:
    return f"coalesce({a} < {b} AND {lag(a)} >= {lag(b)}, false)"


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"

cte("nb", "SELECT asset, ts, open, high, low, close, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i FROM bars_nw")
cte("nb_range", f"""SELECT asset, ts, close, {roll('max', 'close', 2)} AS high, {roll('min', 'close', 2)} AS low, i FROM nb""")
for src, tag in (("nb", "nb_atr"), ("nb_range", "nb_ratr")):
    for n in (10, 14, 20):
        cte(f"{tag}{n}", f"""SELECT *, {roll('avg', 'tr', n)} AS atr FROM (SELECT *, {TR} AS tr FROM {src})""")
# Recursive averages, one row at a time.
for n in (5, 12, 15, 20, 26, 30):
    a = 2.0 / (n + 1)
    cte(f"ema{n}", f"""(asset, i, ema) SELECT asset, i, close FROM nb WHERE i = 0
    UNION ALL SELECT b.asset, b.i, {a!r} * b.close + (1 - {a!r}) * e.ema
    FROM ema{n} e JOIN nb b ON b.asset = e.asset AND b.i = e.i + 1""")
cte("macd_line", """SELECT f.asset, f.i, f.ema - s.ema AS macd FROM ema12 f JOIN ema26 s ON s.asset = f.asset AND s.i = f.i""")
cte("macd_sig", """(asset, i, sig) SELECT asset, i, macd FROM macd_line WHERE i = 0
    UNION ALL SELECT b.asset, b.i, 0.2 * b.macd + 0.8 * e.sig
    FROM macd_sig e JOIN macd_line b ON b.asset = e.asset AND b.i = e.i + 1""")
cte("nb_diff", f"""SELECT *, close - {lag('close')} AS d FROM nb""")
cte("wilder14", """(asset, i, g, l) SELECT asset, i, greatest(d, 0), -least(d, 0) FROM nb_diff WHERE i = 1
    UNION ALL SELECT b.asset, b.i, greatest(b.d, 0) / 14 + (1 - 1.0::DOUBLE / 14) * e.g, -least(b.d, 0) / 14 + (1 - 1.0::DOUBLE / 14) * e.l
    FROM wilder14 e JOIN nb_diff b ON b.asset = e.asset AND b.i = e.i + 1""")
cte("rsi14", """SELECT b.*, CASE WHEN w.i < 14 THEN NULL WHEN g = 0 THEN 0 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi
    FROM nb b LEFT JOIN wilder14 w ON w.asset = b.asset AND w.i = b.i""")
cte("rsi_simple14", f"""SELECT *, 100 - 100 / (1 + g / nullif(l, 0)) AS rsi FROM (
    SELECT *, {roll('avg', 'gain', 14)} AS g, {roll('avg', 'loss', 14)} AS l FROM (
    SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain, CASE WHEN d IS NOT NULL THEN -least(d, 0) END AS loss FROM nb_diff))""")

IND = "SELECT asset, ts, {c} FROM {t}"


@query("w1_sma", IND.format(c=f"round({roll('avg', 'close', 20)}, 6) AS sma_20", t="nb"))
def w1(spark, sf):
    df = nation_bars(spark, sf).select("asset", "ts", I.sma("close", 20).alias("sma_20"))
    return rounded(df, 6, "sma_20")


@query("w2_rolling_std", IND.format(
    c=f"round({roll('stddev_samp', 'close', 20)}, 6) AS std_samp, round({roll('stddev_pop', 'close', 20)}, 6) AS std_pop", t="nb"))
def w2(spark, sf):
    df = nation_bars(spark, sf).select(
        "asset", "ts", I.rolling_std("close", 20).alias("std_samp"),
        I.rolling_std("close", 20, ddof=0).alias("std_pop"))
    return rounded(df, 6, "std_samp", "std_pop")


@query("w3_donchian", IND.format(
    c=f"""round({before('max', 'high', 20)}, 8) AS channel_high, round({before('min', 'low', 10)}, 8) AS channel_low,
    round({roll('min', 'low', 21)}, 8) AS unshifted_low""", t="nb"))
def w3(spark, sf):
    df = nation_bars(spark, sf).select(
        "asset", "ts", I.donchian_high(20).alias("channel_high"), I.donchian_low(10).alias("channel_low"),
        I.rolling_min("low", 21).alias("unshifted_low"))
    return rounded(df, 8, "channel_high", "channel_low", "unshifted_low")


@query("w4_atr", IND.format(c="round(tr, 6) AS true_range, round(atr, 6) AS atr_14", t="nb_atr14"))
def w4(spark, sf):
    df = nation_bars(spark, sf).withColumn("true_range", I.true_range())
    df = I.with_atr(df, 14, "atr_14").select("asset", "ts", "true_range", "atr_14")
    return rounded(df, 6, "true_range", "atr_14")


@query("w4b_close_only_atr", IND.format(c="round(atr, 6) AS atr_10", t="nb_ratr10"))
def w4b(spark, sf):
    df = I.with_atr(I.with_close_range(nation_bars(spark, sf)), 10, "atr_10")
    return rounded(df.select("asset", "ts", "atr_10"), 6, "atr_10")


@query("w5_returns", """SELECT asset, ts, round(close / lag(close, 20) OVER w - 1, 8) AS trailing_20,
    round(lead(close, 20) OVER w / close - 1, 8) AS forward_20 FROM panel_d WINDOW w AS (PARTITION BY asset ORDER BY ts)""")
def w5(spark, sf):
    df = T.panel(spark, sf).select(
        "asset", "ts", I.trailing_return(20).alias("trailing_20"), I.forward_return(20).alias("forward_20"))
    return rounded(df, 8, "trailing_20", "forward_20")


cte("zs_d", f"""SELECT asset, ts, pos, asset_ord, close, (r - {roll('avg', 'r', 252, 80)}) / nullif({roll('stddev_samp', 'r', 252, 80)}, 0) AS zscore
FROM (SELECT *, close / {lag('close', 20)} - 1 AS r FROM panel_d)""")


@query("w6_event_zscore", "SELECT asset, ts, round(zscore, 6) AS zscore FROM zs_d")
def w6(spark, sf):
    return rounded(I.with_event_zscore(T.panel(spark, sf)).select("asset", "ts", "zscore"), 6, "zscore")


@query("w7_w8_equity_drawdown", """
SELECT asset, ts, round(eq, 6) AS equity, round(eq / max(eq) OVER (PARTITION BY asset ORDER BY ts) - 1, 6) AS drawdown
FROM (SELECT asset, ts, product(1 + r) OVER (PARTITION BY asset ORDER BY ts) AS eq
  FROM (SELECT asset, ts, close / lag(close) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r FROM panel_d) WHERE r IS NOT NULL)""")
def w7(spark, sf):
    df = T.panel(spark, sf).withColumn("r", I.trailing_return(1)).filter("r is not null")
    df = df.withColumn("equity", I.compounded("r")).withColumn("drawdown", I.drawdown("equity"))
    return rounded(df.select("asset", "ts", "equity", "drawdown"), 6, "equity", "drawdown")


@query("w9_ema", """SELECT b.asset, b.ts, round(e.ema, 6) AS ema_12, CASE WHEN b.i >= 29 THEN round(m.ema, 6) END AS ema_30_warm
FROM nb b JOIN ema12 e ON e.asset = b.asset AND e.i = b.i JOIN ema30 m ON m.asset = b.asset AND m.i = b.i""")
def w9(spark, sf):
    df = I.with_ema(nation_bars(spark, sf), "close", "ema_12", 12)
    df = I.with_ema(df, "close", "ema_30_warm", 30, min_periods=30)
    return rounded(df.select("asset", "ts", "ema_12", "ema_30_warm"), 6, "ema_12", "ema_30_warm")


cte("nb_holes", "SELECT asset, ts, i, CASE WHEN (i * 7 + length(asset)) % 5 < 2 AND i > 1 THEN NULL ELSE close END AS x FROM nb")
cte("ema_holes", """(asset, i, y, k)
SELECT asset, i, x, 1 FROM nb_holes WHERE i = 0 UNION ALL
SELECT n.asset, n.i, CASE WHEN n.x IS NULL THEN e.y ELSE ((1 - 2 / 10.0::DOUBLE) ** e.k * e.y + 2 / 10.0::DOUBLE * n.x) / ((1 - 2 / 10.0::DOUBLE) ** e.k + 2 / 10.0::DOUBLE) END,
  CASE WHEN n.x IS NULL THEN e.k + 1 ELSE 1 END FROM ema_holes e JOIN nb_holes n ON n.asset = e.asset AND n.i = e.i + 1""")


@query("w9_ema_with_holes", "SELECT n.asset, n.ts, round(e.y, 6) AS ema_9 FROM nb_holes n JOIN ema_holes e ON e.asset = n.asset AND e.i = n.i")
def w9_holes(spark, sf):
    i = F.row_number().over(Window.partitionBy("asset").orderBy("ts")) - 1
    df = nation_bars(spark, sf).withColumn("_i", i)
    hole = ((F.col("_i") * 7 + F.length("asset")) % 5 < 2) & (F.col("_i") > 1)
    df = I.with_ema(df.withColumn("x", F.when(~hole, F.col("close"))), "x", "ema_9", 9)
    return rounded(df.select("asset", "ts", "ema_9"), 6, "ema_9")


@query("w10_rsi_wilder", "SELECT asset, ts, round(rsi, 6) AS rsi FROM rsi14")
def w10(spark, sf):
    return rounded(I.with_rsi(nation_bars(spark, sf), 14).select("asset", "ts", "rsi"), 6, "rsi")


@query("w11_rsi_simple", "SELECT asset, ts, round(rsi, 6) AS rsi FROM rsi_simple14")
def w11(spark, sf):
    return rounded(I.with_rsi_simple(nation_bars(spark, sf), 14).select("asset", "ts", "rsi"), 6, "rsi")


@query("w12_macd", """SELECT b.asset, b.ts, round(m.macd, 6) AS macd, round(s.sig, 6) AS macd_signal
FROM nb b JOIN macd_line m ON m.asset = b.asset AND m.i = b.i JOIN macd_sig s ON s.asset = b.asset AND s.i = b.i""")
def w12(spark, sf):
    df = I.with_macd(nation_bars(spark, sf)).select("asset", "ts", "macd", "macd_signal")
    return rounded(df, 6, "macd", "macd_signal")


cte("boll20", f"SELECT *, m + 2.0 * s AS bb_upper, m - 2.0 * s AS bb_lower FROM (SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM nb)")


@query("w13_bollinger", "SELECT asset, ts, round(bb_lower, 6) AS bb_lower, round(bb_upper, 6) AS bb_upper FROM boll20")
def w13(spark, sf):
    df = I.with_bollinger(nation_bars(spark, sf), 20).select("asset", "ts", "bb_lower", "bb_upper")
    return rounded(df, 6, "bb_lower", "bb_upper")


cte("keltner", "SELECT b.asset, b.ts, b.close, e.ema - 2.0 * b.atr AS kc_lower, e.ema + 2.0 * b.atr AS kc_upper FROM nb_ratr10 b JOIN ema20 e ON e.asset = b.asset AND e.i = b.i")


@query("w14_keltner", "SELECT asset, ts, round(kc_lower, 6) AS kc_lower, round(kc_upper, 6) AS kc_upper FROM keltner")
def w14(spark, sf):
    df = I.with_keltner(nation_bars(spark, sf)).select("asset", "ts", "kc_lower", "kc_upper")
    return rounded(df, 6, "kc_lower", "kc_upper")


# --- signals --------------------------------------------------------------------------------

def sig(df):
    return df.select("asset", "ts", "entry", "exit")


def smas(**windows: int) -> str:
    cols = ", ".join(f"{roll('avg', 'close', n)} AS {k}" for k, n in windows.items())
    return f"(SELECT *, {cols} FROM nb)"


def signal_sql(entry: str, exit_: str, source: str) -> str:
    return f"SELECT asset, ts, {entry} AS entry, {exit_} AS exit FROM {source}"


def yes(cond: str) -> str:
    return f"coalesce({cond}, false)"


@query("g1_sma_crossover", signal_sql(up("f", "s"), down("f", "s"), smas(f=5, s=15)))
def g1(spark, sf):
    return sig(S.sma_crossover(nation_bars(spark, sf), 5, 15))


_BREAK = (yes(f"close > ({before('max', 'high', 8)})"), yes(f"close < ({before('min', 'low', 4)})"))


@query("g2_donchian_breakout", signal_sql(*_BREAK, "nb"))
def g2(spark, sf):
    return sig(S.donchian_breakout(nation_bars(spark, sf), 8, 4))


cte("g3_src", f"""SELECT *, {yes(f"atr > ({roll('avg', 'atr', 20)})")} AS hot, {yes(f"close > ({roll('avg', 'close', 30)})")} AS upt,
{_BREAK[0]} AS brk, {_BREAK[1]} AS brkdn FROM nb_atr14""")


@query("g3_filtered_donchian", signal_sql("brk AND hot AND upt", "brkdn OR NOT upt", "g3_src"))
def g3(spark, sf):
    return sig(S.filtered_donchian_breakout(nation_bars(spark, sf), 8, 4, 14, 20, 30))


@query("g4_rsi_mean_reversion", signal_sql(yes("rsi < 45"), yes("rsi > 52"), "rsi14"))
def g4(spark, sf):
    return sig(S.rsi_mean_reversion(nation_bars(spark, sf), 14, 45.0, 52.0))


@query("g5_filtered_rsi", f"""
SELECT r.asset, r.ts, coalesce(rsi < 45, false) AND calm AS entry, coalesce(rsi > 52, false) AS exit
FROM rsi14 r JOIN (SELECT asset, i, {yes(f"atr < ({roll('avg', 'atr', 20)})")} AS calm FROM nb_atr14) a
ON a.asset = r.asset AND a.i = r.i""")
def g5(spark, sf):
    return sig(S.filtered_rsi_mean_reversion(nation_bars(spark, sf), 14, 45.0, 52.0, 14, 20))


@query("g6_close_donchian", signal_sql(
    yes(f"close > ({before('max', 'close', 10)})"), yes(f"close < ({before('min', 'close', 5)})"), "nb"))
def g6(spark, sf):
    return sig(S.close_donchian(nation_bars(spark, sf), 10, 5))


@query("g7_ema_crossover", signal_sql(up("f", "s"), down("f", "s"), """(SELECT b.*, f.ema AS f, s.ema AS s
FROM nb b JOIN ema5 f ON f.asset = b.asset AND f.i = b.i JOIN ema15 s ON s.asset = b.asset AND s.i = b.i)"""))
def g7(spark, sf):
    return sig(S.ema_crossover(nation_bars(spark, sf), 5, 15))


@query("g8_rsi_reversion_simple", signal_sql(yes("rsi < 45"), yes("rsi > 52"), "rsi_simple14"))
def g8(spark, sf):
    return sig(S.rsi_reversion_simple(nation_bars(spark, sf), 14, 45.0, 52.0))


@query("g9_bollinger_reversion", signal_sql(
    yes("close <= m - 1.5 * s"), yes("close >= m + 1.5 * s"), "boll20"))
def g9(spark, sf):
    return sig(S.bollinger_reversion(nation_bars(spark, sf), 20, 1.5))


@query("g9_bollinger_breakout", signal_sql(
    up("close", "bu"), down("close", "bl"), "(SELECT *, m + 1.0 * s AS bu, m - 1.0 * s AS bl FROM boll20)"))
def g9b(spark, sf):
    return sig(S.bollinger_breakout(nation_bars(spark, sf), 20, 1.0))


@query("g10_macd_crossover", signal_sql(up("macd", "sig"), down("macd", "sig"), """(SELECT b.*, macd, sig FROM nb b
JOIN macd_line m ON m.asset = b.asset AND m.i = b.i JOIN macd_sig s ON s.asset = b.asset AND s.i = b.i)"""))
def g10(spark, sf):
    return sig(S.macd_crossover(nation_bars(spark, sf)))


@query("g11_keltner_reversion", signal_sql(yes("close < ema - 0.5 * atr"), yes("close > ema + 0.5 * atr"),
    "(SELECT b.*, ema FROM nb_ratr10 b JOIN ema20 e ON e.asset = b.asset AND e.i = b.i)"))
def g11(spark, sf):
    return sig(S.keltner_reversion(nation_bars(spark, sf), 20, 10, 0.5))


@query("g12_sma_trend_filter", signal_sql(
    f"{up('f', 's')} AND {yes('close > t')}", f"{down('f', 's')} AND NOT {yes('close > t')}", smas(f=5, s=15, t=50)))
def g12(spark, sf):
    return sig(S.sma_trend_filter(nation_bars(spark, sf), 5, 15, 50))


@query("g13_sma_dual", signal_sql(up("f", "s"), down("xf", "xs"), smas(f=3, s=7, xf=5, xs=10)))
def g13(spark, sf):
    return sig(S.sma_dual(nation_bars(spark, sf), 3, 7, 5, 10))


# Path-dependent stops, walked one bar at a time.
cte("trail_src", f"""SELECT b.asset, b.i, b.ts, b.close, b.atr, e.entry FROM nb_ratr10 b JOIN (
  SELECT asset, i, {up('f', 's')} AS entry FROM {smas(f=3, s=7)}) e ON e.asset = b.asset AND e.i = b.i""")
cte("trail_bar", """(asset, i, ts, entry, held, hi, exit)
SELECT asset, i, ts, entry, false, 0.0::DOUBLE, false FROM trail_src WHERE i = 0
UNION ALL SELECT asset, i, ts, entry, (held2 AND NOT coalesce(close < hi2 - 1.5 * atr, false)), hi2,
  held2 AND coalesce(close < hi2 - 1.5 * atr, false)
FROM (SELECT s.*, (t.held OR s.entry) AS held2, CASE WHEN s.entry THEN s.close ELSE greatest(t.hi, s.close) END AS hi2
  FROM trail_bar t JOIN trail_src s ON s.asset = t.asset AND s.i = t.i + 1)""")
cte("trail_high", """(asset, i, ts, entry, held, hi, stop, exit)
SELECT asset, i, ts, entry, false, 0.0::DOUBLE, 0.0::DOUBLE, false FROM trail_src WHERE i = 0
UNION ALL SELECT asset, i, ts, entry, entry OR (held AND NOT coalesce(close <= stop2, false)), hi2, stop2,
  NOT entry AND held AND coalesce(close <= stop2, false)
FROM (SELECT s.*, t.held, CASE WHEN s.entry OR s.close > t.hi THEN s.close ELSE t.hi END AS hi2,
    CASE WHEN s.entry OR s.close > t.hi THEN s.close - 1.5 * s.atr ELSE t.stop END AS stop2
  FROM trail_high t JOIN trail_src s ON s.asset = t.asset AND s.i = t.i + 1)""")


@query("g14_sma_atr_trail", "SELECT asset, ts, entry, exit FROM trail_bar")
def g14(spark, sf):
    return sig(S.sma_atr_trail(nation_bars(spark, sf), 3, 7, 10, 1.5, "bar"))


@query("g14_sma_atr_trail_at_high", "SELECT asset, ts, entry, exit FROM trail_high")
def g14b(spark, sf):
    return sig(S.sma_atr_trail(nation_bars(spark, sf), 3, 7, 10, 1.5, "high"))


cte("super_src", "SELECT asset, i, ts, close, (high + low) / 2 + 1.0 * atr AS bu, (high + low) / 2 - 1.0 * atr AS bl FROM nb_ratr10")
cte("super_walk", """(asset, i, ts, close, u, l, held, entry, exit)
SELECT asset, i, ts, close, bu, bl, false, false, false FROM super_src WHERE i = 0
UNION ALL SELECT s.asset, s.i, s.ts, s.close,
  CASE WHEN t.close <= t.u AND t.u < s.bu THEN t.u ELSE s.bu END,
  CASE WHEN t.close >= t.l AND t.l > s.bl THEN t.l ELSE s.bl END,
  CASE WHEN NOT t.held THEN coalesce(s.close > t.u, false) ELSE NOT coalesce(s.close < t.l, false) END,
  NOT t.held AND coalesce(s.close > t.u, false), t.held AND coalesce(s.close < t.l, false)
FROM super_walk t JOIN super_src s ON s.asset = t.asset AND s.i = t.i + 1""")


@query("g15_supertrend", "SELECT asset, ts, entry, exit FROM super_walk")
def g15(spark, sf):
    return sig(S.supertrend(nation_bars(spark, sf), 10, 1.0))


@query("g16_sma_multi_timeframe", signal_sql(
    f"{up('f', 's')} AND {yes('ff > fs')}", f"{down('f', 's')} AND NOT {yes('ff > fs')}", smas(f=5, s=15, ff=20, fs=50)))
def g16(spark, sf):
    return sig(S.sma_multi_timeframe(nation_bars(spark, sf)))


@query("g17_sma_rsi_filter", f"""SELECT x.asset, x.ts, x.e AND {yes('rsi < 52')} AS entry, x.x AND {yes('rsi > 48')} AS exit
FROM (SELECT asset, ts, i, {up('f', 's')} AS e, {down('f', 's')} AS x FROM {smas(f=5, s=15)}) x
JOIN rsi_simple14 r ON r.asset = x.asset AND r.i = x.i""")
def g17(spark, sf):
    return sig(S.sma_rsi_filter(nation_bars(spark, sf), 5, 15, 14, 52.0, 48.0))


@query("g18_sma_volatility_gate", f"""SELECT asset, ts, e AS entry, x AND NOT {yes(f"vol / nullif({roll('avg', 'vol', 50)}, 0) > 1.0")} AS exit
FROM (SELECT *, {roll('stddev_samp', 'r', 20)} AS vol FROM (
  SELECT *, close / {lag('close')} - 1 AS r, {up('f', 's')} AS e, {down('f', 's')} AS x FROM {smas(f=5, s=15)}))""")
def g18(spark, sf):
    return sig(S.sma_volatility_gate(nation_bars(spark, sf), 5, 15, 20, 1.0, 50))


@query("g19_sma_late_exit", signal_sql(up("f", "s"), yes(f"close < {lag('xs')}"), smas(f=5, s=15, xs=50)))
def g19(spark, sf):
    return sig(S.sma_late_exit(nation_bars(spark, sf)))


@query("g20_sma_partial_exit", f"""SELECT asset, ts, entry, exit,
  coalesce(last_value(CASE WHEN entry THEN 1.0 WHEN exit THEN 0.5 END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts), 0)::DOUBLE AS level
FROM ({signal_sql(up('f', 's'), down('f', 's'), smas(f=5, s=15))})""")
def g20(spark, sf):
    return S.sma_partial_exit(nation_bars(spark, sf)).select("asset", "ts", "entry", "exit", "level")


@query("g21_trend_strength", f"""SELECT asset, ts, e AND strong AS entry, x AND strong AS exit FROM (
  SELECT *, {yes(f"str > ({roll('avg', 'str', 50)})")} AS strong FROM (
  SELECT *, abs(f - s) / close * 100 AS str, {up('f', 's')} AS e, {down('f', 's')} AS x FROM {smas(f=5, s=15)}))""")
def g21(spark, sf):
    return sig(S.trend_strength_filter(nation_bars(spark, sf)))


# --- replay of signals ----------------------------------------------------------------------

cte("cross_d", f"""SELECT asset, ts, pos AS i, close, {up('f', 's')} AS entry, {down('f', 's')} AS exit FROM (
  SELECT *, {roll('avg', 'close', 5)} AS f, {roll('avg', 'close', 15)} AS s FROM panel_d)""")
# A cash-and-shares book per asset: sell at the bid, buy at the ask, commission on the value.
cte("book_walk", """(asset, i, ts, cash, shares, equity, pos, trade_id, cost_basis, trade_value)
SELECT asset, -1, NULL::DATE, 10000.0::DOUBLE, 0.0::DOUBLE, 10000.0::DOUBLE, 0, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM cross_d WHERE i = 0
UNION ALL
SELECT asset, i, ts,
  CASE WHEN buy THEN 0.0 WHEN sell THEN shares * close * 0.9995 * 0.999 ELSE cash END,
  CASE WHEN buy THEN cash / (close * 1.0005 * 1.001) WHEN sell THEN 0.0 ELSE shares END,
  CASE WHEN buy THEN cash / (1.0005 * 1.001) WHEN sell THEN shares * close * 0.9995 * 0.999 WHEN pos = 1 THEN shares * close ELSE cash END,
  CASE WHEN buy THEN 1 WHEN sell THEN 0 ELSE pos END,
  CASE WHEN buy THEN trade_id + 1 ELSE trade_id END,
  CASE WHEN buy THEN cash ELSE cost_basis END,
  CASE WHEN buy THEN cash / (1.0005 * 1.001) WHEN sell THEN shares * close * 0.9995 * 0.999 WHEN pos = 1 THEN shares * close ELSE trade_value END
FROM (SELECT c.asset, c.i, c.ts, c.close, b.cash, b.shares, b.pos, b.trade_id, b.cost_basis, b.trade_value,
    b.pos = 0 AND c.entry AND NOT c.exit AS buy, b.pos = 1 AND c.exit AND NOT c.entry AS sell
  FROM book_walk b JOIN cross_d c ON c.asset = b.asset AND c.i = b.i + 1)""")
cte("book_trades", """SELECT asset, trade_id, min(ts) AS entry_ts, arg_max(trade_value, i) / arg_max(cost_basis, i) - 1 AS trade_return
FROM book_walk WHERE trade_id > 0 GROUP BY 1, 2""")


def crossed(spark, sf):
    panel = T.panel(spark, sf).select("asset", "ts", "close")
    return panel, R.replay_signals(S.sma_crossover(panel, 5, 15))


@query("v1_signal_replay_equity", "SELECT asset, ts, pos, round(equity, 4) AS equity FROM book_walk WHERE i >= 0")
def v1(spark, sf):
    return rounded(crossed(spark, sf)[1].select("asset", "ts", "pos", "equity"), 4, "equity")


@query("v1_signal_trades", "SELECT asset, CAST(trade_id AS BIGINT) AS trade_id, entry_ts, round(trade_return, 8) AS trade_return FROM book_trades")
def v1_trades(spark, sf):
    trades = R.signal_trades(crossed(spark, sf)[1])
    return rounded(trades.select("asset", "trade_id", "entry_ts", "trade_return"), 8, "trade_return")


@query("a5_signal_metrics", """
WITH e AS (SELECT *, lag(equity) OVER (PARTITION BY asset ORDER BY i) AS prev, max(equity) OVER (PARTITION BY asset ORDER BY i) AS peak FROM book_walk),
m AS (SELECT asset, (arg_max(equity, i) / 10000 - 1) * 100 AS total_return_pct,
  avg(equity / prev - 1) / stddev_samp(equity / prev - 1) * sqrt(365) AS sharpe_ratio, min(equity / peak - 1) * 100 AS max_drawdown_pct,
  sqrt(avg((100 * (equity / peak - 1)) ** 2)) AS ulcer_index, avg(pos) * 100 AS exposure_pct FROM e WHERE i >= 0 GROUP BY asset),
t AS (SELECT asset, count(*) AS num_trades, avg(CASE WHEN trade_return > 0 THEN 1.0 ELSE 0.0 END) * 100 AS win_rate_pct,
  sum(greatest(trade_return, 0)) / coalesce(nullif(sum(-least(trade_return, 0)), 0), 1e-4) AS profit_factor,
  CASE WHEN count(*) >= 3 THEN (avg(trade_return ** 3) - 3 * avg(trade_return) * avg(trade_return ** 2) + 2 * avg(trade_return) ** 3)
    / stddev_pop(trade_return) ** 3 END AS return_skew FROM book_trades GROUP BY asset),
h AS (SELECT asset, (arg_max(close, pos) / arg_min(close, pos) - 1) * 100 AS bh FROM panel_d GROUP BY asset)
SELECT asset, round(total_return_pct, 6) AS total_return_pct, round(sharpe_ratio, 6) AS sharpe_ratio,
  round(max_drawdown_pct, 6) AS max_drawdown_pct, round(ulcer_index, 6) AS ulcer_index, round(exposure_pct, 6) AS exposure_pct,
  num_trades, round(win_rate_pct, 6) AS win_rate_pct, round(profit_factor, 6) AS profit_factor, round(return_skew, 6) AS return_skew,
  round(bh, 6) AS buy_and_hold_pct, total_return_pct > bh AS beats_benchmark
FROM m JOIN t USING (asset) JOIN h USING (asset)""")
def a5(spark, sf):
    panel, eq = crossed(spark, sf)
    out = M.signal_metrics(eq, R.signal_trades(eq), panel, R.INITIAL_CASH)
    out = out.drop("n_obs", "final_equity")
    return rounded(out, 6, *[c for c, t in out.dtypes if t == "double"])


@query("a3_buy_and_hold", """SELECT asset, round((arg_max(close, pos) / arg_min(close, pos) - 1) * 100, 6) AS buy_and_hold_pct
FROM panel_d GROUP BY 1""")
def a3(spark, sf):
    return rounded(M.buy_and_hold(T.panel(spark, sf)), 6, "buy_and_hold_pct")


# --- pairs and monthly rules ----------------------------------------------------------------

PW = "PARTITION BY pair_id ORDER BY ts"
cte("pair_d", """SELECT a.asset || '/' || b.asset AS pair_id, a.ts, a.close AS l1, b.close AS l2, a.pos AS i
FROM panel_d a JOIN panel_d b ON b.ts = a.ts AND b.asset > a.asset""")


def pair_table(spark, sf):
    names = T.universe(spark, sf).select("asset")
    other = names.withColumnRenamed("asset", "leg2")
    pairs = names.withColumnRenamed("asset", "leg1").join(other, F.col("leg1") < F.col("leg2"))
    return pairs.withColumn("pair_id", F.concat_ws("/", "leg1", "leg2"))


def pairs_daily(spark, sf):
    return P.align_pairs(T.panel(spark, sf), pair_table(spark, sf))


def proll(agg: str, col: str, n: int) -> str:
    fr = f"({PW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) OVER {fr} = {n} THEN {agg}({col}) OVER {fr} END"


_PAST = f"({PW} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
cte("hedge_d", f"""SELECT *, lag(ln(l1)) OVER ({PW}) - beta * lag(ln(l2)) OVER ({PW}) AS spread FROM (
  SELECT *, CASE WHEN count(l1) OVER {_PAST} = 60 THEN regr_slope(ln(l1), ln(l2)) OVER {_PAST} END AS beta FROM pair_d)""")


@query("w27_rolling_hedge_ratio", "SELECT pair_id, ts, round(beta, 5) AS beta, round(spread, 4) AS spread FROM hedge_d")
def w27(spark, sf):
    df = P.with_hedge_spread(pairs_daily(spark, sf)).select("pair_id", "ts", "beta", "spread")
    return df.withColumn("beta", F.round("beta", 5)).withColumn("spread", F.round("spread", 4))


@query("g22_pairs_hedge_z", f"""SELECT pair_id, ts, {yes('abs(z) > 1.5')} AS entry, {yes('z > -0.5 OR z < 0.5')} AS exit FROM (
SELECT *, (spread - {proll('avg', 'spread', 60)}) / nullif({proll('stddev_samp', 'spread', 60)}, 0) AS z FROM hedge_d)""")
def g22(spark, sf):
    return P.hedge_ratio_signals(pairs_daily(spark, sf), 60, 1.5).select("pair_id", "ts", "entry", "exit")


cte("ratio_z", f"""SELECT *, (lr - {proll('avg', 'lr', 60)}) / nullif({proll('stddev_samp', 'lr', 60)}, 0) AS z
FROM (SELECT *, ln(l1) - ln(l2) AS lr FROM pair_d)""")


@query("w28_log_ratio_z", "SELECT pair_id, ts, round(z, 6) AS zscore FROM ratio_z")
def w28(spark, sf):
    return rounded(P.with_log_ratio_z(pairs_daily(spark, sf)).select("pair_id", "ts", "zscore"), 6, "zscore")


cte("state_walk", """(pair_id, i, ts, held, state) SELECT pair_id, i, ts, 0, 0 FROM ratio_z WHERE i = 0
UNION ALL SELECT r.pair_id, r.i, r.ts, s.state, CASE WHEN s.state = 0 AND r.z < -1.5 THEN 1 WHEN s.state = 0 AND r.z > 1.5 THEN -1
  WHEN s.state = 1 AND r.z > -0.5 THEN 0 WHEN s.state = -1 AND r.z < 0.5 THEN 0 ELSE s.state END
FROM state_walk s JOIN ratio_z r ON r.pair_id = s.pair_id AND r.i = s.i + 1""")


@query("g23_pairs_state", """SELECT pair_id, ts, CAST(state AS INTEGER) AS state, held = 0 AND state <> 0 AS entry,
held <> 0 AND state = 0 AS exit FROM state_walk""")
def g23(spark, sf):
    return P.spread_state_signals(pairs_daily(spark, sf), 60, 1.5).select("pair_id", "ts", "state", "entry", "exit")


@query("g24_pairs_extreme", f"""SELECT pair_id, ts, {yes('abs(z) > 1.5')} AS entry,
{yes('abs(z) < 0.0')} OR z IS NULL OR sign(z) <> sign(coalesce(lag(z) OVER ({PW}), 0)) AS exit FROM ratio_z""")
def g24(spark, sf):
    return P.spread_extreme_signals(pairs_daily(spark, sf), 60, 1.5).select("pair_id", "ts", "entry", "exit")


@query("j14_pair_alignment", """SELECT a.asset || '/' || b.asset AS pair_id, a.ts, round(a.close, 8) AS l1, round(b.close, 8) AS l2
FROM bars_d a JOIN bars_d b ON b.ts = a.ts AND b.asset > a.asset""")
def j14(spark, sf):
    return rounded(P.align_pairs(T.bars(spark, sf, "day"), pair_table(spark, sf)), 8, "l1", "l2")


cte("pair_m", """SELECT a.asset || '/' || b.asset AS pair_id, a.month AS ts, a.close AS l1, b.close AS l2 FROM
(SELECT asset, last_day(ts) AS month, arg_max(close, ts) AS close FROM panel_d GROUP BY 1, 2) a JOIN
(SELECT asset, last_day(ts) AS month, arg_max(close, ts) AS close FROM panel_d GROUP BY 1, 2) b ON b.month = a.month AND b.asset > a.asset""")


def pairs_monthly(spark, sf):
    months = B.month_end(T.panel(spark, sf))
    return P.align_pairs(months, pair_table(spark, sf), "month")


@query("g25_monthly_lag", f"""WITH s AS (SELECT *, coalesce(l2 / lag(l2, 2) OVER ({PW}) - 1 > 0, false) AS u FROM pair_m),
e AS (SELECT *, coalesce(lag(u) OVER ({PW}), false) AND NOT coalesce(lag(u, 2) OVER ({PW}), false) AS entry FROM s)
SELECT pair_id, ts AS month, entry, coalesce(lag(entry) OVER ({PW}), false) AS exit FROM e""")
def g25(spark, sf):
    return P.monthly_lag_signals(pairs_monthly(spark, sf), 2).select("pair_id", "month", "entry", "exit")


@query("g26_below_average_short", f"""WITH m AS (SELECT asset, last_day(ts) AS month, arg_max(close, ts) AS close, arg_max(s, ts) FILTER (s IS NOT NULL) AS s
  FROM (SELECT *, {roll('avg', 'close', 100)} AS s FROM panel_d) GROUP BY 1, 2),
b AS (SELECT *, coalesce(close < s, false) AS below FROM m),
e AS (SELECT *, below AND NOT coalesce(lag(below) OVER (PARTITION BY asset ORDER BY month), true) AS entry FROM b)
SELECT asset, month, entry, coalesce(lag(entry, 3) OVER (PARTITION BY asset ORDER BY month), false) AS exit FROM e""")
def g26(spark, sf):
    return P.below_average_short(T.panel(spark, sf), 100).select("asset", "month", "entry", "exit")


@query("g27_monthly_ratio", f"""SELECT pair_id, ts AS month, round(l1 / l2, 8) AS close, row_number() OVER ({PW}) > 1 AS entry,
row_number() OVER ({PW}) > 2 AS exit FROM pair_m""")
def g27(spark, sf):
    return rounded(P.monthly_ratio(pairs_monthly(spark, sf)), 8, "close")
