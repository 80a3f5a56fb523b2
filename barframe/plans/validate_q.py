"""Queries on segments, walk-forward, stress, sweeps, resampling and whole evaluations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barframe.functions.scalars import trading_days
from barframe.operators import bootstrap as Bo
from barframe.operators import log as L
from barframe.operators import metrics as M
from barframe.operators import replay as R
from barframe.operators import research as Re
from barframe.operators import signals as S
from barframe.operators import sweep as Sw
from barframe.operators import validate as V
from barframe.operators import weights as Wt
from barframe.operators.bars import calendar
from barframe.plans import portfolio_q as PQ
from barframe.plans import series_q  # noqa: F401  (defines cross_d)
from barframe.plans import tables as T
from barframe.plans.log_q import psr_sql, threshold_sql
from barframe.plans.registry import cte, query, rounded
from barframe.session import written

# --- chunks of a series ---------------------------------------------------------------------


@query("w20_series_chunks", """SELECT asset, chunk, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last FROM (
SELECT asset, i, CAST(ntile(3) OVER (PARTITION BY asset ORDER BY i) - 1 AS INTEGER) AS chunk FROM nb) GROUP BY 1, 2""")
def w20(spark, sf):
    n = series_q.nation_bars(spark, sf).groupBy("asset").agg(F.count("*").cast("int").alias("n"))
    return n.select("asset", F.inline(V.chunk_bounds(F.col("n"), F.lit(3))))


cte("wf_sig", f"""SELECT *, {series_q.up('f', 's').replace('PARTITION BY asset', 'PARTITION BY asset, chunk')} AS entry, {series_q.down('f', 's').replace('PARTITION BY asset', 'PARTITION BY asset, chunk')} AS exit FROM (
  SELECT *, {series_q.roll('avg', 'close', 5).replace('PARTITION BY asset', 'PARTITION BY asset, chunk')} AS f, {series_q.roll('avg', 'close', 15).replace('PARTITION BY asset', 'PARTITION BY asset, chunk')} AS s
  FROM (SELECT asset, ts, pos, close, ntile(4) OVER (PARTITION BY asset ORDER BY pos) - 1 AS chunk FROM panel_d))""")
cte("wf_pos", """SELECT *, coalesce(lag(p) OVER (PARTITION BY asset, chunk ORDER BY pos), 0) AS prev, lag(close) OVER (PARTITION BY asset, chunk ORDER BY pos) AS pc FROM (
  SELECT *, coalesce(last_value(CASE WHEN entry AND NOT exit THEN 1 WHEN exit AND NOT entry THEN 0 END IGNORE NULLS) OVER (PARTITION BY asset, chunk ORDER BY pos), 0) AS p FROM wf_sig)""")
cte("wf_chunk", """SELECT asset, chunk, (product(CASE WHEN prev = 1 THEN close / pc ELSE 1 END * CASE WHEN prev = 0 AND p = 1 THEN 1 / (1.0005 * 1.001) WHEN prev = 1 AND p = 0 THEN 0.9995 * 0.999 ELSE 1 END) - 1) * 100 AS total_return_pct,
  (arg_max(close, pos) / arg_min(close, pos) - 1) * 100 AS benchmark_pct FROM wf_pos GROUP BY 1, 2""")


@query("a43_walk_forward_check", """SELECT asset, count(*) AS n_windows, avg(CASE WHEN total_return_pct > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate,
avg(CASE WHEN total_return_pct > benchmark_pct THEN 1.0 ELSE 0.0 END) AS beat_rate,
avg(CASE WHEN total_return_pct > 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AND avg(CASE WHEN total_return_pct > benchmark_pct THEN 1.0 ELSE 0.0 END) >= 0.5 AS passed FROM wf_chunk GROUP BY 1""")
def a43(spark, sf):
    """Four chunks of every asset, each replayed as a series of its own."""
    panel = T.panel(spark, sf)
    sizes = panel.groupBy("asset").agg(F.count("*").cast("int").alias("n"))
    k = F.least(F.lit(4), F.floor(F.col("n") / 252)).cast("int")
    bounds = sizes.filter("n >= 504").select("asset", F.inline(V.chunk_bounds(F.col("n"), k)))
    rows = panel.join(bounds, "asset").filter(F.col("pos").between(F.col("first"), F.col("last"))).select("asset", "chunk", "ts", "close")
    keys = ("asset", "chunk")
    eq = R.replay_signals(S.sma_crossover(rows, 5, 15, keys), keys=keys)
    total = eq.groupBy(*keys).agg(((F.max_by("equity", "ts") / R.INITIAL_CASH - 1) * 100).alias("total_return_pct"))
    bench = M.buy_and_hold(rows, keys).withColumnRenamed("buy_and_hold_pct", "benchmark_pct")
    return V.walk_forward_check(total.join(bench, list(keys)), ("asset",))


# --- resampling -----------------------------------------------------------------------------

cte("bs_ret", "SELECT asset, close / lag(close) OVER (PARTITION BY asset ORDER BY pos) - 1 AS r, pos FROM panel_d")
cte("bs_idx", "SELECT asset, r, CAST(row_number() OVER (PARTITION BY asset ORDER BY pos) - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY asset) AS n FROM bs_ret WHERE r IS NOT NULL")
cte("bs_draw", """SELECT asset, path, step, ((y * y + x * 3 + step) % 2147483647) % n AS i FROM (SELECT *, (x * x) % 2147483647 AS y FROM (
  SELECT a.asset, a.n, p.path, s.i AS step, (p.path * 48271 + s.i * 69621 + 42 * 7919) % 2147483647 AS x
  FROM (SELECT DISTINCT asset, n FROM bs_idx) a, (SELECT CAST(range AS BIGINT) AS path FROM range(500)) p, bs_idx s WHERE s.asset = a.asset))""")
cte("bs_path", """SELECT asset, path, arg_max(eq, step) - 1 AS terminal, min(eq / peak - 1) AS dd FROM (
  SELECT *, max(eq) OVER (PARTITION BY asset, path ORDER BY step) AS peak FROM (
  SELECT d.asset, d.path, d.step, product(1 + b.r) OVER (PARTITION BY d.asset, d.path ORDER BY d.step) AS eq FROM bs_draw d JOIN bs_idx b ON b.asset = d.asset AND b.i = d.i)) GROUP BY 1, 2""")


@query("a34_bootstrap", """SELECT asset, count(*) AS n_paths, avg(CASE WHEN terminal > 0 THEN 1.0 ELSE 0.0 END) AS probability_positive, round(quantile_cont(terminal, 0.05) * 100, 6) AS return_p5_pct,
round(quantile_cont(dd, 0.05) * 100, 6) AS drawdown_p5_pct, avg(CASE WHEN terminal > 0 THEN 1.0 ELSE 0.0 END) >= 0.6 AND quantile_cont(terminal, 0.05) * 100 > -20 AS passed FROM bs_path GROUP BY 1""")
def a34(spark, sf):
    panel = T.panel(spark, sf)
    rets = panel.withColumn("ret", F.col("close") / F.lag("close").over(V.series(("asset",), "pos")) - 1)
    out = Bo.summarize(Bo.resample(rets, ("asset",)), ("asset",))
    return rounded(out, 6, "return_p5_pct", "drawdown_p5_pct")


# --- perturbations, plateau, stress summary -------------------------------------------------

cte("base_spec", """SELECT p_partkey AS spec_id, ['cross_sectional_momentum', 'equal_weight_trend', 'dual_momentum'][p_partkey % 3 + 1] AS family, CASE WHEN p_partkey % 2 = 0 THEN ['SPY', 'TLT', 'GLD'] ELSE ['SPY', 'TLT'] END AS assets,
  CAST(20 + p_size * 2 AS INTEGER) AS lookback, CAST(1 + p_partkey % 2 AS INTEGER) AS top_k, CAST(1 + p_size AS INTEGER) AS rebalance FROM part""")
cte("pert", """SELECT spec_id, 'lockbox' AS category, 'lockbox_pct=' || p AS label, lookback, rebalance, top_k, len(assets) AS n_assets FROM base_spec, (VALUES ('0.15'), ('0.20'), ('0.25'), ('0.30')) v(p)
UNION ALL SELECT DISTINCT spec_id, 'parameter', 'lookback=' || v, v, rebalance, top_k, len(assets) FROM (SELECT *, unnest([CAST(trunc(lookback * 0.8) AS INTEGER), CAST(trunc(lookback * 1.25) AS INTEGER)]) AS v FROM base_spec) WHERE v BETWEEN 20 AND 1260 AND v <> lookback
UNION ALL SELECT DISTINCT spec_id, 'parameter', 'rebalance=' || v, lookback, v, top_k, len(assets) FROM (SELECT *, unnest([greatest(1, CAST(trunc(rebalance * 0.5) AS INTEGER)), rebalance * 2]) AS v FROM base_spec) WHERE v BETWEEN 1 AND 252 AND v <> rebalance
UNION ALL SELECT spec_id, 'parameter', 'top_k=' || v, lookback, rebalance, v, len(assets) FROM (SELECT *, unnest([top_k - 1, top_k + 1]) AS v FROM base_spec WHERE family <> 'equal_weight_trend') WHERE v BETWEEN 1 AND len(assets)
UNION ALL SELECT spec_id, 'universe', 'drop ' || a, lookback, rebalance, least(top_k, len(assets) - 1), len(assets) - 1 FROM (SELECT *, unnest(assets) AS a FROM base_spec WHERE len(assets) >= 3)""")


def base_specs(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    fams = F.array(*[F.lit(f) for f in ("cross_sectional_momentum", "equal_weight_trend", "dual_momentum")])
    three = F.array(F.lit("SPY"), F.lit("TLT"), F.lit("GLD"))
    return T.table(spark, sf, "part").select(
        key.alias("spec_id"), F.get(fams, (key % 3).cast("int")).alias("family"), F.when(key % 2 == 0, three).otherwise(F.slice(three, 1, 2)).alias("assets"),
        (20 + size * 2).cast("int").alias("lookback"), (1 + key % 2).cast("int").alias("top_k"), (1 + size).cast("int").alias("rebalance"))


@query("v6_u5_j11_perturbations", "SELECT spec_id, category, label, lookback, rebalance, top_k, CAST(n_assets AS INTEGER) AS n_assets FROM pert")
def v6(spark, sf):
    out = V.perturbations(base_specs(spark, sf))
    return out.select("spec_id", "category", "label", "lookback", "rebalance", "top_k", F.size("assets").alias("n_assets"))


@query("a32_stress_summary", """WITH r AS (SELECT *, (spec_id + length(label)) % 9 <> 0 AS runnable, (spec_id * 7 + lookback + rebalance + top_k) % 4 <> 0 AND (spec_id + length(label)) % 9 <> 0 AS confirms FROM pert),
c AS (SELECT spec_id, category, count(*) FILTER (runnable) AS n, count(*) FILTER (confirms) AS k, count(*) FILTER (NOT runnable) AS bad, coalesce(bool_or(confirms) FILTER (label = 'lockbox_pct=0.20'), false) AS base FROM r GROUP BY 1, 2),
s AS (SELECT spec_id, bool_or(base) AS base_confirms, CAST(sum(k) AS BIGINT) AS confirmed, CAST(sum(n) AS BIGINT) AS n_runnable, CAST(sum(bad) AS BIGINT) AS unrunnable, min(CASE WHEN n > 0 THEN k / n END) AS worst_category_rate FROM c GROUP BY 1)
SELECT spec_id, base_confirms, confirmed, n_runnable, unrunnable, round(worst_category_rate, 6) AS worst_category_rate, round(coalesce(confirmed / nullif(n_runnable, 0), 0), 6) AS overall_rate,
CASE WHEN NOT base_confirms THEN 'BROKEN' WHEN confirmed / nullif(n_runnable, 0) >= 0.7 AND worst_category_rate >= 0.5 THEN 'ROBUST' ELSE 'FRAGILE' END AS verdict FROM s""")
def a32(spark, sf):
    p = V.perturbations(base_specs(spark, sf))
    ok = (F.col("spec_id") + F.length("label")) % 9 != 0
    yes = (F.col("spec_id") * 7 + F.col("lookback") + F.col("rebalance") + F.col("top_k")) % 4 != 0
    out = V.stress_summary(p.withColumns({"runnable": ok, "confirms": yes}), ("spec_id",))
    return rounded(out, 6, "worst_category_rate", "overall_rate")


@query("w24_plateau", """WITH e AS (SELECT o_custkey AS sweep, CAST(o_orderkey AS INTEGER) AS v, o_orderstatus <> 'P' AND o_orderkey % 10 <> 0 AS hit FROM orders),
g AS (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY v) - sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY sweep ORDER BY v) AS island FROM e),
r AS (SELECT sweep, count(*) FILTER (hit) AS run, min(v) FILTER (hit) AS a, max(v) FILTER (hit) AS b FROM g GROUP BY sweep, island)
SELECT sweep, CAST(sum(run) AS BIGINT) AS n_confirmed, max(run) AS longest_run, arg_max(a, (run, -a)) AS from_value, arg_max(b, (run, -a)) AS to_value,
CASE WHEN sum(run) = 0 THEN 'NONE' WHEN max(run) >= 3 THEN 'PLATEAU' ELSE 'SPIKE' END AS verdict FROM r GROUP BY 1""")
def w24(spark, sf):
    entries = T.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("sweep"), F.col("o_orderkey").cast("int").alias("value"), (F.col("o_orderkey") % 10 != 0).alias("ok"), (F.col("o_orderstatus") != "P").alias("confirms"))
    return V.plateau(entries, ("sweep",))


# --- a parameter sweep through the whole path ----------------------------------------------

_SW = "PARTITION BY asset, value ORDER BY ts"


def _sw(sql: str) -> str:
    return sql.replace("PARTITION BY asset ORDER BY ts", _SW)


cte("sweep_src", "SELECT asset, ts, close, value, avg(close) OVER (PARTITION BY asset, value ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s0, count(*) OVER (PARTITION BY asset, value ORDER BY ts) AS k, "
    "CASE value " + " ".join(f"WHEN {n} THEN avg(close) OVER (PARTITION BY asset, value ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in range(3, 9))
    + " END AS f0 FROM panel_d, (SELECT CAST(range AS INTEGER) AS value FROM range(3, 9))")
cte("sweep_sig", _sw(f"SELECT *, {series_q.up('f', 's')} AS entry, {series_q.down('f', 's')} AS exit FROM (SELECT *, CASE WHEN k >= value THEN f0 END AS f, CASE WHEN k >= 20 THEN s0 END AS s FROM sweep_src)"))
cte("sweep_eq", f"""SELECT *, 10000 * product(CASE WHEN prev = 1 THEN close / pc ELSE 1 END * CASE WHEN prev = 0 AND p = 1 THEN 1 / (1.0005 * 1.001) WHEN prev = 1 AND p = 0 THEN 0.9995 * 0.999 ELSE 1 END) OVER ({_SW}) AS eq FROM (
  SELECT *, coalesce(lag(p) OVER ({_SW}), 0) AS prev, lag(close) OVER ({_SW}) AS pc FROM (
  SELECT *, coalesce(last_value(CASE WHEN entry AND NOT exit THEN 1 WHEN exit AND NOT entry THEN 0 END IGNORE NULLS) OVER ({_SW}), 0) AS p FROM sweep_sig))""")
cte("sweep_m", f"""SELECT asset, value, (arg_max(eq, ts) / 10000 - 1) * 100 AS ret, (arg_max(close, ts) / arg_min(close, ts) - 1) * 100 AS bh,
  avg(eq / prev_eq - 1) / nullif(stddev_samp(eq / prev_eq - 1), 0) * sqrt(365) AS sharpe FROM (SELECT *, coalesce(lag(eq) OVER ({_SW}), 10000) AS prev_eq FROM sweep_eq) GROUP BY 1, 2""")
cte("sweep_run", """SELECT asset, island, count(*) FILTER (hit) AS run, min(value) FILTER (hit) AS a, max(value) FILTER (hit) AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY asset ORDER BY value) - sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY value) AS island FROM (SELECT *, ret > bh AND ret > 0 AS hit FROM sweep_m)) GROUP BY 1, 2""")


@query("v7_parameter_sweep", f"""SELECT p.*, round(d.best, 6) AS best_sharpe, round({psr_sql('d.best', 'd.days', threshold_sql('d.v', 'd.n'))}, 6) AS sweep_dsr
FROM (SELECT asset, CAST(sum(run) AS BIGINT) AS n_confirmed, max(run) AS longest_run, arg_max(a, (run, -a)) AS from_value, arg_max(b, (run, -a)) AS to_value,
  CASE WHEN sum(run) = 0 THEN 'NONE' WHEN max(run) >= 3 THEN 'PLATEAU' ELSE 'SPIKE' END AS verdict FROM sweep_run GROUP BY 1) p
JOIN (SELECT asset, count(sharpe) AS n, var_samp(sharpe / sqrt(252)) AS v, max(sharpe) FILTER (ret > bh AND ret > 0) AS best, (SELECT greatest(2, CAST(round_even((max(ts) - min(ts)) * 252 / 365.0::DOUBLE, 0) AS INTEGER)) FROM panel_d) AS days FROM sweep_m GROUP BY 1) d ON d.asset = p.asset""")
def v7(spark, sf):
    """Fast windows 3 to 8 of a crossover on every asset over all dates, read as a surface."""
    panel = written(T.panel(spark, sf).select("asset", "ts", "close"), "panel")
    keys = ("asset", "value")
    swept = None
    for n in range(3, 9):
        one = S.sma_crossover(panel.withColumn("value", F.lit(n)), n, 20, keys)
        swept = one if swept is None else swept.unionByName(one)
    eq = written(R.replay_signals(swept, keys=keys), "sweep-equity")
    m = M.signal_metrics(eq, R.signal_trades(eq, keys), eq, R.INITIAL_CASH, keys)
    m = m.join(panel.groupBy("asset").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b")), "asset")
    entries = m.withColumns({"ok": F.lit(True), "confirms": F.col("beats_benchmark") & (F.col("total_return_pct") > 0), "n_days": trading_days(F.col("_a"), F.col("_b"))})
    out = V.plateau(entries, ("asset",)).join(L.sweep_dsr(entries, ("asset",)), "asset")
    return rounded(out, 6, "best_sharpe", "sweep_dsr")


# The same path as an operator, with a train side and a lockbox.
SWEPT, SLOW, HELD_OUT = (2, 3, 4, 5, 6, 8, 12, 20, 25), 20, "1997-01-01"
_LW = "PARTITION BY asset, segment, value ORDER BY ts"


def _lw(sql: str) -> str:
    return sql.replace("PARTITION BY asset ORDER BY ts", _LW)


_VALID = [n for n in SWEPT if n < SLOW]
cte("lat_src", f"SELECT asset, segment, ts, close, value, count(*) OVER ({_LW}) AS k, avg(close) OVER ({_LW} ROWS BETWEEN {SLOW - 1} PRECEDING AND CURRENT ROW) AS s0, CASE value "
    + " ".join(f"WHEN {n} THEN avg(close) OVER ({_LW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in _VALID)
    + f" END AS f0 FROM (SELECT *, CASE WHEN ts < DATE '{HELD_OUT}' THEN 'train' ELSE 'lockbox' END AS segment FROM panel_d), (SELECT unnest({_VALID}) AS value)")
cte("lat_sig", _lw(f"SELECT *, {series_q.up('f', 's')} AS entry, {series_q.down('f', 's')} AS exit FROM (SELECT *, CASE WHEN k >= value THEN f0 END AS f, CASE WHEN k >= {SLOW} THEN s0 END AS s FROM lat_src)"))
cte("lat_eq", f"""SELECT *, 10000 * product(CASE WHEN prev = 1 THEN close / pc ELSE 1 END * CASE WHEN prev = 0 AND p = 1 THEN 1 / (1.0005 * 1.001) WHEN prev = 1 AND p = 0 THEN 0.9995 * 0.999 ELSE 1 END) OVER ({_LW}) AS eq FROM (
  SELECT *, coalesce(lag(p) OVER ({_LW}), 0) AS prev, lag(close) OVER ({_LW}) AS pc FROM (
  SELECT *, coalesce(last_value(CASE WHEN entry AND NOT exit THEN 1 WHEN exit AND NOT entry THEN 0 END IGNORE NULLS) OVER ({_LW}), 0) AS p FROM lat_sig))""")
cte("lat_m", f"""SELECT asset, segment, value, (arg_max(eq, ts) / 10000 - 1) * 100 AS ret, (arg_max(close, ts) / arg_min(close, ts) - 1) * 100 AS bh, count(*) FILTER (prev = 0 AND p = 1) AS trades,
  avg(eq / prev_eq - 1) / nullif(stddev_samp(eq / prev_eq - 1), 0) * sqrt(365) AS sharpe, min(eq / peak - 1) * 100 AS dd, greatest(2, CAST(round_even((max(ts) - min(ts)) * 252 / 365.0::DOUBLE, 0) AS INTEGER)) AS days
  FROM (SELECT *, coalesce(lag(eq) OVER ({_LW}), 10000) AS prev_eq, max(eq) OVER ({_LW}) AS peak FROM lat_eq) GROUP BY 1, 2, 3""")
cte("lat_v", f"""SELECT *, CASE WHEN ret < 0 OR dd <= -50 OR trades < 10 THEN 'reject' WHEN ret > 0 AND ret > bh AND trades >= 20 AND
  (trades >= 20)::INT + (ret > bh)::INT + (ret > 0)::INT + (dd > -50)::INT + coalesce({psr_sql('sharpe', 'days', '0.0')} >= 0.95, false)::INT > 2.5 THEN 'worth_paper_trading' ELSE 'needs_more_testing' END AS verdict FROM lat_m""")
cte("lat_entry", f"""SELECT a.asset, a.value, CASE WHEN a.value < {SLOW} THEN 'ok' ELSE 'invalid' END AS status, t.verdict AS train_verdict, l.verdict AS lockbox_verdict, coalesce(l.verdict = 'worth_paper_trading', false) AS confirms,
  l.sharpe, l.ret, l.bh, l.days FROM (SELECT DISTINCT asset, value FROM panel_d, (SELECT unnest({list(SWEPT)}) AS value)) a LEFT JOIN lat_v t ON t.asset = a.asset AND t.value = a.value AND t.segment = 'train'
  LEFT JOIN lat_v l ON l.asset = a.asset AND l.value = a.value AND l.segment = 'lockbox'""")


def swept(spark, sf):
    panel = written(T.panel(spark, sf).select("asset", "ts", "close"), "panel")
    return Sw.sweep_entries(panel, SWEPT, SLOW, HELD_OUT)


@query("v7_sweep_entries", """SELECT asset, value, status, train_verdict, lockbox_verdict, confirms, round(sharpe, 6) AS held_out_sharpe, round(ret, 6) AS held_out_return_pct,
round(bh, 6) AS held_out_benchmark_pct FROM lat_entry""")
def v7_entries(spark, sf):
    return rounded(swept(spark, sf).drop("ok", "n_days"), 6, "held_out_sharpe", "held_out_return_pct", "held_out_benchmark_pct")


@query("v7_sweep_surface", f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY value) - sum(confirms::INT) OVER (PARTITION BY asset ORDER BY value) AS island FROM lat_entry),
r AS (SELECT asset, island, count(*) FILTER (confirms) AS run, min(value) FILTER (confirms) AS a, max(value) FILTER (confirms) AS b FROM i GROUP BY 1, 2)
SELECT p.*, round(d.best, 6) AS best_sharpe, round(CASE WHEN d.n >= 2 THEN {psr_sql('d.best', 'd.days', threshold_sql('d.v', 'd.n'))} END, 6) AS sweep_dsr
FROM (SELECT asset, CAST(sum(run) AS BIGINT) AS n_confirmed, max(run) AS longest_run, arg_max(a, (run, -a)) AS from_value, arg_max(b, (run, -a)) AS to_value,
  CASE WHEN sum(run) = 0 THEN 'NONE' WHEN max(run) >= 3 THEN 'PLATEAU' ELSE 'SPIKE' END AS verdict FROM r GROUP BY 1) p
LEFT JOIN (SELECT asset, count(sharpe) AS n, var_samp(sharpe / sqrt(252)) AS v, max(sharpe) FILTER (confirms) AS best, max(days) AS days FROM lat_entry WHERE status = 'ok' GROUP BY 1) d ON d.asset = p.asset""")
def v7_surface(spark, sf):
    return rounded(Sw.sweep_surface(written(swept(spark, sf), "sweep-entries")), 6, "best_sharpe", "sweep_dsr")


# --- segments of portfolio runs -------------------------------------------------------------

FIRST, LAST = "1995-06-01", "2001-09-30"
SLATE = tuple((f"{f}/{n}", f, n, 2, 21, 0, None) for f, n in (
    ("cross_sectional_momentum", 63), ("dual_momentum", 126), ("equal_weight_trend", 100), ("time_series_momentum", 63), ("volatility_scaled_momentum", 126)))


def dated_specs(panel, rows=SLATE):
    specs = PQ.whole_span_runs(panel, *rows).drop("pos0", "pos1")
    return specs.withColumns({"start": F.lit(FIRST).cast("date"), "end": F.lit(LAST).cast("date")})


def segment_runs(panel, rows=SLATE, pct=0.25):
    return Re.with_segments(dated_specs(panel, rows), calendar(panel), pct)


cte("seg", f"""SELECT segment, min(pos) AS p0, max(pos) AS p1 FROM (SELECT DISTINCT pos, ts, CASE WHEN ts >= lb THEN 'lockbox' ELSE 'train' END AS segment
  FROM panel_d, (SELECT DATE '{LAST}' - CAST(round_even((DATE '{LAST}' - DATE '{FIRST}') * 0.25::DOUBLE, 0) AS INTEGER) AS lb) WHERE ts BETWEEN DATE '{FIRST}' AND DATE '{LAST}') GROUP BY 1""")


@query("p4_p7_located_segments", "SELECT segment, CAST(p0 AS INTEGER) AS pos0, CAST(p1 AS INTEGER) AS pos1 FROM seg")
def p4_p7(spark, sf):
    return segment_runs(T.panel(spark, sf), SLATE[:1]).select("segment", "pos0", "pos1")


cte("seg_wt", """SELECT 'cross_sectional_momentum/63|' || segment AS run_id, pos + 1 AS exec_pos, asset_ord, CASE WHEN rk <= 2 THEN 0.5 ELSE 0.0 END AS weight
FROM (SELECT g.segment, c.pos, c.asset_ord, row_number() OVER (PARTITION BY g.segment, c.pos ORDER BY c.close / b.close DESC, c.asset_ord) AS rk
  FROM seg g JOIN panel_d c ON c.pos BETWEEN g.p0 + 63 AND g.p1 - 1 AND (c.pos - g.p0 - 63) % 21 = 0 JOIN panel_d b ON b.asset = c.asset AND b.pos = c.pos - 63)
UNION ALL SELECT 'time_series_momentum/63|' || segment, pos + 1, asset_ord, CASE WHEN m > 0 THEN 0.2 ELSE 0.0 END
FROM (SELECT g.segment, c.pos, c.asset_ord, c.close / b.close - 1 AS m
  FROM seg g JOIN panel_d c ON c.pos BETWEEN g.p0 + 63 AND g.p1 - 1 AND (c.pos - g.p0 - 63) % 21 = 0 JOIN panel_d b ON b.asset = c.asset AND b.pos = c.pos - 63)""")
PQ.sequential_nav("sg", "panel_d", "seg_wt")


@query("v5_segment_returns", """SELECT n.run_id, round((arg_max(n.nav, n.pos) / 10000 - 1) * 100, 6) AS total_return_pct, CAST(count(*) FILTER (n.is_order) AS BIGINT) AS rebalances, round(any_value(b.bench), 6) AS benchmark_pct
FROM sg_nav n JOIN seg g ON n.run_id LIKE '%|' || g.segment AND n.pos BETWEEN g.p0 AND g.p1
JOIN (SELECT segment, (avg(g) - 1) * 100 AS bench FROM (SELECT s.segment, p.asset, arg_max(p.close, p.pos) / arg_min(p.close, p.pos) AS g FROM seg s JOIN panel_d p ON p.pos BETWEEN s.p0 AND s.p1 GROUP BY 1, 2) GROUP BY 1) b ON b.segment = g.segment
GROUP BY 1""")
def v5(spark, sf):
    """Train and lockbox replays of two specs, each seeing only its own dates."""
    panel = written(T.panel(spark, sf), "panel")
    runs = segment_runs(panel, (SLATE[0], SLATE[3]))
    out = PQ.nav_report(panel, Wt.target_weights(Wt.running_sums(panel), runs), runs)
    return rounded(out.select("run_id", "total_return_pct", "rebalances", "benchmark_pct"), 6, "total_return_pct", "benchmark_pct")


def evaluated(spark, sf, rows=SLATE, paths=500):
    panel = written(T.panel(spark, sf), "panel")
    runs = segment_runs(panel, rows)
    return panel, runs, Re.evaluate(Wt.running_sums(panel), panel, runs, paths=paths)


_SHOWN = ("total_return_pct", "sharpe_ratio", "max_drawdown_pct", "benchmark_pct")


@query("v5_train_and_lockbox_verdicts")
def v5_verdicts(spark, sf):
    """A slate judged on train and lockbox with every check: walk-forward, resampling, PSR."""
    out = evaluated(spark, sf)[2]
    return rounded(out.select("run_id", *_SHOWN, "num_trades", "n_passed", "n_checks", "failed_checks", "verdict"), 6, *_SHOWN)


# A slate of two specs that run, one after its end, one of a single asset, one off the calendar, one too short.
BAD = (("one asset", FIRST, LAST), ("backwards", LAST, FIRST), ("long ago", "1950-01-01", "1960-01-01"), ("short", "1996-01-01", "1996-12-31"), ("no date", "1996-13-01", LAST))
cte("slate_train", """SELECT split_part(n.run_id, '|', 1) AS run_id, split_part(n.run_id, '|', 2) AS segment, (arg_max(nav, pos) / 10000 - 1) * 100 AS ret,
  avg(nav / prev - 1) / stddev_samp(nav / prev - 1) * sqrt(365) AS sharpe FROM (
  SELECT n.*, coalesce(lag(nav) OVER (PARTITION BY n.run_id ORDER BY n.pos), 10000.0) AS prev FROM sg_nav n JOIN seg g ON n.run_id LIKE '%|' || g.segment AND n.pos BETWEEN g.p0 AND g.p1) n GROUP BY 1, 2""")
cte("slate_bench", """SELECT segment, (avg(g) - 1) * 100 AS bench FROM (
  SELECT s.segment, p.asset, arg_max(p.close, p.pos) / arg_min(p.close, p.pos) AS g FROM seg s JOIN panel_d p ON p.pos BETWEEN s.p0 AND s.p1 GROUP BY 1, 2) GROUP BY 1""")
cte("slate_best", """SELECT run_id, CASE WHEN ret > bench THEN 'highest_sharpe_among_benchmark_beaters' ELSE 'highest_sharpe_overall_no_benchmark_beaters' END AS winner_reason
FROM slate_train JOIN slate_bench USING (segment) WHERE segment = 'train' ORDER BY ret > bench DESC, sharpe DESC, ret DESC, run_id LIMIT 1""")


_TRAIN_DAYS = f"greatest(2, CAST(round_even((DATE '{LAST}' - CAST(round_even((DATE '{LAST}' - DATE '{FIRST}') * 0.25::DOUBLE, 0) AS INTEGER) - 1 - DATE '{FIRST}') * 252 / 365.0, 0) AS INTEGER))"


@query("v5_slate_research", f"""WITH spread AS (SELECT count(sharpe) AS n, var_samp(sharpe / sqrt(252)) AS v FROM slate_train WHERE segment = 'train'),
deflated AS (SELECT run_id, {psr_sql('sharpe', _TRAIN_DAYS, threshold_sql('v', 'n'))} AS dsr FROM slate_train, spread WHERE segment = 'train')
SELECT o.run_id, o.status, o.reason, len(o.problems) AS n_problems, round(t.ret, 6) AS total_return_pct, round(t.sharpe, 6) AS sharpe_ratio,
  CASE WHEN t.run_id IS NOT NULL THEN CAST(2 AS BIGINT) END AS trials, round(d.dsr, 6) AS dsr, w.run_id IS NOT NULL AS is_winner, w.winner_reason,
  CASE WHEN w.run_id IS NOT NULL THEN round(l.ret, 6) END AS lockbox_total_return_pct
FROM (VALUES ('cross_sectional_momentum/63', 'ok', NULL, []::VARCHAR[]), ('time_series_momentum/63', 'ok', NULL, []),
  ('one asset', 'rejected', 'a portfolio needs at least 2 assets; at least 2 distinct assets are required; top_k cannot exceed the number of assets',
    ['a', 'b', 'c']),
  ('backwards', 'rejected', 'end date must be after start date', ['a']), ('long ago', 'error', 'no dates in the calendar', []),
  ('short', 'error', 'too few rows', []), ('no date', 'rejected', 'invalid ISO date', ['a'])) o(run_id, status, reason, problems)
LEFT JOIN slate_train t ON t.run_id = o.run_id AND t.segment = 'train' LEFT JOIN slate_train l ON l.run_id = o.run_id AND l.segment = 'lockbox'
LEFT JOIN slate_best w ON w.run_id = o.run_id LEFT JOIN deflated d ON d.run_id = o.run_id""")
def v5_slate(spark, sf):
    """A slate with bad specs from critique to the winner's lockbox."""
    panel = written(T.panel(spark, sf), "panel")
    good = dated_specs(panel, (SLATE[0], SLATE[3])).withColumns({c: F.col(c).cast("string") for c in ("start", "end")})
    first = good.filter(F.col("run_id") == SLATE[0][0])
    bad = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("from"), F.lit(b).alias("to")) for n, a, b in BAD])).alias("bad")
    bad = first.select("*", bad).withColumns({
        "run_id": F.col("bad.name"), "start": F.col("bad.from"), "end": F.col("bad.to"),
        "assets": F.when(F.col("bad.name") == "one asset", F.slice("assets", 1, 1)).otherwise(F.col("assets")),
    }).drop("bad")
    specs = good.unionByName(bad).withColumns({"slate_id": F.lit("S"), "idx": F.rank().over(Window.orderBy("run_id"))})
    out = Re.slate_research(Wt.running_sums(panel), panel, specs, calendar(panel), 0.25)
    out = out.withColumns({"run_id": F.col("spec_id"), "n_problems": F.size("problems").cast("bigint")})
    return rounded(out.select(
        "run_id", "status", "reason", "n_problems", "total_return_pct", "sharpe_ratio", "trials", "dsr", "is_winner", "winner_reason",
        "lockbox_total_return_pct"), 6, "total_return_pct", "sharpe_ratio", "dsr", "lockbox_total_return_pct")


@query("v10_gated_slate")
def v10(spark, sf):
    """A fixed slate through train, lockbox and stress; each gate sees only what passed."""
    panel = written(T.panel(spark, sf), "panel")
    return Re.gated_lab(written(Wt.running_sums(panel), "sums"), panel, dated_specs(panel), calendar(panel))[1]


CAMPAIGN = {
    "cross 3/7": lambda b, k: S.sma_crossover(b, 3, 7, k),
    "cross 5/15": lambda b, k: S.sma_crossover(b, 5, 15, k),
    "channel 10/5": lambda b, k: S.close_donchian(b, 10, 5, k),
}


def campaign_rows(spark, sf):
    panel = written(T.panel(spark, sf).select("asset", "ts", "close"), "panel")
    return Re.campaign(panel, CAMPAIGN, F.lit("2000-01-01").cast("date"))


@query("v9_campaign")
def v9(spark, sf):
    """Three rules on every asset: train verdicts, the winner's lockbox verdict, per asset and in total."""
    return L.campaign_summary(campaign_rows(spark, sf))


@query("v6_stress_confirmations")
def v6_stress(spark, sf):
    """Every perturbation of the whole slate, train and lockbox, in one plan; then the survival rates."""
    panel = written(T.panel(spark, sf), "panel")
    base = dated_specs(panel).withColumnsRenamed({"run_id": "spec_id"})
    varied = V.perturbations(base).withColumn("run_id", F.concat_ws("/", "spec_id", "category", "label")).drop("spec_id")
    located = Re.with_segments(varied, calendar(panel), "lockbox_pct")
    out = Re.evaluate(Wt.running_sums(panel), panel, located)
    confirmed = Re.confirmations(out, located, varied)
    results = confirmed.select(
        F.split("spec_id", "/")[0].alias("family"), F.split("spec_id", "/")[2].alias("category"), F.split("spec_id", "/")[3].alias("label"),
        (F.col("status") == "ok").alias("runnable"), "confirms")
    return rounded(V.stress_summary(results, ("family",)), 6, "overall_rate", "worst_category_rate")


@query("v8_batch_of_specs")
def v8(spark, sf):
    """A batch document expanded and evaluated over its whole range."""
    from barframe.sources.logs import BATCH_FILE, batch_specs

    panel = written(T.panel(spark, sf), "panel")
    names = panel.filter("pos = 0").groupBy("universe_id").agg(F.array_sort(F.collect_set("asset")).alias("a"))
    item = F.format_string(
        '{"defaults": {"family": "cross_sectional_momentum", "lookback": 126, "top_k": 2, "start": "%s", "end": "%s"}, "portfolios": [{"name": "all", "assets": %s}, {"name": "three", "assets": "%s", "family": "dual_momentum", "rebalance": 42}, {"name": "lone", "assets": "NONE"}]}',
        F.lit(FIRST), F.lit(LAST), F.to_json("a"), F.array_join(F.slice("a", 1, 3), ","))
    docs = names.select("universe_id", F.from_json(item, BATCH_FILE).alias("f")).select("universe_id", "f.*")
    specs = batch_specs(docs, carry=("universe_id",)).withColumn("run_id", F.col("name"))
    out = Re.batch_research(Wt.running_sums(panel), panel, specs, calendar(panel)).withColumnRenamed("spec_id", "run_id")
    return rounded(out.select("run_id", "status", "reason", *_SHOWN, "failed_checks", "verdict"), 6, *_SHOWN)


cte("seg_comp", """SELECT segment, pos, composite, avg(composite) OVER (PARTITION BY segment ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS s FROM (
  SELECT segment, pos, avg(close / c0) AS composite FROM (SELECT g.segment, p.pos, p.asset_ord, p.close, first_value(p.close) OVER (PARTITION BY g.segment, p.asset ORDER BY p.pos) AS c0
  FROM seg g JOIN panel_d p ON p.pos BETWEEN g.p0 AND g.p1) WHERE asset_ord < 3 GROUP BY 1, 2)""")
cte("wt_sbook", """SELECT v.rule || '|' || c.segment || '/' || v.variant AS run_id, c.pos + 1 AS exec_pos, p.asset_ord, CASE WHEN v.variant = 'combined' AND (v.rule = 'static' OR NOT c.composite > c.s)
  THEN CASE WHEN p.asset_ord < 3 THEN 0.7 / 3 ELSE 0.15 END WHEN p.asset_ord < 3 THEN 1.0 / 3 ELSE 0.0 END AS weight
FROM seg_comp c JOIN seg g ON g.segment = c.segment, (VALUES ('regime', 'core'), ('regime', 'combined'), ('static', 'core'), ('static', 'combined')) v(rule, variant), (SELECT DISTINCT asset_ord FROM panel_d) p
WHERE c.pos >= g.p0 + 100 AND (c.pos - g.p0 - 100) % 21 = 0 AND c.pos < g.p1""")
PQ.sequential_nav("sbook", "panel_d", "wt_sbook")
cte("sbook_m", """SELECT run_id, (arg_max(nav, pos) / 10000 - 1) * 100 AS t, avg(nav / prev - 1) / stddev_samp(nav / prev - 1) * sqrt(365) AS s, min(nav / peak - 1) * 100 AS d FROM (
  SELECT n.*, coalesce(lag(nav) OVER w, 10000.0) AS prev, max(nav) OVER w AS peak FROM sbook_nav n JOIN seg g ON n.run_id LIKE '%|' || g.segment || '/%' AND n.pos BETWEEN g.p0 AND g.p1 WINDOW w AS (PARTITION BY run_id ORDER BY pos)) GROUP BY 1""")


@query("v12_book_lockbox_confirm", """WITH j AS (SELECT split_part(c.run_id, '/', 1) AS run_id, c.t AS ct, c.s AS cs, c.d AS cd, b.t AS bt, b.s AS bs, b.d AS bd FROM sbook_m c JOIN sbook_m b
  ON c.run_id = split_part(b.run_id, '/', 1) || '/core' AND b.run_id LIKE '%/combined')
SELECT run_id, round(ct - bt, 6) AS return_cost_pct, round(bd - cd, 6) AS drawdown_improvement_pct, round(bs - cs, 6) AS sharpe_delta,
  CASE WHEN bs > cs THEN 'IMPROVES_RISK_ADJUSTED' WHEN cd < 0 AND bd / cd <= 0.8 THEN 'REDUCES_DRAWDOWN_AT_COST' ELSE 'NOT_WORTH_IT' END AS verdict, bs > cs OR (cd < 0 AND bd / cd <= 0.8) AS confirmed FROM j""")
def v12(spark, sf):
    """Overlay book against core on train and on the lockbox."""
    panel = written(T.panel(spark, sf), "panel")
    rows = (("regime", "book", 100, 1, 21, 0, None), ("static", "book", 100, 1, 21, 0, None))
    runs = segment_runs(panel, rows)
    books = runs.select(
        "run_id", "universe_id", F.slice("assets", 1, 3).alias("core"), F.slice("assets", 4, 2).alias("overlay"), F.lit(0.3).alias("overlay_weight"),
        F.col("spec_id").alias("rule"), "lookback", "rebalance", "pos0", "pos1")
    w = Wt.book_weights(Wt.running_sums(panel), books)
    bars = R.run_bars(panel, runs).join(w.select("run_id", "variant").distinct(), "run_id")
    nav = R.replay_weights(bars, w, PQ.COST, run_keys=("run_id", "variant"))
    m = M.equity_metrics(nav, R.INITIAL_CASH, ("run_id", "variant"), "pos", "nav", "exposure")
    out = V.compare_books(m).withColumn("confirmed", F.col("verdict") != "NOT_WORTH_IT")
    return rounded(out, 6, "return_cost_pct", "drawdown_improvement_pct", "sharpe_delta")


cte("fwd_eval", """SELECT run_id, count(*) AS n, (arg_max(nav, pos) / arg_min(nav, pos) - 1) * 100 AS r, min(nav / peak - 1) * 100 AS dd, max(ts) - min(ts) AS span
FROM (SELECT f.run_id, f.pos, f.nav, p.ts, max(f.nav) OVER (PARTITION BY f.run_id ORDER BY f.pos) AS peak FROM fam_nav f JOIN (SELECT DISTINCT pos, ts FROM panel_d) p ON p.pos = f.pos WHERE p.ts >= DATE '2000-03-01') GROUP BY 1""")


@query("v13_forward_evaluation", """SELECT run_id, n AS forward_days, round(r, 6) AS realized_return_pct, round(dd, 6) AS realized_max_drawdown_pct, round((greatest(1 + r / 100, 1e-9) ** (365.0 / span) - 1) * 100, 6) AS realized_annualized_pct,
CASE WHEN dd < -25 THEN 'DRAWDOWN_BREACH' WHEN n < 63 THEN 'TOO_EARLY' WHEN (greatest(1 + r / 100, 1e-9) ** (365.0 / span) - 1) * 100 < 0 THEN 'DIVERGING' ELSE 'TRACKING' END AS status FROM fwd_eval""")
def v13(spark, sf):
    panel, runs, w = PQ.family_weights(spark, sf)
    nav = PQ.replay(panel, w, runs)
    positions = runs.select("run_id", F.lit("2000-03-01").cast("date").alias("inception"), F.lit(5.0).alias("expected_annualized_pct"), F.lit(-25.0).alias("backtest_max_drawdown_pct"))
    out = Re.forward_evaluation(nav, positions).drop("inception", "expected_annualized_pct", "backtest_max_drawdown_pct")
    return rounded(out, 6, "realized_return_pct", "realized_max_drawdown_pct", "realized_annualized_pct")
