"""Queries on target weights, NAV replay and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.operators import asof as A
from barframe.operators import metrics as M
from barframe.operators import replay as R
from barframe.operators import validate as V
from barframe.operators import weights as Wt
from barframe.plans import tables as T
from barframe.plans.registry import cte, query, rounded, settled
from barframe.session import written

COST = R.COMMISSION + R.SLIPPAGE


def whole_span_runs(panel: DataFrame, *rows: tuple) -> DataFrame:
    """Runs over the whole calendar. Each row is run_id, family, lookback, top_k, rebalance,
    skip, hedge_weight and optionally the number of leading assets to use (all without it)."""
    span = panel.groupBy("universe_id").agg(
        F.min("pos").alias("pos0"),
        F.max("pos").alias("pos1"),
        F.array_sort(F.collect_set(F.struct("asset_ord", "asset"))).alias("_names"),
    )
    spec = F.array(*[
        F.struct(
            F.lit(r[0]).alias("run_id"), F.lit(r[1]).alias("family"), F.lit(r[2]).alias("lookback"),
            F.lit(r[3]).alias("top_k"), F.lit(r[4]).alias("rebalance"), F.lit(r[5]).alias("skip"),
            F.lit(r[6]).cast("double").alias("hedge_weight"),
            F.lit(r[7] if len(r) > 7 else None).cast("int").alias("_take"),
        )
        for r in rows
    ])
    return (
        span.select("*", F.inline(spec))
        .withColumn("assets", F.slice(F.col("_names.asset"), F.lit(1), F.coalesce("_take", F.size("_names"))))
        .select(*Wt.RUN_COLUMNS)
    )


def replay(panel: DataFrame, weights: DataFrame, runs: DataFrame) -> DataFrame:
    return R.replay_weights(R.run_bars(panel, runs), weights, COST)


def nav_report(panel: DataFrame, weights: DataFrame, runs: DataFrame, periods: int = M.REPLAY_YEAR) -> DataFrame:
    """Metrics of each run beside its benchmark, rounded."""
    nav = replay(panel, weights, runs)
    out = M.nav_metrics(nav, M.equal_weight_benchmark(panel, runs), R.INITIAL_CASH, periods=periods)
    return rounded(
        out, 6, "total_return_pct", "sharpe_ratio", "max_drawdown_pct", "exposure_pct", "benchmark_pct"
    ).withColumn("final_equity", F.round("final_equity", 4))


def flagship(spark, sf) -> DataFrame:
    """Cross-sectional momentum on the weekly panel: weights, NAV, metrics, benchmark."""
    panel = written(T.panel(spark, sf, "week"), "panel")
    runs = whole_span_runs(panel, ("momentum", "cross_sectional_momentum", 26, 2, 4, 0, None))
    weights = Wt.target_weights(Wt.running_sums(panel), runs)
    return nav_report(panel, weights, runs, 52)


# Sequential book keeping in SQL: cash and share counts, one row per bar.
def sequential_nav(prefix: str, panel: str, weights: str) -> None:
    """CTEs <prefix>_px, <prefix>_wt and <prefix>_nav for one panel and one weights CTE with
    run_id, exec_pos, asset_ord (0..4), weight."""
    cte(f"{prefix}_px", f"""SELECT pos, list(close ORDER BY asset_ord) AS px FROM {panel} GROUP BY pos""")
    cte(f"{prefix}_wt", f"""SELECT run_id, exec_pos AS pos, [
        coalesce(max(weight) FILTER (asset_ord = 0), 0), coalesce(max(weight) FILTER (asset_ord = 1), 0),
        coalesce(max(weight) FILTER (asset_ord = 2), 0), coalesce(max(weight) FILTER (asset_ord = 3), 0),
        coalesce(max(weight) FILTER (asset_ord = 4), 0)] AS w FROM {weights} GROUP BY 1, 2""")
    s = "list_sum([abs(w[i] * {x} - q[i] * px[i] / pre) for i in range(1, 6)])"
    body = f"""(run_id, pos, cash, q, nav, is_order, paid, traded, sells)
    SELECT DISTINCT run_id, -1, 10000.0::DOUBLE, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[], 10000.0::DOUBLE, false,
           0.0::DOUBLE, 0.0::DOUBLE, 0 FROM {prefix}_wt
    UNION ALL
    SELECT run_id, pos,
      CASE WHEN w IS NULL THEN cash ELSE pre * x6 * (1 - list_sum(w)) END,
      CASE WHEN w IS NULL THEN q ELSE [w[i] * pre * x6 / px[i] for i in range(1, 6)] END,
      CASE WHEN w IS NULL THEN pre ELSE pre * x6 END, w IS NOT NULL,
      CASE WHEN w IS NULL THEN 0.0 ELSE pre * (1 - x6) END,
      CASE WHEN w IS NULL THEN 0.0 ELSE pre * {s.format(x='x6')} END,
      CASE WHEN w IS NULL THEN 0 ELSE CAST(len([1 for i in range(1, 6)
           if w[i] * x6 < q[i] * px[i] / pre - 1e-12]) AS INTEGER) END
    FROM (SELECT *, 1 - 0.0015 * {s.format(x='x5')} AS x6 FROM (SELECT *, 1 - 0.0015 * {s.format(x='x4')} AS x5
     FROM (SELECT *, 1 - 0.0015 * {s.format(x='x3')} AS x4 FROM (SELECT *, 1 - 0.0015 * {s.format(x='x2')} AS x3
     FROM (SELECT *, 1 - 0.0015 * {s.format(x='x1')} AS x2 FROM (SELECT *, 1 - 0.0015 * {s.format(x='1.0')} AS x1
     FROM (SELECT n.run_id, p.pos, n.cash, n.q, p.px, o.w,
                  n.cash + list_sum([n.q[i] * p.px[i] for i in range(1, 6)]) AS pre
           FROM {prefix}_nav n JOIN {prefix}_px p ON p.pos = n.pos + 1
           LEFT JOIN {prefix}_wt o ON o.run_id = n.run_id AND o.pos = p.pos)))))))"""
    cte(f"{prefix}_nav", body)


cte("mom_w_wt", """
SELECT 'momentum' AS run_id, pos + 1 AS exec_pos, asset_ord, CASE WHEN rk <= 2 THEN 0.5 ELSE 0.0 END AS weight
FROM (
  SELECT c.pos, c.asset_ord,
         row_number() OVER (PARTITION BY c.pos ORDER BY c.close / b.close DESC, c.asset_ord) AS rk
  FROM panel_w c JOIN panel_w b ON b.asset = c.asset AND b.pos = c.pos - 26
  WHERE (c.pos - 26) % 4 = 0 AND c.pos < (SELECT max(pos) FROM panel_w))""")
sequential_nav("fl", "panel_w", "mom_w_wt")


def nav_metrics_sql(prefix: str, panel: str, periods: int) -> str:
    return f"""
WITH nv AS (SELECT *, coalesce(lag(nav) OVER (PARTITION BY run_id ORDER BY pos), 10000.0) AS prev,
              max(nav) OVER (PARTITION BY run_id ORDER BY pos) AS peak,
              1 - cash / nav AS exposure,
              len([1 for x in q if x > 0]) AS holdings FROM {prefix}_nav WHERE pos >= 0),
bench AS (SELECT (avg(g) - 1) * 100 AS of_all, (max(g) FILTER (asset_ord = 0) - 1) * 100 AS of_core FROM (
  SELECT asset_ord, arg_max(close, pos) / arg_min(close, pos) AS g FROM {panel} GROUP BY asset, asset_ord))
SELECT run_id, count(*) AS n_obs, (arg_max(nav, pos) / 10000 - 1) * 100 AS total_return_pct,
       avg(nav / prev - 1) / stddev_samp(nav / prev - 1) * sqrt({periods}) AS sharpe_ratio,
       min(nav / peak - 1) * 100 AS max_drawdown_pct, avg(exposure) * 100 AS exposure_pct,
       arg_max(nav, pos) AS final_equity, CAST(sum(sells) + arg_max(holdings, pos) AS BIGINT) AS num_trades,
       CAST(count(*) FILTER (is_order) AS BIGINT) AS rebalances, any_value(CASE WHEN run_id = 'f6' THEN of_core ELSE of_all END) AS benchmark_pct
FROM nv, bench GROUP BY run_id"""


def _metrics_rounded(inner: str) -> str:
    return f"""SELECT run_id, n_obs, round(total_return_pct, 6) AS total_return_pct,
    round(sharpe_ratio, 6) AS sharpe_ratio, round(max_drawdown_pct, 6) AS max_drawdown_pct,
    round(exposure_pct, 6) AS exposure_pct, round(final_equity, 4) AS final_equity, num_trades, rebalances,
    round(benchmark_pct, 6) AS benchmark_pct, total_return_pct > benchmark_pct AS beats_benchmark
    FROM ({inner.strip()})"""


query("f1_momentum_nav_metrics", _metrics_rounded(nav_metrics_sql("fl", "panel_w", 52)))(flagship)


# --- all weight families --------------------------------------------------------------------

FAMILY_RUNS = (
    ("f1", "cross_sectional_momentum", 126, 2, 21, 0, None),
    ("f2", "dual_momentum", 126, 2, 21, 0, None),
    ("f3", "equal_weight_trend", 100, 1, 21, 0, None),
    ("f4", "time_series_momentum", 126, 1, 21, 0, None),
    ("f5", "volatility_scaled_momentum", 126, 1, 21, 0, None),
    ("f6", "crisis_hedge", 100, 1, 21, 0, 0.3, 2),
    ("f7", "cross_sectional_reversal", 252, 2, 21, 63, None),
    ("f8", "fx_carry", 60, 2, 21, 0, None),
)


def rates_on_panel(spark, sf, panel):
    """What is known of each of the five monthly series on each panel date; the series stand
    for the five assets in order."""
    rates = T.rates(spark, sf)
    names = T.table(spark, sf, "orders").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("n"))
    order = names.select(F.posexplode("n").alias("asset_ord", "series_id"))  # five names
    wanted = panel.join(order, "asset_ord").select("series_id", "ts")
    return A.asof_values(rates, wanted, 60), order


def carry_for_panel(spark, sf, panel):
    """Carry of each asset: its series less the first series."""
    known, order = rates_on_panel(spark, sf, panel)
    assets = panel.filter("pos = 0").select("asset", "asset_ord")
    base = known.filter("series_id = '1-URGENT'").select("ts", F.col("known").alias("base"))
    carry = (
        known.join(order, "series_id").join(assets, "asset_ord").join(base, "ts")
        .select("asset", "ts", (F.col("known") - F.col("base")).alias("carry"))
    )
    return A.reindex_aux(carry, panel)


def family_weights(spark, sf, *ids):
    panel = written(T.panel(spark, sf), "panel")
    rows = [r for r in FAMILY_RUNS if not ids or r[0] in ids]
    carry = carry_for_panel(spark, sf, panel) if any(r[1] == "fx_carry" for r in rows) else None
    runs = whole_span_runs(panel, *rows)
    return panel, runs, Wt.target_weights(Wt.running_sums(panel, carry), runs)


def reb(lookback: int) -> str:
    return f"pos >= {lookback} AND (pos - {lookback}) % 21 = 0 AND pos < (SELECT max(pos) FROM panel_d)"


_AW = "PARTITION BY asset ORDER BY pos"
cte("pan_l", f"""SELECT *, close / lag(close, 126) OVER ({_AW}) - 1 AS m126,
  avg(close) OVER ({_AW} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS s100,
  lag(close, 63) OVER ({_AW}) / lag(close, 252) OVER ({_AW}) - 1 AS rev,
  stddev_pop(r) OVER ({_AW} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS vol60
FROM (SELECT *, close / lag(close) OVER ({_AW}) - 1 AS r FROM panel_d)""")
cte("rates_asof", """SELECT d.series_id, d.ts, r.value AS known FROM
  (SELECT DISTINCT series_id, ts FROM rates, (SELECT DISTINCT ts FROM panel_d)) d
  ASOF LEFT JOIN (SELECT series_id, obs_date + 60 AS avail, value FROM rates) r
  ON r.series_id = d.series_id AND d.ts >= r.avail""")
cte("carry_d", """SELECT p.*, k.known - b.known AS carry FROM panel_d p
  JOIN (SELECT *, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority < series_id) AS so FROM rates_asof) k
    ON k.so = p.asset_ord AND k.ts = p.ts JOIN rates_asof b ON b.series_id = '1-URGENT' AND b.ts = p.ts""")
_TOP = """SELECT '{id}' AS run_id, pos + 1 AS exec_pos, asset, asset_ord, CASE WHEN {elig} AND
  row_number() OVER (PARTITION BY pos ORDER BY CASE WHEN {elig} THEN {score} END {dir} NULLS LAST, asset_ord) <= 2
  THEN 0.5 ELSE 0.0 END AS weight FROM {src} WHERE {reb}"""
cte("wt_f1", _TOP.format(id="f1", elig="m126 IS NOT NULL", score="m126", dir="DESC", src="pan_l", reb=reb(126)))
cte("wt_f2", _TOP.format(id="f2", elig="m126 > 0", score="m126", dir="DESC", src="pan_l", reb=reb(126)))
cte("wt_f3", f"SELECT 'f3' AS run_id, pos + 1 AS exec_pos, asset, asset_ord, CASE WHEN close > s100 THEN 0.2 ELSE 0.0 END AS weight FROM pan_l WHERE {reb(100)}")
cte("wt_f4", f"SELECT 'f4' AS run_id, pos + 1 AS exec_pos, asset, asset_ord, CASE WHEN m126 > 0 THEN 0.2 ELSE 0.0 END AS weight FROM pan_l WHERE {reb(126)}")
cte("wt_f5", f"""SELECT 'f5' AS run_id, pos + 1 AS exec_pos, asset, asset_ord,
  coalesce(CASE WHEN m126 > 0 THEN 1 / vol60 END / sum(CASE WHEN m126 > 0 THEN 1 / vol60 END) OVER (PARTITION BY pos), 0) AS weight
  FROM pan_l WHERE {reb(126)}""")
cte("wt_f6", f"""SELECT 'f6' AS run_id, p.pos + 1 AS exec_pos, p.asset, p.asset_ord,
  CASE WHEN c.close > c.s100 THEN CASE WHEN p.asset_ord = 0 THEN 1.0 ELSE 0.0 END WHEN p.asset_ord = 1 THEN 0.3 ELSE 0.0 END AS weight
  FROM pan_l p JOIN pan_l c ON c.pos = p.pos AND c.asset_ord = 0 WHERE p.asset_ord < 2 AND {reb(100).replace('pos', 'p.pos').replace('max(p.pos)', 'max(pos)')}""")
cte("wt_f7", _TOP.format(id="f7", elig="rev IS NOT NULL", score="rev", dir="ASC", src="pan_l", reb=reb(252)))
cte("wt_f8", _TOP.format(id="f8", elig="mc IS NOT NULL", score="mc", dir="DESC", reb=reb(60), src=f"""
  (SELECT *, avg(carry) OVER ({_AW} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS mc FROM carry_d)"""))

_NAMES = {
    "f1": "f1_momentum_weights", "f2": "f2_dual_momentum_weights", "f3": "f3_equal_weight_trend_weights",
    "f4": "f4_time_series_momentum_weights", "f5": "f5_volatility_scaled_weights",
    "f6": "f6_crisis_hedge_weights", "f7": "f7_reversal_weights", "f8": "f8_carry_weights",
}


def _register(run: str, name: str) -> None:
    sql = f"""SELECT run_id, CAST(exec_pos AS INTEGER) AS exec_pos, asset, CAST(asset_ord AS INTEGER) AS asset_ord,
    round(CAST(weight AS DOUBLE), 8) AS weight FROM wt_{run}"""

    @query(name, sql)
    def weights(spark, sf):
        return rounded(family_weights(spark, sf, run)[2].drop("universe_id"), 8, "weight")


for _id, _name in _NAMES.items():
    _register(_id, _name)

cte("wt_all", " UNION ALL ".join(f"SELECT run_id, exec_pos, asset_ord, weight FROM wt_{i}" for i in _NAMES))
sequential_nav("fam", "panel_d", "wt_all")


@query("f11_all_families_in_one_batch", """SELECT run_id, count(*) AS n_rows, count(DISTINCT exec_pos) AS orders,
    round(sum(weight), 6) AS total_weight FROM wt_all GROUP BY 1""")
def f11(spark, sf):
    w = family_weights(spark, sf)[2]
    out = w.groupBy("run_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct("exec_pos").alias("orders"),
        F.sum("weight").alias("total_weight"))
    return rounded(out, 6, "total_weight")


@query("n_portfolio_nav", """SELECT run_id, CAST(pos AS INTEGER) AS pos, round(nav, 4) AS nav, is_order, round(paid, 4) AS cost_paid,
    round(traded, 4) AS traded, sells FROM fam_nav WHERE pos >= 0""")
def n_nav(spark, sf):
    panel, runs, w = family_weights(spark, sf)
    nav = replay(panel, w, runs)
    return rounded(
        nav.select("run_id", "pos", "nav", "is_order", "cost_paid", "traded", "sells"), 4, "nav", "cost_paid", "traded")


@query("a35_rebalance_count", """SELECT run_id, count(DISTINCT exec_pos) AS rebalances, count(DISTINCT exec_pos) >= 6 AS passed
    FROM wt_all GROUP BY 1""")
def a35(spark, sf):
    w = family_weights(spark, sf)[2].groupBy("run_id").agg(F.countDistinct("exec_pos").alias("rebalances"))
    return w.withColumn("passed", F.col("rebalances") >= 6)


@query("a4_equal_weight_benchmark", """SELECT round((avg(g) - 1) * 100, 6) AS benchmark_pct, round((max(g) FILTER (o = 0) - 1) * 100, 6) AS core_pct
FROM (SELECT asset_ord AS o, arg_max(close, pos) / arg_min(close, pos) AS g FROM panel_d GROUP BY 1)""")
def a4(spark, sf):
    panel = T.panel(spark, sf)
    runs = whole_span_runs(
        panel, ("all", "equal_weight_trend", 100, 1, 21, 0, None), ("core", "crisis_hedge", 100, 1, 21, 0, 0.3, 2))
    both = M.equal_weight_benchmark(panel, runs)
    out = both.agg(
        F.max(F.when(F.col("run_id") == "all", F.col("benchmark_pct"))).alias("benchmark_pct"),
        F.max(F.when(F.col("run_id") == "core", F.col("benchmark_pct"))).alias("core_pct"))
    return rounded(out, 6, "benchmark_pct", "core_pct")


# --- as-of joins, carry, macro --------------------------------------------------------------


@query("j2_asof_lagged_rates", "SELECT series_id, ts, round(known + 1e-7, 4) AS known FROM rates_asof")
def j2(spark, sf):
    return settled(rates_on_panel(spark, sf, T.panel(spark, sf))[0], 4, "known")


@query("j4_carry_differential", """SELECT k.series_id AS asset, k.ts, round(k.known - b.known + 1e-7, 4) AS carry
FROM rates_asof k JOIN rates_asof b ON b.ts = k.ts AND b.series_id = '5-LOW' WHERE k.series_id <> '5-LOW'""")
def j4(spark, sf):
    known = rates_on_panel(spark, sf, T.panel(spark, sf))[0]
    return settled(A.carry_panel(known, "5-LOW"), 4, "carry")


@query("j5_left_reindex", """SELECT p.asset, p.ts, p.pos, round(b.volume, 6) AS volume FROM panel_d p
LEFT JOIN (SELECT * FROM bars_d WHERE volume > 100) b ON b.asset = p.asset AND b.ts = p.ts""")
def j5(spark, sf):
    aux = T.bars(spark, sf, "day").filter("volume > 100")
    return A.reindex_aux(aux, T.panel(spark, sf), "volume").drop("universe_id")


cte("macro_d", """SELECT ts, pos, coalesce(known > lag(known, 63) OVER (ORDER BY ts), false) AS expansion FROM
  (SELECT r.ts, r.known, p.pos FROM rates_asof r JOIN (SELECT DISTINCT ts, pos FROM panel_d) p ON p.ts = r.ts
   WHERE series_id = '3-MEDIUM')""")
cte("wt_macro", """SELECT 'macro' AS run_id, m.pos + 1 AS exec_pos, p.asset, p.asset_ord,
  CASE WHEN m.expansion AND p.asset_ord < 4 THEN 0.25 WHEN NOT m.expansion AND p.asset_ord = 4 THEN 1.0 ELSE 0.0 END AS weight
  FROM macro_d m JOIN panel_d p ON p.pos = m.pos
  WHERE m.pos >= 63 AND (m.pos - 63) % 21 = 0 AND m.pos < (SELECT max(pos) FROM panel_d)""")
sequential_nav("mac", "panel_d", "wt_macro")


def macro_regime(spark, sf, panel):
    """Whether one monthly series rose over the last quarter, as known on each panel date."""
    series_one = T.rates(spark, sf).filter("series_id = '3-MEDIUM'")
    cal = panel.filter("asset_ord = 0").select("universe_id", "ts", "pos")
    known = A.asof_values(series_one, cal.select(F.lit("3-MEDIUM").alias("series_id"), "ts"), 60)
    return A.expansion_regime(known, 63).join(cal, "ts")


@query("j3_macro_regime", "SELECT ts, CAST(pos AS INTEGER) AS pos, expansion FROM macro_d")
def j3(spark, sf):
    return macro_regime(spark, sf, T.panel(spark, sf)).select("ts", "pos", "expansion")


def macro_weights(spark, sf):
    panel = written(T.panel(spark, sf), "panel")
    runs = whole_span_runs(panel, ("macro", "frozen_map", 63, 1, 21, 0, None))
    regime = macro_regime(spark, sf, panel)
    choice = (
        runs.select("run_id", "universe_id", "assets", F.explode(Wt.rebalance_positions(
            F.col("pos0"), F.col("pos1") - 1, F.col("lookback"), F.col("rebalance"))).alias("pos"))
        .join(regime.select("universe_id", "pos", "expansion"), ["universe_id", "pos"])
        .withColumn("state", F.when(F.col("expansion"), "expansion").otherwise("contraction"))
    )
    mapping = panel.filter("pos = 0").select(
        F.when(F.col("asset_ord") < 4, "expansion").otherwise("contraction").alias("state"), "asset")
    return panel, runs, Wt.mapped_weights(choice, mapping)


@query("f9_macro_regime_weights", """SELECT run_id, CAST(exec_pos AS INTEGER) AS exec_pos, asset, CAST(asset_ord AS INTEGER) AS asset_ord,
CAST(weight AS DOUBLE) AS weight FROM wt_macro""")
def f9(spark, sf):
    return macro_weights(spark, sf)[2].drop("universe_id")


@query("f9_macro_regime_metrics", _metrics_rounded(nav_metrics_sql("mac", "panel_d", 365)))
def f9_metrics(spark, sf):
    panel, runs, w = macro_weights(spark, sf)
    return nav_report(panel, w, runs)


@query("a5_portfolio_metrics", _metrics_rounded(nav_metrics_sql("fam", "panel_d", 365)))
def a5_portfolio(spark, sf):
    panel, runs, w = family_weights(spark, sf)
    return nav_report(panel, w, runs)


# --- combined book --------------------------------------------------------------------------

cte("comp_d", """SELECT pos, avg(close / c0) AS composite FROM (
  SELECT pos, asset_ord, close, first_value(close) OVER (PARTITION BY asset ORDER BY pos) AS c0 FROM panel_d) WHERE asset_ord < 3 GROUP BY pos""")
cte("wt_book", """SELECT run_id, pos + 1 AS exec_pos, asset_ord,
  CASE WHEN overlaid THEN CASE WHEN asset_ord < 3 THEN 0.7 / 3 ELSE 0.15 END WHEN asset_ord < 3 THEN 1.0 / 3 ELSE 0.0 END AS weight
FROM (SELECT v.run_id, c.pos, p.asset_ord, v.rule <> 'core' AND (v.rule = 'static' OR NOT c.composite > c.s) AS overlaid
  FROM (SELECT pos, composite, avg(composite) OVER (ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS s FROM comp_d) c,
       (VALUES ('regime/core', 'core'), ('regime/combined', 'regime'), ('static/core', 'core'), ('static/combined', 'static')) v(run_id, rule),
       (SELECT DISTINCT asset_ord FROM panel_d) p
  WHERE c.pos >= 100 AND (c.pos - 100) % 21 = 0 AND c.pos < (SELECT max(pos) FROM panel_d))""")
sequential_nav("book", "panel_d", "wt_book")
cte("book_m", """SELECT run_id, total_return_pct, sharpe_ratio, max_drawdown_pct FROM (
SELECT run_id, (arg_max(nav, pos) / 10000 - 1) * 100 AS total_return_pct,
  avg(nav / prev - 1) / stddev_samp(nav / prev - 1) * sqrt(365) AS sharpe_ratio, min(nav / peak - 1) * 100 AS max_drawdown_pct
FROM (SELECT *, coalesce(lag(nav) OVER (PARTITION BY run_id ORDER BY pos), 10000.0) AS prev,
  max(nav) OVER (PARTITION BY run_id ORDER BY pos) AS peak FROM book_nav WHERE pos >= 0) GROUP BY run_id)""")


def book_runs(spark, sf):
    """A regime and a static overlay book on the five assets: three core, two overlay."""
    panel = written(T.panel(spark, sf), "panel")
    base = whole_span_runs(panel, ("regime", "book", 100, 1, 21, 0, None), ("static", "book", 100, 1, 21, 0, None))
    books = base.select(
        "run_id", "universe_id", F.slice("assets", 1, 3).alias("core"), F.slice("assets", 4, 2).alias("overlay"),
        F.lit(0.3).alias("overlay_weight"), F.col("run_id").alias("rule"), "lookback", "rebalance", "pos0", "pos1")
    w = Wt.book_weights(Wt.running_sums(panel), books)
    return panel, base, w


def book_nav(spark, sf):
    panel, base, w = book_runs(spark, sf)
    bars = R.run_bars(panel, base).join(w.select("run_id", "variant").distinct(), "run_id")
    return R.replay_weights(bars, w, COST, run_keys=("run_id", "variant"))


@query("f10_combined_book_weights", """SELECT split_part(run_id, '/', 1) AS run_id, split_part(run_id, '/', 2) AS variant,
CAST(exec_pos AS INTEGER) AS exec_pos, CAST(asset_ord AS INTEGER) AS asset_ord, round(CAST(weight AS DOUBLE), 8) AS weight FROM wt_book""")
def f10(spark, sf):
    w = book_runs(spark, sf)[2]
    return rounded(w.select("run_id", "variant", "exec_pos", "asset_ord", "weight"), 8, "weight")


@query("a37_v12_book_comparison", """WITH j AS (SELECT split_part(c.run_id, '/', 1) AS run_id, c.total_return_pct AS ct, c.sharpe_ratio AS cs, c.max_drawdown_pct AS cd,
  b.total_return_pct AS bt, b.sharpe_ratio AS bs, b.max_drawdown_pct AS bd FROM book_m c JOIN book_m b
  ON c.run_id = split_part(b.run_id, '/', 1) || '/core' AND b.run_id LIKE '%/combined')
SELECT run_id, round(ct - bt, 6) AS return_cost_pct, round(bd - cd, 6) AS drawdown_improvement_pct,
  round(coalesce(bs, 0) - coalesce(cs, 0), 6) AS sharpe_delta, CASE WHEN coalesce(bs, 0) > coalesce(cs, 0) THEN 'IMPROVES_RISK_ADJUSTED'
  WHEN cd < 0 AND bd / cd <= 0.8 THEN 'REDUCES_DRAWDOWN_AT_COST' ELSE 'NOT_WORTH_IT' END AS verdict FROM j""")
def a37(spark, sf):
    m = M.equity_metrics(book_nav(spark, sf), R.INITIAL_CASH, ("run_id", "variant"), "pos", "nav", "exposure")
    return rounded(V.compare_books(m), 6, "return_cost_pct", "drawdown_improvement_pct", "sharpe_delta")
