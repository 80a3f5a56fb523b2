"""Queries on the research log, specifications and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.functions import normal as N
from barframe.functions import normal_sql as NS
from barframe.functions import scalars as Sc
from barframe.operators import log as L
from barframe.operators import log_index as Ix
from barframe.operators import rules as Ru
from barframe.operators import validate as V
from barframe.plans import tables as T
from barframe.plans.registry import cte, query, rounded
from barframe.session import work_path

_A = "['AAA', 'BBB', 'CCC', 'DDD', 'EEE']"
_FAM = "[" + ", ".join(f"'{f}'" for f in T.LOG_FAMILIES) + "]"
cte("rlog", f"""SELECT o_orderkey AS record_id, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS ts_text,
  CASE WHEN o_orderkey % 11 = 0 THEN 'stress' WHEN o_orderkey % 3 <> 0 THEN 'portfolio' ELSE 'explore' END AS mode, o_orderkey % 7 = 0 AS is_lockbox,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'PORTFOLIO[' || a1 || ',' || a2 || ']' ELSE a1 END AS asset, CASE WHEN o_orderkey % 3 <> 0 THEN [a1, a2] ELSE [a1] END AS assets,
  {_FAM}[o_orderkey % 8 + 1] AS family,
  CASE WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'ROBUST' ELSE 'FRAGILE' END WHEN o_orderstatus = 'F' THEN 'worth_paper_trading'
    WHEN o_orderstatus = 'O' THEN 'needs_more_testing' ELSE 'reject' END AS verdict,
  CASE WHEN o_orderkey % 10 = 0 THEN 'winner' WHEN o_orderkey % 5 = 0 THEN 'train_loser' END AS learning,
  [x for x in [CASE WHEN o_orderkey % 2 = 0 THEN 'Benchmark comparison' END, CASE WHEN o_custkey % 2 = 0 THEN 'Drawdown sanity' END,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Portfolio walk-forward stability' END] if x IS NOT NULL] AS failed,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 200000 - 1 END AS sharpe, o_totalprice / 5000 - 40 AS ret, o_totalprice / 5000 - 40 > 20 AS beats,
  CAST(-(o_custkey % 70) AS DOUBLE) AS dd, o_orderkey % 60 AS trades, CAST(o_orderdate AS DATE) - 1500 AS d0, CAST(o_orderdate AS DATE) + CAST(o_custkey % 500 AS INTEGER) AS d1,
  'S' || (o_custkey % 200) AS slate, 20 + (o_custkey % 4) * 21 AS lookback, 1 + o_orderkey % 2 AS top_k
FROM (SELECT *, {_A}[o_orderkey % 5 + 1] AS a1, {_A}[(o_orderkey + 1 + o_custkey % 4) % 5 + 1] AS a2 FROM orders)""")
_TRIAL = "NOT is_lockbox AND mode <> 'stress'"
_PTRIAL = "asset LIKE 'PORTFOLIO[%' AND NOT is_lockbox AND mode <> 'stress'"
_CONF = "is_lockbox AND verdict = 'worth_paper_trading'"
_DAYS = "greatest(2, CAST(round_even((d1 - d0) * 252 / 365.0, 0) AS INTEGER))"


def ppf_sql(p: str) -> str:
    return f"""(SELECT x0 - u / (1 + x0 * u / 2) FROM (SELECT x0, ({NS.cdf('x0')} - p0) * 2.5066282746310002 * exp(x0 * x0 / 2) AS u
      FROM (SELECT p0, {NS.ppf_start('p0')} AS x0 FROM (SELECT {p} AS p0))))"""


def threshold_sql(var: str, n: str) -> str:
    return f"""CASE WHEN {n} < 2 OR {var} <= 0 THEN 0.0 ELSE sqrt({var}) * ((1 - 0.5772156649015329) * {ppf_sql(f'1 - 1.0::DOUBLE / {n}')}
      + 0.5772156649015329 * {ppf_sql(f'1 - 1.0::DOUBLE / ({n} * 2.718281828459045)')}) END"""


def psr_sql(sharpe: str, n: str, thr: str) -> str:
    return f"(SELECT CASE WHEN {n} < 2 THEN 0.0 ELSE {NS.cdf('zz')} END FROM (SELECT ({sharpe} / sqrt(252) - {thr}) * sqrt({n} - 1) AS zz))"


def rlog(spark, sf):
    return T.research_log(spark, sf)


@query("a28_history_totals", f"""SELECT count(*) FILTER ({_TRIAL}) AS total_trials, count(*) FILTER (is_lockbox) AS lockbox_runs, count(*) FILTER (mode = 'stress') AS stress_runs,
count(*) FILTER (mode = 'stress' AND verdict = 'ROBUST') AS robust_stress_runs, min(ts_text) AS earliest_timestamp, max(ts_text) AS latest_timestamp FROM rlog""")
def a28(spark, sf):
    return L.history_totals(rlog(spark, sf))


@query("a28_k4_history_counts", f"""WITH t AS (SELECT * FROM rlog WHERE {_TRIAL})
SELECT 'asset' AS dimension, asset AS key, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'family', family, count(*) FROM t GROUP BY 2
UNION ALL SELECT 'verdict', verdict, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'learning_status', learning, count(*) FROM t WHERE learning IS NOT NULL GROUP BY 2
UNION ALL SELECT 'asset_family', asset || ' / ' || family, count(*) FROM t GROUP BY 2
UNION ALL SELECT 'failed_check', c, count(*) FROM (SELECT unnest(failed) AS c FROM t) GROUP BY 2""")
def a28b(spark, sf):
    return L.history_counts(rlog(spark, sf)).orderBy("dimension", F.desc("n"), "key")


@query("a28_passed_and_learning_runs", f"""SELECT record_id, 'passed' AS list FROM rlog WHERE {_TRIAL} AND verdict = 'worth_paper_trading'
UNION ALL SELECT record_id, 'learning' FROM rlog WHERE {_TRIAL} AND learning IS NOT NULL""")
def a28c(spark, sf):
    log = rlog(spark, sf)
    a = L.passed_runs(log).select("record_id", F.lit("passed").alias("list"))
    return a.unionByName(L.learning_runs(log).select("record_id", F.lit("learning").alias("list")))


@query("w30_recent_runs", "SELECT record_id, ts_text AS timestamp, mode, verdict FROM rlog ORDER BY ts_text DESC, record_id DESC LIMIT 20")
def w30(spark, sf):
    return L.recent_runs(rlog(spark, sf)).select("record_id", "timestamp", "mode", "verdict")


@query("p16_portfolio_trials", f"SELECT record_id, asset FROM rlog WHERE {_PTRIAL}")
def p16(spark, sf):
    return rlog(spark, sf).filter(L.is_trial()).select("record_id", "asset")


@query("a24_f2_deflated_threshold", f"""SELECT slate AS slate_id, n AS n_sharpes, round(v, 8) AS sharpe_variance, round({threshold_sql('v', 'n')}, 7) AS threshold
FROM (SELECT slate, count(sharpe) AS n, var_samp(sharpe / sqrt(252)) AS v FROM rlog GROUP BY 1)""")
def a24(spark, sf):
    out = L.sharpe_spread(rlog(spark, sf), ("slate_id",))
    return rounded(rounded(out, 8, "sharpe_variance"), 7, "threshold")


cte("dsr_rows", f"""SELECT r.*, s.n AS n_sharpes, CASE WHEN s.n >= 2 AND r.sharpe IS NOT NULL THEN {psr_sql('r.sharpe', _DAYS.replace('d1', 'r.d1').replace('d0', 'r.d0'), 's.thr')} END AS dsr
FROM rlog r JOIN (SELECT slate, n, {threshold_sql('v', 'n')} AS thr FROM (SELECT slate, count(sharpe) AS n, var_samp(sharpe / sqrt(252)) AS v FROM rlog GROUP BY 1)) s ON s.slate = r.slate""")


@query("a25_slate_deflated_sharpe", "SELECT record_id, slate AS slate_id, n_sharpes, round(dsr, 6) AS dsr, coalesce(dsr >= 0.95, false) AS dsr_passed FROM dsr_rows")
def a25(spark, sf):
    out = L.slate_dsr(rlog(spark, sf)).select("record_id", "slate_id", "n_sharpes", "dsr", "dsr_passed")
    return rounded(out, 6, "dsr")


@query("a23_probabilistic_sharpe", f"SELECT record_id, {_DAYS} AS n_obs, round({psr_sql('sharpe', _DAYS, '0.0')}, 6) AS psr FROM rlog WHERE sharpe IS NOT NULL")
def a23(spark, sf):
    log = rlog(spark, sf).filter("sharpe_ratio is not null")
    n = Sc.trading_days(F.col("start_date"), F.col("end_date"))
    out = log.select("record_id", n.alias("n_obs"), V.probabilistic_sharpe(F.col("sharpe_ratio"), n).alias("psr"))
    return rounded(out, 6, "psr")


@query("a26_sweep_deflated_sharpe", f"""WITH s AS (SELECT mode, family, count(sharpe) AS n, var_samp(sharpe / sqrt(252)) AS v, max(sharpe) FILTER (verdict = 'worth_paper_trading') AS best,
  max({_DAYS}) AS days FROM rlog GROUP BY 1, 2)
SELECT mode, family AS strategy_family, round(best, 6) AS best_sharpe, round({psr_sql('best', 'days', threshold_sql('v', 'n'))}, 6) AS sweep_dsr FROM s""")
def a26(spark, sf):
    log = rlog(spark, sf).withColumns({
        "ok": F.lit(True), "confirms": F.col("verdict") == L.CONFIRMED,
        "n_days": Sc.trading_days(F.col("start_date"), F.col("end_date"))})
    return rounded(L.sweep_dsr(log, ("mode", "strategy_family")), 6, "best_sharpe", "sweep_dsr")


cte("budget_all", f"SELECT count(sharpe) AS n, var_samp(sharpe / sqrt(252)) AS v FROM rlog WHERE {_PTRIAL}")
cte("budget_thr", f"SELECT {threshold_sql('v', 'n')} AS thr FROM budget_all")
cte("budget_cand", f"SELECT r.record_id, r.sharpe, {psr_sql('r.sharpe', _DAYS.replace('d1', 'r.d1').replace('d0', 'r.d0'), 't.thr')} AS dsr FROM rlog r, budget_thr t WHERE asset LIKE 'PORTFOLIO[%' AND {_CONF} AND sharpe IS NOT NULL")


@query("a27_budget_candidates", "SELECT record_id, round(sharpe, 6) AS sharpe_ratio, round(dsr, 6) AS cross_run_dsr, dsr >= 0.95 AS clears_bar FROM budget_cand")
def a27(spark, sf):
    out = L.budget_candidates(rlog(spark, sf)).select("record_id", "sharpe_ratio", "cross_run_dsr", "clears_bar")
    return rounded(out, 6, "sharpe_ratio", "cross_run_dsr")


@query("a27_trial_budget", f"""SELECT n_trials, n_lockbox, n_confirmed, round(best, 6) AS best_cross_run_dsr, CASE WHEN n_trials = 0 THEN 'NO_PORTFOLIO_RESEARCH_YET' WHEN n_confirmed = 0 THEN 'NOTHING_CONFIRMED'
  WHEN best >= 0.95 THEN 'SURVIVES_MULTIPLE_TESTING' ELSE 'CONFIRMED_BUT_NOT_AFTER_CORRECTION' END AS verdict
FROM (SELECT count(*) FILTER ({_PTRIAL}) AS n_trials, count(*) FILTER (asset LIKE 'PORTFOLIO[%' AND is_lockbox) AS n_lockbox,
  count(*) FILTER (asset LIKE 'PORTFOLIO[%' AND {_CONF}) AS n_confirmed FROM rlog), (SELECT max(dsr) AS best FROM budget_cand)""")
def a27b(spark, sf):
    return rounded(L.trial_budget(rlog(spark, sf)), 6, "best_cross_run_dsr")


@query("a29_slate_failure_tally", """SELECT slate AS slate_id, 'verdict' AS kind, verdict AS name, count(*) AS n FROM rlog GROUP BY 1, 2, 3
UNION ALL SELECT slate, 'failed_check', c, count(*) FROM (SELECT slate, unnest(failed) AS c FROM rlog) GROUP BY 1, 2, 3""")
def a29(spark, sf):
    return L.failure_tally(rlog(spark, sf)).orderBy("slate_id", "kind", F.desc("n"), "name")


@query("a30_campaign_summary", f"""SELECT asset, count(*) FILTER (NOT is_lockbox) AS trials, count(*) FILTER (is_lockbox) AS lockbox_runs,
count(*) FILTER (NOT is_lockbox AND verdict = 'worth_paper_trading') AS passes, count(*) FILTER ({_CONF}) AS lockbox_passes FROM rlog GROUP BY ROLLUP (asset)""")
def a30(spark, sf):
    return L.campaign_summary(rlog(spark, sf))


@query("a31_research_funnel", f"""SELECT count(*) FILTER ({_TRIAL}) AS tried, count(*) FILTER (is_lockbox) AS lockbox_tested, count(*) FILTER ({_CONF}) AS lockbox_confirmed,
count(*) FILTER (mode = 'stress' AND verdict = 'ROBUST') AS robust_after_stress, (SELECT count(*) FROM customer) AS paper_traded FROM rlog""")
def a31(spark, sf):
    return L.research_funnel(rlog(spark, sf), T.paper_positions(spark, sf))


@query("k2_slate_winner", """SELECT slate AS slate_id, record_id AS winner, round(sharpe, 6) AS sharpe_ratio, round(ret, 6) AS total_return_pct,
CASE WHEN beats THEN 'highest_sharpe_among_benchmark_beaters' ELSE 'highest_sharpe_overall_no_benchmark_beaters' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY slate ORDER BY beats DESC, sharpe DESC NULLS LAST, ret DESC, record_id) AS rn FROM rlog) WHERE rn = 1""")
def k2(spark, sf):
    return rounded(L.slate_winner(rlog(spark, sf)), 6, "sharpe_ratio", "total_return_pct")


@query("k3_a42_top_per_family", """SELECT family AS strategy_family, record_id, rn AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY family ORDER BY sharpe DESC NULLS LAST, record_id) AS INTEGER) AS rn FROM rlog) WHERE rn <= 3""")
def k3(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("strategy_family").orderBy(F.desc_nulls_last("sharpe_ratio"), "record_id")
    ranked = rlog(spark, sf).select("strategy_family", "record_id", "sharpe_ratio").withColumn("rank", F.row_number().over(w))
    return ranked.filter("rank <= 3").drop("sharpe_ratio")


cte("win_slates", f"""SELECT slate, arg_max(record_id, (ts_text, -record_id)) FILTER ({_CONF}) AS record_id, min(d0) AS full_start, max(d1) AS full_end, max(ts_text) AS ts
FROM rlog WHERE mode = 'portfolio' GROUP BY 1 HAVING count(*) FILTER ({_CONF}) > 0""")


@query("j9_confirmed_winners", "SELECT w.slate AS slate_id, w.record_id, r.family AS strategy_family, w.full_start, w.full_end, w.ts AS timestamp FROM win_slates w JOIN rlog r ON r.record_id = w.record_id")
def j9(spark, sf):
    return L.confirmed_winners(rlog(spark, sf)).select("slate_id", "record_id", "strategy_family", "full_start", "full_end", "timestamp")


@query("v15_newer_winner", """SELECT slate AS slate_id, record_id, ts AS timestamp FROM (SELECT * FROM win_slates ORDER BY ts DESC, slate LIMIT 1)
WHERE ts > (SELECT strftime(DATE '2000-01-01' + CAST(max(c_custkey) % 90 AS INTEGER), '%Y-%m-%dT00:00:00Z') FROM customer WHERE c_custkey % 2 = 0)""")
def v15(spark, sf):
    books = T.paper_positions(spark, sf).filter("status = 'open'").agg(F.max("position_id").alias("m")).select(
        F.lit("open").alias("status"),
        F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("m") % 90).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'").alias("origin_timestamp"))
    return L.newer_winner(rlog(spark, sf), books).select("slate_id", "record_id", "timestamp")


cte("paper", f"""SELECT c_custkey AS position_id, CASE WHEN c_custkey % 9 < 8 THEN {_FAM}[c_custkey % 9 + 1] END AS family, [{_A}[c_custkey % 5 + 1], {_A}[(c_custkey + 1 + c_custkey % 4) % 5 + 1]] AS assets
FROM customer""")


@query("j10_matching_positions", "SELECT position_id, family AS strategy_family FROM paper p WHERE EXISTS (SELECT 1 FROM rlog r WHERE r.assets = p.assets AND r.family = p.family)")
def j10(spark, sf):
    return L.matching_positions(T.paper_positions(spark, sf), rlog(spark, sf)).select("position_id", "strategy_family")


_SEARCH = """WITH g AS (SELECT slate AS group_id, family || '|' || array_to_string(assets, ',') || '|' || lookback || '|' || top_k || '|21' AS strategy, family, assets, count(*) AS n_records, max(ts_text) AS latest
  FROM rlog GROUP BY slate, family, assets, lookback, top_k)
SELECT group_id, strategy, CAST(CASE WHEN len(assets) = 2 THEN 1000 ELSE 0 END + CASE WHEN contains('portfolio[' || lower(array_to_string(assets, ',')) || ']', 'zzz') THEN 20 ELSE 0 END
  + CASE WHEN family = 'dual_momentum' THEN 10 + 50 ELSE 0 END AS INTEGER) AS score, n_records, latest
FROM g WHERE list_contains(assets, 'AAA') AND list_contains(assets, 'BBB')"""
_SEARCH_EXACT = """SELECT slate AS group_id, family || '|' || array_to_string(assets, ',') || '|' || lookback || '|' || top_k || '|21' AS strategy, 0 AS score, count(*) AS n_records, max(ts_text) AS latest
FROM rlog WHERE slate = 'S17' GROUP BY slate, family, assets, lookback, top_k"""


@query("v18_log_search", _SEARCH)
def v18(spark, sf):
    return L.search(rlog(spark, sf), "AAA BBB dual_momentum")


@query("v18_log_search_exact", _SEARCH_EXACT)
def v18b(spark, sf):
    return L.search(rlog(spark, sf), "s17")


def log_index(spark, sf):
    """The index of the log, appended in two parts, each indexed when it has landed."""
    log = rlog(spark, sf)
    landing, path, seen = work_path(spark, "log-landing"), work_path(spark, "log-index"), work_path(spark, "log-index-state")
    late = F.pmod(F.xxhash64("record_id"), F.lit(4)) == 0
    for part in (~late, late):
        log.filter(part).write.mode("append").parquet(landing)
        Ix.extend(spark.readStream.schema(log.schema).parquet(landing), path, seen)
    return path


@query("v18_log_index_search", _SEARCH)
def v18_index(spark, sf):
    return Ix.search_index(spark, log_index(spark, sf), "AAA BBB dual_momentum")


@query("v18_log_index_search_exact", _SEARCH_EXACT)
def v18_index_exact(spark, sf):
    return Ix.search_index(spark, log_index(spark, sf), "s17")


@query("p13_research_verdict", """SELECT record_id, CASE WHEN record_id % 17 = 0 THEN 'error' WHEN record_id % 19 = 0 THEN 'reject' WHEN ret < 0 OR dd <= -50 OR trades < 10 THEN 'reject'
  WHEN strong AND list_contains(failed, 'Portfolio walk-forward stability') THEN 'needs_more_testing' WHEN strong THEN 'worth_paper_trading' ELSE 'needs_more_testing' END AS verdict
FROM (SELECT *, ret > 0 AND beats AND trades >= 20 AND dd > -50 AND 5 - len(failed) > 2.5 AS strong FROM rlog)""")
def p13(spark, sf):
    log = rlog(spark, sf).withColumns({
        "n_checks": F.lit(5), "n_passed": 5 - F.size("failed_checks"),
        "walk_forward_failed": F.array_contains("failed_checks", "Portfolio walk-forward stability")})
    key = F.col("record_id")
    return log.select("record_id", V.research_verdict(key % 17 == 0, key % 19 != 0, F.lit(True)).alias("verdict"))


@query("a44_metric_checks", f"""SELECT record_id, unnest([{{'test_name': 'Minimum trade count', 'passed': trades >= 20}}, {{'test_name': 'Benchmark comparison', 'passed': ret > 20}},
  {{'test_name': 'Positive return', 'passed': ret > 0}}, {{'test_name': 'Drawdown sanity', 'passed': dd > -50}},
  {{'test_name': 'Sharpe ratio significance (PSR)', 'passed': coalesce({psr_sql('sharpe', _DAYS, '0.0')} >= 0.95, false)}}], recursive := true) FROM rlog""")
def a44(spark, sf):
    log = rlog(spark, sf).withColumn("n_days", Sc.trading_days(F.col("start_date"), F.col("end_date")))
    return V.metric_checks(log, "buy_and_hold_pct", ("record_id",), 20)


@query("p14_forward_status", """SELECT record_id, CASE WHEN dd < -45 THEN 'DRAWDOWN_BREACH' WHEN trades < 63 - 40 THEN 'TOO_EARLY' WHEN sharpe < 0 AND ret > 0 THEN 'DIVERGING' ELSE 'TRACKING' END AS status FROM rlog""")
def p14(spark, sf):
    return rlog(spark, sf).select("record_id", V.forward_status(
        F.col("num_trades") + 40, F.col("sharpe_ratio"), F.col("total_return_pct"), F.col("max_drawdown_pct"), F.lit(-45.0)).alias("status"))


@query("p17_sweep_filter", "SELECT record_id, round(ret - 20, 6) AS excess_pct, trades AS num_trades FROM rlog WHERE ret - 20 > 0 AND sharpe > 1.15 AND trades >= 20")
def p17(spark, sf):
    keep = Ru.sweep_qualifies(F.col("total_return_pct") - F.col("buy_and_hold_pct"), F.col("sharpe_ratio"), F.col("num_trades"), 1.15, 20)
    out = rlog(spark, sf).filter(keep).select("record_id", (F.col("total_return_pct") - F.col("buy_and_hold_pct")).alias("excess_pct"), "num_trades")
    return rounded(out, 6, "excess_pct")


@query("a41_pass_rates", """SELECT CASE WHEN grouping(family) = 0 THEN 'category' ELSE 'period' END AS dimension, coalesce(family, CAST(yr AS VARCHAR)) AS key, count(*) AS n, count(*) FILTER (ret - 20 > 0) AS passes
FROM (SELECT *, year(d0) AS yr FROM rlog WHERE is_lockbox) GROUP BY GROUPING SETS ((family), (yr))""")
def a41(spark, sf):
    log = rlog(spark, sf).filter(L.is_lockbox()).withColumn("period", F.year("start_date").cast("string"))
    fam, per = F.col("strategy_family"), F.col("period")
    out = log.groupingSets([[fam], [per]], fam, per).agg(
        F.grouping(fam).alias("_g"), F.count("*").alias("n"), F.count_if(F.col("total_return_pct") - F.col("buy_and_hold_pct") > 0).alias("passes"))
    return out.select(F.when(F.col("_g") == 0, "category").otherwise("period").alias("dimension"), F.coalesce(fam, per).alias("key"), "n", "passes")


@query("a41_traps", "SELECT record_id FROM rlog WHERE is_lockbox AND ret - 20 < 0 AND sharpe > 0.2")
def a41b(spark, sf):
    return rlog(spark, sf).filter(L.is_lockbox() & (F.col("total_return_pct") < F.col("buy_and_hold_pct")) & (F.col("sharpe_ratio") > 0.2)).select("record_id")


# --- specification rules over parts ---------------------------------------------------------

_P = "p_partkey"
cte("s_specs", f"""SELECT {_P} AS spec_id, ['sma_crossover', 'donchian_breakout', 'rsi_mean_reversion', 'filtered_donchian_breakout', 'filtered_rsi_mean_reversion'][{_P} % 5 + 1] AS family,
  CASE WHEN {_P} % 11 <> 0 THEN p_size END AS fast_window, p_size + {_P} % 330 - 20 AS slow_window, {_P} % 320 AS entry_window, p_size AS exit_window, p_size % 20 AS rsi_window,
  CAST({_P} % 60 AS DOUBLE) AS oversold, CAST({_P} % 110 AS DOUBLE) AS exit_above, {_P} % 120 AS atr_window, CASE WHEN {_P} % 7 <> 0 THEN {_P} % 230 END AS atr_ma_window, {_P} % 350 AS regime_window FROM part""")


def strategy_specs(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    fams = F.array(*[F.lit(f) for f in (Ru.SMA, Ru.DONCHIAN, Ru.RSI, Ru.FILTERED_DONCHIAN, Ru.FILTERED_RSI)])
    return T.table(spark, sf, "part").select(
        key.alias("spec_id"), F.get(fams, (key % 5).cast("int")).alias("family"), F.when(key % 11 != 0, size).alias("fast_window"),
        (size + key % 330 - 20).alias("slow_window"), (key % 320).alias("entry_window"), size.alias("exit_window"), (size % 20).alias("rsi_window"),
        (key % 60).cast("double").alias("oversold"), (key % 110).cast("double").alias("exit_above"), (key % 120).alias("atr_window"),
        F.when(key % 7 != 0, key % 230).alias("atr_ma_window"), (key % 350).alias("regime_window"))


def problems_sql(*rules: tuple[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in rules)
    return f"array_to_string([x for x in [{items}] if x IS NOT NULL], '; ')"


_CH = "family IN ('donchian_breakout', 'filtered_donchian_breakout')"
_RS = "family IN ('rsi_mean_reversion', 'filtered_rsi_mean_reversion')"
_AT = "family IN ('filtered_donchian_breakout', 'filtered_rsi_mean_reversion')"


@query("p9_strategy_rules", "SELECT spec_id, " + problems_sql(
    ("family = 'sma_crossover' AND (fast_window IS NULL OR slow_window IS NULL)", "fast_window and slow_window are required"),
    ("family = 'sma_crossover' AND fast_window <= 1", "fast_window must be > 1"),
    ("family = 'sma_crossover' AND slow_window <= fast_window", "slow_window must be greater than fast_window"),
    ("family = 'sma_crossover' AND slow_window > 300", "slow_window must be <= 300"),
    (f"{_CH} AND (entry_window IS NULL OR exit_window IS NULL)", "entry_window and exit_window are required"),
    (f"{_CH} AND entry_window < 5", "entry_window must be >= 5"), (f"{_CH} AND exit_window < 2", "exit_window must be >= 2"),
    (f"{_CH} AND (entry_window > 300 OR exit_window > 300)", "channel windows must be <= 300"),
    ("family = 'filtered_donchian_breakout' AND regime_window IS NULL", "regime_window is required"),
    ("family = 'filtered_donchian_breakout' AND regime_window NOT BETWEEN 20 AND 300", "regime_window must be between 20 and 300"),
    (f"{_RS} AND (rsi_window IS NULL OR oversold IS NULL OR exit_above IS NULL)", "rsi_window and both thresholds are required"),
    (f"{_RS} AND rsi_window < 2", "rsi_window must be >= 2"), (f"{_RS} AND oversold >= exit_above", "oversold must be lower than exit_above"),
    (f"{_RS} AND oversold < 5", "oversold must be >= 5"), (f"{_RS} AND exit_above > 95", "exit_above must be <= 95"),
    (f"{_AT} AND (atr_window IS NULL OR atr_ma_window IS NULL)", "atr_window and atr_ma_window are required"),
    (f"{_AT} AND atr_window NOT BETWEEN 2 AND 100", "atr_window must be between 2 and 100"),
    (f"{_AT} AND atr_ma_window NOT BETWEEN 2 AND 200", "atr_ma_window must be between 2 and 200"),
) + " AS problems FROM s_specs")
def p9(spark, sf):
    return strategy_specs(spark, sf).select("spec_id", F.array_join(Ru.strategy_problems(), "; ").alias("problems"))


cte("p_specs", f"""SELECT {_P} AS spec_id, {_FAM}[{_P} % 8 + 1] AS family, CASE {_P} % 4 WHEN 0 THEN ['SPY', 'TLT', 'spy '] WHEN 1 THEN ['SPY', 'TLT', 'GLD'] WHEN 2 THEN ['SPY', ' spy', ''] ELSE ['SPY', 'GLD'] END AS assets,
  p_size * 30 - 20 AS lookback, {_P} % 5 AS top_k, {_P} % 270 AS rebalance, {_P} % 900 - 50 AS skip, CASE WHEN {_P} % 3 <> 0 THEN CAST(p_size AS DOUBLE) / 60 END AS hedge_weight FROM part""")
cte("p_specs_n", "SELECT *, (SELECT count(DISTINCT lower(trim(a))) FROM (SELECT unnest(assets) AS a) WHERE trim(a) <> '') AS n FROM p_specs")


def portfolio_specs(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    fams = F.array(*[F.lit(f) for f in T.LOG_FAMILIES])
    lists = [("SPY", "TLT", "spy "), ("SPY", "TLT", "GLD"), ("SPY", " spy", ""), ("SPY", "GLD")]
    assets = F.get(F.array(*[F.array(*[F.lit(a) for a in x]) for x in lists]), (key % 4).cast("int"))
    return T.table(spark, sf, "part").select(
        key.alias("spec_id"), F.get(fams, (key % 8).cast("int")).alias("family"), assets.alias("assets"), (size * 30 - 20).alias("lookback"),
        (key % 5).alias("top_k"), (key % 270).alias("rebalance"), (key % 900 - 50).alias("skip"),
        F.when(key % 3 != 0, size.cast("double") / 60).alias("hedge_weight"))


_RK = "family IN ('cross_sectional_momentum', 'dual_momentum', 'cross_sectional_reversal', 'fx_carry')"


@query("p10_portfolio_rules", "SELECT spec_id, " + problems_sql(
    ("n < 2", "at least 2 distinct assets are required"), ("lookback < 20", "lookback must be >= 20"), ("lookback > 1260", "lookback must be <= 1260"),
    ("rebalance < 1", "rebalance must be >= 1"), ("rebalance > 252", "rebalance must be <= 252"), (f"{_RK} AND top_k < 1", "top_k must be >= 1"),
    (f"{_RK} AND top_k > n", "top_k cannot exceed the number of assets"), ("family = 'cross_sectional_reversal' AND skip < 0", "skip must be >= 0"),
    ("family = 'cross_sectional_reversal' AND skip >= lookback", "skip must be < lookback"), ("family = 'crisis_hedge' AND n <> 2", "exactly 2 assets are required: core and hedge"),
    ("family = 'crisis_hedge' AND hedge_weight IS NULL", "hedge_weight is required"),
    ("family = 'crisis_hedge' AND (hedge_weight <= 0 OR hedge_weight > 0.5)", "hedge_weight must be in (0, 0.5]"),
) + " AS problems FROM p_specs_n")
def p10(spark, sf):
    return portfolio_specs(spark, sf).select("spec_id", F.array_join(Ru.portfolio_problems(), "; ").alias("problems"))


@query("p6_asset_dedupe", """SELECT p_partkey, (SELECT string_agg(t, ',' ORDER BY i) FROM (SELECT t, i, row_number() OVER (PARTITION BY lower(t) ORDER BY i) AS rn
  FROM (SELECT trim(unnest(x)) AS t, generate_subscripts(x, 1) AS i) WHERE t <> '') WHERE rn = 1) AS assets
FROM (SELECT p_partkey, [p_brand, lower(p_brand), ' ' || p_type || ' ', p_type, '', p_name] AS x FROM part)""")
def p6(spark, sf):
    x = F.array("p_brand", F.lower("p_brand"), F.concat(F.lit(" "), "p_type", F.lit(" ")), "p_type", F.lit(""), "p_name")
    return T.table(spark, sf, "part").select("p_partkey", F.array_join(Sc.dedupe_assets(x), ",").alias("assets"))


@query("p11_j15_book_rules", "WITH b AS (SELECT p_partkey AS spec_id, CASE p_partkey % 3 WHEN 0 THEN ['SPY', 'QQQ'] WHEN 1 THEN ['', ' '] ELSE ['SPY'] END AS core, CASE p_partkey % 4 WHEN 0 THEN ['GLD', 'spy'] WHEN 1 THEN ['TLT'] ELSE ['VIXY', 'GLD'] END AS overlay, p_size / 80 AS ow, p_size * 12 AS lookback, p_partkey % 260 AS rebalance FROM part) SELECT spec_id, " + problems_sql(
    ("spec_id % 3 = 1", "core must contain at least one asset"), ("len(overlay) = 0", "overlay must contain at least one asset"),
    ("list_has_any([lower(trim(x)) for x in core if trim(x) <> ''''], [lower(x) for x in overlay])".replace("''''", "''"), "core and overlay must be disjoint"),
    ("ow <= 0 OR ow > 0.5", "overlay_weight must be in (0, 0.5]"), ("lookback NOT BETWEEN 20 AND 504", "lookback must be between 20 and 504"),
    ("rebalance NOT BETWEEN 1 AND 252", "rebalance must be between 1 and 252"),
) + " AS problems FROM b")
def p11(spark, sf):
    key = F.col("p_partkey")

    def pick(n, *lists):
        return F.get(F.array(*[F.array(*[F.lit(a) for a in x]) for x in lists]), (key % n).cast("int"))

    books = T.table(spark, sf, "part").select(
        key.alias("spec_id"), pick(3, ("SPY", "QQQ"), ("", " "), ("SPY",)).alias("core"), pick(4, ("GLD", "spy"), ("TLT",), ("VIXY", "GLD"), ("VIXY", "GLD")).alias("overlay"),
        (F.col("p_size") / 80).alias("overlay_weight"), (F.col("p_size") * 12).alias("lookback"), (key % 260).alias("rebalance"))
    return books.select("spec_id", F.array_join(Ru.book_problems(), "; ").alias("problems"))


@query("p12_critique", """WITH c AS (SELECT o_orderkey AS spec_id, CASE WHEN o_orderkey % 29 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS sd, strftime(o_orderdate + INTERVAL 1 DAY * (o_custkey - 100), '%Y-%m-%d') AS ed,
  CASE WHEN o_orderkey % 7 = 0 THEN 'BTC-USD' WHEN o_orderkey % 23 = 0 THEN '' ELSE 'SPY' END AS asset, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE (o_custkey % 20 - 1) / 1000 END AS comm,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Best rule with guaranteed drawdown' ELSE 'trend' END AS req, CASE WHEN o_orderkey % 37 = 0 THEN '4h' ELSE '1d' END AS tf FROM orders)
SELECT spec_id, """ + problems_sql(("try_cast(sd AS DATE) IS NULL OR try_cast(ed AS DATE) IS NULL", "invalid ISO date"), ("try_cast(ed AS DATE) <= try_cast(sd AS DATE)", "end date must be after start date"),
    ("tf <> '1d'", "only daily timeframe 1d is supported"), ("comm IS NULL OR comm < 0", "commission must be present and non-negative"), ("asset = ''''".replace("''''", "''"), "asset must be present")) + " AS problems, " + problems_sql(
    ("asset LIKE 'BTC%'", "asset appears to be crypto"), ("try_cast(ed AS DATE) - try_cast(sd AS DATE) < 365 * 3", "backtest period is less than 3 years"),
    ("req LIKE 'Best%'", "drawdown cannot be guaranteed"), ("req LIKE 'Best%'", "outcome-seeking language without criteria")) + " AS warnings FROM c")
def p12(spark, sf):
    key, cust, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    specs = T.table(spark, sf, "orders").select(
        key.alias("spec_id"), F.when(key % 29 == 0, "soon").otherwise(day.cast("string")).alias("start_date"),
        F.date_add(day, (cust - 100).cast("int")).cast("string").alias("end_date"),
        F.when(key % 7 == 0, "BTC-USD").when(key % 23 == 0, "").otherwise("SPY").alias("asset"),
        F.when(key % 31 != 0, (cust % 20 - 1) / 1000).alias("commission_pct"), F.lit(0.0005).alias("slippage_pct"),
        F.when(key % 5 == 0, "Best rule with guaranteed drawdown").otherwise("trend").alias("user_request"),
        F.when(key % 37 == 0, "4h").otherwise("1d").alias("timeframe"), F.lit("h").alias("hypothesis"))
    return specs.select("spec_id", F.array_join(Ru.critique_problems(), "; ").alias("problems"), F.array_join(Ru.critique_warnings(), "; ").alias("warnings"))


# --- scalar functions -----------------------------------------------------------------------

cte("spans", "SELECT o_custkey AS custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b, 0.15::DOUBLE + 0.05::DOUBLE * (o_custkey % 4) AS pct FROM orders GROUP BY 1")
_LB = "greatest(1, CAST(round_even((b - a) * CAST(pct AS DOUBLE), 0) AS INTEGER))"


def spans(spark, sf):
    return T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")
    ).withColumn("pct", (0.15 + 0.05 * (F.col("custkey") % 4)))


@query("p7_p8_lockbox_split", f"""SELECT custkey, CASE WHEN b - a >= 2 AND {_LB} < b - a THEN b - {_LB} - 1 END AS train_end, CASE WHEN b - a >= 2 AND {_LB} < b - a THEN b - {_LB} END AS lockbox_start,
greatest(2, CAST(round_even((b - a) * 252 / 365.0, 0) AS INTEGER)) AS trading_days FROM spans""")
def p7(spark, sf):
    df = spans(spark, sf).withColumn("s", Sc.split_date_range(F.col("a"), F.col("b"), F.col("pct")))
    return df.select("custkey", F.col("s.train_end").alias("train_end"), F.col("s.lockbox_start").alias("lockbox_start"), Sc.trading_days(F.col("a"), F.col("b")).alias("trading_days"))


@query("a8_annualize", """SELECT custkey, CASE WHEN r < 1e6 THEN round(r, 4) END AS annualized_pct, CASE WHEN r >= 1e6 THEN round(ln(r), 6) END AS log_annualized
FROM (SELECT custkey, CASE WHEN b - a <= 0 THEN 0 ELSE (greatest(1 + (custkey % 300 - 120) / 100, 1e-9) ** (365.0 / (b - a)) - 1) * 100 END AS r FROM spans)""")
def a8(spark, sf):
    """All spans; where short ones give huge numbers their logarithms are compared."""
    df = spans(spark, sf).withColumn("r", Sc.annualize((F.col("custkey") % 300 - 120).cast("double"), F.datediff("b", "a")))
    huge = F.col("r") >= 1e6
    return df.select(
        "custkey", F.when(~huge, F.round("r", 4)).alias("annualized_pct"), F.when(huge, F.round(F.ln("r"), 6)).alias("log_annualized"))


@query("f1_f2_normal", f"""SELECT event_id, round({NS.cdf('z')}, 9) AS cdf, round({NS.two_sided_p('z')}, 9) AS tail, round({ppf_sql('p')}, 7) AS ppf
FROM (SELECT event_id, value / 20 - 3 AS z, (event_id % 997 + 1) / 999 AS p FROM events)""")
def f1f2(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", (F.col("value") / 20 - 3).alias("z"), ((F.col("event_id") % 997 + 1) / 999).alias("p"))
    out = e.select("event_id", N.norm_cdf(F.col("z")).alias("cdf"), N.two_sided_p(F.col("z")).alias("tail"), N.norm_ppf(F.col("p")).alias("ppf"))
    return rounded(rounded(out, 9, "cdf", "tail"), 7, "ppf")


@query("f3_f4_math", """SELECT event_id, greatest(-0.9, least(0.9, value / 50 - 1)) AS clipped, round(ln(value + 1), 9) AS log_value, round(sqrt(value), 9) AS root, round(value ** 1.5, 6) AS powered, sign(value - 40)::DOUBLE AS side FROM events""")
def f3(spark, sf):
    v = F.col("value")
    return T.table(spark, sf, "events").select(
        "event_id", F.greatest(F.lit(-0.9), F.least(F.lit(0.9), v / 50 - 1)).alias("clipped"), F.round(F.ln(v + 1), 9).alias("log_value"),
        F.round(F.sqrt(v), 9).alias("root"), F.round(F.pow(v, 1.5), 6).alias("powered"), F.signum(v - 40).alias("side"))


@query("f5_dates", """SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) + CAST(o_custkey % 40 AS INTEGER) AS shifted, CAST(epoch(o_orderdate) AS BIGINT) AS unix_s,
CAST(to_timestamp(epoch(o_orderdate)) AT TIME ZONE 'UTC' AS TIMESTAMP) AS from_s, epoch_ms(CAST(epoch(o_orderdate) * 1000 AS BIGINT)) AS from_ms FROM orders""")
def f5(spark, sf):
    ts = F.col("o_orderdate").cast("timestamp")
    secs = F.unix_timestamp(ts)
    return T.table(spark, sf, "orders").select(
        "o_orderkey", F.date_add(F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd")), (F.col("o_custkey") % 40).cast("int")).alias("shifted"),
        secs.alias("unix_s"), F.timestamp_seconds(secs).cast("timestamp_ntz").alias("from_s"), F.timestamp_millis(secs * 1000).cast("timestamp_ntz").alias("from_ms"))


@query("f6_f8_text_and_arrays", """SELECT record_id, array_to_string(assets, '+') AS parsed, len(list_distinct([t for t in regexp_extract_all(lower(slate || ' ' || asset || ' x'), '[a-z0-9_.-]+') if len(t) > 1])) AS n_tokens,
list_has_any(assets, ['AAA', 'CCC']) AS touches, len([x for x in assets if x <> 'AAA' AND x <> 'BBB']) AS n_other FROM rlog""")
def f6(spark, sf):
    log = rlog(spark, sf)
    toks = Sc.tokens(F.concat_ws(" ", "slate_id", "asset", F.lit("x")))
    two = F.array(F.lit("AAA"), F.lit("BBB"))
    return log.select(
        "record_id", F.array_join(Sc.assets_from_label(F.col("asset")), "+").alias("parsed"), F.size(F.array_distinct(toks)).cast("bigint").alias("n_tokens"),
        F.arrays_overlap("assets", F.array(F.lit("AAA"), F.lit("CCC"))).alias("touches"), F.size(F.array_except("assets", two)).cast("bigint").alias("n_other"))


@query("f7_f9_f10_json_map_parse", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 7.0) AS as_number, 126.0::DOUBLE AS lookback,
try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS parsed FROM events""")
def f7(spark, sf):
    e = T.table(spark, sf, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return e.select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"), Sc.map_number(F.col("m"), "k", 7.0).alias("as_number"), Sc.map_number(F.col("m"), "lookback", 126.0).alias("lookback"),
        Sc.safe_number(F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))).alias("parsed"))


@query("f11_u5_neighbours", """SELECT p_partkey, array_to_string(list_distinct([CAST(trunc(p_size * 0.8) AS INTEGER), CAST(trunc(p_size * 1.25) AS INTEGER)]).list_sort(), ',') AS around, CAST(round_even(p_size / 4, 0) AS INTEGER) AS quarter FROM part""")
def f11(spark, sf):
    return T.table(spark, sf, "part").select(
        "p_partkey", F.array_join(F.array_sort(Sc.neighbours(F.col("p_size"), (0.8, 1.25))), ",").alias("around"), Sc.round_int(F.col("p_size") / 4).alias("quarter"))
