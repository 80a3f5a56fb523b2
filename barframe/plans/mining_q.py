"""Queries on cross-asset scans and event strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.functions import normal_sql as NS
from barframe.operators import events as E
from barframe.operators import mining as Mi
from barframe.operators import signals as S
from barframe.plans import series_q  # noqa: F401  (defines zs_d)
from barframe.plans import tables as T
from barframe.plans.registry import cte, query, rounded
from barframe.session import written

cte("lag_list", "SELECT unnest([5, 10, 20, 40, 60]) AS lag")
cte("fwd_d", "SELECT asset, pos, asset_ord, close, lead(close, 20) OVER (PARTITION BY asset ORDER BY pos) / close - 1 AS fwd FROM panel_d")
cte("ll_pairs", """SELECT l.asset AS leader, f.asset AS follower, g.lag, l.pos, l.fwd AS x, f.fwd AS y,
  row_number() OVER (PARTITION BY l.asset, f.asset, g.lag ORDER BY l.pos) AS k, count(*) OVER (PARTITION BY l.asset, f.asset, g.lag) AS n
FROM fwd_d l, lag_list g, fwd_d f WHERE f.pos = l.pos + g.lag AND f.asset <> l.asset AND l.fwd IS NOT NULL AND f.fwd IS NOT NULL""")
cte("ll_stats", """SELECT leader, follower, lag, count(*) AS n_obs, corr(x, y) AS effect,
  coalesce(corr(x, y) FILTER (k <= n // 2), 0) AS train_score, coalesce(corr(x, y) FILTER (k > n // 2), 0) AS holdout_score
FROM ll_pairs GROUP BY 1, 2, 3 HAVING count(*) >= 80""")
_STABLE = "sign(effect) = sign(train_score) AND sign(effect) = sign(holdout_score) AND effect <> 0"
_SIGN_STAB = f"CASE WHEN {_STABLE} THEN least(1.0, least(abs(train_score), abs(holdout_score)) / greatest(abs(effect), 1e-12)) ELSE 0 END"
cte("ll_facts", f"""SELECT 'lead_lag' AS kind, leader, follower, lag AS lag_days, n_obs, 100 AS trials, effect, train_score, holdout_score, p AS p_value,
  least(1.0, p * 100) AS adjusted_p_value, abs(effect) * (0.5 + CASE WHEN {_STABLE} THEN least(abs(effect), abs(train_score), abs(holdout_score)) ELSE 0 END) AS score
FROM (SELECT *, {NS.two_sided_p('z')} AS p FROM (SELECT *, 0.5 * ln((1 + effect) / (1 - effect)) * sqrt(n_obs - 3) AS z FROM ll_stats WHERE abs(effect) >= 0.18))
WHERE least(1.0, p * 100) <= 0.25""")
cte("ev_marks", "SELECT asset, pos, CASE WHEN zscore >= 1 THEN 1 ELSE -1 END AS side FROM zs_d WHERE zscore >= 1 OR zscore <= -1")
cte("rg_marks", "SELECT asset, pos, CASE WHEN t > 0 THEN 1 ELSE -1 END AS side FROM (SELECT asset, pos, close / lag(close, 63) OVER (PARTITION BY asset ORDER BY pos) - 1 AS t FROM panel_d) WHERE t IS NOT NULL")
_SPREAD = """SELECT leader, follower, lag, count(*) FILTER (side > 0) AS n_up, count(*) FILTER (side < 0) AS n_down,
  avg(y) FILTER (side > 0) AS mean_up, avg(y) FILTER (side < 0) AS mean_down, var_samp(y) FILTER (side > 0) AS var_up, var_samp(y) FILTER (side < 0) AS var_down,
  coalesce((avg(y) FILTER (side > 0) - avg(y) FILTER (side < 0)) * 100, 0) AS effect,
  coalesce((avg(y) FILTER (side > 0 AND k <= n // 2) - avg(y) FILTER (side < 0 AND k <= n // 2)) * 100, 0) AS train_score,
  coalesce((avg(y) FILTER (side > 0 AND k > n // 2) - avg(y) FILTER (side < 0 AND k > n // 2)) * 100, 0) AS holdout_score
FROM (SELECT m.asset AS leader, f.asset AS follower, g.lag, m.side, f.fwd AS y, row_number() OVER (PARTITION BY m.asset, f.asset, g.lag ORDER BY m.pos) AS k,
  count(*) OVER (PARTITION BY m.asset, f.asset, g.lag) AS n
  FROM {marks} m, {lags} g, fwd_d f WHERE f.pos = m.pos + g.lag AND f.asset <> m.asset AND f.fwd IS NOT NULL)
GROUP BY 1, 2, 3 HAVING count(*) FILTER (side > 0) >= {least} AND count(*) FILTER (side < 0) >= {least}"""
cte("ev_stats", _SPREAD.format(marks="ev_marks", lags="lag_list", least=18))
cte("rg_stats", _SPREAD.format(marks="rg_marks", lags="(SELECT 0 AS lag)", least=40))
_WELCH = NS.two_sided_p("z")
_SP_FACTS = """SELECT '{kind}' AS kind, leader, follower, {lag} AS lag_days, n_up + n_down AS n_obs, {trials} AS trials, effect, train_score, holdout_score, p AS p_value,
  least(1.0, p * {trials}) AS adjusted_p_value, abs(effect) * (0.5 + {stab}) AS score
FROM (SELECT *, {welch} AS p FROM (SELECT *, (mean_up - mean_down) / sqrt(var_up / n_up + var_down / n_down) AS z FROM {src})) WHERE {cond}"""
cte("ev_facts", _SP_FACTS.format(kind="event_followthrough", lag="lag", trials=100, stab=_SIGN_STAB, welch=_WELCH, src="ev_stats", cond=f"abs(effect) >= 1.0 AND {_STABLE}"))
cte("rg_facts", _SP_FACTS.format(kind="regime_split", lag="CAST(NULL AS INTEGER)", trials=20, stab=_SIGN_STAB, welch=_WELCH, src="rg_stats", cond="abs(effect) >= 2.0 AND least(1.0, p * 20) <= 0.35"))
_RANK = """abs(score) * (1 + CASE WHEN score <> 0 AND sign(train_score) = sign(score) AND sign(holdout_score) = sign(score)
  THEN least(1.0, least(abs(train_score), abs(holdout_score)) / greatest(abs(score), 1e-12)) ELSE 0 END) * (1 + greatest(0, -ln(greatest(adjusted_p_value, 1e-12))) / 10)"""
_ORDER = "ORDER BY rank_score DESC, kind, leader, follower, lag_days LIMIT 12"
cte("all_facts", " UNION ALL ".join(f"SELECT * FROM (SELECT *, {_RANK} AS rank_score FROM {t} {_ORDER})" for t in ("ll_facts", "ev_facts", "rg_facts")))

def panel_table(spark, sf):
    """The panel written once: every scan reads it several times."""
    return written(T.panel(spark, sf), "panel")


_NUMS = ("effect", "train_score", "holdout_score")


def _r(names, places=6):
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


@query("a14_a18_lead_lag_correlation", f"SELECT leader, follower, CAST(lag AS INTEGER) AS lag_days, n_obs, {_r(_NUMS)} FROM ll_stats")
def a14(spark, sf):
    return rounded(Mi.lead_lag_stats(panel_table(spark, sf)).drop("universe_id", "n_assets"), 6, *_NUMS)


_FACT = "SELECT kind, leader, follower, CAST(lag_days AS INTEGER) AS lag_days, n_obs, CAST(trials AS INTEGER) AS trials, {nums} FROM {t}"
_FNUM = (*_NUMS, "p_value", "adjusted_p_value", "score")


def _facts(df):
    return rounded(df.drop("universe_id"), 6, *_FNUM)


@query("a19_lead_lag_facts", _FACT.format(nums=_r(_FNUM), t="ll_facts"))
def a19(spark, sf):
    return _facts(Mi.lead_lag_facts(panel_table(spark, sf)))


_STAT = ("mean_up", "mean_down", "var_up", "var_down", *_NUMS)


@query("a16_a17_event_spreads", f"SELECT leader, follower, CAST(lag AS INTEGER) AS lag_days, n_up, n_down, {_r(_STAT)} FROM ev_stats")
def a17(spark, sf):
    return rounded(Mi.event_stats(panel_table(spark, sf)).drop("universe_id", "n_assets"), 6, *_STAT)


@query("a20_event_facts", _FACT.format(nums=_r(_FNUM), t="ev_facts"))
def a20(spark, sf):
    return _facts(Mi.event_facts(panel_table(spark, sf)))


@query("a21_regime_spreads", f"SELECT leader, follower, n_up, n_down, {_r(_STAT)} FROM rg_stats")
def a21(spark, sf):
    return rounded(Mi.regime_stats(panel_table(spark, sf)).drop("universe_id", "n_assets"), 6, *_STAT)


@query("a21_regime_facts", _FACT.format(nums=_r(_FNUM), t="rg_facts"))
def a21b(spark, sf):
    return _facts(Mi.regime_facts(panel_table(spark, sf)))


@query("a22_k1_mined_facts", f"SELECT kind, leader, follower, CAST(lag_days AS INTEGER) AS lag_days, round(score, 6) AS score, round(rank_score, 6) AS rank_score FROM all_facts {_ORDER}")
def a22(spark, sf):
    out = Mi.mine(panel_table(spark, sf)).select("kind", "leader", "follower", "lag_days", "score", "rank_score")
    return rounded(out, 6, "score", "rank_score")


cte("cand", f"""SELECT leader || ' ' || direction || ' -> ' || follower || ' lag' || lag_days AS spec_id, leader, follower AS target, direction, lag_days AS lag, rs AS rank_score
FROM (SELECT leader, follower, lag_days, CASE WHEN train_score + holdout_score >= 0 THEN 'strength' ELSE 'weakness' END AS direction, max({_RANK}) AS rs
  FROM ev_facts GROUP BY 1, 2, 3, 4) ORDER BY rs DESC, leader, target, lag LIMIT 6""")


def slate(spark, sf, panel=None):
    panel = panel if panel is not None else panel_table(spark, sf)
    return Mi.candidate_specs(Mi.event_facts(panel), 6)


@query("a47_candidate_slate", "SELECT spec_id, leader, target, direction, CAST(lag AS INTEGER) AS lag, round(rank_score, 6) AS rank_score FROM cand")
def a47(spark, sf):
    return rounded(slate(spark, sf).select("spec_id", "leader", "target", "direction", "lag", "rank_score"), 6, "rank_score")


# --- event strategies -----------------------------------------------------------------------

# Fixed slate: every ordered neighbour pair of the five assets, both directions.
cte("ev_specs", """SELECT l.asset || '>' || t.asset || '/' || d.direction AS spec_id, l.asset AS leader, t.asset AS target, d.direction, 0.75::DOUBLE AS zt, 5 AS lag, 20 AS hold, 0.001::DOUBLE AS cost
FROM (SELECT DISTINCT asset, asset_ord FROM panel_d) l JOIN (SELECT DISTINCT asset, asset_ord FROM panel_d) t ON t.asset_ord = (l.asset_ord + 1) % 5,
(VALUES ('strength'), ('weakness')) d(direction)""")
cte("ev_events", """SELECT s.*, z.pos, coalesce(CASE WHEN direction = 'strength' THEN zscore >= zt ELSE zscore <= -zt END, false) AS ev
FROM ev_specs s JOIN zs_d z ON z.asset = s.leader""")
_DAILY = """SELECT *, coalesce(prev, 0) * ret - coalesce(abs(position - prev), 0) * cost AS strategy_ret FROM (
  SELECT *, lag(position) OVER (PARTITION BY spec_id ORDER BY pos) AS prev FROM (
  SELECT e.spec_id, e.pos, p.ts, e.cost, coalesce(p.close / lag(p.close) OVER (PARTITION BY e.spec_id ORDER BY e.pos) - 1, 0) AS ret,
    CASE WHEN EXISTS (SELECT 1 FROM {ev} x WHERE x.spec_id = e.spec_id AND x.ev AND x.pos <= e.pos - e.lag AND x.pos > e.pos - e.lag - e.hold) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS position
  FROM {ev} e JOIN panel_d p ON p.asset = e.target AND p.pos = e.pos))"""
cte("ev_daily", _DAILY.format(ev="ev_events"))
_METRICS = """SELECT spec_id, {seg} AS segment, (arg_max(eq, pos) - 1) * 100 AS total_return_pct, (arg_max(eq, pos) ** (252.0 / count(*)) - 1) * 100 AS annualized_return_pct,
  avg(strategy_ret) / nullif(stddev_samp(strategy_ret), 0) * sqrt(252) AS sharpe, min(eq / peak - 1) * 100 AS max_drawdown_pct,
  avg(CASE WHEN position > 0 THEN 1.0 ELSE 0.0 END) * 100 AS exposure_pct, CAST(count(*) FILTER (position > 0 AND coalesce(pp, 0) <= 0) AS BIGINT) AS num_entries,
  (arg_max(bh, pos) - 1) * 100 AS buy_hold_return_pct, (arg_max(bh, pos) ** (252.0 / count(*)) - 1) * 100 AS buy_hold_annualized_pct,
  avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS buy_hold_sharpe, min(bh / bpeak - 1) * 100 AS buy_hold_max_drawdown_pct,
  coalesce(avg(strategy_ret) / nullif(stddev_samp(strategy_ret), 0) * sqrt(252), -999) > avg(ret) / stddev_samp(ret) * sqrt(252) AS beats_buy_hold_sharpe
FROM (SELECT *, max(eq) OVER w AS peak, max(bh) OVER w AS bpeak, lag(position) OVER w AS pp
  FROM (SELECT *, product(1 + strategy_ret) OVER w AS eq, product(1 + ret) OVER w AS bh FROM {src} WINDOW w AS (PARTITION BY spec_id, {seg} ORDER BY pos))
  WINDOW w AS (PARTITION BY spec_id, {seg} ORDER BY pos)) GROUP BY 1, 2"""
SPLIT = "2000-01-01"
cte("ev_metrics", _METRICS.format(seg=f"CASE WHEN ts < DATE '{SPLIT}' THEN 'train' ELSE 'lockbox' END", src="ev_daily"))
_MET = ("total_return_pct", "annualized_return_pct", "sharpe", "max_drawdown_pct", "exposure_pct", "buy_hold_return_pct",
        "buy_hold_annualized_pct", "buy_hold_sharpe", "buy_hold_max_drawdown_pct")


def neighbour_specs(spark, sf, panel):
    names = panel.filter("pos = 0").select("universe_id", F.col("asset").alias("leader"), "asset_ord")
    other = names.select("universe_id", F.col("leader").alias("target"), ((F.col("asset_ord") + 4) % 5).alias("asset_ord"))
    both = names.join(other, ["universe_id", "asset_ord"]).withColumn("direction", F.explode(F.array(F.lit("strength"), F.lit("weakness"))))
    return both.select(
        F.concat("leader", F.lit(">"), "target", F.lit("/"), "direction").alias("spec_id"), "universe_id", "leader", "target", "direction",
        F.lit(0.75).alias("z_threshold"), F.lit(5).alias("lag"), F.lit(20).alias("hold"), F.lit(0.001).alias("cost"))


def event_setup(spark, sf):
    panel = panel_table(spark, sf)
    return panel, neighbour_specs(spark, sf, panel)


def by_segment(daily):
    return daily.withColumn("segment", F.when(F.col("ts") < F.lit(SPLIT).cast("date"), "train").otherwise("lockbox"))


@query("g29_w19_event_position", """SELECT asset, ts, CAST(CASE WHEN max(CASE WHEN zscore >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING) = 1 THEN 1 ELSE 0 END AS INTEGER) AS position FROM zs_d""")
def g29(spark, sf):
    from barframe.operators.indicators import with_event_zscore

    df = with_event_zscore(T.panel(spark, sf)).withColumn("event", F.col("zscore") >= 1)
    return df.select("asset", "ts", S.holding_from_events("event", 5, 20).alias("position"))


@query("v3_event_daily_returns", """SELECT spec_id, CAST(pos AS INTEGER) AS pos, position, round(ret, 8) AS ret, round(strategy_ret, 8) AS strategy_ret FROM ev_daily""")
def v3(spark, sf):
    daily = E.event_daily(*event_setup(spark, sf)).select("spec_id", "pos", "position", "ret", "strategy_ret")
    return rounded(daily, 8, "ret", "strategy_ret")


@query("a7_event_segment_metrics", "SELECT spec_id, segment, num_entries, beats_buy_hold_sharpe, " + _r(_MET) + " FROM ev_metrics")
def a7(spark, sf):
    m = E.daily_metrics(by_segment(E.event_daily(*event_setup(spark, sf))), ("spec_id", "segment"))
    return rounded(m, 6, *_MET)


_TRAIN_OK = "coalesce(total_return_pct > 0 AND coalesce(nullif(sharpe, 0), -999) >= 0.5 AND max_drawdown_pct > -75 AND num_entries >= 5, false)"
_BOX_OK = "coalesce(total_return_pct > 0 AND coalesce(nullif(sharpe, 0), -999) >= 0.8 AND beats_buy_hold_sharpe AND max_drawdown_pct > -50 AND num_entries >= 2, false)"


@query("p15_event_gates", f"SELECT spec_id, segment, {_TRAIN_OK} AS train_pass, {_BOX_OK} AS lockbox_pass FROM ev_metrics")
def p15(spark, sf):
    m = E.daily_metrics(by_segment(E.event_daily(*event_setup(spark, sf))), ("spec_id", "segment"))
    return m.select("spec_id", "segment", E.passes_train().alias("train_pass"), E.passes_lockbox().alias("lockbox_pass"))


cte("st_specs", """SELECT s.spec_id AS base_id, s.spec_id || ' lag=' || (s.lag + o.o) || ' hold=' || h.h || ' z=' || z.z AS spec_id, leader, target, direction, z.z AS zt, s.lag + o.o AS lag, h.h AS hold, cost
FROM ev_specs s, (VALUES (-20), (-10), (0), (10), (20)) o(o), (VALUES (10), (20), (40)) h(h), (VALUES (0.75::DOUBLE), (1.0), (1.25)) z(z) WHERE s.lag + o.o >= 1""")
cte("st_events", """SELECT s.*, z.pos, coalesce(CASE WHEN direction = 'strength' THEN zscore >= zt ELSE zscore <= -zt END, false) AS ev
FROM st_specs s JOIN zs_d z ON z.asset = s.leader""")
# Last event by running maximum instead of the EXISTS above, to keep the check quick.
cte("st_daily", f"""SELECT *, coalesce(prev, 0) * ret - coalesce(abs(position - prev), 0) * cost AS strategy_ret FROM (
  SELECT *, lag(position) OVER (PARTITION BY spec_id ORDER BY pos) AS prev FROM (
  SELECT e.spec_id, e.pos, p.ts, e.cost, coalesce(p.close / lag(p.close) OVER (PARTITION BY e.spec_id ORDER BY e.pos) - 1, 0) AS ret,
    CASE WHEN l.last_ev > e.pos - e.lag - e.hold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS position
  FROM st_events e JOIN panel_d p ON p.asset = e.target AND p.pos = e.pos
  LEFT JOIN (SELECT spec_id, pos, max(CASE WHEN ev THEN pos END) OVER (PARTITION BY spec_id ORDER BY pos) AS last_ev FROM st_events) l
    ON l.spec_id = e.spec_id AND l.pos = e.pos - e.lag))""")
cte("st_metrics", _METRICS.format(seg=f"CASE WHEN ts < DATE '{SPLIT}' THEN 'train' ELSE 'lockbox' END", src="st_daily"))


@query("a33_event_stress", f"""SELECT s.base_id, count(*) AS tested, CAST(sum(CASE WHEN {_BOX_OK} THEN 1 ELSE 0 END) AS BIGINT) AS passed,
round(avg(CASE WHEN {_BOX_OK} THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, CASE WHEN count(*) >= 6 AND avg(CASE WHEN {_BOX_OK} THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'ROBUST' ELSE 'FRAGILE' END AS verdict
FROM st_metrics m JOIN st_specs s ON s.spec_id = m.spec_id WHERE m.segment = 'lockbox' GROUP BY 1""")
def a33(spark, sf):
    panel, specs = event_setup(spark, sf)
    variants = E.stress_variants(specs)
    tail = E.event_daily(panel, variants).filter(F.col("ts") >= F.lit(SPLIT).cast("date"))
    return rounded(E.stress_verdict(E.daily_metrics(tail, ("spec_id",)), variants), 6, "pass_rate")


cte("lab_stress", f"""SELECT s.base_id AS spec_id, CASE WHEN count(*) >= 6 AND avg(CASE WHEN {_BOX_OK} THEN 1.0 ELSE 0.0 END) >= 0.5 THEN true ELSE false END AS robust,
  avg(CASE WHEN {_BOX_OK} THEN 1.0 ELSE 0.0 END) AS pass_rate FROM st_metrics m JOIN st_specs s ON s.spec_id = m.spec_id WHERE m.segment = 'lockbox' GROUP BY 1""")
cte("lab_gates", f"""SELECT t.spec_id, {_TRAIN_OK.replace('total_return_pct', 't.total_return_pct').replace('sharpe', 't.sharpe').replace('max_drawdown_pct', 't.max_drawdown_pct').replace('num_entries', 't.num_entries')} AS train_pass,
  b.ok AS lockbox_pass, b.sharpe, b.annualized_return_pct, s.pass_rate, s.robust AND b.ok AS robust_pass
FROM ev_metrics t JOIN (SELECT *, {_BOX_OK} AS ok FROM ev_metrics WHERE segment = 'lockbox') b ON b.spec_id = t.spec_id JOIN lab_stress s ON s.spec_id = t.spec_id WHERE t.segment = 'train'""")


@query("v11_event_lab")
def v11(spark, sf):
    """Mined on the train dates only, then scored on train, lockbox and stress."""
    panel = panel_table(spark, sf)
    split = F.lit(SPLIT).cast("date")
    specs = slate(spark, sf, panel.filter(F.col("ts") < split)).drop("rank_score")
    return E.lab(panel, specs, split)


@query("a45_learning_records", """SELECT spec_id, CASE WHEN train_pass AND robust_pass THEN 'winner' WHEN train_pass AND lockbox_pass THEN 'fragile_lockbox_survivor' WHEN lockbox_pass THEN 'fragile_lockbox_survivor' WHEN train_pass THEN 'lockbox_loser' ELSE 'train_loser' END AS learning_status,
(SELECT count(*) FROM lab_gates) AS candidates, (SELECT count(*) FROM lab_gates WHERE train_pass) AS train_survivors FROM lab_gates""")
def a45(spark, sf):
    panel, specs = event_setup(spark, sf)
    results = written(E.lab(panel, specs, F.lit(SPLIT).cast("date")), "lab")
    return E.learning_records(results, specs).select("spec_id", "learning_status", "candidates", "train_survivors")


@query("a45_learning_log_round_trip", f"""SELECT g.spec_id, s.leader, s.target, CAST(s.lag AS INTEGER) AS lag_days, s.zt AS z_threshold, round(g.sharpe, 6) AS lockbox_sharpe, round(g.pass_rate, 6) AS pass_rate,
  (SELECT count(*) FROM lab_gates) AS candidates, (SELECT count(*) FROM lab_gates WHERE train_pass) AS train_survivors,
  (SELECT strftime(max(ts), '%Y-%m-%d') FROM panel_d WHERE ts < DATE '{SPLIT}') AS train_end, (SELECT strftime(min(ts), '%Y-%m-%d') FROM panel_d) AS start_date
FROM lab_gates g JOIN ev_specs s ON s.spec_id = g.spec_id""")
def a45_log(spark, sf):
    """Whole learning records written as JSON lines, read back, stored, and read by their paths."""
    from barframe.session import work_path
    from barframe.sources import logs as Lg

    panel, specs = event_setup(spark, sf)
    split = F.lit(SPLIT).cast("date")
    results = written(E.lab(panel, specs, split), "lab")
    lines, table = work_path(spark, "learning-log"), work_path(spark, "learning-table")
    Lg.append_json(E.learning_log(results, specs, E.lab_context(panel, split)), lines)
    Lg.store_log(Lg.read_log(spark, lines), table)
    stored = spark.read.parquet(table).select(
        Lg.field("spec_id").alias("spec_id"), Lg.field("params.leader").alias("leader"), Lg.field("params.target").alias("target"),
        Lg.field("params.lag_days", "int").alias("lag_days"), Lg.field("params.z_threshold", "double").alias("z_threshold"),
        Lg.field("metrics.lockbox_sharpe", "double").alias("lockbox_sharpe"), Lg.field("stress_summary.pass_rate", "double").alias("pass_rate"),
        Lg.field("gate_denominators.candidates", "bigint").alias("candidates"),
        Lg.field("gate_denominators.train_survivors", "bigint").alias("train_survivors"),
        Lg.field("train_end").alias("train_end"), Lg.field("start_date").alias("start_date"))
    return rounded(stored, 6, "lockbox_sharpe", "pass_rate")


@query("a46_gate_funnel", """SELECT candidates, train_survivors, lockbox_survivors, robust_survivors, CASE WHEN candidates = 0 THEN 'REJECTED_NO_EVENT_CANDIDATES' WHEN train_survivors = 0 THEN 'REJECTED_NO_TRAIN_SURVIVORS'
  WHEN lockbox_survivors = 0 THEN 'REJECTED_NO_LOCKBOX_SURVIVORS' WHEN robust_survivors = 0 THEN 'REJECTED_FRAGILE_LOCKBOX_SURVIVORS' ELSE 'PAPER_TRADE_CANDIDATE' END AS verdict
FROM (SELECT count(*) AS candidates, count(*) FILTER (train_pass) AS train_survivors, count(*) FILTER (train_pass AND lockbox_pass) AS lockbox_survivors, count(*) FILTER (train_pass AND lockbox_pass AND robust_pass) AS robust_survivors FROM lab_gates)""")
def a46(spark, sf):
    panel, specs = event_setup(spark, sf)
    return E.funnel(E.lab(panel, specs, F.lit(SPLIT).cast("date")))


@query("k2b_lab_winner", "SELECT arg_max(spec_id, (pass_rate, coalesce(nullif(sharpe, 0), -999), annualized_return_pct)) FILTER (train_pass AND lockbox_pass AND robust_pass) AS winner FROM lab_gates")
def k2b(spark, sf):
    panel, specs = event_setup(spark, sf)
    return E.lab_winner(E.lab(panel, specs, F.lit(SPLIT).cast("date")))
