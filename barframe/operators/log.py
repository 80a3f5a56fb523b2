"""The research log: counts, budgets, winners, search.

A log group (slate, family, asset) may hold a large share of all rows, so everything here is an
aggregation with map-side partials; group members are never collected except as distinct names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.functions.normal import EULER_GAMMA, norm_ppf
from barframe.functions.scalars import TRADING_DAYS, tokens, trading_days
from barframe.functions.windows import Keys
from barframe.operators.validate import probabilistic_sharpe

CONFIRMED = "worth_paper_trading"
DSR_PASS = 0.95


def is_stress() -> Column:
    return F.coalesce(F.col("mode") == "stress", F.lit(False))


def is_lockbox() -> Column:
    return F.coalesce(F.col("is_lockbox"), F.lit(False))


def is_portfolio() -> Column:
    return F.coalesce(F.col("asset").startswith("PORTFOLIO["), F.lit(False))


def is_trial() -> Column:
    """A new portfolio hypothesis: neither a lockbox re-test nor a stress variant."""
    return is_portfolio() & ~is_lockbox() & ~is_stress()


def confirmed() -> Column:
    return is_lockbox() & F.coalesce(F.col("verdict") == CONFIRMED, F.lit(False))


def history_totals(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count_if(~is_lockbox() & ~is_stress()).alias("total_trials"),
        F.count_if(is_lockbox()).alias("lockbox_runs"),
        F.count_if(is_stress()).alias("stress_runs"),
        F.count_if(is_stress() & (F.col("verdict") == "ROBUST")).alias("robust_stress_runs"),
        F.min("timestamp").alias("earliest_timestamp"),
        F.max("timestamp").alias("latest_timestamp"),
    )


def history_counts(log: DataFrame) -> DataFrame:
    """dimension, key, n: trials by asset, family, verdict, learning status, asset and family
    (one grouping-sets pass) and by failed check."""
    trials = log.filter(~is_lockbox() & ~is_stress())
    names = {"asset": "asset", "family": "strategy_family", "verdict": "verdict"}
    base = trials.select(
        *[F.coalesce(F.col(c), F.lit("unknown")).alias(n) for n, c in names.items()],
        F.coalesce("learning_status", F.lit("")).alias("learning_status"),
    )
    cols = ["asset", "family", "verdict", "learning_status"]
    sets = [["asset"], ["family"], ["verdict"], ["learning_status"], ["asset", "family"]]
    grouped = base.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]
    ).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
    which = {0b0111: "asset", 0b1011: "family", 0b1101: "verdict", 0b1110: "learning_status", 0b0011: "asset_family"}
    dim = F.element_at(F.create_map(*[F.lit(v) for kv in which.items() for v in kv]), F.col("_g").cast("int"))
    counts = grouped.select(
        dim.alias("dimension"), F.concat_ws(" / ", "asset", "family", "verdict", "learning_status").alias("key"), "n"
    ).filter("key <> ''")
    checks = (
        trials.select(F.explode("failed_checks").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
        .select(F.lit("failed_check").alias("dimension"), "key", "n")
    )
    return counts.unionByName(checks)


def passed_runs(log: DataFrame) -> DataFrame:
    return log.filter(~is_lockbox() & ~is_stress() & (F.col("verdict") == CONFIRMED))


def learning_runs(log: DataFrame) -> DataFrame:
    return log.filter(~is_lockbox() & ~is_stress() & (F.coalesce("learning_status", F.lit("")) != ""))


def recent_runs(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), F.desc("record_id")).limit(n)


def deflated_threshold(daily_variance: Column, n_trials: Column) -> Column:
    """Expected best daily Sharpe of n independent trials."""
    z1 = norm_ppf(1 - 1 / n_trials)
    z2 = norm_ppf(1 - 1 / (n_trials * math.e))
    value = F.sqrt(daily_variance) * ((1 - EULER_GAMMA) * z1 + EULER_GAMMA * z2)
    return F.when((n_trials < 2) | (daily_variance <= 0), 0.0).otherwise(value)


def sharpe_spread(trials: DataFrame, keys: Keys) -> DataFrame:
    """keys, n_sharpes, sharpe_variance (daily) and the deflated threshold."""
    daily = F.col("sharpe_ratio") / math.sqrt(TRADING_DAYS)
    return trials.groupBy(*keys).agg(
        F.count("sharpe_ratio").alias("n_sharpes"), F.var_samp(daily).alias("sharpe_variance")
    ).withColumn(
        "threshold",
        F.when(F.col("n_sharpes") >= 2, deflated_threshold(F.col("sharpe_variance"), F.col("n_sharpes"))).otherwise(0.0),
    )


def slate_dsr(candidates: DataFrame, keys: Keys = ("slate_id",)) -> DataFrame:
    """Each candidate with its deflated Sharpe against its own slate; fewer than two Sharpes in
    the slate, or none of its own, fails the check."""
    spread = sharpe_spread(candidates, keys)
    n_obs = trading_days(F.col("start_date"), F.col("end_date"))
    dsr = F.when(
        F.col("n_sharpes") >= 2, probabilistic_sharpe(F.col("sharpe_ratio"), n_obs, F.col("threshold"))
    )
    return candidates.join(spread, list(keys)).withColumn("dsr", dsr).withColumn(
        "dsr_passed", F.coalesce(F.col("dsr") >= DSR_PASS, F.lit(False))
    )


def sweep_dsr(entries: DataFrame, keys: Keys) -> DataFrame:
    """entries(keys, ok, confirms, sharpe_ratio, n_days): deflated Sharpe of the best confirmer."""
    ok = entries.filter("ok")
    best = ok.groupBy(*keys).agg(
        F.max(F.when(F.col("confirms"), F.col("sharpe_ratio"))).alias("best_sharpe"), F.max("n_days").alias("n_days")
    )
    return best.join(sharpe_spread(ok, keys), list(keys)).select(
        *keys, "best_sharpe",
        F.when(
            (F.col("n_sharpes") >= 2) & F.col("best_sharpe").isNotNull(),
            probabilistic_sharpe(F.col("best_sharpe"), F.col("n_days"), F.col("threshold")),
        ).alias("sweep_dsr"),
    )


def budget_candidates(log: DataFrame) -> DataFrame:
    """Every confirmed lockbox portfolio, deflated against all portfolio trials ever made."""
    spread = sharpe_spread(log.filter(is_trial()).withColumn("_all", F.lit(1)), ("_all",))
    n_obs = F.coalesce(trading_days(F.col("start_date"), F.col("end_date")), F.lit(TRADING_DAYS))
    return (
        log.filter(is_portfolio() & confirmed() & F.col("sharpe_ratio").isNotNull())
        .withColumn("_all", F.lit(1))
        .join(spread, "_all", "left")
        .withColumn(
            "cross_run_dsr",
            probabilistic_sharpe(F.col("sharpe_ratio"), n_obs, F.coalesce("threshold", F.lit(0.0))),
        )
        .withColumn("clears_bar", F.col("cross_run_dsr") >= DSR_PASS)
        .drop("_all", "n_sharpes", "sharpe_variance", "threshold")
    )


def trial_budget(log: DataFrame) -> DataFrame:
    """One row: counts, the best deflated Sharpe and the verdict."""
    counts = log.agg(
        F.count_if(is_trial()).alias("n_trials"),
        F.count_if(is_portfolio() & is_lockbox()).alias("n_lockbox"),
        F.count_if(is_portfolio() & confirmed()).alias("n_confirmed"),
    ).withColumn("_all", F.lit(1))
    best = budget_candidates(log).agg(F.max("cross_run_dsr").alias("best_cross_run_dsr")).withColumn("_all", F.lit(1))
    return counts.join(best, "_all").drop("_all").withColumn(
        "verdict",
        F.when(F.col("n_trials") == 0, "NO_PORTFOLIO_RESEARCH_YET")
        .when(F.col("n_confirmed") == 0, "NOTHING_CONFIRMED")
        .when(F.col("best_cross_run_dsr") >= DSR_PASS, "SURVIVES_MULTIPLE_TESTING")
        .otherwise("CONFIRMED_BUT_NOT_AFTER_CORRECTION"),
    )


def failure_tally(candidates: DataFrame, keys: Keys = ("slate_id",)) -> DataFrame:
    """keys, kind (verdict or failed_check), name, n: most frequent first within a slate."""
    both = F.concat(
        F.array(F.struct(F.lit("verdict").alias("kind"), F.col("verdict").alias("name"))),
        F.transform(
            F.coalesce("failed_checks", F.array().cast("array<string>")),
            lambda c: F.struct(F.lit("failed_check").alias("kind"), c.alias("name")),
        ),
    )
    return (
        candidates.select(*keys, F.inline(both))
        .filter("name is not null")
        .groupBy(*keys, "kind", "name")
        .agg(F.count("*").alias("n"))
    )


def campaign_summary(candidates: DataFrame) -> DataFrame:
    """Per asset, and in total (asset NULL): trials, lockbox runs, passes. One rollup."""
    trial = ~is_lockbox()
    return candidates.rollup("asset").agg(
        F.count_if(trial).alias("trials"),
        F.count_if(is_lockbox()).alias("lockbox_runs"),
        F.count_if(trial & (F.col("verdict") == CONFIRMED)).alias("passes"),
        F.count_if(confirmed()).alias("lockbox_passes"),
    )


def research_funnel(log: DataFrame, paper: DataFrame) -> DataFrame:
    counts = log.agg(
        F.count_if(~is_lockbox() & ~is_stress()).alias("tried"),
        F.count_if(is_lockbox()).alias("lockbox_tested"),
        F.count_if(confirmed()).alias("lockbox_confirmed"),
        F.count_if(is_stress() & (F.col("verdict") == "ROBUST")).alias("robust_after_stress"),
    ).withColumn("_all", F.lit(1))
    held = paper.agg(F.count("*").alias("paper_traded")).withColumn("_all", F.lit(1))
    return counts.join(held, "_all").drop("_all")


def slate_winner(candidates: DataFrame, keys: Keys = ("slate_id",), idx: str = "record_id") -> DataFrame:
    """Best candidate of each slate: benchmark beaters first, then Sharpe (missing is lowest),
    then return, then the earliest. An aggregation, so a huge slate is no harder than many."""
    s = F.coalesce("sharpe_ratio", F.lit(float("-inf")))
    rank = F.struct("beats_benchmark", s.alias("s"), "total_return_pct", (-F.col(idx)).alias("i"))
    best = candidates.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(idx), "beats_benchmark", "sharpe_ratio", "total_return_pct"), rank).alias("w")
    )
    return best.select(
        *keys, F.col(f"w.{idx}").alias("winner"), "w.sharpe_ratio", "w.total_return_pct",
        F.when(F.col("w.beats_benchmark"), "highest_sharpe_among_benchmark_beaters")
        .otherwise("highest_sharpe_overall_no_benchmark_beaters")
        .alias("reason"),
    )


def confirmed_winners(log: DataFrame) -> DataFrame:
    """Per portfolio slate with a confirmed lockbox: the newest confirmed record and the full
    date range and latest timestamp of the slate."""
    ok = confirmed()
    slates = log.filter((F.col("mode") == "portfolio") & F.col("slate_id").isNotNull()).groupBy("slate_id").agg(
        F.max_by(
            F.struct("record_id", "strategy_family", "assets", "lookback", "top_k", "rebalance"),
            F.when(ok, F.struct("timestamp", -F.col("record_id"))),
        ).alias("w"),
        F.max(ok).alias("_any"),
        F.min("start_date").alias("full_start"),
        F.max("end_date").alias("full_end"),
        F.max("timestamp").alias("timestamp"),
    )
    return slates.filter("_any and w.assets is not null and full_start is not null and full_end is not null").select(
        "slate_id", "w.*", "full_start", "full_end", "timestamp"
    )


def latest_winner(log: DataFrame) -> DataFrame:
    return confirmed_winners(log).orderBy(F.desc("timestamp"), "slate_id").limit(1)


def newer_winner(log: DataFrame, books: DataFrame) -> DataFrame:
    """The latest winner, if it is newer than the origin of every open book."""
    newest = books.filter("status = 'open'").agg(F.max("origin_timestamp").alias("_newest")).withColumn("_all", F.lit(1))
    return (
        latest_winner(log).withColumn("_all", F.lit(1)).join(newest, "_all")
        .filter(F.col("_newest").isNotNull() & (F.col("timestamp") > F.col("_newest")))
        .drop("_all", "_newest")
    )


def matching_positions(paper: DataFrame, log: DataFrame) -> DataFrame:
    """Paper positions whose exact upper-cased asset list and family appear in the log."""
    up = F.transform("assets", lambda a: F.upper(a))
    seen = log.filter(F.col("assets").isNotNull()).select(
        F.array_join(up, "\u0001").alias("_k"), F.col("strategy_family").alias("_f")
    ).distinct()
    keyed = paper.filter(F.size("assets") > 0).withColumn("_k", F.array_join(up, "\u0001"))
    return keyed.join(
        seen, (keyed["_k"] == seen["_k"]) & (keyed["strategy_family"] == seen["_f"]), "left_semi"
    ).drop("_k")


def search_rows(log: DataFrame) -> DataFrame:
    """What a search needs of each record: its group, strategy, text, assets and family."""
    text = F.lower(F.concat_ws(
        " ", F.coalesce("slate_id", F.lit("")), F.coalesce("asset", F.lit("")),
        F.coalesce("strategy_family", F.lit("")), F.array_join("assets", " "),
    ))
    group_id = F.coalesce("slate_id", F.concat(F.lit("record-"), F.col("record_id").cast("string")))
    strategy = F.concat_ws(
        "|", "strategy_family", F.array_join("assets", ","), F.col("lookback").cast("string"),
        F.col("top_k").cast("string"), F.col("rebalance").cast("string"),
    )
    return log.select(
        group_id.alias("group_id"), strategy.alias("strategy"), text.alias("text"),
        F.transform("assets", lambda a: F.lower(a)).alias("assets"), F.lower("strategy_family").alias("family"),
        F.lit(1).cast("long").alias("n"), F.col("timestamp").alias("latest"),
    )


def search_facts(rows: DataFrame, identifier: str) -> DataFrame:
    """One row: whether a group id equals the text, and which of its tokens are assets of the log."""
    q = F.lit(identifier.strip().lower())
    return rows.select(
        (F.lower("group_id") == q).alias("_exact"), F.array_intersect("assets", tokens(q)).alias("_known"),
    ).agg(
        F.max("_exact").alias("_any_exact"),
        F.array_distinct(F.flatten(F.collect_set("_known"))).alias("_query_assets"),
    )


def ranked_groups(rows: DataFrame, facts: DataFrame, identifier: str) -> DataFrame:
    """Groups of search rows by score. rows may be any part of the log that holds whole groups,
    facts are those of the whole log."""
    q = F.lit(identifier.strip().lower())
    wanted = tokens(q)
    hits = F.filter("_tok", lambda t: F.col("text").contains(t))
    groups = rows.withColumn("_tok", wanted).withColumn("_hit", hits).groupBy("group_id", "strategy").agg(
        F.array_distinct(F.flatten(F.collect_set("assets"))).alias("_assets"),
        F.max(F.col("text").contains(q)).alias("_whole"),
        F.array_distinct(F.flatten(F.collect_set("_hit"))).alias("_found"),
        F.collect_set("family").alias("_families"),
        F.sum("n").alias("n_records"),
        F.max("latest").alias("latest"),
    )
    out = groups.withColumn("_all", F.lit(1)).join(facts.withColumn("_all", F.lit(1)), "_all").withColumn("_tok", wanted)
    asked = F.size("_query_assets")
    missing = F.size(F.array_except("_query_assets", "_assets")) > 0
    extra = F.size("_assets") - asked
    asset_score = F.when(asked == 0, 0).when(extra == 0, 1000).otherwise(F.greatest(F.lit(100), 500 - extra))
    score = (
        asset_score
        + F.when(F.col("_whole"), 20).otherwise(0)
        + F.when((F.size("_tok") > 0) & (F.size("_found") == F.size(F.array_distinct("_tok"))), 10).otherwise(0)
        + F.when(F.arrays_overlap("_families", "_tok"), 50).otherwise(0)
    )
    exact = F.lower("group_id") == q
    scored = out.withColumn("score", F.when(exact, F.lit(0)).when((asked > 0) & missing, 0).otherwise(score))
    kept = scored.filter(F.when(F.col("_any_exact"), exact).otherwise(F.col("score") > 0))
    return kept.select("group_id", "strategy", "score", "n_records", "latest").orderBy(
        F.desc("score"), F.desc("latest"), "group_id", "strategy"
    )


def search(log: DataFrame, identifier: str) -> DataFrame:
    """Groups (slate and strategy) that match a text, best first: an exact group id wins alone;
    otherwise asset-set, text, token and family matches add up. Text must match within one
    record. Reads the whole log; operators.log_index answers from a stored index."""
    rows = search_rows(log)
    return ranked_groups(rows, search_facts(rows, identifier), identifier)
