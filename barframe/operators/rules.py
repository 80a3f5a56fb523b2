"""Specification rules as columns: each returns the list of problems of its row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barframe.functions.scalars import dedupe_assets, n_assets

# Symbols treated as crypto.
CRYPTO_PREFIXES = ("BTC", "ETH", "SOL", "XRP", "ADA", "DOGE", "BNB", "AVAX")
SMA, DONCHIAN, RSI = "sma_crossover", "donchian_breakout", "rsi_mean_reversion"
FILTERED_DONCHIAN, FILTERED_RSI = "filtered_donchian_breakout", "filtered_rsi_mean_reversion"


def problems(*rules: tuple[Column, str]) -> Column:
    """Messages of the rules that are true."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in rules]))


def _outside(c: str, low: float, high: float) -> Column:
    return ~F.col(c).between(low, high)


def strategy_problems() -> Column:
    fam = F.col("family")
    sma = fam == SMA
    channel = fam.isin(DONCHIAN, FILTERED_DONCHIAN)
    rsi = fam.isin(RSI, FILTERED_RSI)
    atr = fam.isin(FILTERED_DONCHIAN, FILTERED_RSI)

    def missing(*names: str) -> Column:
        out = F.col(names[0]).isNull()
        for n in names[1:]:
            out = out | F.col(n).isNull()
        return out

    return problems(
        (sma & missing("fast_window", "slow_window"), "fast_window and slow_window are required"),
        (sma & (F.col("fast_window") <= 1), "fast_window must be > 1"),
        (sma & (F.col("slow_window") <= F.col("fast_window")), "slow_window must be greater than fast_window"),
        (sma & (F.col("slow_window") > 300), "slow_window must be <= 300"),
        (channel & missing("entry_window", "exit_window"), "entry_window and exit_window are required"),
        (channel & (F.col("entry_window") < 5), "entry_window must be >= 5"),
        (channel & (F.col("exit_window") < 2), "exit_window must be >= 2"),
        (channel & ((F.col("entry_window") > 300) | (F.col("exit_window") > 300)), "channel windows must be <= 300"),
        ((fam == FILTERED_DONCHIAN) & missing("regime_window"), "regime_window is required"),
        ((fam == FILTERED_DONCHIAN) & _outside("regime_window", 20, 300), "regime_window must be between 20 and 300"),
        (rsi & missing("rsi_window", "oversold", "exit_above"), "rsi_window and both thresholds are required"),
        (rsi & (F.col("rsi_window") < 2), "rsi_window must be >= 2"),
        (rsi & (F.col("oversold") >= F.col("exit_above")), "oversold must be lower than exit_above"),
        (rsi & (F.col("oversold") < 5), "oversold must be >= 5"),
        (rsi & (F.col("exit_above") > 95), "exit_above must be <= 95"),
        (atr & missing("atr_window", "atr_ma_window"), "atr_window and atr_ma_window are required"),
        (atr & _outside("atr_window", 2, 100), "atr_window must be between 2 and 100"),
        (atr & _outside("atr_ma_window", 2, 200), "atr_ma_window must be between 2 and 200"),
    )


def _portfolio_rules(n: Column) -> tuple[tuple[Column, str], ...]:
    """n: the number of distinct assets."""
    fam = F.col("family")
    ranked = fam.isin("cross_sectional_momentum", "dual_momentum", "cross_sectional_reversal", "fx_carry")
    reversal, hedge = fam == "cross_sectional_reversal", fam == "crisis_hedge"
    return (
        (n < 2, "at least 2 distinct assets are required"),
        (F.col("lookback") < 20, "lookback must be >= 20"),
        (F.col("lookback") > 1260, "lookback must be <= 1260"),
        (F.col("rebalance") < 1, "rebalance must be >= 1"),
        (F.col("rebalance") > 252, "rebalance must be <= 252"),
        (ranked & (F.col("top_k") < 1), "top_k must be >= 1"),
        (ranked & (F.col("top_k") > n), "top_k cannot exceed the number of assets"),
        (reversal & (F.col("skip") < 0), "skip must be >= 0"),
        (reversal & (F.col("skip") >= F.col("lookback")), "skip must be < lookback"),
        (hedge & (n != 2), "exactly 2 assets are required: core and hedge"),
        (hedge & F.col("hedge_weight").isNull(), "hedge_weight is required"),
        (hedge & ((F.col("hedge_weight") <= 0) | (F.col("hedge_weight") > 0.5)), "hedge_weight must be in (0, 0.5]"),
    )


def portfolio_problems() -> Column:
    return problems(*_portfolio_rules(n_assets(F.col("assets"))))


def portfolio_sound(n: Column) -> Column:
    """Whether a portfolio of n distinct assets has none of portfolio_problems()."""
    return F.coalesce(*[F.when(broken, F.lit(text)) for broken, text in _portfolio_rules(n)]).isNull()


def book_problems() -> Column:
    core, overlay = dedupe_assets(F.col("core")), dedupe_assets(F.col("overlay"))
    low = [F.transform(a, lambda x: F.lower(x)) for a in (core, overlay)]
    return problems(
        (F.size(core) == 0, "core must contain at least one asset"),
        (F.size(overlay) == 0, "overlay must contain at least one asset"),
        (F.arrays_overlap(*low), "core and overlay must be disjoint"),
        ((F.col("overlay_weight") <= 0) | (F.col("overlay_weight") > 0.5), "overlay_weight must be in (0, 0.5]"),
        (_outside("lookback", 20, 504), "lookback must be between 20 and 504"),
        (_outside("rebalance", 1, 252), "rebalance must be between 1 and 252"),
    )


def critique_problems() -> Column:
    """start_date and end_date are text, as users give them."""
    start, end = (F.col(c).try_cast("date") for c in ("start_date", "end_date"))
    return problems(
        (start.isNull() | end.isNull(), "invalid ISO date"),
        (end <= start, "end date must be after start date"),
        (F.col("timeframe") != "1d", "only daily timeframe 1d is supported"),
        (F.col("commission_pct").isNull() | (F.col("commission_pct") < 0), "commission must be present and non-negative"),
        (F.col("slippage_pct").isNull() | (F.col("slippage_pct") < 0), "slippage must be present and non-negative"),
        (F.coalesce("asset", F.lit("")) == "", "asset must be present"),
        (F.coalesce("hypothesis", F.lit("")) == "", "hypothesis must be present"),
    )


def critique_warnings() -> Column:
    start, end = (F.col(c).try_cast("date") for c in ("start_date", "end_date"))
    prefix = F.upper(F.split("asset", "-")[0])
    text = F.lower(F.coalesce("user_request", F.lit("")))
    return problems(
        (prefix.isin(*CRYPTO_PREFIXES), "asset appears to be crypto"),
        (F.datediff(end, start) < 365 * 3, "backtest period is less than 3 years"),
        (text.contains("drawdown") & text.contains("guarantee"), "drawdown cannot be guaranteed"),
        (text.contains("best") | text.contains("profitable"), "outcome-seeking language without criteria"),
    )


def _span() -> tuple[Column, Column]:
    return tuple(F.col(c).try_cast("date") for c in ("start", "end"))


def portfolio_critique_problems() -> Column:
    """start and end are dates, or text as users give it."""
    start, end = _span()
    return problems(
        (start.isNull() | end.isNull(), "invalid ISO date"),
        (end <= start, "end date must be after start date"),
        (n_assets(F.col("assets")) < 2, "a portfolio needs at least 2 assets"),
    )


def portfolio_critique_warnings() -> Column:
    start, end = _span()
    n = n_assets(F.col("assets"))
    few = F.concat(F.lit("portfolio rotates across "), n.cast("string"), F.lit(" assets only"))
    young = (end > start) & (F.datediff(end, start) < 365 * 3)
    return F.array_compact(F.array(F.when(young, F.lit("backtest period is less than 3 years")), few))


def required_changes() -> Column:
    start, end = _span()
    return problems(
        (start.isNull() | end.isNull(), "use YYYY-MM-DD dates"), (end <= start, "choose an end date after the start date"),
    )


def sweep_qualifies(excess: Column, pf: Column, trades: Column, min_pf: float, min_trades: int) -> Column:
    return F.coalesce((excess > 0) & (pf > min_pf) & (trades >= min_trades), F.lit(False))
