"""Parameter surfaces of moving-average crossovers: every value in train and lockbox, one scan.

A running sum of closes per series and segment serves all windows: an average of n bars is a difference
of two of its values. Sums are decimals, so equal averages are equal whatever window they come from. The
whole lattice of values and segments is made of one exchange of the bars by (series, segment); rows
multiply by the values only after it, and the replay keeps that partitioning.

Defined cases: bars without a close are left out; values that are not below the slow window, or below
one, are invalid entries without verdicts; a series without bars in a segment has no verdict there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.functions.scalars import trading_days
from barframe.functions.windows import ASSET, Keys, cumulative, safe, series
from barframe.operators import log as L
from barframe.operators import metrics as M
from barframe.operators import replay as R
from barframe.operators import validate as V
from barframe.session import written

MIN_TRADES = 20
EXACT = "decimal(28,10)"


def crossover_lattice(bars: DataFrame, fast: Sequence[int], slow: int, keys: Keys = ASSET, order: str = "ts") -> DataFrame:
    """Bars times fast windows: keys, order, close, value, entry and exit of each window's crossover."""
    w = series(keys, order)
    base = bars.filter("close is not null").select(*keys, order, "close").withColumns({
        "_k": F.row_number().over(w), "_cum": F.sum(F.col("close").cast(EXACT)).over(cumulative(keys, order)),
    })

    def mean(n: int) -> Column:
        before = F.coalesce(F.lag("_cum", n).over(w), F.lit(0).cast(EXACT))
        return F.when(F.col("_k") >= n, (F.col("_cum") - before).cast("double") / n)

    grid = base.withColumns({"_slow": mean(slow), "_fast": F.array(*[mean(n) for n in fast])})
    held = grid.withColumns({"_slow0": F.lag("_slow").over(w), "_fast0": F.lag("_fast").over(w)})
    now, then = (lambda i: F.get("_fast", F.lit(i))), (lambda i: F.get("_fast0", F.lit(i)))
    cells = F.array(*[
        F.struct(
            F.lit(n).alias("value"),
            safe((now(i) > F.col("_slow")) & (then(i) <= F.col("_slow0"))).alias("entry"),
            safe((now(i) < F.col("_slow")) & (then(i) >= F.col("_slow0"))).alias("exit"),
        )
        for i, n in enumerate(fast)
    ])
    return held.select(*keys, order, "close", F.inline(cells))


def segment_verdicts(lattice: DataFrame, keys: Keys, order: str = "ts", cash: float = R.INITIAL_CASH) -> DataFrame:
    """Metrics, checks and verdict of every cell (keys, value) of a lattice."""
    cell = (*keys, "value")
    eq = written(R.replay_signals(lattice, keys=cell, order=order, cash=cash), "sweep-equity")
    days = eq.groupBy(*cell).agg(trading_days(F.min(order), F.max(order)).alias("n_days"))
    m = written(M.signal_metrics(eq, R.signal_trades(eq, cell, order), eq, cash, cell, order).join(days, list(cell)), "sweep-metrics")
    checked = m.join(V.check_summary(V.metric_checks(m, "buy_and_hold_pct", cell, MIN_TRADES), cell), list(cell))
    return checked.withColumn("verdict", V.research_verdict(F.lit(False), F.lit(True), F.lit(True)))


def sweep_entries(bars: DataFrame, fast: Sequence[int], slow: int, lockbox_start: str, keys: Keys = ASSET, order: str = "ts") -> DataFrame:
    """One row per series and value: status, verdict in train and lockbox, whether the lockbox confirms
    it, and the held-out Sharpe, return, benchmark and days."""
    values = sorted(set(fast))
    valid = [n for n in values if 1 <= n < slow]
    split = F.when(F.col(order) < F.lit(lockbox_start).cast("date"), "train").otherwise("lockbox")
    ids = bars.select(*keys).distinct()
    grid = ids.withColumn("value", F.explode(F.array(*[F.lit(n) for n in values]).cast("array<int>")))
    ok = F.col("value").between(1, slow - 1)
    base = grid.withColumns({"ok": ok, "status": F.when(ok, "ok").otherwise("invalid")})
    if not valid:
        empty = {c: F.lit(None).cast(t) for c, t in (
            ("train_verdict", "string"), ("lockbox_verdict", "string"), ("held_out_sharpe", "double"), ("held_out_return_pct", "double"),
            ("held_out_benchmark_pct", "double"), ("n_days", "int"))}
        return base.withColumns(empty).withColumn("confirms", F.lit(False))
    cells = segment_verdicts(crossover_lattice(bars.withColumn("segment", split), valid, slow, (*keys, "segment"), order), (*keys, "segment"), order)

    def of(segment: str, column: str, name: str) -> Column:
        return F.max(F.when(F.col("segment") == segment, F.col(column))).alias(name)

    wide = cells.groupBy(*keys, "value").agg(
        of("train", "verdict", "train_verdict"), of("lockbox", "verdict", "lockbox_verdict"), of("lockbox", "sharpe_ratio", "held_out_sharpe"),
        of("lockbox", "total_return_pct", "held_out_return_pct"), of("lockbox", "buy_and_hold_pct", "held_out_benchmark_pct"),
        of("lockbox", "n_days", "n_days"),
    )
    return base.join(wide, [*keys, "value"], "left").withColumn("confirms", safe(F.col("lockbox_verdict") == L.CONFIRMED))


def sweep_surface(entries: DataFrame, keys: Keys = ASSET) -> DataFrame:
    """Per series: the longest run of neighbouring values that confirm, PLATEAU, SPIKE or NONE, and the
    deflated Sharpe of the best confirming value against all values tried."""
    dsr = L.sweep_dsr(entries.withColumn("sharpe_ratio", F.col("held_out_sharpe")), keys)
    return V.plateau(entries, keys).join(dsr, list(keys), "left")
