"""Series windows. A series is the rows of one key (asset, or asset and parameter) in time
order. Bars hold one row per key and period, so a series is as long as its calendar, not as
long as its ticks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Keys = Sequence[str]
ASSET: Keys = ("asset",)


def series(keys: Keys = ASSET, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def cumulative(keys: Keys = ASSET, order: str = "ts") -> WindowSpec:
    return series(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(n: int, keys: Keys = ASSET, order: str = "ts") -> WindowSpec:
    return series(keys, order).rowsBetween(-(n - 1), 0)


def full(
    agg: Callable[[Column], Column],
    col: str | Column,
    n: int,
    keys: Keys = ASSET,
    order: str = "ts",
    min_periods: int | None = None,
) -> Column:
    """A trailing aggregate that stays NULL until enough values are present."""
    c = F.col(col) if isinstance(col, str) else col
    w = trailing(n, keys, order)
    return F.when(F.count(c).over(w) >= (min_periods or n), agg(c).over(w))


def safe(cond: Column) -> Column:
    """A comparison with a missing side is False, also before it is negated."""
    return F.coalesce(cond, F.lit(False))
