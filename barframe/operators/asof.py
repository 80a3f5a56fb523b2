"""Backward as-of joins with a publication lag, carry and macro regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.windows import Keys, safe, series


def asof_values(
    obs: DataFrame, wanted: DataFrame, lag_days: int | Column, series_key: str = "series_id"
) -> DataFrame:
    """For each wanted (series, ts), the latest observation available by then.

    obs(series, obs_date, value) becomes available lag_days after its date. Observations and
    wanted dates are one ordered stream per series and the last value is carried forward, so
    there is no range join. A series holds one row per observation and date, which the calendar
    bounds.
    """
    available = F.date_add("obs_date", F.lit(lag_days) if isinstance(lag_days, int) else lag_days)
    facts = obs.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(
        series_key, available.alias("ts"), F.lit(0).alias("_wanted"), "obs_date", "value"
    )
    asked = wanted.select(
        series_key, "ts", F.lit(1).alias("_wanted"),
        F.lit(None).cast("date").alias("obs_date"), F.lit(None).cast("double").alias("value"),
    )
    order = Window.partitionBy(series_key).orderBy("ts", "_wanted", "obs_date")
    known = F.last("value", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        facts.unionByName(asked)
        .withColumn("known", known)
        .filter(F.col("_wanted") == 1)
        .select(series_key, "ts", "known")
    )


def carry_panel(known: DataFrame, base_series: str, series_key: str = "series_id") -> DataFrame:
    """Rate of each series minus the base rate on the same date."""
    base = known.filter(F.col(series_key) == base_series).select("ts", F.col("known").alias("_base"))
    return (
        known.filter(F.col(series_key) != base_series)
        .join(base, "ts")
        .select(F.col(series_key).alias("asset"), "ts", (F.col("known") - F.col("_base")).alias("carry"))
    )


def reindex_aux(aux: DataFrame, panel: DataFrame, value: str = "carry") -> DataFrame:
    """The auxiliary values on the panel's dates; dates without one stay NULL."""
    return panel.select("universe_id", "pos", "ts", "asset").join(
        aux.select("asset", "ts", value), ["asset", "ts"], "left"
    )


def expansion_regime(
    known: DataFrame, change_window: int = 63, keys: Keys = ("series_id",)
) -> DataFrame:
    """True where the known value is above what was known change_window dates earlier."""
    prev = F.lag("known", change_window).over(series(keys, "ts"))
    return known.withColumn("expansion", safe(F.col("known") > prev))

