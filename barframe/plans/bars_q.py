"""Queries on bars, gates, panels and joins of panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.operators import bars as B
from barframe.plans import tables as T
from barframe.plans.registry import query, rounded

OHLC = ("open", "high", "low", "close")


def _bars_sql(name: str) -> str:
    return f"""SELECT asset, ts, round(open, 8) AS open, round(high, 8) AS high,
    round(low, 8) AS low, round(close, 8) AS close, volume FROM {name}"""


@query("a1_resample_daily", _bars_sql("bars_d"))
def resample_daily(spark, sf):
    return rounded(T.bars(spark, sf, "day").drop("avg_price"), 8, *OHLC)


@query("a1_resample_weekly_nations", _bars_sql("bars_nw"))
def resample_weekly(spark, sf):
    return rounded(T.bars(spark, sf, "week", "nation").drop("avg_price"), 8, *OHLC)


@query("a1_resample_intraday", _bars_sql("intraday"))
def resample_intraday(spark, sf):
    bars = T.intraday(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rounded(bars.drop("avg_price"), 8, *OHLC)


@query("a2_month_end", """
SELECT asset, last_day(ts) AS month, round(arg_max(close, ts), 8) AS close
FROM bars_d GROUP BY 1, 2""")
def month_end(spark, sf):
    return rounded(B.month_end(T.bars(spark, sf, "day")), 8, "close")


@query("j1_aligned_panel", "SELECT ts, pos, asset, asset_ord, round(close, 5) AS close FROM panel_d")
def panel(spark, sf):
    return rounded(T.panel(spark, sf).drop("universe_id", "n_assets"), 5, "close")


@query("p2_p3_history_gate", """
WITH b AS (SELECT *, CASE WHEN (day(ts) + length(asset)) % 13 = 0 THEN NULL ELSE open END AS open2 FROM bars_nw),
k AS (SELECT * FROM b WHERE open2 IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL)
SELECT asset, ts, round(open2, 8) AS open, round(close, 8) AS close FROM k
WHERE asset IN (SELECT asset FROM k GROUP BY 1 HAVING count(*) >= 300)""")
def history_gate(spark, sf):
    bars = T.bars(spark, sf, "week", "nation")
    hole = (F.dayofmonth("ts") + F.length("asset")) % 13 == 0
    bars = bars.withColumn("open", F.when(~hole, F.col("open")))
    kept = B.minimum_history(B.drop_incomplete(bars), 300)
    return rounded(kept.select("asset", "ts", "open", "close"), 8, "open", "close")


@query("p4_date_slice", """
SELECT asset, ts, round(close, 8) AS close, volume FROM bars_d
WHERE ts BETWEEN DATE '1997-03-01' AND DATE '1998-06-30'""")
def date_slice(spark, sf):
    bars = T.bars(spark, sf, "day", span=("1997-03-01", "1998-06-30"))
    out = B.date_slice(bars, "1997-03-01", "1998-06-30").select("asset", "ts", "close", "volume")
    return rounded(out, 8, "close")
