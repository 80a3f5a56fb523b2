"""Landed provider files to bars. A reader per file shape, then a projection to bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.functions.scalars import safe_number
from barframe.operators.bars import BAR_COLUMNS, drop_incomplete, require_columns

ADJUSTED_ROW = (
    "date string, adjOpen double, adjHigh double, adjLow double, adjClose double, adjVolume double"
)
SPLIT_ROW = "date string, open double, high double, low double, close double, adj_close double, volume double"
CSV_ROW = "Date string, Open double, High double, Low double, Close double, Volume double"
TICK_PAYLOAD = "prices array<array<double>>, total_volumes array<array<double>>"
PRICE_PAGE = "data array<struct<time:string, PriceUSD:string>>"
SERIES_ROW = "obs string, value string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str = CSV_ROW) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Two-column series file; "." stands for a missing value."""
    return spark.read.schema(SERIES_ROW).option("header", True).option("nullValue", ".").csv(path)


def _day(c: str) -> Column:
    return F.to_date(F.substring(c, 1, 10))


def adjusted_rows(rows: DataFrame) -> DataFrame:
    """Adjusted OHLCV rows: incomplete prices dropped, missing volume is 0."""
    require_columns(rows, ["asset", "date", "adjOpen", "adjHigh", "adjLow", "adjClose", "adjVolume"])
    return drop_incomplete(rows.select(
        "asset", _day("date").alias("ts"), F.col("adjOpen").alias("open"), F.col("adjHigh").alias("high"),
        F.col("adjLow").alias("low"), F.col("adjClose").alias("close"),
        F.coalesce("adjVolume", F.lit(0.0)).alias("volume"),
    ))


def split_adjusted(rows: DataFrame) -> DataFrame:
    """Open, high and low scaled by adjusted close over close; a close of 0 has no ratio."""
    require_columns(rows, ["asset", "date", "open", "high", "low", "close", "adj_close", "volume"])
    ratio = F.col("adj_close") / F.nullif(F.col("close"), F.lit(0.0))
    return drop_incomplete(rows.select(
        "asset", _day("date").alias("ts"), *[(F.col(c) * ratio).alias(c) for c in ("open", "high", "low")],
        F.col("adj_close").alias("close"), "volume",
    ))


def csv_rows(rows: DataFrame) -> DataFrame:
    require_columns(rows, ["asset", "Date", "Open", "High", "Low", "Close", "Volume"])
    return drop_incomplete(rows.select(
        "asset", _day("Date").alias("ts"), *[F.col(c.title()).alias(c) for c in BAR_COLUMNS[2:]]
    ))


def macro_series(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """series_id, obs_date, value: unparsable values dropped, dates clipped."""
    out = rows.select("series_id", _day("obs").alias("obs_date"), safe_number(F.col("value")).alias("value"))
    if start:
        out = out.filter(F.col("obs_date") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("obs_date") <= F.lit(end).cast("date"))
    return out.filter("value is not null and obs_date is not null")


def close_only_bars(series: DataFrame) -> DataFrame:
    """A value series as flat bars with volume 0."""
    return series.select(
        F.col("series_id").alias("asset"), F.col("obs_date").alias("ts"),
        *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(0.0).alias("volume"),
    )


def tick_payloads(payloads: DataFrame) -> DataFrame:
    """payloads(asset, prices, total_volumes) of [ms, value] pairs to daily bars.

    Prices and volumes are exploded and aggregated on their own, then joined on the day: the
    last volume of the day counts, 0 where there is none.
    """
    def exploded(col: str) -> DataFrame:
        pairs = payloads.select("asset", F.explode(col).alias("p"))
        ms = F.col("p")[0].cast("bigint")
        return pairs.select(
            "asset", ms.alias("ms"), F.to_date(F.timestamp_millis(ms)).alias("ts"), F.col("p")[1].alias("v")
        ).filter("v is not null")

    rank = F.struct("ms", "v")
    bars = exploded("prices").groupBy("asset", "ts").agg(
        F.min_by("v", rank).alias("open"), F.max("v").alias("high"), F.min("v").alias("low"),
        F.max_by("v", rank).alias("close"),
    )
    volumes = exploded("total_volumes").groupBy("asset", "ts").agg(F.max_by("v", rank).alias("volume"))
    return bars.join(volumes, ["asset", "ts"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def price_pages(pages: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """pages(asset, data) of {time, PriceUSD} rows to flat daily bars; unparsable rows dropped."""
    rows = pages.select("asset", F.inline("data")).select(
        F.col("asset").alias("series_id"), F.col("time").alias("obs"), F.col("PriceUSD").alias("value")
    )
    return close_only_bars(macro_series(rows, start, end))
