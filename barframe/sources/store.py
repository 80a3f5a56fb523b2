"""The bar store: source priority, idempotent upsert, coverage and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.functions.windows import Keys

# Symbol aliases and source order, best first.
BITCOIN = ("btc", "btc-usd", "xbt", "xbt-usd", "bitcoin")
NASDAQ = ("qqq", "nasdaq", "nasdaq100", "nasdaq-100", "ndx")
SOURCE_ORDER = ("tiingo", "yfinance", "stooq")
COVER_BUCKET = "month"


def route(asset: Column) -> Column:
    """Sources of a symbol in the order they are tried."""
    name = F.lower(F.trim(asset))
    return (
        F.when(name.isin(*BITCOIN), F.array(F.lit("coinmetrics")))
        .when(name.isin(*NASDAQ), F.array(F.lit("fred")))
        .otherwise(F.array(*[F.lit(s) for s in SOURCE_ORDER]))
    )


def first_source(landed: DataFrame, whole_asset: bool = True) -> DataFrame:
    """Bars of the best source that landed any. landed has asset, source and bar columns.

    One source serves a whole asset, as a fallback is tried only when the one before failed;
    with whole_asset=False the choice is made per day.
    """
    ranked = landed.withColumn("_rank", F.array_position(route(F.col("asset")), F.col("source"))).filter("_rank > 0")
    if whole_asset:
        best = ranked.groupBy("asset").agg(F.min("_rank").alias("_rank"))
        return ranked.join(best, ["asset", "_rank"], "left_semi").drop("_rank")
    row = F.struct(*[F.col(c) for c in landed.columns if c not in ("asset", "ts")])
    picked = ranked.withColumn("_row", row).groupBy("asset", "ts").agg(F.min_by("_row", "_rank").alias("r"))
    return picked.select("asset", "ts", "r.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Keys = ("asset", "ts"), seq: str = "ingest_seq") -> DataFrame:
    """Union where the last write per key wins. An aggregation: only the newest row of a key
    crosses the shuffle, and repeating an upsert changes nothing."""
    both = existing.unionByName(incoming)
    row = F.struct(*[F.col(c) for c in both.columns if c not in keys])
    newest = both.withColumn("_row", row).groupBy(*keys).agg(
        F.max_by("_row", F.struct(F.col(seq), "_row")).alias("r")
    )
    return newest.select(*keys, "r.*")


def write_store(bars: DataFrame, path: str) -> None:
    """Bars by year; a run replaces only the years it holds."""
    (
        bars.withColumn("year", F.year("ts"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def _merge(ranges: DataFrame, keys: Keys) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = reach.isNull() | (F.col("start") > F.date_add(reach, 1))
    return (
        ranges.withColumn("_new", fresh.cast("int"))
        .withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_island")
    )


def merge_ranges(coverage: DataFrame, key: str = "symbol") -> DataFrame:
    """Merge ranges that overlap or touch within a day; ranges that end before they start go.

    A symbol may hold any number of ranges, so they are first merged per symbol and month of
    their start. What is left per symbol is bounded by the calendar and merged once more.
    """
    valid = coverage.select(key, "start", "end").filter(F.col("end") >= F.col("start"))
    distinct = valid.groupBy(key, "start").agg(F.max("end").alias("end"))
    monthly = _merge(distinct.withColumn("_month", F.trunc("start", COVER_BUCKET)), (key, "_month"))
    return _merge(monthly.drop("_month"), (key,))


def covered(requests: DataFrame, coverage: DataFrame, key: str = "symbol") -> DataFrame:
    """Requests(symbol, start, end) that one merged range holds completely."""
    held = coverage.select(
        F.col(key).alias("_k"), F.col("start").alias("_a"), F.col("end").alias("_b")
    )
    inside = (requests[key] == held["_k"]) & (held["_a"] <= requests["start"]) & (held["_b"] >= requests["end"])
    return requests.join(held, inside, "left_semi")


def rows_between(rows: DataFrame, start: str, end: str, day: str = "ts") -> DataFrame:
    return rows.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def health(requested: DataFrame, bars: DataFrame, start: str, end: str) -> DataFrame:
    """asset, status, rows, first and last date of each requested(asset)."""
    held = rows_between(bars, start, end)
    stats = held.groupBy("asset").agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("first_date"), F.max("ts").alias("last_date")
    )
    return requested.join(stats, "asset", "left").select(
        "asset", F.when(F.col("n_rows") > 0, "ok").otherwise("error").alias("status"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "first_date", "last_date",
    )


def universe_health(requested: DataFrame, bars: DataFrame, start: str, end: str, min_rows: int = 300) -> DataFrame:
    """One row: common dates of all requested assets, whether they can be run, and why not."""
    checks = health(requested, bars, start, end).withColumn("_all", F.lit(1))
    asked = checks.groupBy("_all").agg(
        F.count("*").alias("_n"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") != "ok", F.col("asset")))), "; ").alias("_bad"),
    )
    dates = (
        rows_between(bars, start, end).join(requested, "asset", "left_semi").groupBy("ts")
        .agg(F.count_distinct("asset").alias("_have")).withColumn("_all", F.lit(1))
    )
    common = dates.join(asked, "_all", "right").groupBy("_all", "_bad").agg(
        F.count_if(F.col("_have") == F.col("_n")).alias("common_rows"),
        F.min(F.when(F.col("_have") == F.col("_n"), F.col("ts"))).alias("common_start"),
        F.max(F.when(F.col("_have") == F.col("_n"), F.col("ts"))).alias("common_end"),
    )
    few = F.concat(
        F.lit("only "), F.col("common_rows").cast("string"), F.lit(f" common rows; need at least {min_rows}")
    )
    bad = F.col("_bad") != ""
    return common.select(
        "common_rows", "common_start", "common_end",
        (~bad & (F.col("common_rows") >= min_rows)).alias("runnable"),
        F.when(bad, F.concat(F.lit("no data: "), "_bad")).when(F.col("common_rows") < min_rows, few).otherwise("OK").alias("reason"),
    )
