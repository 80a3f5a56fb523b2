"""The given tables read as ticks, bars, panels, logs and specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barframe.functions.scalars import packed_key
from barframe.operators import bars as B

TIE_BREAK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(
    spark: SparkSession, sf: str, level: str = "region", span: tuple[str, str] | None = None
) -> DataFrame:
    """One tick per line item; the asset is the supplier's region or nation. A date span is
    compared with the raw column so that it reaches the parquet scan."""
    lines = table(spark, sf, "lineitem").select(*TIE_BREAK, "l_quantity", "l_shipdate")
    if span:
        lo, hi = (F.lit(d).cast("timestamp_ntz") for d in span)
        lines = lines.filter((F.col("l_shipdate") >= lo) & (F.col("l_shipdate") < hi + F.expr("interval 1 day")))
    # One dimension after the other: each right side is a plain table whose file size is known,
    # so whether it is broadcast follows from its real size.
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation")
    joined = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    name = "n_name"
    if level == "region":
        region = table(spark, sf, "region")
        joined = joined.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        name = "r_name"
    return joined.select(
        F.col(name).alias("asset"),
        F.to_date("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        *TIE_BREAK,
    )


def bars(
    spark: SparkSession,
    sf: str,
    period: str = "week",
    level: str = "region",
    span: tuple[str, str] | None = None,
) -> DataFrame:
    per = F.col("ts") if period == "day" else F.date_trunc(period, "ts").cast("date")
    rank = packed_key(
        (F.unix_date("ts"), 6), (F.col("l_orderkey"), 12), (F.col("l_linenumber"), 2), (F.col("l_partkey"), 10), (F.col("l_suppkey"), 8)
    )
    return B.resample(ticks(spark, sf, level, span), per, TIE_BREAK, rank=rank)


def universe(spark: SparkSession, sf: str) -> DataFrame:
    """The five regions in alphabetical order as one universe."""
    names = table(spark, sf, "region").select(
        F.lit("U").alias("universe_id"), F.col("r_name").alias("asset")
    )
    order = Window.partitionBy("universe_id").orderBy("asset")
    return names.withColumn("asset_ord", F.row_number().over(order) - 1)


def closes(spark: SparkSession, sf: str, period: str = "day") -> DataFrame:
    return B.smoothed_close(bars(spark, sf, period), 20 if period == "day" else 8)


def panel(spark: SparkSession, sf: str, period: str = "day") -> DataFrame:
    return B.aligned_panel(closes(spark, sf, period), universe(spark, sf))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("asset"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
    )


def intraday(spark: SparkSession, sf: str, width: str = "4 hours") -> DataFrame:
    start = F.window("ts", width)["start"]
    rank = packed_key((F.unix_micros("ts"), 18), (F.col("event_id"), 19))
    return B.resample(events(spark, sf), start, ("event_id",), qty=F.lit(1.0), rank=rank)


def rates(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly series, one per order priority."""
    return (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("series_id"),
            F.trunc(F.to_date("o_orderdate"), "month").alias("obs_date"),
        )
        .agg(F.avg("o_totalprice").alias("value"))
    )


# Fixed values for records derived from orders.
LOG_ASSETS = ("AAA", "BBB", "CCC", "DDD", "EEE")
LOG_FAMILIES = (
    "cross_sectional_momentum", "dual_momentum", "equal_weight_trend", "time_series_momentum",
    "volatility_scaled_momentum", "crisis_hedge", "cross_sectional_reversal", "fx_carry",
)
LOG_CHECKS = ("Benchmark comparison", "Drawdown sanity", "Portfolio walk-forward stability")


def research_log(spark: SparkSession, sf: str) -> DataFrame:
    """One log record per order."""
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date("o_orderdate")
    names = F.array(*[F.lit(a) for a in LOG_ASSETS])
    families = F.array(*[F.lit(f) for f in LOG_FAMILIES])
    pair = F.array(
        F.get(names, (key % 5).cast("int")), F.get(names, ((key + 1 + cust % 4) % 5).cast("int"))
    )
    portfolio, stress = key % 3 != 0, key % 11 == 0
    status = F.col("o_orderstatus")
    failed = F.array_compact(F.array(
        F.when(key % 2 == 0, LOG_CHECKS[0]), F.when(cust % 2 == 0, LOG_CHECKS[1]),
        F.when(key % 3 == 0, LOG_CHECKS[2]),
    ))
    return o.select(
        key.alias("record_id"),
        F.date_format(day, "yyyy-MM-dd'T'00:00:00'Z'").alias("timestamp"),
        F.when(stress, "stress").when(portfolio, "portfolio").otherwise("explore").alias("mode"),
        (key % 7 == 0).alias("is_lockbox"),
        F.when(portfolio, F.concat(F.lit("PORTFOLIO["), F.array_join(pair, ","), F.lit("]")))
        .otherwise(pair[0]).alias("asset"),
        F.when(portfolio, pair).otherwise(F.slice(pair, 1, 1)).alias("assets"),
        F.get(families, (key % 8).cast("int")).alias("strategy_family"),
        F.when(stress, F.when(status == "F", "ROBUST").otherwise("FRAGILE"))
        .when(status == "F", "worth_paper_trading").when(status == "O", "needs_more_testing")
        .otherwise("reject").alias("verdict"),
        F.when(key % 5 == 0, F.when(key % 10 == 0, "winner").otherwise("train_loser")).alias("learning_status"),
        failed.alias("failed_checks"),
        F.when(key % 13 != 0, F.col("o_totalprice") / 200000 - 1).alias("sharpe_ratio"),
        (F.col("o_totalprice") / 5000 - 40).alias("total_return_pct"),
        F.lit(20.0).alias("buy_and_hold_pct"),
        (F.col("o_totalprice") / 5000 - 40 > 20).alias("beats_benchmark"),
        (-(cust % 70)).cast("double").alias("max_drawdown_pct"),
        (key % 60).alias("num_trades"),
        F.date_sub(day, 1500).alias("start_date"),
        F.date_add(day, (cust % 500).cast("int")).alias("end_date"),
        F.concat(F.lit("S"), (cust % 200).cast("string")).alias("slate_id"),
        (20 + (cust % 4) * 21).alias("lookback"),
        (1 + key % 2).alias("top_k"),
        F.lit(21).alias("rebalance"),
    )


def paper_positions(spark: SparkSession, sf: str) -> DataFrame:
    """One paper position per customer."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    names = F.array(*[F.lit(a) for a in LOG_ASSETS])
    families = F.array(*[F.lit(f) for f in LOG_FAMILIES])
    lower = F.array(
        F.lower(F.get(names, (key % 5).cast("int"))), F.get(names, ((key + 1 + key % 4) % 5).cast("int"))
    )
    return c.select(
        key.alias("position_id"), F.get(families, (key % 9).cast("int")).alias("strategy_family"), lower.alias("assets"),
        F.when(key % 2 == 0, "open").otherwise("closed").alias("status"),
    )
