"""Streaming queries: bars from ticks and live books from bars, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.functions.scalars import packed_key
from barframe.operators import replay as R
from barframe.plans import portfolio_q as PQ
from barframe.plans import tables as T
from barframe.plans.registry import cte, query, rounded
from barframe.session import work_path, written
from barframe.streaming import bars as SB
from barframe.streaming import books as Bk
from barframe.streaming import corrections as Co

COST = R.COMMISSION + R.SLIPPAGE


_STREAM_BARS = """SELECT asset, ts, open, high, low, close, volume FROM intraday
WHERE ts + INTERVAL 4 HOUR <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTE"""


@query("r6_stream_bars", _STREAM_BARS)
def r6(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    ticks = raw.select("event_id", F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    out = work_path(spark, "stream-bars")
    Bk.run_available(SB.stream_bars(ticks, "4 hours", tie_break=("event_id",)), out, work_path(spark, "stream-bars-state"))
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


TICK = "event_id long, asset string, ts timestamp, price double"


def corrected(spark, sf):
    """Ticks in three deliveries: the first half, the second half, then every tenth tick of both, late."""
    ticks = T.events(spark, sf).select("event_id", "asset", "ts", F.col("price").cast("double"))
    landing, path, state = work_path(spark, "ticks-landing"), work_path(spark, "corrected-bars"), work_path(spark, "corrected-state")
    late = F.col("event_id") % 10 == 0
    lo, hi = ticks.agg(F.min("ts"), F.max("ts")).first()
    half = F.col("ts") < F.lit(lo + (hi - lo) / 2)
    rank = packed_key((F.unix_micros("ts"), 18), (F.col("event_id"), 19))
    for part in (~late & half, ~late & ~half, late):
        ticks.filter(part).write.mode("append").parquet(landing)
        Co.run_corrections(spark.readStream.schema(TICK).parquet(landing), path, state, "4 hours", "10 minutes", rank)
    return path


@query("r6_corrected_bars", _STREAM_BARS)
def r6_corrected(spark, sf):
    bars = Co.current_bars(spark, corrected(spark, sf))
    return bars.select("asset", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


@query("r6_late_ticks", """SELECT event_id, event_type AS asset, value AS price FROM events WHERE event_id % 10 = 0
AND time_bucket(INTERVAL '4 hours', ts) + INTERVAL 4 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events WHERE event_id % 10 <> 0)""")
def r6_late(spark, sf):
    return Co.late_ticks(spark, corrected(spark, sf), TICK).select("event_id", "asset", "price")


def book_bars(spark, sf, *ids):
    """One row per book and bar: prices of its assets and, on order dates, its target weights."""
    panel, runs, w = PQ.family_weights(spark, sf, *ids)
    bars = R.run_bars(panel, runs).join(
        w.select("run_id", F.col("exec_pos").alias("pos"), "asset", "weight"), ["run_id", "pos", "asset"], "left")
    packed = bars.groupBy(F.col("run_id").alias("book_id"), "ts").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "close")))).alias("closes"),
        F.array_sort(F.collect_list(F.when(F.col("weight").isNotNull(), F.struct("asset", "weight")))).alias("_w"))
    return packed.withColumn("weights", F.when(F.size("_w") > 0, F.map_from_entries("_w"))).drop("_w")


def live_ledger(spark, sf, *ids, again: bool = False, books=None, as_of=None):
    """Bars land as one write and are ticked; with again, a part of them is delivered before, so the
    books have to go on from their state and ignore what they have seen."""
    bars = Bk.split_valid(book_bars(spark, sf, *ids))[0]
    staged, landing = work_path(spark, "book-bars"), work_path(spark, "landing")
    out, state = work_path(spark, "ledger"), work_path(spark, "ledger-state")
    bars.write.parquet(staged)
    table = spark.read.schema(Bk.BOOK_BAR).parquet(staged)

    def deliver(part):
        part.repartition("book_id").write.mode("append").parquet(landing)
        stream = spark.readStream.schema(Bk.BOOK_BAR).parquet(landing)
        ledger = Bk.ledger_stream(stream, COST, R.INITIAL_CASH) if books is None else Bk.ledger_stream(Bk.opened(stream, books, as_of))
        Bk.run_available(ledger, out, state)

    if again:
        deliver(table.filter(F.col("ts") < F.lit("1997-07-01").cast("date")))
    deliver(table)
    return spark.read.parquet(out)


_LEDGER = """SELECT f.run_id AS book_id, p.ts, f.is_order, round(f.nav, 3) AS post_nav, round(f.paid, 3) AS costs, round(f.traded, 3) AS traded_value
FROM fam_nav f JOIN (SELECT DISTINCT pos, ts FROM panel_d) p ON p.pos = f.pos WHERE f.pos >= 0"""


@query("r1_r2_r5_live_books", _LEDGER)
def r2(spark, sf):
    led = live_ledger(spark, sf, again=True).select("book_id", "ts", "is_order", "post_nav", "costs", "traded_value")
    return rounded(led, 3, "post_nav", "costs", "traded_value")


INCEPTION, AS_OF = "1996-03-01", "2000-06-30"
cte("wt_live", f"SELECT * FROM wt_all WHERE exec_pos >= (SELECT min(pos) FROM panel_d WHERE ts >= DATE '{INCEPTION}')")
PQ.sequential_nav("live", "panel_d", "wt_live")


@query("r1_book_inception_as_of", f"""SELECT f.run_id AS book_id, p.ts, f.is_order, round(f.nav, 3) AS post_nav, round(f.paid, 3) AS costs, round(f.traded, 3) AS traded_value
FROM live_nav f JOIN (SELECT DISTINCT pos, ts FROM panel_d) p ON p.pos = f.pos WHERE p.ts BETWEEN DATE '{INCEPTION}' AND DATE '{AS_OF}'""")
def r1_inception(spark, sf):
    """Books opened at a later day with their own cash and costs, ticked up to a given day, twice."""
    ids = book_bars(spark, sf).select("book_id").distinct()
    books = ids.select(
        "book_id", F.lit(INCEPTION).cast("date").alias("inception_date"), F.lit(R.INITIAL_CASH).alias("cash"), F.lit(COST).alias("cost_rate"),
        F.lit(None).cast("map<string,double>").alias("positions"), F.lit(None).cast("date").alias("last_bar_date"), F.lit("open").alias("status"))
    led = live_ledger(spark, sf, again=True, books=written(books, "books"), as_of=F.lit(AS_OF).cast("date"))
    led = led.select("book_id", "ts", "is_order", "post_nav", "costs", "traded_value")
    return rounded(led, 3, "post_nav", "costs", "traded_value")


@query("v14_live_book_status", """SELECT run_id AS book_id, count(*) AS forward_days, round((arg_max(nav, pos) / 10000 - 1) * 100, 4) AS realized_return_pct, round(min(nav / peak - 1) * 100, 4) AS realized_max_drawdown_pct,
CASE WHEN min(nav / peak - 1) * 100 < -60 THEN 'DRAWDOWN_BREACH' WHEN count(*) < 63 THEN 'TOO_EARLY' WHEN arg_max(nav, pos) < 10000 THEN 'DIVERGING' ELSE 'TRACKING' END AS status
FROM (SELECT *, max(nav) OVER (PARTITION BY run_id ORDER BY pos) AS peak FROM fam_nav WHERE pos >= 0) GROUP BY 1""")
def v14(spark, sf):
    led = live_ledger(spark, sf)
    books = led.select("book_id").distinct().select(
        "book_id", F.lit(R.INITIAL_CASH).alias("initial_cash"), F.lit(5.0).alias("expected_annualized_pct"), F.lit(-60.0).alias("backtest_max_drawdown_pct"))
    out = Bk.ledger_status(led, books).select("book_id", "forward_days", "realized_return_pct", "realized_max_drawdown_pct", "status")
    return rounded(out, 4, "realized_return_pct", "realized_max_drawdown_pct")


@query("r4_bar_guards", """SELECT o_orderkey AS book_id, CASE WHEN o_orderkey % 6 = 1 THEN 'invalid close price' WHEN o_orderkey % 6 = 2 THEN 'partial target weights' WHEN o_orderkey % 6 = 3 THEN 'negative target weight'
WHEN o_orderkey % 6 = 4 THEN 'target weights sum above 1' END AS problem FROM orders WHERE o_orderkey % 6 BETWEEN 1 AND 4""")
def r4(spark, sf):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    kind = key % 6
    a, b = F.lit("AAA"), F.lit("BBB")
    weights = (
        F.when(kind == 2, F.create_map(a, F.lit(0.5))).when(kind == 3, F.create_map(a, F.lit(-0.1), b, F.lit(0.5)))
        .when(kind == 4, F.create_map(a, F.lit(0.8), b, F.lit(0.5))).when(kind == 5, F.create_map(a, F.lit(0.5), b, F.lit(0.5))))
    rows = T.table(spark, sf, "orders").select(
        key.alias("book_id"), F.to_date("o_orderdate").alias("ts"), F.create_map(a, price, b, F.when(kind == 1, -1.0).otherwise(price)).alias("closes"), weights.alias("weights"))
    return Bk.split_valid(rows)[1].select("book_id", F.col("problems")[0].alias("problem"))


@query("r3_cost_fixed_point", """WITH RECURSIVE o AS (SELECT o_orderkey AS k, 0.2 + (o_orderkey % 5) / 10 AS w1, 0.3::DOUBLE AS w2, (o_custkey % 7) / 10 AS v1, 0.2::DOUBLE AS v2 FROM orders),
it AS (SELECT k, w1, w2, v1, v2, 1.0::DOUBLE AS x, 0 AS n FROM o UNION ALL SELECT k, w1, w2, v1, v2, 1 - 0.0015 * (abs(w1 * x - v1) + abs(w2 * x - v2)), n + 1 FROM it WHERE n < 10)
SELECT k AS o_orderkey, round(x, 9) AS factor FROM it WHERE n = 10""")
def r3(spark, sf):
    from barframe.functions.costs import cost_factor

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    legs = F.array(
        F.struct((0.2 + (key % 5) / 10).alias("w"), ((cust % 7) / 10).alias("v")), F.struct(F.lit(0.3).alias("w"), F.lit(0.2).alias("v")))
    df = T.table(spark, sf, "orders").select("o_orderkey", cost_factor(legs, F.lit(1.0), F.lit(COST)).alias("factor"))
    return rounded(df, 9, "factor")
