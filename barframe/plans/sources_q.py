"""Queries on landed files, the bar store, coverage and logs. Provider rows are derived from the
given tables, in the providers' shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.plans import tables as T
from barframe.plans.bars_q import OHLC
from barframe.plans.registry import cte, query, rounded
from barframe.session import work_path
from barframe.sources import landed as La
from barframe.sources import logs as Lg
from barframe.sources import store as St

BARS = "SELECT asset, ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume FROM {t}"


def _round(df):
    return rounded(df, 8, *OHLC)


@query("s1_adjusted_json_rows", BARS.format(t="(SELECT asset, ts, open, high, low, close, CASE WHEN day(ts) % 5 = 0 THEN 0 ELSE volume END AS volume FROM bars_nw WHERE day(ts) % 11 <> 0)"))
def s1(spark, sf):
    """Weekly bars written out as JSON rows with holes, then read back as landed files."""
    bars = T.bars(spark, sf, "week", "nation")
    day = F.dayofmonth("ts")
    rows = bars.select(
        "asset", F.concat(F.col("ts").cast("string"), F.lit("T00:00:00.000Z")).alias("date"), F.when(day % 11 != 0, F.col("open")).alias("adjOpen"),
        F.col("high").alias("adjHigh"), F.col("low").alias("adjLow"), F.col("close").alias("adjClose"), F.when(day % 5 != 0, F.col("volume")).alias("adjVolume"))
    path = work_path(spark, "adjusted-rows")
    Lg.append_json(rows, path)
    return _round(La.adjusted_rows(La.read_json(spark, path, "asset string, " + La.ADJUSTED_ROW)))


@query("s2_split_adjusted", """SELECT asset, ts, round(open * 0.5, 8) AS open, round(high * 0.5, 8) AS high, round(low * 0.5, 8) AS low, round(close * 0.5, 8) AS close, volume
FROM bars_nw WHERE day(ts) % 13 <> 0""")
def s2(spark, sf):
    bars = T.bars(spark, sf, "week", "nation")
    zero = F.dayofmonth("ts") % 13 == 0
    rows = bars.select(
        "asset", F.col("ts").cast("string").alias("date"), "open", "high", "low", F.when(zero, 0.0).otherwise(F.col("close")).alias("close"),
        (F.col("close") * 0.5).alias("adj_close"), "volume")
    return rounded(La.split_adjusted(rows), 8, *OHLC)


@query("s3_csv_bars", BARS.format(t="bars_nw"))
def s3(spark, sf):
    bars = T.bars(spark, sf, "week", "nation")
    path = work_path(spark, "csv-bars")
    Lg.write_csv(bars.select("asset", F.col("ts").cast("string").alias("Date"), *[F.col(c).alias(c.title()) for c in (*OHLC, "volume")]), path)
    return _round(La.csv_rows(La.read_csv(spark, path, "asset string, " + La.CSV_ROW)))


def series_rows(spark, sf):
    o = T.table(spark, sf, "orders")
    value = F.when(F.col("o_orderkey") % 9 == 0, ".").otherwise(F.col("o_totalprice").cast("string"))
    return o.select(F.concat(F.lit("X"), F.col("o_orderkey").cast("string")).alias("series_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("obs"), value.alias("value"))


_SERIES = "FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderdate BETWEEN '1996-01-01' AND '1999-12-31'"


@query("s4_close_only_bars", f"""SELECT 'X' || o_orderkey AS asset, CAST(o_orderdate AS DATE) AS ts, o_totalprice AS open, o_totalprice AS high, o_totalprice AS low, o_totalprice AS close, 0.0::DOUBLE AS volume {_SERIES}""")
def s4(spark, sf):
    return La.close_only_bars(La.macro_series(series_rows(spark, sf), "1996-01-01", "1999-12-31"))


@query("s5_macro_series", f"SELECT 'X' || o_orderkey AS series_id, CAST(o_orderdate AS DATE) AS obs_date, o_totalprice AS value {_SERIES}")
def s5(spark, sf):
    return La.macro_series(series_rows(spark, sf), "1996-01-01", "1999-12-31")


@query("s6_tick_payloads", """WITH e AS (SELECT event_type AS asset, epoch_ms(ts) AS ms, CAST(ts AS DATE) AS d, value AS v, event_id FROM events)
SELECT b.asset, b.ts, open, high, low, close, coalesce(volume, 0) AS volume FROM (SELECT asset, d AS ts, arg_min(v, (ms, v)) AS open, max(v) AS high, min(v) AS low, arg_max(v, (ms, v)) AS close FROM e GROUP BY 1, 2) b
LEFT JOIN (SELECT asset, d AS ts, arg_max(v * 2, (ms, v * 2)) AS volume FROM e WHERE event_id % 50 = 0 GROUP BY 1, 2) w ON w.asset = b.asset AND w.ts = b.ts""")
def s6(spark, sf):
    """Payload documents of at most a thousand ticks each."""
    e = T.events(spark, sf)
    ms = F.unix_millis("ts").cast("double")
    docs = e.groupBy("asset", F.floor(F.col("event_id") / 1000).alias("page")).agg(F.to_json(F.struct(
        F.collect_list(F.array(ms, F.col("price"))).alias("prices"),
        F.collect_list(F.when(F.col("event_id") % 50 == 0, F.array(ms, F.col("price") * 2))).alias("total_volumes"))).alias("doc"))
    return La.tick_payloads(docs.select("asset", F.from_json("doc", La.TICK_PAYLOAD).alias("d")).select("asset", "d.*"))


@query("s7_price_pages", """SELECT 'P' || o_orderkey AS asset, CAST(o_orderdate AS DATE) AS ts, o_totalprice AS open, o_totalprice AS high, o_totalprice AS low, o_totalprice AS close, 0.0::DOUBLE AS volume FROM orders WHERE o_orderkey % 8 <> 0""")
def s7(spark, sf):
    o = T.table(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 8 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    item = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("time"), price.alias("PriceUSD"))
    doc = F.to_json(F.struct(F.array(item).alias("data")))
    pages = o.select(F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("asset"), F.from_json(doc, La.PRICE_PAGE)["data"].alias("data"))
    return La.price_pages(pages)


_LAND = """SELECT asset, ts, close, src AS source FROM bars_nw, (VALUES ('tiingo'), ('yfinance'), ('stooq'), ('fred')) s(src)
WHERE (src = 'stooq') OR (src = 'yfinance' AND length(asset) % 3 = 0) OR (src = 'tiingo' AND length(asset) % 5 = 0) OR src = 'fred'"""


@query("s8_source_priority", f"""SELECT asset, ts, round(close, 8) AS close, source FROM (SELECT *, CASE source WHEN 'tiingo' THEN 1 WHEN 'yfinance' THEN 2 ELSE 3 END AS r,
min(CASE source WHEN 'tiingo' THEN 1 WHEN 'yfinance' THEN 2 ELSE 3 END) OVER (PARTITION BY asset) AS best FROM ({_LAND}) WHERE source <> 'fred') WHERE r = best""")
def s8(spark, sf):
    n = F.length("asset")
    sources = F.array_compact(F.array(F.lit("stooq"), F.lit("fred"), F.when(n % 3 == 0, "yfinance"), F.when(n % 5 == 0, "tiingo")))
    bars = T.bars(spark, sf, "week", "nation").select("asset", "ts", "close")
    return rounded(St.first_source(bars.withColumn("source", F.explode(sources))), 8, "close")


@query("s8_symbol_routes", """SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN 'coinmetrics' WHEN p_partkey % 5 = 2 THEN 'fred' ELSE 'tiingo,yfinance,stooq' END AS sources FROM part""")
def s8b(spark, sf):
    names = F.array(*[F.lit(s) for s in ("BTC-USD", " xbt", "NDX", "SPY", "GLD")])
    symbol = F.get(names, (F.col("p_partkey") % 5).cast("int"))
    return T.table(spark, sf, "part").select("p_partkey", F.array_join(St.route(symbol), ",").alias("sources"))


@query("s9_bar_store_upsert", """SELECT o_custkey AS asset, CAST(o_orderdate AS DATE) AS ts, arg_max(o_totalprice, o_orderkey) AS close, max(o_orderkey) AS ingest_seq FROM orders GROUP BY 1, 2""")
def s9(spark, sf):
    """Two landings with repeats; the first one arrives again at the end."""
    rows = T.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("asset"), F.to_date("o_orderdate").alias("ts"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("ingest_seq"))
    old, new = rows.filter("ingest_seq % 3 = 0"), rows.filter("ingest_seq % 3 <> 0")
    return St.upsert(St.upsert(old, new), old)


cte("ranges", "SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 - 3 AS INTEGER) AS b FROM orders")
cte("merged", """SELECT symbol, min(a) AS a, max(b) AS b FROM (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY a, b) AS g
FROM (SELECT *, max(b) OVER (PARTITION BY symbol ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges WHERE b >= a)) GROUP BY symbol, g""")


def coverage(spark, sf):
    day = F.to_date("o_orderdate")
    return T.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("symbol"), day.alias("start"), F.date_add(day, (F.col("o_orderkey") % 90 - 3).cast("int")).alias("end"))


@query("w25_coverage_merge", 'SELECT symbol, a AS start, b AS "end" FROM merged')
def w25(spark, sf):
    return St.merge_ranges(coverage(spark, sf))


@query("w26_coverage_containment", """SELECT c_custkey AS symbol, q.a AS start, q.b AS "end" FROM (SELECT c_custkey, DATE '1996-01-01' + CAST(c_custkey % 1500 AS INTEGER) AS a,
DATE '1996-01-01' + CAST(c_custkey % 1500 + c_custkey % 20 AS INTEGER) AS b FROM customer) q WHERE EXISTS (SELECT 1 FROM merged m WHERE m.symbol = q.c_custkey AND m.a <= q.a AND m.b >= q.b)""")
def w26(spark, sf):
    base, key = F.lit("1996-01-01").cast("date"), F.col("c_custkey")
    asks = T.table(spark, sf, "customer").select(
        key.alias("symbol"), F.date_add(base, (key % 1500).cast("int")).alias("start"), F.date_add(base, (key % 1500 + key % 20).cast("int")).alias("end"))
    return St.covered(asks, St.merge_ranges(coverage(spark, sf)))


@query("p5_store_day_slice", "SELECT asset, ts, round(close, 8) AS close FROM bars_nw WHERE ts BETWEEN DATE '1998-01-05' AND DATE '1998-12-28'")
def p5(spark, sf):
    """Bars written by year and read back for a span: only its year is read."""
    path = work_path(spark, "bar-store")
    St.write_store(T.bars(spark, sf, "week", "nation"), path)
    held = spark.read.parquet(path).filter("year = 1998")
    return rounded(St.rows_between(held, "1998-01-05", "1998-12-28").select("asset", "ts", "close"), 8, "close")


_ASKED = "(SELECT n_name AS asset FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'NOWHERE')"


def requested(spark, sf):
    names = T.table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("asset"))
    extra = T.table(spark, sf, "region").agg(F.lit("NOWHERE").alias("asset"))
    return names.unionByName(extra)


@query("a36_data_health", f"""SELECT q.asset, CASE WHEN n > 0 THEN 'ok' ELSE 'error' END AS status, coalesce(n, 0) AS n_rows, first_date, last_date FROM {_ASKED} q
LEFT JOIN (SELECT asset, count(*) AS n, min(ts) AS first_date, max(ts) AS last_date FROM bars_nw WHERE ts BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1) b ON b.asset = q.asset""")
def a36(spark, sf):
    return St.health(requested(spark, sf), T.bars(spark, sf, "week", "nation"), "1996-01-01", "2000-12-31")


@query("a36_universe_health", f"""WITH q AS {_ASKED}, d AS (SELECT ts, count(DISTINCT asset) AS have FROM bars_nw WHERE ts BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND asset IN (SELECT asset FROM q WHERE asset <> 'NOWHERE') GROUP BY 1),
c AS (SELECT count(*) AS common_rows, min(ts) AS common_start, max(ts) AS common_end FROM d WHERE have = (SELECT count(*) FROM q WHERE asset <> 'NOWHERE'))
SELECT common_rows, common_start, common_end, common_rows >= 100 AS runnable, CASE WHEN common_rows >= 100 THEN 'OK' ELSE 'only ' || common_rows || ' common rows; need at least 100' END AS reason FROM c""")
def a36b(spark, sf):
    asked = requested(spark, sf).filter("asset <> 'NOWHERE'")
    return St.universe_health(asked, T.bars(spark, sf, "week", "nation"), "1996-01-01", "2000-12-31", 100)


@query("s10_research_log_files", "SELECT strategy_family, verdict, count(*) AS n, round(sum(sharpe), 4) AS sharpe_sum FROM (SELECT family AS strategy_family, verdict, sharpe FROM rlog) GROUP BY 1, 2")
def s10(spark, sf):
    """The log written as nested JSON lines, with one damaged line beside it, and read back."""
    log = T.research_log(spark, sf)
    path = work_path(spark, "research-log")
    nested = log.select(
        "timestamp", "mode", "slate_id", "is_lockbox", "asset", "strategy_family", F.col("start_date").cast("string"), F.col("end_date").cast("string"),
        F.struct("assets", F.col("lookback").cast("int").alias("lookback_days"), F.col("top_k").cast("int").alias("top_k"), F.col("rebalance").alias("rebalance_days")).alias("params"),
        F.struct("total_return_pct", F.col("buy_and_hold_pct").alias("buy_and_hold_return_pct"), "sharpe_ratio", "max_drawdown_pct", F.col("num_trades").cast("int").alias("num_trades"), "beats_benchmark").alias("metrics"),
        "failed_checks", "verdict", "learning_status")
    Lg.append_json(nested, path)
    log.limit(1).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    read = Lg.flat_log(Lg.read_log(spark, path))
    out = read.groupBy("strategy_family", "verdict").agg(F.count("*").alias("n"), F.sum("sharpe_ratio").alias("sharpe_sum"))
    return rounded(out, 4, "sharpe_sum")


@query("s11_paper_log_files", "SELECT position_id, family AS strategy_family FROM paper")
def s11(spark, sf):
    pos = T.paper_positions(spark, sf)
    path = work_path(spark, "paper-log")
    Lg.append_json(pos.select(F.col("position_id").cast("string").alias("id"), "strategy_family", F.struct("assets").alias("params"), "status"), path)
    return Lg.read_log(spark, path, Lg.PAPER_LOG).select(F.col("id").cast("bigint").alias("position_id"), "strategy_family")


@query("s12_book_table", "SELECT c_custkey AS book_id, CAST('1997-01-01' AS DATE) + CAST(c_custkey % 900 AS INTEGER) AS inception_date, c_acctbal AS cash FROM customer WHERE c_custkey % 2 = 0")
def s12(spark, sf):
    key = F.col("c_custkey")
    books = T.table(spark, sf, "customer").select(
        key.alias("book_id"), F.date_add(F.lit("1997-01-01").cast("date"), (key % 900).cast("int")).alias("inception_date"), F.col("c_acctbal").alias("cash"),
        F.create_map(F.lit("AAA"), F.col("c_acctbal") / 100).alias("positions"), F.when(key % 2 == 0, "open").otherwise("closed").alias("status"))
    path = work_path(spark, "books")
    Lg.save_books(books, path)
    return Lg.list_books(spark, path, only_open=True).select("book_id", "inception_date", "cash")


@query("s13_batch_specs", """SELECT p_partkey AS file_id, CAST(0 AS INTEGER) AS idx, 'SPY+TLT' AS assets, 'dual_momentum' AS family, CAST(p_size + 60 AS INTEGER) AS lookback, 2 AS top_k, 21 AS rebalance FROM part
UNION ALL SELECT p_partkey, 1, 'SPY+QQQ+GLD', 'fx_carry', 126, 1, CAST(p_size AS INTEGER) FROM part""")
def s13(spark, sf):
    """One batch document per part: two portfolios with defaults and aliases."""
    size = F.col("p_size").cast("string")
    doc = F.concat(
        F.lit('{"defaults": {"family": "dual_momentum", "top_k": 2}, "portfolios": [{"assets": "SPY, TLT", "lookback": '), (F.col("p_size") + 60).cast("string"),
        F.lit('}, {"assets": ["SPY", " QQQ", "GLD"], "portfolio_family": "fx_carry", "top-k": null, "top_k": 1, "rebalance_days": '), size, F.lit("}]}"))
    files = T.table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), F.from_json(doc, Lg.BATCH_FILE).alias("f"))
    path = work_path(spark, "batch-rows")
    files.select("file_id", "f.*").write.parquet(path)
    rows = spark.read.parquet(path)
    specs = Lg.batch_specs(rows, carry=("file_id",))
    return specs.select("file_id", "idx", F.array_join("assets", "+").alias("assets"), "family", "lookback", "top_k", "rebalance")


@query("s14_result_csv", "SELECT asset, count(*) AS n FROM bars_nw GROUP BY 1")
def s14(spark, sf):
    path = work_path(spark, "results")
    Lg.write_csv(T.bars(spark, sf, "week", "nation").groupBy("asset").count(), path)
    back = spark.read.schema("asset string, n bigint").option("header", True).csv(path)
    return back


@query("u2_u3_u4_date_sets", """WITH d AS (SELECT DISTINCT ts FROM bars_d WHERE asset = 'ASIA'), e AS (SELECT DISTINCT ts FROM bars_d WHERE asset = 'EUROPE')
SELECT (SELECT count(*) FROM (SELECT ts FROM d UNION SELECT ts FROM e)) AS n_union, (SELECT count(*) FROM (SELECT ts FROM d INTERSECT SELECT ts FROM e)) AS n_intersect,
(SELECT count(*) FROM (SELECT ts FROM d EXCEPT SELECT ts FROM e)) AS n_except""")
def u2(spark, sf):
    """One pass: the dates of either asset, with a flag for each."""
    d, e = (F.bool_or(F.col("asset") == a) for a in ("ASIA", "EUROPE"))
    days = T.ticks(spark, sf).filter(F.col("asset").isin("ASIA", "EUROPE")).groupBy("ts").agg(d.alias("d"), e.alias("e"))
    return days.agg(F.count("*").alias("n_union"), F.count_if(F.expr("d and e")).alias("n_intersect"), F.count_if(F.expr("d and not e")).alias("n_except"))


@query("u4_unmapped_assets", "SELECT n_name AS asset FROM nation WHERE n_name NOT IN (SELECT DISTINCT asset FROM ticks_n WHERE price > 100000)")
def u4(spark, sf):
    names = T.table(spark, sf, "nation").select(F.col("n_name").alias("asset"))
    return names.join(T.ticks(spark, sf, "nation").filter("price > 100000").select("asset"), "asset", "left_anti")
