"""SQL counterparts of plans.tables, shared by the oracle statements."""

from barframe.plans.registry import cte

cte("ticks", """
SELECT r_name AS asset, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS price,
       l_quantity AS qty, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""")
cte("ticks_n", """
SELECT n_name AS asset, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS price,
       l_quantity AS qty, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
_BARS = """
SELECT asset, {p} AS ts,
       first(price ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
       max(price) AS high, min(price) AS low,
       last(price ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close,
       sum(qty) AS volume, avg(price) AS avg_price
FROM {t} GROUP BY asset, {p}"""
cte("bars_d", _BARS.format(p="ts", t="ticks"))
cte("bars_w", _BARS.format(p="CAST(date_trunc('week', ts) AS DATE)", t="ticks"))
cte("bars_nw", _BARS.format(p="CAST(date_trunc('week', ts) AS DATE)", t="ticks_n"))
_CLOSES = """
SELECT asset, ts, close FROM (
  SELECT asset, ts, avg(avg_price) OVER w AS close, count(avg_price) OVER w AS n FROM {b}
  WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)
) WHERE n = {k} + 1"""
cte("closes_d", _CLOSES.format(b="bars_d", k=19))
cte("closes_w", _CLOSES.format(b="bars_w", k=7))
_PANEL = """
SELECT 'U' AS universe_id, ts, CAST(dense_rank() OVER (ORDER BY ts) - 1 AS INTEGER) AS pos, asset,
       CAST((SELECT count(*) FROM region WHERE r_name < asset) AS INTEGER) AS asset_ord, close
FROM {c} WHERE ts IN (
  SELECT ts FROM {c} GROUP BY ts HAVING count(*) = (SELECT count(*) FROM region))"""
cte("panel_d", _PANEL.format(c="closes_d"))
cte("panel_w", _PANEL.format(c="closes_w"))
cte("intraday", """
SELECT event_type AS asset, time_bucket(INTERVAL '4 hours', ts) AS ts,
       first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
       last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume,
       avg(value) AS avg_price
FROM events GROUP BY 1, 2""")
cte("rates", """
SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS obs_date,
       avg(o_totalprice) AS value FROM orders GROUP BY 1, 2""")
