import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barframe.operators import bars as B
from barframe.session import work_path
from barframe.sources import landed as La
from barframe.sources import logs as Lg
from barframe.sources import store as St
from barframe.streaming import books as Bk

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def test_json_rows_drop_holes_and_fill_volume(spark):
    path = work_path(spark, "rows")
    rows = [{"asset": "A", "date": f"{day(i)}T00:00:00Z", "adjOpen": None if i == 0 else 1.0, "adjHigh": 2.0, "adjLow": 0.5, "adjClose": 1.5, "adjVolume": None} for i in range(5)]
    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").write.text(path)
    got = La.adjusted_rows(La.read_json(spark, path, "asset string, " + La.ADJUSTED_ROW)).orderBy("ts").collect()
    assert [r.ts for r in got] == [day(i) for i in range(1, 5)] and all(r.volume == 0 for r in got)
    with pytest.raises(ValueError):
        La.adjusted_rows(spark.createDataFrame([("A",)], "asset string"))


def test_series_file_with_missing_marks(spark):
    path = work_path(spark, "series")
    spark.createDataFrame([("obs,value",), ("2020-01-01,1.5",), ("2020-01-02,.",), ("2020-01-03,x",), ("2020-01-04,2.5",)], "value string").coalesce(1).write.text(path)
    got = La.macro_series(La.read_series(spark, path).withColumn("series_id", F.lit("S"))).orderBy("obs_date").collect()
    assert [r.value for r in got] == [1.5, 2.5]


def test_tick_payload(spark):
    ms = 1577836800000
    prices = [[float(ms + 3600_000 * i), 100.0 + i] for i in range(30)]
    df = spark.createDataFrame([("A", prices, [[float(ms), 7.0], [float(ms + 1), 9.0]])], "asset string, prices array<array<double>>, total_volumes array<array<double>>")
    got = La.tick_payloads(df).orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(100.0, 123.0, 100.0, 123.0, 9.0), (124.0, 129.0, 124.0, 129.0, 0.0)]


def test_gates(spark):
    rows = [("A", day(i), 1.0, 1.0, 1.0, 1.0) for i in range(301)] + [("B", day(i), None if i == 0 else 1.0, 1.0, 1.0, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "asset string, ts date, open double, high double, low double, close double")
    kept = B.minimum_history(B.drop_incomplete(df), 300)
    assert [r.asset for r in kept.select("asset").distinct().collect()] == ["A"]


def test_store_upsert_is_idempotent(spark):
    one = spark.createDataFrame([("A", D0, 1.0, 1), ("A", day(1), 2.0, 1)], "asset string, ts date, close double, ingest_seq int")
    two = spark.createDataFrame([("A", day(1), 3.0, 2)], one.schema)
    got = St.upsert(St.upsert(one, two), two).orderBy("ts").collect()
    assert [(r.ts, r.close) for r in got] == [(D0, 1.0), (day(1), 3.0)]
    path = work_path(spark, "store")
    St.write_store(one, path)
    St.write_store(two, path)
    assert spark.read.parquet(path).count() == 1


def test_ranges_merge_across_months_when_they_touch(spark):
    r = [("A", D0, day(40)), ("A", day(41), day(50)), ("A", day(60), day(61)), ("A", day(10), day(5)), ("B", D0, D0)]
    df = spark.createDataFrame(r, "symbol string, start date, end date")
    got = sorted((x.symbol, x.start, x.end) for x in St.merge_ranges(df).collect())
    assert got == [("A", D0, day(50)), ("A", day(60), day(61)), ("B", D0, D0)]
    asks = spark.createDataFrame([("A", day(5), day(45)), ("A", day(45), day(60))], "symbol string, start date, end date")
    assert [x.start for x in St.covered(asks, St.merge_ranges(df)).collect()] == [day(5)]


def test_log_skips_damaged_lines_and_missing_files(spark):
    assert Lg.read_log(spark, work_path(spark, "nowhere")).count() == 0
    path = work_path(spark, "log")
    lines = ['{"timestamp": "t1", "mode": "portfolio", "params": {"assets": ["A", "B"]}}', "{broken", '{"timestamp": "t2", "mode": "stress"}']
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    assert sorted(r.timestamp for r in Lg.read_log(spark, path).collect()) == ["t1", "t2"]


def test_batch_file(spark, tmp_path):
    doc = {"defaults": {"family": "cross_sectional_momentum", "lookback": 126, "top_k": 2, "start": "2010-01-01", "end": "2025-01-01"},
           "portfolios": [{"name": "one", "assets": ["SPY", "TLT"]}, {"assets": "SPY, QQQ,GLD", "rebalance_days": 42, "family": "dual_momentum"}]}
    (tmp_path / "batch.json").write_text(json.dumps(doc, indent=1))
    got = Lg.read_batch(spark, f"file://{tmp_path}/batch.json").orderBy("idx").collect()
    assert [(r.assets, r.family, r.lookback, r.top_k, r.rebalance) for r in got] == [
        (["SPY", "TLT"], "cross_sectional_momentum", 126, 2, 21), (["SPY", "QQQ", "GLD"], "dual_momentum", 126, 2, 42)]
    assert got[1].name == "Dual Momentum (SPY, QQQ, GLD)"


def test_guards(spark):
    rows = [(1, {"A": 1.0, "B": 2.0}, {"A": 0.5, "B": 0.5}), (2, {"A": 0.0, "B": 2.0}, None), (3, {"A": 1.0, "B": 2.0}, {"A": 0.5}),
            (4, {"A": 1.0, "B": 2.0}, {"A": -0.5, "B": 0.5}), (5, {"A": 1.0, "B": 2.0}, {"A": 0.9, "B": 0.5}), (6, {"A": 1.0}, None)]
    df = spark.createDataFrame(rows, "book_id int, closes map<string,double>, weights map<string,double>")
    good, bad = Bk.split_valid(df)
    assert sorted(r.book_id for r in good.collect()) == [1, 6]
    assert {r.book_id: r.problems for r in bad.collect()} == {
        2: ["invalid close price"], 3: ["partial target weights"], 4: ["negative target weight"], 5: ["target weights sum above 1"]}


def test_live_book_stream(spark):
    """Two files, then the first one again: same ledger, nothing added."""
    landing, out, state = (work_path(spark, n) for n in ("bars", "ledger", "state"))
    closes = [100.0, 100.0, 100.0, 110.0, 120.0]
    rows = [("b", day(i), {"AAA": c}, {"AAA": 1.0} if i == 2 else None) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, Bk.BOOK_BAR)

    def land(a, b):
        df.filter((F.col("ts") >= F.lit(day(a))) & (F.col("ts") < F.lit(day(b)))).coalesce(1).write.mode("append").parquet(landing)

    def tick():
        stream = spark.readStream.schema(Bk.BOOK_BAR).option("maxFilesPerTrigger", 1).parquet(landing)
        Bk.run_available(Bk.ledger_stream(stream, 0.0, 10_000.0), out, state)
        return [r.post_nav for r in spark.read.parquet(out).orderBy("ts").collect()]

    land(0, 3)
    assert tick() == [10_000.0] * 3
    land(3, 5)
    assert tick() == pytest.approx([10_000.0, 10_000.0, 10_000.0, 11_000.0, 12_000.0])
    land(0, 3)
    assert len(tick()) == 5


def test_rebalance_cost(spark):
    post, traded = Bk.rebalance(10_000.0, {"A": 0.0}, {"A": 1.0}, 0.0015)
    assert post == pytest.approx(10_000 / 1.0015) and traded == pytest.approx(post)


def test_whole_records_survive_write_and_read(spark):
    records = [
        {"timestamp": "t1", "mode": "event", "mechanism": "m", "params": {"leader": "A", "lag_days": 5, "assets": ["A", "B"]}, "metrics": {"train_sharpe": 1.25, "own": {"deep": [1, {"x": None}]}}, "gate_denominators": {"candidates": 6}},
        {"timestamp": "t2", "mode": "portfolio", "params": {"top_k": "many", "lookback_days": 30}, "initial_cash": 10000.5, "verdict": "reject"},
        {"verdict": "reject", "timestamp": "t3", "mode": "portfolio"},
    ]
    path, copy, table = (work_path(spark, n) for n in ("log", "log-copy", "log-table"))
    lines = [json.dumps(r) for r in records] + ["{broken", "", "[1, 2]", "7", '{"timestamp": "t3", "mode": "portfolio", "verdict": "reject"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    log = Lg.read_log(spark, path)
    got = {r.timestamp: r for r in log.withColumn("json", F.to_json("record")).collect()}
    assert {k: json.loads(r.json) for k, r in got.items()} == {r["timestamp"]: r for r in records}
    assert got["t2"].params.lookback_days == 30 and got["t2"].params.top_k is None  # of another type: kept in the record only
    Lg.append_records(log, copy)
    assert sorted(map(json.dumps, (json.loads(r.json) for r in Lg.read_log(spark, copy).select(F.to_json("record").alias("json")).collect()))) == sorted(
        map(json.dumps, (json.loads(r.json) for r in log.select(F.to_json("record").alias("json")).collect())))
    ids = [r.record_id for r in Lg.flat_log(log).collect()]
    assert len(ids) == 4 and len(set(ids)) == 3  # the order of fields makes no other record
    Lg.store_log(log, table)
    stored = spark.read.parquet(table)
    asked = stored.filter("mode = 'event'").select(
        Lg.field("params.leader").alias("leader"), Lg.field("metrics.own.deep[0]", "int").alias("deep"), Lg.field("gate_denominators.candidates", "int").alias("n"),
        Lg.field("no.such").alias("none"), Lg.field("params.leader", "int").alias("unfit"))
    assert tuple(asked.first()) == ("A", 1, 6, None, None)


def test_books_open_at_inception_and_are_handed_over(spark):
    """Inception, as_of, own cash and costs; a saved book goes on under a new checkpoint as if it had never stopped."""
    rows = [(b, day(i), {"A": 100.0 + i, "B": 50.0}, {"A": 0.5, "B": 0.3} if i % 3 == 0 else None) for b in ("x", "y", "shut") for i in range(12)]
    landing = work_path(spark, "bars")
    spark.createDataFrame(rows, Bk.BOOK_BAR).coalesce(1).write.parquet(landing)
    books = spark.createDataFrame([
        ("x", day(2), 1000.0, 0.01, None, None, "open"), ("y", day(0), 5000.0, 0.0, {"A": 10.0}, day(3), "open"), ("shut", day(0), 1.0, 0.0, None, None, "closed"),
    ], Bk.BOOK)

    def tick(held, as_of, out, state):
        stream = spark.readStream.schema(Bk.BOOK_BAR).parquet(landing)
        Bk.run_available(Bk.ledger_stream(Bk.opened(stream, held, F.lit(as_of))), out, state)
        return spark.read.parquet(out)

    whole = tick(books, day(9), work_path(spark, "out"), work_path(spark, "state")).cache()
    got = {(r.book_id, (r.ts - D0).days): r for r in whole.collect()}
    assert sorted(i for b, i in got if b == "x") == list(range(2, 10)) and sorted(i for b, i in got if b == "y") == list(range(4, 10))
    assert {b for b, _ in got} == {"x", "y"}
    assert got["x", 2].post_nav == 1000.0 and got["x", 2].target_weights == {"A": 0.0, "B": 0.0} and got["x", 2].closes == {"A": 102.0, "B": 50.0}
    assert got["x", 3].is_order and got["x", 3].target_weights == {"A": 0.5, "B": 0.3} and got["x", 3].costs > 0
    r = got["x", 4]
    assert r.target_weights["A"] == pytest.approx(r.positions["A"] * 104.0 / r.post_nav) and r.target_weights["A"] > 0.5
    assert got["y", 4].post_nav == 5000.0 + 10 * 104.0  # goes on from its saved cash and shares
    first = tick(books, day(5), work_path(spark, "out"), work_path(spark, "state"))
    saved = work_path(spark, "books")
    Bk.handed_over(first, books).write.parquet(saved)
    second = tick(spark.read.schema(Bk.BOOK).parquet(saved), day(9), work_path(spark, "out"), work_path(spark, "state"))
    both = {(r.book_id, (r.ts - D0).days): r for r in first.unionByName(second).collect()}
    assert set(both) == set(got)
    assert all(both[k].post_nav == pytest.approx(got[k].post_nav) and both[k].positions == pytest.approx(got[k].positions) for k in got)
