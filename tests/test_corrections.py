import datetime as dt
import random

from pyspark.sql import functions as F

from barframe.operators import bars as B
from barframe.streaming import corrections as Co

TICK = "n long, asset string, ts timestamp, price double"
BAR = ["asset", "ts", "open", "high", "low", "close", "volume"]
START = dt.datetime(2021, 3, 1)


def deliveries(seed, n=240, parts=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + dt.timedelta(minutes=rng.randrange(6 * 24 * 60))
        rows.append((i % 200, rng.choice("AAAB"), rng.choice([at] * 20 + [None]), rng.choice([float(i % 37), None])))
    # Mostly in order, a fifth anywhere.
    place = {i: (rng.randrange(parts) if rng.random() < 0.2 else (0 if r[2] is None else (r[2] - START).days * parts // 6)) for i, r in enumerate(rows)}
    return [[r for i, r in enumerate(rows) if place[i] == k] for k in range(parts)]


def rank():
    return F.unix_micros("ts") * 1000 + F.col("n")


def taken(spark, path, parts, again=()):
    for k, part in enumerate(parts):
        for _ in range(2 if k in again else 1):
            Co.take_batch(spark.createDataFrame(part, TICK), path, k, "4 hours", "30 minutes", rank())
    return Co.current_bars(spark, path)


def whole(spark, path, parts):
    """Bars of all ticks at once, as far as the last watermark."""
    ticks = spark.createDataFrame([r for p in parts for r in p], TICK).filter("ts is not null")
    out = B.resample(ticks, F.window("ts", "4 hours")["start"], ("n",), qty=F.lit(1.0))
    mark = F.timestamp_micros(F.lit(Co.watermark(spark, path)))
    return out.filter(F.col("ts") + F.expr("interval 4 hours") <= mark)


def rows(df):
    return sorted(map(tuple, df.select(*BAR).collect()), key=str)


def test_bars_after_late_delivery_equal_resampling(spark, tmp_path):
    for seed in (1, 2):
        parts = deliveries(seed)
        got = taken(spark, f"{tmp_path}/{seed}", parts, again=(1, 3) if seed == 2 else ())
        assert rows(got) == rows(whole(spark, f"{tmp_path}/{seed}", parts)) and got.filter("corrected").count() > 0


def test_late_ticks_and_the_bars_they_change(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    path = f"{tmp_path}/c"
    taken(spark, path, [[(1, "A", at(1), 5.0), (2, "A", at(9), 6.0)], [(3, "A", at(0), 9.0), (4, "A", None, 1.0)], []], again=(1,))
    assert [r.n for r in Co.late_ticks(spark, path, TICK).collect()] == [3]
    log = sorted((r.ingest_seq, r.ts, r.open, r.close, r.volume, r.corrected) for r in Co.revisions(spark, path).collect())
    assert log == [(0, at(0), 5.0, 5.0, 1.0, False), (1, at(0), 9.0, 5.0, 2.0, True)]
    held = Co.revisions(spark, path).filter("ingest_seq = 0").withColumn("asset", F.lit("B"))
    assert {r.asset: r.volume for r in Co.current_bars(spark, path, held).collect()} == {"A": 2.0, "B": 1.0}


def test_nothing_delivered(spark, tmp_path):
    assert Co.current_bars(spark, f"{tmp_path}/none").count() == 0
    assert taken(spark, f"{tmp_path}/e", [[], [(1, "A", None, 1.0)]]).count() == 0


def test_a_stream_takes_each_file_once(spark, tmp_path):
    parts = deliveries(5, n=60, parts=2)
    for part in [*parts, []]:
        if part:
            spark.createDataFrame(part, TICK).write.mode("append").parquet(f"{tmp_path}/in")
        Co.run_corrections(spark.readStream.schema(TICK).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", "4 hours", "30 minutes", rank())
    assert rows(Co.current_bars(spark, f"{tmp_path}/out")) == rows(whole(spark, f"{tmp_path}/out", parts))
