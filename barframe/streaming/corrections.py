"""Event-time bars that late ticks correct.

Every batch of ticks is folded to partial bars, mergeable rows of first and last tick, extremes and
count, and written to a folder of its own below one path:

    partials/batch=n/day=d   one row per asset, window and whether its ticks came late
    late/batch=n             the ticks whose window had been published before
    marks/batch=n            the watermark after the batch
    revisions/batch=n        bars published by the batch: windows the watermark has passed since the
                             batch before, and published windows that late ticks change

A published bar is always merged from the partial bars of all batches, never from an earlier bar, so a
batch that is run again after a failure writes the same folders and counts no tick twice. Only the days
that the batch publishes are read. `current_bars` upserts the revisions by asset and window, so bars
after late delivery equal those of resampling all ticks at once.

Defined cases: ticks without a time are in no window and dropped; a null price stays in its bar's order
as in resample; windows the watermark has not passed are not published yet; repeated ticks count each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.sources.store import upsert

RANK = "decimal(38,0)"
PARTIAL = (
    f"asset string, start timestamp, end timestamp, late boolean, first {RANK}, open double, high double, low double, "
    f"last {RANK}, close double, volume double, seen timestamp, batch long, day date"
)
BAR = "asset string, ts timestamp, open double, high double, low double, close double, volume double, corrected boolean"
MARK = "mark long, batch long"


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")


def _time(micros: int) -> Column:
    return F.timestamp_micros(F.lit(micros))


def watermark(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """Microseconds up to which windows are published, of all batches or those before one."""
    marks = _table(spark, path, "marks", MARK)
    return (marks if before is None else marks.filter(F.col("batch") < before)).agg(F.max("mark")).first()[0]


def _merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("asset", "start").agg(
        F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last").alias("close"), F.sum("volume").alias("volume"), F.max("late").alias("corrected"),
    ).withColumnRenamed("start", "ts")


def take_batch(ticks: DataFrame, path: str, batch: int, width: str, lateness: str, rank: Column) -> None:
    """Fold one batch of ticks(asset, ts, price) in. rank is a whole number that orders them."""
    spark = ticks.sparkSession
    old = watermark(spark, path, batch)
    window = F.window("ts", width)
    late = F.lit(False) if old is None else F.col("end") <= _time(old)
    rows = ticks.filter("ts is not null").withColumns({"start": window["start"], "end": window["end"]}).withColumn("late", late)
    order = rank.cast(RANK)
    folded = rows.groupBy("asset", "start", "end", "late").agg(
        F.min(order).alias("first"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max(order).alias("last"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"), F.max("ts").alias("seen"),
    ).withColumn("day", F.to_date("start"))
    folded.write.mode("overwrite").partitionBy("day").parquet(f"{path}/partials/batch={batch}")
    rows.filter("late").drop("late").write.mode("overwrite").parquet(f"{path}/late/batch={batch}")

    partials = _table(spark, path, "partials", PARTIAL).filter(F.col("batch") <= batch)
    mine = partials.filter(F.col("batch") == batch)
    reached = F.unix_micros(F.date_trunc("millisecond", F.max("seen")) - F.expr(f"interval {lateness}"))
    marks = [m for m in (old, mine.agg(reached).first()[0]) if m is not None]
    if not marks:
        return
    new = max(marks)
    passed = partials.filter((F.col("end") <= _time(new)) & (F.col("day") <= F.to_date(_time(new))))
    if old is not None:
        # A window that ends after the old mark starts at most its width before it.
        since = F.to_date(_time(old) - F.expr(f"interval {width}"))
        passed = passed.filter((F.col("end") > _time(old)) & (F.col("day") >= since))
    changed = mine.filter("late").select("day", "asset", "start").distinct()
    bars = _merged(passed.unionByName(partials.join(changed, ["day", "asset", "start"], "left_semi")))
    bars.write.mode("overwrite").parquet(f"{path}/revisions/batch={batch}")
    spark.range(1).select(F.lit(new).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch={batch}")


def run_corrections(ticks: DataFrame, path: str, checkpoint: str, width: str, lateness: str, rank: Column) -> None:
    """Take what a stream of ticks has delivered since the last call, then stop."""
    query = (
        ticks.writeStream.foreachBatch(lambda part, n: take_batch(part, path, n, width, lateness, rank))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def revisions(spark: SparkSession, path: str) -> DataFrame:
    """Every published bar, ingest_seq being its batch."""
    return _table(spark, path, "revisions", BAR + ", batch long").withColumnRenamed("batch", "ingest_seq")


def current_bars(spark: SparkSession, path: str, store: DataFrame | None = None) -> DataFrame:
    """The newest revision of every bar, laid over the bars of a store where one is given (the columns
    of revisions)."""
    new = revisions(spark, path)
    return upsert(spark.createDataFrame([], new.schema) if store is None else store, new)


def late_ticks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ticks that came after their window was published; schema names their columns."""
    return _table(spark, path, "late", schema + ", start timestamp, end timestamp, batch long")
