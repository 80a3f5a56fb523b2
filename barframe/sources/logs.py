"""Append-only JSON logs, book tables, batch spec files and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMS = (
    "struct<assets:array<string>, lookback_days:int, top_k:int, rebalance_days:int, "
    "skip_recent_days:int, hedge_weight:double, fast_window:int, slow_window:int, entry_window:int, "
    "exit_window:int, rsi_window:int, oversold_threshold:double, exit_threshold:double>"
)
METRICS = (
    "struct<total_return_pct:double, buy_and_hold_return_pct:double, sharpe_ratio:double, "
    "max_drawdown_pct:double, num_trades:int, beats_benchmark:boolean>"
)
RESEARCH_LOG = (
    "timestamp string, mode string, user_request string, slate_id string, is_lockbox boolean, asset string, "
    f"strategy_family string, data_source string, start_date string, end_date string, params {PARAMS}, "
    f"metrics {METRICS}, failed_checks array<string>, verdict string, learning_status string, lesson string"
)
PAPER_LOG = (
    "id string, created_at string, inception_date string, strategy_family string, "
    f"params {PARAMS}, initial_cash double, commission_pct double, slippage_pct double, expectation "
    "struct<annualized_return_pct:double, backtest_total_return_pct:double, backtest_span_days:int, "
    "backtest_sharpe:double, backtest_max_drawdown_pct:double>, status string"
)
_SPEC = (
    "struct<name:string, hypothesis:string, assets:string, family:string, portfolio_family:string, "
    "lookback:int, lookback_days:int, top_k:int, `top-k`:int, rebalance:int, rebalance_days:int, "
    "skip_recent:int, skip_recent_days:int, hedge_weight:double, start:string, start_date:string, "
    "end:string, end_date:string>"
)
BATCH_FILE = f"defaults {_SPEC}, portfolios array<{_SPEC}>"
ALIASES = {
    "family": ("portfolio_family", "family"),
    "lookback": ("lookback_days", "lookback"),
    "top_k": ("top_k", "top-k"),
    "rebalance": ("rebalance_days", "rebalance"),
    "skip": ("skip_recent_days", "skip_recent"),
    "hedge_weight": ("hedge_weight",),
    "start": ("start_date", "start"),
    "end": ("end_date", "end"),
    "name": ("name",),
    "hypothesis": ("hypothesis",),
}
BATCH_DEFAULTS = {"lookback": 126, "top_k": 1, "rebalance": 21, "skip": 252}


def append_json(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str = RESEARCH_LOG) -> DataFrame:
    """The typed columns of `schema` beside `record`, the whole line as a VARIANT, so fields that no
    column names are kept. Lines that are no JSON object are skipped; a field of another type is NULL
    in its column only; a missing path is an empty log."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema).withColumn("record", F.parse_json(F.lit(None).cast("string")))
    lines = spark.read.text(path).select("value", F.try_parse_json("value").alias("record"))
    known = lines.filter(F.schema_of_variant("record").startswith("OBJECT")).withColumn("_t", F.from_json("value", schema))
    return known.select("_t.*", "record")


def append_records(log: DataFrame, path: str) -> None:
    """Append whole records as they were read, whatever fields they have."""
    log.select(F.to_json("record").alias("value")).write.mode("append").text(path)


def field(path: str, kind: str = "string") -> Column:
    """A field of the whole record, such as field("params.leader"); NULL where it is absent or does
    not fit. Over a stored log only the asked paths are read."""
    return F.try_variant_get("record", "$." + path, kind)


def store_log(log: DataFrame, path: str) -> None:
    """Typed columns and whole records as a table by mode; later appends add files."""
    log.write.mode("append").partitionBy("mode").parquet(path)


def flat_log(log: DataFrame) -> DataFrame:
    """The columns the log operators use."""
    # The whole record: variants that differ in any field are records of their own, whatever the
    # order of their fields.
    whole = F.to_json("record") if "record" in log.columns else F.to_json(F.struct("*"))
    return log.select(
        F.xxhash64(whole).alias("record_id"), "timestamp", "mode", "is_lockbox", "slate_id", "asset", "strategy_family",
        "verdict", "learning_status", "failed_checks", F.to_date("start_date").alias("start_date"),
        F.to_date("end_date").alias("end_date"), "params.assets", F.col("params.lookback_days").alias("lookback"),
        "params.top_k", F.col("params.rebalance_days").alias("rebalance"), "metrics.*",
    )


def save_books(books: DataFrame, path: str) -> None:
    """A new version of the book table; write to a new path and switch, or to a versioned path."""
    books.write.mode("overwrite").parquet(path)


def list_books(spark: SparkSession, path: str, only_open: bool = False) -> DataFrame:
    books = spark.read.parquet(path)
    if only_open:
        books = books.filter("status = 'open'")
    return books.orderBy("inception_date", "book_id")


def batch_specs(files: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Spec rows of batch files(defaults, portfolios, carried columns): an item's key wins over
    the defaults, then the built-in values; assets are a JSON list or a comma string."""
    items = files.select(*carry, "defaults", F.posexplode("portfolios").alias("idx", "item"))

    def value(name: str):
        options = [F.col(f"{side}.`{k}`") for side in ("item", "defaults") for k in ALIASES[name]]
        if name in BATCH_DEFAULTS:
            options.append(F.lit(BATCH_DEFAULTS[name]))
        return F.coalesce(*options).alias(name)

    raw = F.coalesce("item.assets", "defaults.assets")
    listed = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, ","))
    assets = F.filter(F.transform(listed, lambda a: F.trim(a)), lambda a: a != "")
    out = items.select(*carry, "idx", assets.alias("assets"), *[value(n) for n in ALIASES])
    names = F.concat(F.initcap(F.replace("family", F.lit("_"), F.lit(" "))), F.lit(" ("), F.array_join("assets", ", "), F.lit(")"))
    return out.withColumn("name", F.coalesce("name", names)).withColumns(
        {"start": F.to_date("start"), "end": F.to_date("end")}
    )


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    return batch_specs(spark.read.schema(BATCH_FILE).option("multiLine", True).json(path))


def write_csv(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)
