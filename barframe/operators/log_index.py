"""A stored inverted index of the research log.

The index is three tables below one path. `entries` holds the search rows, equal ones added up, by a
bucket of the group id. `postings` holds (term, field, bucket, group_key) by a shard of the term: the
token runs of a record's text, its whole assets and its family. `terms` is the dictionary, each term and
field once a batch. Every batch writes folders of its own, so the index grows by appended records only;
writing a batch again replaces it.

A token of a search lies within one token run of any text that contains it, so the dictionary says which
terms to follow and only their shards and the buckets of the groups found are read. Those groups are then
scored by the same rules as a scan of the log, so both give the same rows. A search without any token of
two characters scans the texts of the entries.

Defined cases: repeated records count each time, null fields have no terms, records without a slate are
groups of their own, an index without a batch finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.functions.scalars import tokens
from barframe.operators.log import ranked_groups, search_rows

SHARDS = 64  # folders of a batch, for terms and for groups
ENTRY = "group_id string, strategy string, text string, assets array<string>, family string, n long, latest string, group_key long, batch long, bucket int"
POSTING = "term string, field string, bucket int, group_key long, batch long, shard int"
TERM = "term string, field string, shard int, batch long"


def _part(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SHARDS)).cast("int")


def write_batch(log: DataFrame, path: str, batch: int) -> None:
    """Index the records of one batch. The entries come last: postings without them find nothing."""
    spark = log.sparkSession
    at = {t: f"{path}/{t}/batch={batch}" for t in ("entries", "postings", "terms")}
    rows = (
        search_rows(log).groupBy("group_id", "strategy", "text", "assets", "family")
        .agg(F.sum("n").alias("n"), F.max("latest").cast("string").alias("latest"))
        .withColumns({"group_key": F.xxhash64("group_id", "strategy"), "bucket": _part(F.lower("group_id"))})
    )
    staged = f"{path}/staged/batch={batch}"
    rows.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)

    def of(kind: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(kind).alias("field")))

    every = F.concat(of("text", tokens(F.col("text"))), of("asset", F.col("assets")), of("family", F.array("family")))
    postings = (
        rows.select(F.explode(F.array_distinct(every)).alias("p"), "bucket", "group_key").select("p.*", "bucket", "group_key")
        .filter("term is not null").distinct().withColumn("shard", _part(F.col("term")))
    )
    # Ranges end inside a frequent term, so one that a third of all groups hold is spread over tasks.
    postings.repartitionByRange("shard", "term", "group_key").write.mode("overwrite").partitionBy("shard").parquet(at["postings"])
    spark.read.schema(POSTING).parquet(at["postings"]).select("term", "field", "shard").distinct().write.mode("overwrite").parquet(at["terms"])
    rows.repartitionByRange("bucket", "group_key").write.mode("overwrite").partitionBy("bucket").parquet(at["entries"])


def extend(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Index what was appended to a streamed log since the last call; returns the records read.
    The checkpoint remembers the files, so records indexed before are not read again."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, n: write_batch(batch, path, n))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")


def search_index(spark: SparkSession, path: str, identifier: str) -> DataFrame:
    """The rows of log.search, from the index."""
    q = F.lit(identifier.strip().lower())
    wanted = tokens(q)
    entries = _table(spark, path, "entries", ENTRY)
    postings = _table(spark, path, "postings", POSTING)
    terms = _table(spark, path, "terms", TERM)

    exact = entries.filter((F.col("bucket") == _part(q)) & (F.lower("group_id") == q))
    known = terms.filter((F.col("field") == "asset") & F.array_contains(wanted, F.col("term")))
    facts = (
        exact.agg((F.count("*") > 0).alias("_any_exact"))
        .crossJoin(known.agg(F.collect_set("term").alias("_query_assets")))  # one row each
    )

    # Terms to follow, each with the tokens that lie within it.
    follow = (
        terms.withColumn("_tok", F.filter(wanted, lambda t: F.col("term").contains(t)))
        .filter(F.size("_tok") > 0).select("shard", "term", "field", "_tok").distinct()
    )
    token_hits = (
        postings.join(follow, ["shard", "term", "field"])
        .select("bucket", "group_key", F.explode("_tok").alias("_hit"), ((F.col("field") == "family") & F.array_contains(wanted, F.col("term"))).alias("_family"))
        .groupBy("bucket", "group_key").agg(F.collect_set("_hit").alias("_hits"), F.max("_family").alias("_family"))
    )
    # A group without all asked assets scores nothing; without asked assets all tokens or the family must match.
    may_score = F.when(F.size("_query_assets") > 0, F.size(F.array_except("_query_assets", "_hits")) == 0).otherwise(
        F.col("_family") | (F.size(F.array_except(wanted, F.col("_hits"))) == 0)
    )
    found = token_hits.withColumn("_all", F.lit(1)).join(facts.withColumn("_all", F.lit(1)), "_all").filter(may_score & ~F.col("_any_exact"))
    keys = found.select("bucket", "group_key").unionByName(exact.select("bucket", "group_key")).distinct()
    untold = entries.filter((F.size(wanted) == 0) & F.col("text").contains(q)).select("bucket", "group_key")
    rows = entries.join(keys.unionByName(untold).distinct(), ["bucket", "group_key"], "left_semi")
    return ranked_groups(rows, facts, identifier)
