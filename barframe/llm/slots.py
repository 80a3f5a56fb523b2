"""A fixed-size bit filter built and tested with DataFrame functions only.

A filter is a table (bucket, bits): slot = bucket * 32768 + bit. The number of slots is a power of
two of at most MAX_SLOTS, so a filter never exceeds MAX_SLOTS / 8 bytes (16 MB) and may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.session import written

BLOCK = 32768
MAX_SLOTS = 1 << 27


def slot_count(rows: int, per_row: int = 16) -> int:
    """The power of two with at least `per_row` slots a row, within [BLOCK, MAX_SLOTS]."""
    need = max(BLOCK, min(MAX_SLOTS, rows * per_row))
    return 1 << (need - 1).bit_length()


def slots(key: Column, count: int, hashes: int = 2) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), key), F.lit(count)) for i in range(hashes)])


def as_filter(taken: DataFrame) -> DataFrame:
    """`taken` has one column `slot`; repeats are allowed."""
    return taken.groupBy(F.expr(f"slot div {BLOCK}").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(slot % {BLOCK})").alias("bits")
    )


def hits(df: DataFrame, key: Column, bits: DataFrame, count: int, flag: str, hashes: int = 2) -> DataFrame:
    """df with a boolean `flag`: every slot of the key is set. No row is added or lost."""
    out = df.withColumn("_slots", slots(key, count, hashes))
    for i in range(hashes):
        side = F.broadcast(bits.select(F.col("bucket").alias(f"_b{i}"), F.col("bits").alias(f"_bits{i}")))
        at = F.get("_slots", F.lit(i))
        out = out.withColumn("_at", at).withColumn("_bucket", F.expr(f"_at div {BLOCK}"))
        out = out.join(side, F.col("_bucket") == F.col(f"_b{i}"), "left")
        byte = F.conv(F.hex(F.expr(f"substring(_bits{i}, cast((_at % {BLOCK}) div 8 as int) + 1, 1)")), 16, 10)
        is_set = byte.cast("int").bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0
        out = out.withColumn(f"_hit{i}", F.coalesce(is_set, F.lit(False))).drop(f"_b{i}", f"_bits{i}", "_at", "_bucket")
    every = F.lit(True)
    for i in range(hashes):
        every = every & F.col(f"_hit{i}")
    return out.withColumn(flag, every).drop("_slots", *[f"_hit{i}" for i in range(hashes)])


def boxed(docs: DataFrame, **names: str) -> DataFrame:
    """The row as one struct `_row` beside the named columns, so that whatever other columns docs
    has cannot clash with those that an operator adds. opened() gives the rows back."""
    return docs.select(F.struct("*").alias("_row"), *[F.col(c).alias(n) for n, c in names.items()])


def opened(boxes: DataFrame) -> DataFrame:
    return boxes.select("_row.*")


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not in `gone` (one column; null matches null).

    Rows that a filter over the keys of `gone` clears pass straight on; only the others meet `gone`
    in a join, so the texts of clean rows are never shuffled.
    """
    gone = written(gone.toDF("_gone").distinct(), "gone")
    count = slot_count(gone.count())
    bits = written(as_filter(gone.select(F.explode(slots(F.col("_gone"), count)).alias("slot"))), "gone-filter")
    seen = hits(boxed(docs, _key=key), F.col("_key"), bits, count, "_seen")
    other = seen.filter("_seen").join(gone, F.col("_key").eqNullSafe(F.col("_gone")), "left_anti")
    return opened(seen.filter("not _seen").select("_row")).unionByName(opened(other))
