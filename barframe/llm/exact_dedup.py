"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 hashes every text and finds the filter slots that more than one row has set; what is shuffled
is a slot number, summed in part before it moves. Pass 2 tests every row against the filter of these
slots: a row with a slot of its own is alone and passes straight through, only possibly repeated
rows are shuffled, as (hash, id, length), and compared exactly by SHA-256 of the whole text.

Defined cases: a null text is an empty one; texts are equal when they are identical after white
space [\\x20\\x09-\\x0D] is deleted; of a group the row with the most code points stays, then the
smallest id (a null id after all others); rows repeated with the same id and length tie: marks()
keeps all of them, exact_dedup() one. Rows of one id (or of none) with equal texts of different length are
told apart by the length. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm import slots as S
from barframe.session import written


def text_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"),
        F.length(body).alias("n_chars"),
        F.sha2(F.regexp_replace(body, r"[ \t-\r]+", ""), 256).alias("text_sha256"),
    )


def repeated_filter(keys: DataFrame, count: int) -> DataFrame:
    """The slots that at least two rows have set."""
    each = keys.select(F.explode(S.slots(F.col("text_sha256"), count)).alias("slot"))
    return S.as_filter(each.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("slot"))


def marks(docs: DataFrame, key: str = "doc_id", text: str = "text", per_row: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return sized_marks(docs, key, text, per_row).drop("n_chars")


def sized_marks(docs: DataFrame, key: str = "doc_id", text: str = "text", per_row: int = 16) -> DataFrame:
    """marks() and n_chars."""
    keys = written(text_keys(docs, key, text), "dedup-keys")
    count = S.slot_count(keys.count(), per_row)
    bits = written(repeated_filter(keys, count), "dedup-filter")
    tested = S.hits(keys, F.col("text_sha256"), bits, count, "maybe")
    alone = tested.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", "n_chars",
    )
    maybe = tested.filter("maybe").drop("maybe")
    rank = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    groups = maybe.groupBy(F.col("text_sha256").alias("_sha")).agg(
        F.min(rank).alias("_first"), F.count(F.lit(1)).alias("group_size")
    )
    kept = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("n_chars") == -F.col("_first.shorter"))
    shared = maybe.join(groups, F.col("text_sha256") == F.col("_sha")).select(
        "doc_id", F.col("_first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "n_chars"
    )
    return alone.unionByName(shared)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; one of rows repeated as they are."""
    found = written(sized_marks(docs, key, text).filter("group_size > 1"), "dedup-groups")
    # Ids in a group of copies: their rows, and only theirs, are looked at again.
    count = S.slot_count(found.count())
    bits = written(S.as_filter(found.select(F.explode(S.slots(F.col("doc_id"), count)).alias("slot"))), "dedup-id-filter")
    seen = S.hits(S.boxed(docs, _key=key, _text=text), F.col("_key"), bits, count, "_seen")
    body = F.regexp_replace(F.coalesce("_text", F.lit("")), r"[ \t-\r]+", "")
    other = seen.filter("_seen").select("_row", "_key", F.sha2(body, 256).alias("_own"), F.length(F.coalesce("_text", F.lit(""))).alias("_size"))
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")) & (F.col("_size") == F.col("_n_chars"))
    pair = [F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_chars").alias("_n_chars")]
    other = other.join(found.filter("not kept").select(*pair).distinct(), same, "left_anti")
    ties = found.filter("kept").groupBy("doc_id", "text_sha256", "n_chars").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not ties.isEmpty():
        ties = ties.select(*pair)
        once = other.join(ties, same, "left_semi").dropDuplicates(["_key", "_own"])
        other = other.join(ties, same, "left_anti").unionByName(once)
    return S.opened(seen.filter("not _seen").select("_row")).unionByName(S.opened(other))
