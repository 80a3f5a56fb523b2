"""First stop hits by descent through blocks, and picks of non-overlapping trades by pointer doubling.

A long position (a short one with all prices negated) leaves at the first bar whose low is at or
below max(hard, anchor - wide), where the anchor is the highest close since the fill. Bars are packed
into blocks of `fan`, blocks into blocks of blocks. A block keeps its lowest low, its highest close
and its deepest fall from a close to a later low: no bar in it can stop a position of anchor a if
lowest > max(hard, a - wide) and deepest < wide. So a position looks through the rest of its own
block, climbs while nothing can stop it, goes down into the first block that can, and ends on a bar:
two passes over the levels, each an equi-join on the block, with at most `fan` steps in it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.session import written

FAN = 64  # bars of a block, and blocks of a larger one
PICK = 256  # trades whose links are followed in one row
SLACK = 1e-9  # blocks that rounding leaves in doubt are looked into

STATE = "struct<high: double, deep: double>"


@dataclass(frozen=True)
class Rule:
    """What ends a search. Items are structs, of bars on level 0 and of blocks above; a search carries a
    number, `anchor`, along."""

    bar: tuple[str, ...]  # columns of a bar; i is its place
    summary: Callable[[Column, int], Column]  # struct of the items of a block on a level
    ends: Callable[[Column, Column, int], Column]  # (item, anchor, level): may it end here
    onward: Callable[[Column, Column, int], Column]  # the anchor behind an item
    hit: Callable[[Column, Column], Column]  # (bar, anchor) -> struct with exit_i
    shape: Callable[[DataFrame], str]  # type of that struct


def _stop(anchor: Column) -> Column:
    return F.greatest(F.col("hard"), anchor - F.col("wide"))


def _stop_summary(items: Column, level: int) -> Column:
    """Lowest low, highest close and deepest fall, in order."""
    low, high = ("lo", "hi") if level else ("l", "c")
    start = F.struct(F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("deep")).cast(STATE)

    def add(acc: Column, x: Column) -> Column:
        falls = [acc["deep"], acc["high"] - x[low]] + ([x["deep"]] if level else [])
        return F.struct(F.greatest(acc["high"], x[high]).alias("high"), F.greatest(*falls).alias("deep")).cast(STATE)

    state = F.aggregate(items, start, add)
    return F.struct(F.array_min(F.transform(items, lambda x: x[low])).alias("lo"), state["high"].alias("hi"), state["deep"].alias("deep"))


def _stop_ends(x: Column, anchor: Column, level: int) -> Column:
    if level == 0:
        return x["l"] <= _stop(anchor)
    doubt = SLACK * (F.abs(x["lo"]) + F.abs(x["hi"]) + F.abs(F.col("wide")))
    return (x["lo"] <= _stop(anchor)) | (x["deep"] >= F.col("wide") - doubt)


STOP = Rule(
    bar=("i", "o", "l", "c", "at", "upto"), summary=_stop_summary, ends=_stop_ends,
    onward=lambda x, anchor, level: F.greatest(anchor, x["hi" if level else "c"]),
    hit=lambda bar, anchor: F.struct(
        bar["i"].cast("bigint").alias("exit_i"), bar["at"].alias("exit_ts"), F.least(bar["o"], _stop(anchor)).alias("exit_price"),
        bar["upto"].alias("upto"),
    ),
    shape=lambda bars: f"struct<exit_i: bigint, exit_ts: {bars.schema['at'].dataType.simpleString()}, exit_price: double, upto: bigint>",
)

# The first bar whose band is at or below the searcher's own, or whose close before lies above it.
LEAVES_BAND = Rule(
    bar=("i", "band", "before"),
    summary=lambda items, level: F.struct(
        F.array_min(F.transform(items, lambda x: x["band"])).alias("band"), F.array_max(F.transform(items, lambda x: x["before"])).alias("before"),
    ),
    ends=lambda x, anchor, level: (x["band"] <= anchor) | (x["before"] > anchor),
    onward=lambda x, anchor, level: anchor,
    hit=lambda bar, anchor: F.struct(bar["i"].cast("bigint").alias("exit_i")),
    shape=lambda bars: "struct<exit_i: bigint>",
)


def levels(bars: DataFrame, keys: Sequence[str], fan: int, last: int, rule: Rule = STOP) -> list[DataFrame]:
    """Level 0: (keys, _block, items of `fan` bars); level k: items of `fan` blocks of level k - 1."""
    base = bars.groupBy(*keys, F.floor(F.col("i") / fan).alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct(*rule.bar))).alias("items")
    )
    found, size = [written(base, "stop-blocks")], fan
    while size <= last:
        below = found[-1].select(*keys, F.col("_block").alias("no"), rule.summary(F.col("items"), len(found) - 1).alias("s"))
        item = F.struct("no", "s.*")
        found.append(below.groupBy(*keys, F.floor(F.col("no") / fan).alias("_block")).agg(F.array_sort(F.collect_list(item)).alias("items")))
        size *= fan
    return found


def _scanned(open_: DataFrame, table: DataFrame, keys: Sequence[str], level: int, fan: int, going: Column, rule: Rule) -> DataFrame:
    """Positions for which `going` holds look through the rest of their block of the level. `next_i` is
    the first bar not yet passed; `found` the level of the block at `next_i` that may stop them."""
    child, own = fan**level, fan ** (level + 1)
    # Others keep a key of their own that no block has, so they spread over the join.
    block = F.when(going, F.floor(F.col("next_i") / own)).otherwise(-1 - F.col("signal_i"))
    side = table.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_at"), "items")
    on = F.col("_block") == F.col("_at")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    met = open_.withColumn("_block", block).join(side, on, "left")
    place = "no" if level else "i"
    rest = F.filter("items", lambda x: x[place] >= F.floor(F.col("next_i") / child))
    shape = "struct<anchor: double, at: bigint>"
    start = F.struct(F.col("anchor"), F.lit(None).cast("bigint").alias("at")).cast(shape)

    def step(acc: Column, x: Column) -> Column:
        ends = F.coalesce(rule.ends(x, acc["anchor"], level), F.lit(False))
        onward = F.struct(
            F.when(ends, acc["anchor"]).otherwise(rule.onward(x, acc["anchor"], level)).alias("anchor"), F.when(ends, x[place]).alias("at"),
        ).cast(shape)
        return F.when(acc["at"].isNotNull(), acc).otherwise(onward)

    seen = met.withColumn("_s", F.when(F.col("_at").isNotNull(), F.aggregate(rest, start, step)))
    moved, hit = F.col("_s").isNotNull(), F.col("_s.at").isNotNull()
    past = (F.col("_block") + 1) * own
    out = {"anchor": F.when(moved, F.col("_s.anchor")).otherwise(F.col("anchor"))}
    if level == 0:
        bar = F.get("items", (F.col("_s.at") - F.col("_block") * own).cast("int"))
        out["hit"] = F.when(hit, rule.hit(bar, F.col("_s.anchor"))).otherwise(F.col("hit"))
        out["next_i"] = F.when(moved, past).otherwise(F.col("next_i"))
        out["found"] = F.when(moved & F.col("found").isNotNull(), -1).otherwise(F.col("found"))
    else:
        out["next_i"] = F.when(hit, F.col("_s.at") * child).when(moved, past).otherwise(F.col("next_i"))
        out["found"] = F.when(hit, level).when(moved & F.col("found").isNotNull(), -1).otherwise(F.col("found"))
    return seen.withColumns(out).select(*open_.columns)


def first_hits(entries: DataFrame, bars: DataFrame, keys: Sequence[str], fan: int, last: int, rule: Rule = STOP) -> DataFrame:
    """entries (keys, signal_i, fill_i, last_i, anchor, and what the rule reads) with `hit`, the rule's
    struct of the first bar from fill_i on that ends the search; NULL for those that reach the end.
    `last` is the largest last_i; bars of a series have places i from 0 without holes."""
    tables = levels(bars, keys, fan, last, rule)
    todo = entries.withColumns({
        "next_i": F.col("fill_i").cast("bigint"), "found": F.lit(None).cast("int"), "hit": F.lit(None).cast(rule.shape(bars)),
    })
    done = None
    while True:
        for level in range(len(tables)):
            alive = F.col("hit").isNull() & (F.col("next_i") <= F.col("last_i")) & F.col("found").isNull()
            todo = _scanned(todo, tables[level], keys, level, fan, alive, rule)
        for level in range(len(tables) - 2, -1, -1):
            todo = _scanned(todo, tables[level], keys, level, fan, F.coalesce(F.col("found") == level + 1, F.lit(False)), rule)
        todo = written(todo, "stop-hits")
        doubtful = F.col("hit").isNull() & (F.col("next_i") <= F.col("last_i"))
        done = todo.filter(~doubtful) if done is None else done.unionByName(todo.filter(~doubtful))
        todo = todo.filter(doubtful).withColumn("found", F.lit(None).cast("int"))
        if todo.limit(1).count() == 0:  # else rounding led into a block that stops nothing: go on behind it
            return done.drop("next_i", "found")


def chained(links: DataFrame, keys: Sequence[str], most: int, pick: int = PICK) -> DataFrame:
    """(keys, k) of the links on the chain from k = 0. links: (keys, k, next), k from 0 without holes
    below `most`, next > k; a next that is no k ends the chain.

    Runs of `pick` links are followed inside one row, which gives where each link leaves its run; the
    runs that the chain enters come from doubling these pointers."""
    run = F.floor(F.col("k") / pick)
    rows = written(
        links.groupBy(*keys, run.alias("_run")).agg(F.array_sort(F.collect_list(F.struct("k", "next"))).alias("_links")), "pick-runs"
    )

    def leave(acc: Column, x: Column) -> Column:  # from the last link to the first
        inside = F.get(acc, (x["next"] - x["k"] - 1).cast("int"))
        return F.concat(F.array(F.coalesce(inside, x["next"])), acc)

    steps = max(0, -(-most // pick) - 1).bit_length()
    entered = rows.filter("_run = 0").select(*keys, F.lit(0).cast("bigint").alias("k"))
    if steps:
        leaves = F.aggregate(F.reverse("_links"), F.array().cast("array<bigint>"), leave)
        base = rows.select(
            *keys, F.inline(F.arrays_zip(F.transform("_links", lambda x: x["k"]).alias("k"), leaves.alias("to")))
        )
        there = links.select(*keys, F.col("k").alias("to"))
        pointer = written(base.join(there, [*keys, "to"], "left_semi").select(*keys, "k", "to"), "pick-pointers")
        for step in range(steps):
            ahead = entered.join(pointer, [*keys, "k"]).select(*keys, F.col("to").alias("k"))
            entered = written(entered.unionByName(ahead), f"pick-entered-{step}")
            if step + 1 < steps:
                far = pointer.select(*keys, F.col("k").alias("to"), F.col("to").alias("_to"))
                pointer = written(pointer.join(far, [*keys, "to"]).select(*keys, "k", F.col("_to").alias("to")), f"pick-pointers-{step}")

    shape = "struct<at: bigint, taken: array<bigint>>"
    start = F.struct(F.col("k").alias("at"), F.array().cast("array<bigint>").alias("taken")).cast(shape)

    def follow(acc: Column, x: Column) -> Column:
        there = x["k"] == acc["at"]
        return F.when(there, F.struct(x["next"].alias("at"), F.array_append(acc["taken"], x["k"]).alias("taken")).cast(shape)).otherwise(acc)

    met = entered.withColumn("_run", run).join(rows, [*keys, "_run"])
    return met.select(*keys, F.explode(F.aggregate("_links", start, follow)["taken"]).alias("k"))
