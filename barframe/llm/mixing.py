"""Mixing sources to target weights by entropy balancing.

Among all rates r of the documents that give every source its target number of words, the mix takes
those of least relative entropy, sum of size * (r log r - r + 1). They are exponentially tilted,
r = exp(lambda of the source), and lambda maximises the concave dual
sum(lambda * target) - sum(size * exp(lambda)), found by damped Newton steps whose gradient and
curvature are sums over all documents. Rates become whole copies: within a source, by size and id,
the k-th document takes floor(r) + floor(k f + 1/2) - floor((k-1) f + 1/2) copies, f = r - floor(r), so
that copies are spread evenly over all sizes and every rerun gives the same.

Ranks are counted in three levels (sizes of a source, id blocks of a size, rows of a block); no
window holds a whole source.

Defined cases: a null text has size 0; a null source is a source, ordered last; sources of size 0
have target 0 and rate 1; with no words at all every target is 0; repeated rows count each; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.slots import boxed, opened
from barframe.session import written

WEIGHTS = (5, 2, 1)  # by source in code point order, repeating
CAP = 3
UNSOLVED = 1e-6  # relative distance of a source's mass from its target
ID_BLOCK = 65536


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source_size, target.

    Water level: sources in order of cap * size / weight; the level is what is left after the
    sources below it have got their caps, per unit of the weights that remain."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(n) - 1) % len(weights)
    total = total.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), place).cast("double"))
    level = Window.orderBy(F.col("ratio"), F.col("source").isNull(), "source")
    before, everything = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = total.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    total = total.withColumn("share", share)
    top = F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("ratio", "share"))).over(everything)["share"]
    target = F.least(F.col("weight") * top, (cap * F.col("source_size")).cast("double"))
    return total.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def dual_newton(sized: DataFrame, goal: DataFrame, tolerance: float = 1e-11, most: int = 60) -> DataFrame:
    """goal with `lam`: the solution of the dual. Every step is one aggregate over all documents. Raises
    where the steps do not get there."""
    state = written(goal.withColumn("lam", F.lit(0.0)), "balance-0")
    for step in range(1, most + 1):
        at = state.select(F.col("source").alias("_s"), "source_size", "target", "lam")
        joined = sized.join(at, F.col("source").eqNullSafe(F.col("_s")))
        sums = joined.groupBy("source", "source_size", "target", "lam").agg(
            F.sum(F.col("size") * F.exp("lam")).alias("mass")
        )
        live = (F.col("source_size") > 0) & (F.col("target") > 0)
        # The dual's gradient is target - mass, its curvature -mass.
        move = F.when(live, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("target") / F.col("mass") - 1)))
        state = written(
            sums.select(
                "source", "source_size", "target",
                (F.col("lam") + F.coalesce(move, F.lit(0.0))).alias("lam"), F.abs(move).alias("moved"),
            ),
            f"balance-{step}",
        )
        moved = state.agg(F.max("moved")).first()[0] or 0.0
        if moved < tolerance:
            break
    else:
        # Sums over very many documents may never agree to the tolerance; farther off it is no solution.
        if moved > UNSOLVED:
            raise RuntimeError(f"the weights still moved by {moved} after {most} Newton steps")
    return state.drop("moved")


def rate(goal: DataFrame) -> DataFrame:
    r = F.when(F.col("source_size") == 0, F.lit(1.0)).when(F.col("target") == 0, F.lit(0.0)).otherwise(F.exp("lam"))
    return goal.withColumn("rate", F.round(r, 9))


def ranked(sized: DataFrame) -> DataFrame:
    """sized with `k`: its place (from 1) within its source by size, then id."""
    block = sized.withColumn("_block", F.expr(f"doc_id div {ID_BLOCK}"))
    inner = block.groupBy("source", "size", "_block").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy("source", "size").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("_in", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    outer = inner.groupBy("source", "size").agg(F.sum("_n").alias("_n"))
    less = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.withColumn("_out", F.coalesce(F.sum("_n").over(less), F.lit(0)))
    o = outer.select(F.col("source").alias("_os"), F.col("size").alias("_oz"), "_out")
    start = inner.join(o, F.col("source").eqNullSafe(F.col("_os")) & (F.col("size") == F.col("_oz")))
    start = start.select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_block").alias("_b"),
        (F.col("_in") + F.col("_out")).alias("_start"),
    )
    own = Window.partitionBy("source", "size", "_block").orderBy("doc_id")
    rows = block.withColumn("_k", F.row_number().over(own))
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & F.col("_block").eqNullSafe(F.col("_b"))
    return rows.join(start, on).select("doc_id", "source", "size", (F.col("_k") + F.col("_start")).alias("k"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, rate, copies, taken."""
    sized = written(sizes(docs, key, text, source), "mix-sizes")
    goal = rate(dual_newton(sized, targets(sized)))
    g = goal.select(F.col("source").alias("_s"), "source_size", "target", "rate")
    whole, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    extra = F.floor(F.col("k") * part + 0.5) - F.floor((F.col("k") - 1) * part + 0.5)
    rows = ranked(sized).join(g, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", whole + extra)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def apply_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with every row repeated by its copies (0 removes it). Rows that share an id all take the
    largest number of copies among them."""
    copies = mix(docs, key, text, source).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    copies = copies.filter("_copies > 0")
    rows = boxed(docs, _key=key).join(copies, F.col("_key").eqNullSafe(F.col("_id")))
    return opened(rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))
