"""Live paper books as a stateful stream.

Each input row is one bar of one book: book_id, ts, closes (asset -> price) and weights (asset ->
target, or NULL when there is no order). A book's state is its cash, its shares and the last bar
it has processed; bars at or before that one are dropped, so a repeated file adds nothing. A bar
without a price for an asset the book holds, or that leaves no positive NAV, changes nothing: its
ledger row names the problem and has no amounts.

Opened books (`opened`) start at their inception with their own cash and costs, take bars up to a
given day only, and a book that was saved (`handed_over`) goes on from its cash, shares and last bar
under a new checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barframe.functions.scalars import annualize
from barframe.functions.windows import series
from barframe.operators.rules import problems
from barframe.operators.validate import forward_status

BOOK_BAR = "book_id string, ts date, closes map<string,double>, weights map<string,double>"
BOOK = (
    "book_id string, inception_date date, cash double, cost_rate double, positions map<string,double>, "
    "last_bar_date date, status string"
)
LEDGER = (
    "book_id string, ts date, is_order boolean, pre_nav double, post_nav double, cash double, "
    "traded_value double, costs double, positions map<string,double>, closes map<string,double>, "
    "target_weights map<string,double>, problem string"
)
STATE = "cash double, positions string, last_bar string"
MAX_ROUNDS = 50
TOLERANCE = 1e-9


def bar_problems() -> Column:
    """What is wrong with a bar: prices must be finite and positive; weights, where given, must
    cover every asset, be non-negative and sum to at most 1."""
    prices = F.map_values("closes")
    w = F.map_values("weights")
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    def bad_number(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    ordered = F.col("weights").isNotNull()
    missing = F.size(F.array_except(F.map_keys("closes"), F.map_keys("weights"))) > 0
    return problems(
        (F.exists(prices, lambda p: bad_number(p) | (p <= 0)), "invalid close price"),
        (ordered & (missing | F.exists(w, lambda x: x.isNull())), "partial target weights"),
        (ordered & F.exists(w, lambda x: x.isNotNull() & bad_number(x)), "invalid target weight"),
        (ordered & F.exists(w, lambda x: x < -1e-12), "negative target weight"),
        (ordered & (total > 1.000001), "target weights sum above 1"),
    )


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good bars, and rejected ones with their problems."""
    checked = rows.withColumn("problems", bar_problems())
    return checked.filter(F.size("problems") == 0).drop("problems"), checked.filter(F.size("problems") > 0)


def rebalance(nav: float, values: dict[str, float], weights: dict[str, float], cost: float) -> tuple[float, float]:
    """NAV after costs and traded value, when targets are fractions of the NAV after costs."""
    def traded_at(x: float) -> float:
        return sum(abs(weights.get(a, 0.0) * x - values.get(a, 0.0)) for a in values.keys() | weights.keys())

    post = nav
    for _ in range(MAX_ROUNDS):
        nxt = nav - cost * traded_at(post)
        done = abs(nxt - post) <= TOLERANCE
        post = nxt
        if done:
            break
    return post, traded_at(post)


def opened(bars: DataFrame, books: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Bars of the open books from their inception on, up to and including as_of, with what each
    book starts from. books (BOOK columns) is a plain table beside the stream; a book joins it by id."""
    start = books.filter(F.coalesce("status", F.lit("open")) == "open").select(
        F.col("book_id").alias("_book"), "inception_date", F.col("cash").alias("_cash"), F.col("cost_rate").alias("_cost"),
        F.to_json(F.coalesce("positions", F.create_map().cast("map<string,double>"))).alias("_positions"),
        F.coalesce(F.date_format("last_bar_date", "yyyy-MM-dd"), F.lit("")).alias("_last"),
    )
    live = bars.join(start, F.col("book_id") == F.col("_book")).filter(F.col("ts") >= F.col("inception_date"))
    if as_of is not None:
        live = live.filter(F.col("ts") <= as_of)
    return live.drop("_book", "inception_date")


def advance(cost: float | None = None, cash: float | None = None):
    """The state function of one book; without cost and cash the rows carry them (`opened`)."""
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(batches)).sort_values("ts", kind="stable")
        begin = (cash, "{}", "") if cash is not None else tuple(bars.iloc[0][c] for c in ("_cash", "_positions", "_last"))
        rate = cost if cost is not None else float(bars.iloc[0]["_cost"])
        money, held, last = state.get if state.exists else begin
        shares: dict[str, float] = json.loads(held)
        rows = []
        for bar in bars.itertuples(index=False):
            day = bar.ts.isoformat()
            if day <= last:
                continue
            closes = dict(bar.closes)
            values = {a: shares.get(a, 0.0) * p for a, p in closes.items()}
            pre = money + sum(values.values())
            order = dict(bar.weights) if bar.weights is not None else None
            unpriced = sorted(a for a, n in shares.items() if n and a not in closes)
            problem = f"no price for held {', '.join(unpriced)}" if unpriced else None if pre > 0 else "NAV is not positive"
            if problem:
                rows.append((key[0], bar.ts, False, *(None,) * 5, dict(shares), closes, None, problem))
                continue
            post, traded = (pre, 0.0) if order is None else rebalance(pre, values, order, rate)
            if order is not None:
                shares = {a: order.get(a, 0.0) * post / p for a, p in closes.items()}
                money = post * (1.0 - sum(order.values()))
            # Between orders the weights are those the book has drifted to.
            target = {a: order.get(a, 0.0) if order is not None else values[a] / post for a in closes}
            last = day
            rows.append((
                key[0], bar.ts, order is not None, pre, post, money, traded, pre - post, dict(shares), closes, target, None,
            ))
        state.update((float(money), json.dumps(shares), last))
        names = [f.split()[0] for f in LEDGER.replace("map<string,double>", "map").split(", ")]
        yield pd.DataFrame(rows, columns=names)

    return step


def ledger_stream(bars: DataFrame, cost: float | None = None, cash: float | None = None) -> DataFrame:
    """Ledger rows of all books, appended as bars arrive. Bars of opened() books carry cost and cash."""
    return bars.groupBy("book_id").applyInPandasWithState(
        advance(cost, cash), LEDGER, STATE, "append", GroupStateTimeout.NoTimeout
    )


def handed_over(ledger: DataFrame, books: DataFrame) -> DataFrame:
    """The books as their ledgers leave them, to be saved and opened again."""
    last = ledger.filter("problem is null").groupBy(F.col("book_id").alias("_book")).agg(
        F.max_by(F.struct("cash", "positions", "ts"), "ts").alias("_l")
    )
    went_on = F.col("_l").isNotNull()
    return books.join(last, F.col("book_id") == F.col("_book"), "left").withColumns({
        "cash": F.when(went_on, F.col("_l.cash")).otherwise(F.col("cash")),
        "positions": F.when(went_on, F.col("_l.positions")).otherwise(F.col("positions")),
        "last_bar_date": F.when(went_on, F.col("_l.ts")).otherwise(F.col("last_bar_date")),
    }).drop("_book", "_l")


def ledger_report(ledger: DataFrame) -> DataFrame:
    """The ledger as reported: money to 6 places, shares to 8."""
    money = ("pre_nav", "post_nav", "cash", "traded_value", "costs")
    return ledger.withColumns({c: F.round(c, 6) for c in money}).withColumn(
        "positions", F.transform_values("positions", lambda _, v: F.round(v, 8))
    )


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, append it to a parquet table and stop. The checkpoint makes a
    restart continue where the last run ended."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def ledger_status(ledger: DataFrame, books: DataFrame) -> DataFrame:
    """books(book_id, initial_cash, expected_annualized_pct, backtest_max_drawdown_pct) ->
    realized performance of each ledger and its reading."""
    peak = F.max("post_nav").over(series(("book_id",), "ts"))
    out = (
        ledger.filter("problem is null").withColumn("_dd", F.col("post_nav") / peak - 1)
        .groupBy("book_id")
        .agg(
            F.count("*").alias("forward_days"), F.max_by("post_nav", "ts").alias("nav"),
            (F.min("_dd") * 100).alias("realized_max_drawdown_pct"),
            F.datediff(F.max("ts"), F.min("ts")).alias("_span"),
        )
        .join(books, "book_id")
        .withColumn("realized_return_pct", (F.col("nav") / F.col("initial_cash") - 1) * 100)
    )
    out = out.withColumn("realized_annualized_pct", annualize(F.col("realized_return_pct"), F.col("_span")))
    return out.withColumn(
        "status",
        forward_status(
            F.col("forward_days"), F.col("realized_annualized_pct"), F.col("expected_annualized_pct"),
            F.col("realized_max_drawdown_pct"), F.col("backtest_max_drawdown_pct"),
        ),
    ).drop("_span")
