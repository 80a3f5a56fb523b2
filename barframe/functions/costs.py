"""Cost fixed point of a target-percent rebalance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROUNDS = 50


def cost_factor(legs: Column, nav: Column, cost: Column, rounds: int = MAX_ROUNDS) -> Column:
    """Post-cost NAV over pre-cost NAV.

    legs is an array of (w, v): target weight and current value of each asset in the units of
    nav, one entry per asset of the universe. Targets are fractions of NAV after costs, so x
    solves x = 1 - cost * sum(abs(w * x - v / nav)). Each round shrinks the error by cost.
    """

    def traded(x: Column) -> Column:
        return F.aggregate(
            legs, F.lit(0.0), lambda acc, leg: acc + F.abs(leg["w"] * x - leg["v"] / nav)
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), F.lit(1.0), lambda x, _: 1 - cost * traded(x)
    )
