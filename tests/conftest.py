import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from barframe.session import local_session

    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_panel(spark):
    """closes {asset: [price, ...]} -> aligned panel with consecutive days."""
    import datetime as dt

    from barframe.operators.bars import aligned_panel

    def build(closes, start=dt.date(2015, 1, 1)):
        n = len(next(iter(closes.values())))
        rows = [(a, start + dt.timedelta(days=i), float(p)) for a, ps in closes.items() for i, p in enumerate(ps)]
        bars = spark.createDataFrame(rows, "asset string, ts date, close double")
        uni = spark.createDataFrame([("U", a, i) for i, a in enumerate(closes)], "universe_id string, asset string, asset_ord int")
        assert n
        return aligned_panel(bars, uni).cache()

    return build


@pytest.fixture(scope="session")
def make_run(spark):
    def build(assets, family, lookback, n, top_k=1, rebalance=21, skip=0, hedge=None, run_id="r", pos0=0):
        return spark.createDataFrame(
            [(run_id, "U", list(assets), family, lookback, top_k, rebalance, skip, hedge, pos0, n - 1)],
            "run_id string, universe_id string, assets array<string>, family string, lookback int, top_k int, "
            "rebalance int, skip int, hedge_weight double, pos0 int, pos1 int",
        )

    return build
