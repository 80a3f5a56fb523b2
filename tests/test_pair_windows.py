import numpy as np
import pytest

from barframe.operators import pairs as P


@pytest.mark.parametrize("lookback", [5, 60])
def test_rolling_slope_from_running_sums(spark, lookback):
    rng = np.random.default_rng(8)
    rows = []
    for name, level in (("a", 1.0), ("b", 1e5)):
        one, two = (level * np.exp(np.cumsum(rng.normal(0, 0.01, 1500))) for _ in range(2))
        rows += [(name, i, float(x), float(y)) for i, (x, y) in enumerate(zip(one, two, strict=True))]
    rows += [("flat", i, 2.0 + i, 3.0) for i in range(100)]
    df = spark.createDataFrame(rows, "pair_id string, ts int, l1 double, l2 double")
    got = P.with_hedge_spread(df, lookback).toPandas().sort_values(["pair_id", "ts"])
    for name in "ab":
        part = got[got.pair_id == name]
        x, y = np.log(part.l2.to_numpy()), np.log(part.l1.to_numpy())
        assert part.beta[:lookback].isna().all()
        for i in range(lookback, len(part), 37):
            slope = np.polyfit(x[i - lookback:i], y[i - lookback:i], 1)[0]
            assert part.beta.iloc[i] == pytest.approx(slope, abs=1e-7)
            assert part.spread.iloc[i] == pytest.approx(y[i - 1] - slope * x[i - 1], abs=1e-5)
    assert got[got.pair_id == "flat"].beta.isna().all()
