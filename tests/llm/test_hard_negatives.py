import numpy as np
import pytest

from barframe.llm import hard_negatives as hn

SHAPE = "vec_id long, embedding array<double>, label int, v string, block int, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SHAPE)


def brute(rows, every=100, k=5, m=5, low=80, high=100, scale=256):
    rows = sorted({i: (i, [int(np.floor(x * scale)) for x in v], label) for i, v, label in sorted(rows, reverse=True)}.values())
    ids, labels = [r[0] for r in rows], [r[2] for r in rows]
    v = np.array([r[1] for r in rows], dtype=object)
    out = []
    for a, anchor in enumerate(ids):
        if anchor % every:
            continue
        s = [int(x) for x in v @ v[a]]
        ranked = sorted((-x, i, j) for j, (x, i) in enumerate(zip(s, ids, strict=True)) if j != a)
        for _, positive, p in [x for x in ranked if labels[x[2]] == labels[a]][:k]:
            found = [x for x in ranked if labels[x[2]] != labels[a] and low * s[p] <= -100 * x[0] <= high * s[p]][:m]
            out += [(anchor, positive, n + 1, i, s[p], -x) for n, (x, i, _) in enumerate(found)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in hn.hard_negatives(df, **kw).collect())


@pytest.mark.parametrize("d", [1, 2, 3, 7, 16, 64])
def test_bounds_hold_on_every_level(d):
    rng = np.random.default_rng(d)
    v = rng.integers(-300, 300, (200, d))
    mean, dev = hn.summary(v.astype(float))
    ids = np.arange(200, dtype=np.int64)
    rows = hn.Rows(ids.tobytes(), (ids % 1).tobytes(), v.astype(np.int64).tobytes(), mean.tobytes(), dev.tobytes(), d)
    assert rows.levels[0][0].shape[1] == 1
    for at in range(0, 200, 17):
        exact = v @ v[at]
        wide = None
        for level in range(len(rows.levels)):
            low, high = hn.Tile(rows, rows, at).bounds(level, ids)
            assert (low <= exact).all() and (exact <= high).all()
            assert wide is None or ((high - low) <= wide + 1e-3).all()
            wide = high - low


@pytest.mark.parametrize("block, chunk", [(16, 3), (4096, 128)])
def test_equals_all_pairs(spark, block, chunk):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((4, 9))
    rows = [(i, (centres[i % 4] + 0.5 * rng.standard_normal(9)).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, rows[20][1], i % 3) for i in range(120)]  # one very common vector
    assert mined(table(spark, rows), anchors_every=20, block=block, chunk=chunk) == brute(rows, every=20)


def test_other_limits(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist(), i % 2) for i in range(150)]
    kw = {"low": 50, "high": 90, "scale": 1}
    assert mined(table(spark, rows), anchors_every=10, positives=3, negatives=4, block=20, **kw) == brute(rows, 10, 3, 4, **kw)


def test_large_components(spark):
    rng = np.random.default_rng(13)
    rows = [(i, (rng.standard_normal(8) * 2.0**19).tolist(), i % 2) for i in range(60)]
    assert mined(table(spark, rows), anchors_every=10, block=20) == brute(rows, every=10)


def test_too_large_components(spark):
    with pytest.raises(Exception, match="63 bits"):
        mined(table(spark, [(i, [1e9 * (i + 1)] * 8, i % 2) for i in range(10)]), anchors_every=5)


def test_rows_that_take_no_part_and_repeats(spark):
    rng = np.random.default_rng(14)
    good = [(i, rng.standard_normal(4).tolist(), i % 2) for i in range(80)]
    nan, inf = float("nan"), float("inf")
    bad = [
        (None, [9.0] * 4, 0), (200, None, 0), (300, [1.0, None, 1.0, 1.0], 1), (400, [nan, 1.0, 1.0, 1.0], 0), (500, [inf, 1.0, 1.0, 1.0], 1),
        (600, [9.0] * 3, 0), (700, [9.0] * 4, None), (800, [], 1),
    ]
    again = [(3, good[3][1], good[3][2]), (5, [9.0] * 4, 0), (20, [9.0] * 4, 0)]
    assert mined(table(spark, good + bad + again), anchors_every=20, block=30) == brute(good + again, every=20)


def test_lone_labels_and_empty_table(spark):
    assert mined(table(spark, [(0, [1.0, 1.0], 0), (1, [1.0, 1.0], 1)])) == []
    assert mined(table(spark, [(0, [1.0, 1.0], 0), (1, [1.0, 1.0], 0)])) == []
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(0, None, None)])) == []
    zero = [(0, [0.0], 0), (1, [1.0], 0), (2, [1.0], 1)]
    assert mined(table(spark, zero)) == [(0, 1, 1, 2, 0, 0)] == brute(zero)
