import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from lagwise.operators import isotonic

ROWS = "id bigint, m string, p double, y int"


def bounds_fit(points):
    """Largest over starts of the least mean over ends: the characterisation of the fit."""
    x = sorted(points)
    s = np.cumsum([0] + [points[v][0] for v in x])
    n = np.cumsum([0] + [points[v][1] for v in x])
    mean = lambda a, b: (s[b + 1] - s[a]) / (n[b + 1] - n[a])
    return {v: max(min(mean(a, b) for b in range(i, len(x))) for a in range(i + 1)) for i, v in enumerate(x)}


def sums(rows):
    points = {}
    for p, y in rows:
        won, n = points.get(p, (0, 0))
        points[p] = (won + y, n + 1)
    return points


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12).map(float), st.integers(0, 1)), min_size=1, max_size=40), st.integers(1, 12))
def test_pooling_parts_first_changes_nothing(rows, cut):
    points = sums(rows)
    x = np.array(sorted(points))
    whole = (x, x, np.array([points[v][0] for v in x], dtype=float), np.array([points[v][1] for v in x], dtype=float))
    parts = [isotonic.pooled(tuple(a[where] for a in whole)) for where in (x < cut, x >= cut)]
    for blocks in (isotonic.pooled(whole), isotonic.pooled(tuple(np.concatenate(c) for c in zip(*parts)))):
        lo, hi, won, n = blocks
        fit = {v: (won / n)[np.searchsorted(lo, v, side="right") - 1] for v in x}
        assert fit == pytest.approx(bounds_fit(points))
        assert n.sum() == len(rows) and np.all(np.diff(won / n) > 0)


def test_one_late_fall_takes_linear_time():
    n = 200_000
    x = np.arange(n, dtype=float)
    lo, hi, won, w = isotonic.pooled((x, x, np.append(x[:-1], -1e12), np.ones(n)))
    assert len(lo) == 1 and hi[0] == n - 1 and w[0] == n


def test_groups_in_one_job_equal_separate_fits(spark):
    rng = np.random.default_rng(4)
    rows = [(i, m, float(rng.integers(0, 400)) / 400, int(rng.random() < chance)) for m, size, chance in (("hot", 6000, 0.5), ("a", 300, 0.3), ("b", 40, 0.8)) for i in range(size)]
    rows = [(i, m, p, int(y or rng.random() < p / 2)) for i, m, p, y in rows]
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    test = spark.createDataFrame([(i, m, i / 1000 - 0.1, None) for m in ("hot", "a", "b") for i in range(1200)], ROWS)
    got = {(r.m, r.id): r.p_isotonic for r in isotonic.isotonic(df, test, "p", "y", ["m"]).collect()}
    assert len(got) == 3600
    for m in ("hot", "a", "b"):
        points = sums((p, y) for _, k, p, y in rows if k == m)
        fit = bounds_fit(points) if m != "hot" else None
        own = df.where(F.col("m") == m).groupBy("p").agg(F.avg("y").alias("label"), F.count("*").cast("double").alias("weight"))
        model = IsotonicRegression(featuresCol="p", weightCol="weight").fit(own)
        want = {r.id: r.prediction for r in model.transform(test.where(F.col("m") == m)).collect()}
        assert {i: v for (k, i), v in got.items() if k == m} == pytest.approx(want)
        if fit:
            x = sorted(fit)
            assert [want[i] for i in range(1200)] == pytest.approx(np.interp([i / 1000 - 0.1 for i in range(1200)], x, [fit[v] for v in x]))


def test_awkward_rows(spark):
    train = spark.createDataFrame([(1, None, 0.2, 0), (2, None, 0.4, 1), (3, "a", None, 1), (4, "a", 0.5, None), (5, "b", float("nan"), 1), (6, "b", 0.5, 1)], ROWS)
    test = spark.createDataFrame([(1, None, 0.3, None), (2, None, None, None), (3, "a", 0.5, None), (4, "b", 0.1, None), (5, "b", float("nan"), None), (6, "new", 0.5, None), (7, "b", 0.1, None)], ROWS)
    out = isotonic.isotonic(train, test, "p", "y", ["m"])
    assert out.columns == ["id", "m", "p", "y", "p_isotonic"]
    assert {r.id: r.p_isotonic for r in out.collect()} == {1: pytest.approx(0.5), 2: None, 3: None, 4: 1.0, 5: None, 6: None, 7: 1.0}
    assert isotonic.isotonic(train, test.limit(0), "p", "y", ["m"]).count() == 0
    empty = isotonic.isotonic(train.limit(0), test, "p", "y", ["m"]).collect()
    assert len(empty) == 7 and all(r.p_isotonic is None for r in empty)
    whole = {r.id: r.p_isotonic for r in isotonic.isotonic(train, test, "p", "y").collect()}
    assert whole[6] == 1.0 and whole[4] == 0.0 and whole[2] is None
