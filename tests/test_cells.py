"""Walk-forward fits from sums per cell against the fits on rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from lagwise.operators import cells, models

DAY0 = dt.date(2024, 1, 1)


def games(spark, n=1500):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        x, z, line = float(rng.integers(0, 20)), float(rng.integers(0, 9)), float(rng.integers(-10, 10))
        margin = float(round(x * (z > 4) - line + rng.normal() * 3)) if i % 17 else None
        rows.append((i, DAY0 + dt.timedelta(days=i // 30), (x if i % 7 else float("nan")) if i % 11 else None, z, None, margin, line))
    return spark.createDataFrame(rows, "game_id bigint, game_date date, x double, z double, empty double, home_margin double, spread_signed double")


def test_long_windows_are_fitted_from_cells(spark, monkeypatch):
    df = games(spark)
    monkeypatch.setitem(models.REGRESSORS, "whole", lambda: GBTRegressor(maxIter=6, maxDepth=3, stepSize=0.1, seed=1))
    monkeypatch.setitem(models.REGRESSORS, "forest", lambda: RandomForestRegressor(numTrees=25, maxDepth=5, seed=1))
    names = ["linear", "elastic", "forest", "whole"]

    def run(rows, some):
        out = models.walk_forward(rows, "game_date", "game_id", ["x", "z", "empty"], some, 805, 500)[0]
        assert out.columns == ["game_id", "fold", "model", "pred", "sigma", "home_margin"]
        return {(r.game_id, r.fold, r.model): (r.pred, r.sigma, r.home_margin) for r in out.collect()}

    plain = run(df, names)
    monkeypatch.setattr(cells, "CELL_ROWS", 100)
    monkeypatch.setattr(models, "fit_fold", None)  # no fit on rows is left
    long = run(df.repartition(3), names)
    assert set(long) == set(plain) and len({f for _, f, _ in plain}) == 2
    assert all(long[k][2] == plain[k][2] for k in plain)
    for k, (pred, sigma, _) in plain.items():
        if k[2] != "forest":  # nothing is drawn at random
            assert long[k][0] == pytest.approx(pred, abs=1e-9) and long[k][1] == pytest.approx(sigma, abs=1e-9)
    forest = [k for k in plain if k[2] == "forest" and plain[k][2] is not None]
    error = [math.sqrt(np.mean([(t[k][0] - t[k][2]) ** 2 for k in forest])) for t in (plain, long)]
    assert error[1] == pytest.approx(error[0], rel=0.05)
    monkeypatch.setattr(cells, "TREES", 4)
    assert run(df.repartition(5), ["forest"]).keys() == set(k for k in plain if k[2] == "forest")


def test_cells_of_one_chunk_or_many_add_up(spark, monkeypatch):
    df = games(spark, 900)
    monkeypatch.setattr(cells, "CELL_ROWS", 100)
    monkeypatch.setitem(models.REGRESSORS, "whole", lambda: GBTRegressor(maxIter=4, maxDepth=3, stepSize=0.1, seed=1))

    def run():
        return {(r.game_id, r.fold): (r.pred, r.sigma) for r in models.walk_forward(df, "game_date", "game_id", ["x", "z"], ["whole"], 500, 400)[0].collect()}

    one = run()
    monkeypatch.setattr(cells, "CHUNK", 60)
    monkeypatch.setattr(cells, "DRAW_ROWS", 400)
    many = run()
    assert set(one) == set(many) and all(many[k] == pytest.approx(one[k], abs=1e-9) for k in one)


def test_draws_follow_their_law():
    rng = np.random.default_rng(5)
    for sort, rate in (("forest", 1.0), ("forest", 0.6), ("boosted", 0.8), ("boosted", 1.0)):
        cdf = cells.chances(sort, rate)
        k = cells.drawn_times(rng, cdf, cells.quick_table(cdf), 200_000)
        assert k.mean() == pytest.approx(rate, abs=0.01) and k.var() == pytest.approx(rate if sort == "forest" else rate * (1 - rate), abs=0.02)
        assert k.min() >= 0 and (sort == "forest" or k.max() == 1)


def test_medians_and_edges_are_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, 0.0 if i % 13 else None, float(rng.normal()) if i % 5 else None, float(i % 3) if i % 4 else float("nan"), None) for i in range(500)]
    table = spark.createDataFrame(rows, "__pos long, label double, a double, b double, c double").repartition(3)
    windows = [(1, "all", 0, 400), (1, "early", 0, 320), (2, "all", 150, 500), (2, "early", 150, 430)]
    medians, edges = models.window_values(table, windows, ["a", "b", "c"], 8)
    assert models.window_medians(table, windows, ["a", "b", "c"]) == medians
    for fold, part, lo, hi in windows:
        known = [r for r in rows if lo <= r[0] < hi and r[1] is not None]
        a = sorted(r[2] for r in known if r[2] is not None)
        b = sorted(r[3] for r in known if not math.isnan(r[3]))
        assert medians[fold, part] == {"a": a[(len(a) + 1) // 2 - 1], "b": b[(len(b) + 1) // 2 - 1]}
        assert list(edges[fold, part]["a"]) == [a[-(-k * len(a) // 8) - 1] for k in range(1, 8)] and list(edges[fold, part]["b"]) == [0.0, 1.0]


def test_positions_of_divided_days_are_exact(spark):
    days = [3, 10, 1, 6]
    rows = [(d, k * 7 % n) for d, n in enumerate(days) for k in range(n)]
    df = spark.createDataFrame([(i, DAY0 + dt.timedelta(days=d)) for d, i in rows], "id long, day date").repartition(3)
    got = sorted((r.day, r["__pos"], r.id) for r in cells.placed_by_day(df, "day", "id", [0, 8, 13, 17]).collect())
    want = [(DAY0 + dt.timedelta(days=d), sum(days[:d]) + (i if d in (1, 3) else 0), i) for d, n in enumerate(days) for i in range(n)]
    assert got == sorted(want)
    whole = cells.placed_by_day(df, "day", "id", [0, 3, 13]).agg(F.countDistinct("__pos")).first()[0]
    assert whole == 4
