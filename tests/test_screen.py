"""The tree screen against boosting on rows, and on planted leaks."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.operators import audits, screen


def boosted_on_rows(x, y, trees):
    """Least-squares boosting on the rows of ``x`` (two integer columns), one row at a time in every sum."""
    f = np.full(len(y), y.mean())
    for _ in range(trees.count):
        leaves = [np.arange(len(y))]
        for _ in range(trees.depth):
            grown = []
            for rows in leaves:
                r, best = (y - f)[rows], (1e-9, None)
                for axis in (0, 1):
                    for cut in np.unique(x[rows, axis])[1:]:
                        left = x[rows, axis] < cut
                        a, b = left.sum(), (~left).sum()
                        if min(a, b) >= trees.least:
                            gain = r[left].sum() ** 2 / a + r[~left].sum() ** 2 / b - r.sum() ** 2 / len(r)
                            if gain > best[0] + 1e-12:
                                best = (gain, left)
                grown += [rows] if best[1] is None else [rows[best[1]], rows[~best[1]]]
            leaves = grown
        step = np.zeros(len(y))
        for rows in leaves:
            step[rows] = trees.rate * (y - f)[rows].mean()
        f = f + step
    return f


def test_grid_fit_equals_row_fit():
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 6, 500), rng.integers(0, 5, 500)], axis=1)
    y = rng.normal(size=500) + np.abs(x[:, 1] - 2) + 0.3 * x[:, 0]
    trees = screen.Trees(count=12, rate=0.3, least=20, bins=5)
    n, s = np.zeros((6, 6)), np.zeros((6, 6))
    np.add.at(n, (x[:, 0], x[:, 1]), 1)
    np.add.at(s, (x[:, 0], x[:, 1]), y)
    assert np.allclose(screen.boosted(n, s, trees)[x[:, 0], x[:, 1]], boosted_on_rows(x, y, trees))


def table(spark, n=4000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        margin, line = float(rng.randint(-30, 30)), float(rng.randint(-9, 9))
        sign = rng.choice([-1, 1])
        row = [i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 9), margin if i % 50 else None, line, sign * abs(margin) + rng.random(), abs(margin) + 9 * rng.random()]
        row += [rng.random() if j % 4 or rng.random() < 0.7 else None for j in range(9)] + [None, float(i) if i < 900 else None, float("nan")]
        rows.append(tuple(row))
    names = ["id int", "day date", "m double", "line double", "folded double", "plain double", *[f"n{j} double" for j in range(9)], "empty double", "early double", "broken double"]
    return spark.createDataFrame(rows, ", ".join(names))


FEATURES = ["folded", "plain", *[f"n{j}" for j in range(9)], "empty", "early", "broken"]
FAST = screen.Trees(count=40, rate=0.1, bins=16)


def test_a_leak_without_direction_is_found(spark):
    df = table(spark)
    got = {r.feature: r for r in screen.tree_leak_screen(df, F.abs("m"), F.abs("line"), FEATURES, "day", trees=FAST).collect()}
    assert set(got) == set(FEATURES)
    assert {f for f, r in got.items() if r.flagged} >= {"folded", "plain"} and sum(r.flagged for r in got.values()) <= 3
    assert got["folded"].d_r2 > 0.5 and got["plain"].d_r2 > 0.5 and all(abs(got[f"n{j}"].d_r2) < 0.1 for j in range(9))
    assert got["empty"].d_r2 is None and got["early"].d_r2 is None and got["broken"].d_r2 is None and not got["empty"].flagged
    linear = {r.feature: r.d_r2 for r in audits.linear_leak_screen(df, F.abs("m"), F.abs("line"), FEATURES[:-1]).collect()}
    assert linear["plain"] > 0.5 and abs(linear["folded"]) < 0.01  # a linear screen cannot see it


def test_screen_does_not_depend_on_partitions(spark):
    df = table(spark, 2500)
    one = [screen.tree_leak_screen(d, F.abs("m"), F.abs("line"), ["folded", "n1", "n4"], "day", trees=FAST).select("feature", "rows", F.round("r2", 9)).orderBy("feature").collect()
           for d in (df.coalesce(1), df.repartition(5))]
    assert one[0] == one[1] and one[0][0].rows == 2500 - 50


def test_no_later_block_enters_a_fit(spark):
    df = table(spark, 2500)
    rows = df.where("m IS NOT NULL").select(F.col("day").alias("__day"), F.abs("m").alias("__y"), F.abs("line").alias(screen.BASE), "folded")
    blocks = screen.time_blocks(rows, "__day", 5).groupBy("__block").agg(F.min("__day").alias("a"), F.max("__day").alias("z"), F.count("*").alias("n")).orderBy("__block").collect()
    assert [r["__block"] for r in blocks] == list(range(5)) and all(x["z"] < y["a"] for x, y in zip(blocks, blocks[1:]))
    assert max(r.n for r in blocks) - min(r.n for r in blocks) <= 18


def test_edges_and_empty(spark):
    df = table(spark, 300)
    with pytest.raises(ValueError):
        screen.tree_leak_screen(df, F.abs("m"), F.abs("line"), ["n1"], "day", train_blocks=10)
    assert screen.tree_leak_screen(df.limit(0), F.abs("m"), F.abs("line"), ["n1"], "day").collect() == []
    few = screen.tree_leak_screen(df, F.abs("m"), F.abs("line"), ["n1"], "day").collect()
    assert [(r.d_r2, r.flagged) for r in few] == [(None, False)]


def test_edges_of_many_rows_come_from_points(spark, monkeypatch):
    df = table(spark, 3000).withColumn("few", F.col("id") % 3).repartition(3)
    columns = ["folded", "n1", "n4", "few", "empty", "broken"]
    plain = screen.bin_edges(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]), columns, 8)
    monkeypatch.setattr(screen, "POINTS_OF", 400)  # no task sees more at once, and no aggregate holds a sketch of all columns
    monkeypatch.setattr(F, "percentile_approx", None)
    exact = screen.bin_edges(df, columns, 8)
    assert all(list(exact[c]) == list(plain[c]) for c in columns) and len(exact["n1"]) == 7 and len(exact["empty"]) == len(exact["broken"]) == 0
    monkeypatch.setattr(screen, "POINTS", 50)
    values = sorted(r.n1 for r in df.select("n1").collect() if r.n1 is not None)
    for k, e in enumerate(screen.bin_edges(df, ["n1"], 8)["n1"], 1):
        assert abs(values.index(e) / len(values) - k / 8) <= 0.5 / 50 + 1 / len(values)
