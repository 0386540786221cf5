"""Entry comparison against plain regressions, and findings as data."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.operators import aggregates, diagnostics, entries


def table(spark, n=1200):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i // 5, rng.gauss(0, 1), rng.gauss(0, 2), rng.random()) for i in range(n)]
    rows = [(k, g, 0.5 * x - 0.2 * z + rng.gauss(0, 1 + (g % 3)) if k == "a" else x + z, x, z if u > 0.02 else None) for k, g, x, z, u in rows]
    return spark.createDataFrame(rows + [("c", 1, 1.0, 2.0, 3.0)], "k string, g int, y double, x double, z double")


def test_grouped_regression_equals_one_at_a_time(spark):
    df = table(spark)
    got = {(r.k, r.term): r for r in entries.grouped_ols(df, ["k"], "y", ["x", "z"], "g").collect()}
    for k in "ab":
        for r in aggregates.ols(df.where(F.col("k") == k), F.col("y"), {"x": F.col("x"), "z": F.col("z")}, "g").collect():
            own = got[k, r.term]
            assert own.n == r.n and own.coef == pytest.approx(r.coef, abs=1e-9) and own.se == pytest.approx(r.se, abs=1e-9)
    assert got["c", "x"].coef is None and got["c", "x"].n == 1
    flat = entries.grouped_ols(df.withColumn("z", F.col("x") * 2), ["k"], "y", ["x", "z"], "g").collect()
    assert all(r.coef is None for r in flat)  # collinear
    assert entries.grouped_ols(df.limit(0), ["k"], "y", ["x"], "g").collect() == []


def test_entries_use_the_last_quote_before_them(spark):
    t = dt.datetime(2024, 1, 2, 20)
    ago = lambda h: t - dt.timedelta(hours=h)
    games = spark.createDataFrame([(1, t), (2, t), (3, t)], "game_id int, start timestamp")
    quotes = spark.createDataFrame(
        [(1, ago(25), 2.0, 1.9), (1, ago(12), 2.2, 1.75), (1, ago(1), 2.4, 1.65), (1, t + dt.timedelta(hours=1), 9.0, 1.01),
         (2, ago(5), 2.0, 1.9), (3, ago(30), 2.0, 1.9), (3, ago(2), 5.0, 5.0)],
        "game_id int, at timestamp, decimal_home double, decimal_away double",
    )
    got = {(r.game_id, r.entry): (r.decimal_home, r.p_close) for r in entries.entry_prices(games, quotes, "game_id", "start", "at", {"open": 20, "timed": 9, "close": 0}).collect()}
    close = (1 / 2.4) / (1 / 2.4 + 1 / 1.65)
    assert got == {(1, "open"): (2.0, pytest.approx(close)), (1, "timed"): (2.2, pytest.approx(close)), (1, "close"): (2.4, pytest.approx(close))}  # 2: no open, 3: broken close


def test_entry_report_finds_what_a_forecast_knows(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(4000):
        truth = rng.normal()
        p = 1 / (1 + math.exp(-truth))
        win = float(rng.random() < p)
        close = 1 / (1 + math.exp(-(truth + 0.1 * rng.normal())))
        opened = 1 / (1 + math.exp(-(truth + 0.8 * rng.normal())))
        for entry, q in (("open", opened), ("close", close)):
            rows.append((i, i // 10, entry, 0.98 / q, 0.98 / (1 - q), q, close, 1 / (1 + math.exp(-(truth + 0.3 * rng.normal()))), float(rng.random()), win))
    df = spark.createDataFrame(rows, "game_id int, day int, entry string, decimal_home double, decimal_away double, p_entry double, p_close double, good double, noise double, win double")
    got = {(r.forecast, r.entry): r for r in entries.entry_report(df, {"good": "good", "noise": "noise"}, "win", "day").collect()}
    assert got["good", "open"].clv_slope > 0.5 and got["good", "open"].mean_clv > 0.05 and got["good", "close"].clv_slope is None
    assert abs(got["noise", "close"].close_slope) < 4 * got["noise", "close"].close_se + 0.02 and got["good", "open"].log_loss < got["noise", "open"].log_loss
    own = df.where("entry = 'open'").withColumn("p", F.least(F.greatest("good", F.lit(0.01)), F.lit(0.99)))
    lo = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    want = {r.term: r for r in aggregates.ols(own, lo("p_close") - lo("p_entry"), {"x": lo("p") - lo("p_entry")}, "day").collect()}["x"]
    assert got["good", "open"].clv_slope == pytest.approx(want.coef, abs=1e-9) and got["good", "open"].clv_se == pytest.approx(want.se, abs=1e-9)


def test_spread_report_slices(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i // 8, float(round(e + rng.normal(0, 12))), float(rng.integers(-9, 9)), None) for i, e in enumerate(rng.normal(0, 4, 1000))]
    df = spark.createDataFrame(rows, "id int, day int, margin double, line double, pred double").withColumn("pred", F.col("margin") / 4 + F.col("id") % 7 - F.col("line"))
    got = {r.slice: r for r in entries.spread_report(df, "margin", "line", ["pred"], "day").collect()}
    assert got["all"].n == 1000 and 195 <= got["top"].n <= 210
    want = {r.term: r for r in aggregates.ols(df, F.col("margin") + F.col("line"), {"x": F.col("pred") + F.col("line")}, "day").collect()}["x"]
    assert got["all"].slope == pytest.approx(want.coef) and got["all"].se == pytest.approx(want.se)


def test_rules_are_rows(spark):
    metrics = spark.createDataFrame([("x", "best_model_roi", 0.1, "m1"), ("x", "avg_model_win_rate", 0.49, None), ("x", "feature_match_rate", 0.99, None), ("x", "best_decile_roi", None, None), ("x", "other", 1.0, None)], diagnostics.METRICS)
    found = [(r.metric, r.severity, r.label) for r in diagnostics.rule_findings(metrics).collect()]
    assert found == [("avg_model_win_rate", "medium", None), ("feature_match_rate", "positive", None), ("best_model_roi", "positive", "m1")]
    extra = diagnostics.rule_findings(metrics, [("a", "own rule", "other", "<=", 1.0, "high", "positive")]).collect()
    assert [(r.area, r.finding, r.value, r.severity) for r in extra] == [("a", "own rule", 1.0, "high")]
    assert len(diagnostics.RULES) == 11 and len({r[2] for r in diagnostics.RULES}) == 11
