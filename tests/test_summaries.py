import pytest
from pyspark.sql import functions as F

from lagwise.functions.numeric import weighted_difference
from lagwise.operators import aggregates, diagnostics, ledger, schema


def test_fold_risk(spark):
    rows = [("a", 1, 1.0, 0.5), ("a", 1, 1.0, -0.1), ("a", 2, 1.0, -0.5), ("a", 3, 1.0, 0.2), ("same", 1, 1.0, 0.1), ("same", 2, 2.0, 0.2), ("one", 1, 1.0, -0.3), ("none", 1, 0.0, 0.0)]
    out = {r.model: r for r in ledger.fold_risk(spark.createDataFrame(rows, "model string, fold int, stake double, profit double"), ["model"]).collect()}
    roi = [0.2, -0.5, 0.2]
    mean = sum(roi) / 3
    spread = (sum((x - mean) ** 2 for x in roi) / 2) ** 0.5
    a = out["a"]
    assert (a.folds, a.mean_roi, a.volatility, a.sharpe) == (3, pytest.approx(mean), pytest.approx(spread), pytest.approx(mean / spread))
    assert a.max_drawdown == pytest.approx(-0.5)  # equity 1.4, 0.7, 0.84
    assert out["same"].sharpe == 0.0 and out["same"].max_drawdown == 0.0
    assert out["one"].sharpe is None and out["one"].max_drawdown == pytest.approx(-0.3)
    assert out["none"].mean_roi is None and out["none"].folds == 1


def test_regime_plan(spark):
    daily = spark.createDataFrame([("m", "high_vol", 2, 0.5, 1.0), ("m", "high_vol", 4, 1.0, -2.0), ("m", "low_vol", 1, None, 0.5), ("m", None, 1, 0.0, 0.0)], "model string, vol_bucket string, daily_bets long, daily_win_rate double, daily_pnl double")
    out = {r.vol_bucket: r for r in ledger.regime_plan_summary(ledger.regime_plan(daily, {"high_vol": "R2"}, "R1"), ["model"]).collect()}
    assert {k: r.profile for k, r in out.items()} == {"high_vol": "R2", "low_vol": "R1", None: "R1"}
    high = out["high_vol"]
    assert (high.days, high.total_bets, high.avg_daily_bets, high.avg_daily_win_rate, high.avg_daily_pnl) == (2, 6, 3.0, 0.75, -0.5)
    assert {r.profile for r in ledger.regime_plan(daily, {}, "R1").collect()} == {"R1"}


def test_mixed_first_is_by_order_and_keeps_nulls(spark):
    rows = [("g", 2, 5, 1), ("g", 1, None, 2), ("g", 3, 9, None), ("h", 1, 4, 3)]
    df = spark.createDataFrame(rows, "k string, at int, x int, y int").repartition(3)
    out = {r.k: r for r in aggregates.mixed(df, ["k"], ["at"], {"first_x": "x"}, {"max_x": "x"}, {"sum_y": "y"}, {"big": F.col("x") > 8}).collect()}
    assert (out["g"].first_x, out["g"].max_x, out["g"].sum_y, out["g"].big) == (None, 9, 3, True)
    assert (out["h"].first_x, out["h"].max_x, out["h"].sum_y, out["h"].big) == (4, 4, 3, False)


def test_fill_and_weighted_difference(spark):
    df = spark.createDataFrame([(1, None, True), (2, None, False), (3, 4.0, True), (4, None, None)], "id int, x double, ok boolean")
    assert [r.x for r in schema.fill_trusted(df, ["x"], F.col("ok")).orderBy("id").collect()] == [0.0, None, 4.0, None]
    out = df.select(weighted_difference([(0.5, F.col("x"), F.lit(1.0)), (-2.0, F.col("id"), F.lit(1))]).alias("v")).collect()
    assert [r.v for r in out] == [None, None, -2.5, None]


def test_model_statistics_and_strategies(spark):
    summary = spark.createDataFrame([("a", 3), ("b", 0)], "model string, num_bets int")
    bets = spark.createDataFrame([("a", "HOME", "mirrored", 2.0), ("a", "AWAY", "default", -1.0), ("a", "HOME", "default", 0.0)], "model string, bet_side string, tier string, pnl double")
    predictions = spark.createDataFrame([("a", 3.0, 0.0), ("a", 4.0, 0.0), ("b", 1.0, 1.0)], "model string, home_margin double, pred_ensemble double")
    regimes = spark.createDataFrame([("a", "high_vol", 2.0), ("a", "low_vol", 0.5), ("b", "high_vol", 1.0)], "model string, vol_bucket string, daily_pnl double")
    a, b = diagnostics.model_statistics(summary, bets, predictions, regimes).orderBy("model").collect()
    assert (a.home_away_pnl_gap, a.tier_gap, a.rmse_mean, a.vol_high_minus_low) == (2.0, 2.5, pytest.approx(12.5**0.5), 1.5)
    assert (b.home_away_pnl_gap, b.tier_gap, b.rmse_mean, b.vol_high_minus_low) == (None, None, 0.0, None)
    matrix = spark.createDataFrame([("s", "a", 0.1, -0.2, 5), ("s", "b", 0.1, -0.4, 7), ("s", "c", -0.2, 0.0, 1)], "strategy_id string, model string, roi double, max_drawdown double, bets_placed long")
    r = diagnostics.strategy_summary(matrix).first()
    assert (r.avg_roi, r.median_roi, r.avg_max_drawdown, r.total_bets, r.best_model, r.best_roi) == (pytest.approx(0.0), 0.1, pytest.approx(-0.2), 13, "b", 0.1)
    assert ledger.exposure_and_pnl(spark.createDataFrame([("x", 1.0, 2.0), ("x", 0.5, -1.0)], "tier string, stake double, profit double"), ["tier"]).first()[1:] == (2, 1.5, 1.0)
