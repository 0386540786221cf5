import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.operators import aggregates, calibration, folds, models, ratings, styles

random.seed(11)
DAY0 = dt.date(2024, 1, 1)


def schedule(n_days=90):
    rows, gid = [], 0
    for d in range(n_days):
        for _ in range(random.randint(0, 9)):
            rows.append((gid, DAY0 + dt.timedelta(days=d)))
            gid += 1
    return rows


def reference_folds(rows, train, test):
    days = sorted(r[1] for r in rows)
    bounds = sorted({0, len(days), *[i for i in range(1, len(days)) if days[i] != days[i - 1]]})
    start = next((b for b in bounds if b >= train), None) if train <= len(days) else None
    out = []
    while start is not None and start < len(days):
        train_from = max(b for b in bounds if b <= start - train)
        end = next((b for b in bounds if b >= start + test), bounds[-1])
        out.append((train_from, start, end))
        start = end
    return out


@pytest.mark.parametrize("train,test", [(60, 25), (100, 40), (10, 1), (10_000, 5)])
def test_fold_calendar(spark, train, test):
    rows = schedule()
    df = spark.createDataFrame(rows, "game_id bigint, game_date date").repartition(3)
    cal = folds.fold_calendar(df, "game_date", train, test)
    got = [(r["train_from"], r["test_from"], r["test_to"]) for r in cal.orderBy("fold").collect()]
    assert got == reference_folds(rows, train, test)
    tested = folds.assign_folds(df, cal, "game_date")
    assert tested.count() == tested.select("game_id").distinct().count()
    counts = {r["fold"]: r["count"] for r in tested.groupBy("fold").count().collect()}
    assert counts == {i + 1: b - a for i, (_, a, b) in enumerate(got)}
    learned = {r["fold"]: r["count"] for r in folds.training_rows(df, cal, "game_date").groupBy("fold").count().collect()}
    assert learned == {i + 1: a - t for i, (t, a, _) in enumerate(got)}


def test_fold_errors(spark):
    df = spark.createDataFrame([(1, DAY0), (2, None)], "game_id bigint, game_date date")
    with pytest.raises(ValueError):
        folds.fold_calendar(df, "game_date", 1, 1)
    with pytest.raises(ValueError):
        folds.fold_calendar(df, "game_date", 0, 1)


def test_fixed_row_folds_drop_tail(spark):
    df = spark.createDataFrame([(i, DAY0 + dt.timedelta(days=i // 7)) for i in range(50)], "game_id bigint, game_date date")
    out = folds.fixed_row_folds(df, ["game_date", "game_id"], 20, 9)
    got = {r["game_id"]: r["fold"] for r in out.collect()}
    assert got == {i: (None if i < 20 or i >= 47 else (i - 20) // 9 + 1) for i in range(50)}


def test_pair_ratings_match_loop(spark):
    games = []
    for d in range(160):
        for pool in (0, 1):
            teams = random.sample(range(8), 8)
            for k in range(2):
                games.append((pool, len(games), DAY0 + dt.timedelta(days=3 * d), 2024 if d < 80 else 2025, pool * 100 + teams[2 * k], pool * 100 + teams[2 * k + 1], random.randint(80, 99), random.randint(80, 99)))
    df = spark.createDataFrame(games, "pool_id int, game_id bigint, game_date date, season int, home int, away int, score_home int, score_away int").repartition(6)
    got = {r["game_id"]: (r["elo_home"], r["elo_away"]) for r in ratings.pair_ratings(df).collect()}
    elo, seen = {}, {}
    for _, gid, _, season, h, a, sh, sa in sorted(games, key=lambda g: (g[2], g[1])):
        for t in (h, a):
            elo.setdefault(t, 1500.0)
            if seen.get(t, season) != season:
                elo[t] = 0.75 * elo[t] + 0.25 * 1500
            seen[t] = season
        assert got[gid] == pytest.approx((elo[h], elo[a]), abs=1e-9)
        eh, ea = elo[h] + 65, elo[a]
        exp = 1 / (1 + 10 ** ((ea - eh) / 400))
        mult = math.log(abs(sh - sa) + 1) * (2.2 / ((eh - ea) * 0.001 + 2.2))
        act = 1 if sh > sa else 0
        elo[h] += 20 * mult * (act - exp)
        elo[a] += 20 * mult * ((1 - act) - (1 - exp))


def test_game_without_score_leaves_ratings(spark):
    kind = "pool_id int, game_id bigint, game_date date, season int, home int, away int, score_home int, score_away int"
    games = [(0, i, DAY0 + dt.timedelta(days=i), 2024, 1 + i % 2, 2 - i % 2, 90 + i, 95) for i in range(8)]
    gap = (0, 50, DAY0 + dt.timedelta(days=3, hours=0), 2024, 3, 4, None, 80)
    stub = (0, 99, DAY0 + dt.timedelta(days=20), 2024, 1, 2, None, None)
    whole = {r["game_id"]: (r["elo_home"], r["elo_away"]) for r in ratings.pair_ratings(spark.createDataFrame([*games, gap, stub], kind)).collect()}
    plain = {r["game_id"]: (r["elo_home"], r["elo_away"]) for r in ratings.pair_ratings(spark.createDataFrame(games, kind)).collect()}
    assert {i: whole[i] for i in plain} == plain
    assert whole[50] == (1500.0, 1500.0) and not any(math.isnan(v) for v in whole[99]) and whole[99] != (1500.0, 1500.0)


def test_logistic_keeps_every_row(spark):
    rng = random.Random(3)
    rows = [(i, i // 100, None if i % 50 == 7 else rng.gauss(0, 1), rng.randint(0, 1)) for i in range(500)]
    out = models.logistic_by_fold(spark.createDataFrame(rows, "game_id bigint, fold int, x double, won int"), "x", "won", 250).collect()
    assert len(out) == 500
    for r in out:
        want = "few rows" if r.fold <= 2 else "no feature" if r.game_id % 50 == 7 else None
        assert r.reason == want and (r.p is None) == (want is not None)


def calibration_rows():
    rng = np.random.default_rng(5)
    rows = []
    for fold in range(1, 5):
        for i in range(400):
            edge = float(rng.normal(0, 6))
            margin = float(np.round(edge + rng.normal(0, 14)))
            rows.append((fold * 1000 + i, fold, edge, 0.0, 0.0, margin, 5.0))
    return rows


CAL = "game_id bigint, fold int, pred_ensemble double, spread_signed double, settle_signed double, home_margin double, sigma_ensemble double"


def test_sigma_calibration_uses_earlier_folds_only(spark):
    rows = calibration_rows()
    mult = calibration.sigma_multipliers(spark.createDataFrame(rows, CAL))
    assert mult[1] == calibration.NO_BET_MULTIPLIER and all(1 < mult[f] < 6 for f in (2, 3, 4))
    changed = [(*r[:5], -r[5], r[6]) if r[1] >= 3 else r for r in rows]
    again = calibration.sigma_multipliers(spark.createDataFrame(changed, CAL))
    assert again[2] == mult[2] and again[3] == mult[3] and again[4] != mult[4]

    def loss(c, fold):
        total = 0.0
        for r in rows:
            if r[1] < fold and r[5] != 0:
                p = min(max(0.5 * math.erfc(-(r[2] / (c * 5.0)) / math.sqrt(2)), 1e-6), 1 - 1e-6)
                total -= math.log(p if r[5] > 0 else 1 - p)
        return total

    for f in (2, 3, 4):
        best = min(np.linspace(1, 8, 1401), key=lambda c: loss(c, f))
        assert abs(mult[f] - best) < 0.02
    out = calibration.calibrate_sigma(spark.createDataFrame(rows, CAL))
    assert {r["fold"] for r in out.where("bettable").collect()} == {2, 3, 4}


def test_probit_scale_is_the_exact_minimum_of_earlier_folds(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 15, 6000)
    won = rng.random(6000) < np.array([0.5 * math.erfc(-v / 12 / math.sqrt(2)) for v in x])
    rows = [(i // 300, float(v), int(w)) for i, (v, w) in enumerate(zip(x, won))]
    df = spark.createDataFrame(rows, "fold int, x double, y int")
    got = calibration.fit_probit_scale(df, "fold", list(range(22)), 3.0, 60.0, 1e-12)
    assert got[0] is None and got[20] == got[21]
    signed = np.array([v if w else -v for _, v, w in rows])

    def slope(c, upto):
        t = signed[:upto] / c
        tail = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in t])
        return float(np.sum(t * np.exp(-t * t / 2) / math.sqrt(2 * math.pi) / tail))

    for f in (1, 2, 7, 20):
        a, z = 3.0, 60.0
        for _ in range(40):
            mid = (a + z) / 2
            a, z = (a, mid) if slope(mid, 300 * f) > 0 else (mid, z)
        assert got[f] == pytest.approx(a, rel=1e-6)
    # outcomes that x decides, and outcomes against x, end at the edges
    sure = df.withColumn("y", (F.col("x") > 0).cast("int"))
    assert calibration.fit_probit_scale(sure, "fold", [9], 3.0, 60.0, 1e-12)[9] == 3.0
    assert calibration.fit_probit_scale(sure.withColumn("y", 1 - F.col("y")), "fold", [9], 3.0, 60.0, 1e-12)[9] == 60.0
    assert calibration.fit_probit_scale(df.limit(0), "fold", [9], 3.0, 60.0, 1e-12) == {9: None}


def test_shrunken_bins_identity_when_few(spark):
    df = spark.createDataFrame([(i, i / 100, i % 2) for i in range(50)], "id int, p double, y int")
    out = calibration.shrunken_bins(df, F.col("p"), F.col("y"))
    assert all(abs(r["p_calibrated"] - min(max(r["p"], 1e-4), 1 - 1e-4)) < 1e-12 for r in out.collect())


def test_causal_weights(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (1, "b", 20.0), (2, "a", 40.0), (2, "b", 20.0), (3, "a", 1.0), (3, "b", 1.0)], "fold int, model string, rmse double")
    w = {(r["fold"], r["model"]): r["weight"] for r in folds.causal_weights(df).collect()}
    assert w[1, "a"] == w[1, "b"] == 0.5
    assert w[2, "a"] == pytest.approx((1 / 10) / (1 / 10 + 1 / 20))
    assert w[3, "a"] == pytest.approx((1 / 25) / (1 / 25 + 1 / 20))
    m = {(r["fold"], r["model"]): r["weight"] for r in folds.causal_weights(df, {"a": 3.0, "b": 1.0}).collect()}
    assert m[1, "a"] == 0.75


def test_ols_recovers_slope_and_placebo(spark):
    rng = np.random.default_rng(1)
    truth = rng.normal(0, 1, 8000)
    model = truth + rng.normal(0, 1, 8000)
    y = truth + rng.normal(0, 1, 8000)
    df = spark.createDataFrame([(i, i // 4, float(a), float(b)) for i, (a, b) in enumerate(zip(y, model))], "id bigint, g int, y double, x double")
    r = {x["term"]: x for x in aggregates.ols(df, F.col("y"), {"x": F.col("x")}, "g").collect()}
    assert abs(r["x"]["coef"] - 0.5) < 4 * r["x"]["se"] and r["x"]["p"] < 1e-6
    mixed = aggregates.permuted(df, "x", "id", 3, "xs")
    assert sorted(round(v[0], 9) for v in mixed.select("xs").collect()) == sorted(round(float(v), 9) for v in model)
    p = {x["term"]: x for x in aggregates.ols(mixed, F.col("y"), {"xs": F.col("xs")}).collect()}
    assert abs(p["xs"]["coef"]) < 0.05


def test_walk_forward_and_forecast(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        x = float(rng.normal())
        line = float(rng.integers(-10, 10))
        rows.append((i, DAY0 + dt.timedelta(days=i // 6), x, None, 4 * x - line + float(rng.normal()), line))
    df = spark.createDataFrame(rows, "game_id bigint, game_date date, x double, empty double, home_margin double, spread_signed double")
    oos, cal = models.walk_forward(df, "game_date", "game_id", ["x", "empty"], ["linear"], 300, 100)
    assert cal.count() == 3 and oos.count() == 300
    assert models.fold_rmse(oos).agg(F.max("rmse")).first()[0] < 1.5
    assert 0.8 < oos.agg(F.max("sigma")).first()[0] < 1.3
    blend = models.ensembled(oos, "game_id")
    assert blend.count() == 300
    slate = df.where("game_id >= 594")
    out = models.forecast(df.where("game_id < 594"), slate, "game_date", "game_id", ["x", "empty"], ["linear"], 300, models.final_weights(oos))
    err = out.join(slate, "game_id").agg(F.max(F.abs(F.col("pred_margin") - F.col("home_margin")))).first()[0]
    assert out.count() == 6 and err < 5


def test_slate_is_a_fold_of_the_walk(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        x = float(rng.normal())
        line = float(rng.integers(-10, 10))
        rows.append((i, DAY0 + dt.timedelta(days=i // 6), f"h{i}", f"a{i}", x if i % 11 else None, None, 4 * x - line + float(rng.normal()), line))
    df = spark.createDataFrame(rows, "game_id bigint, game_date date, home string, away string, x double, empty double, home_margin double, spread_signed double")
    done, slate = df.where("game_id < 894"), df.where("game_id >= 894")
    args = ("game_date", "game_id", ["x", "empty"], ["linear", "elastic"], 300, 100)
    out = {r.game_id: r for r in models.forecast_slate(done, slate, *args).collect()}
    assert set(out) == set(range(894, 900)) and {r.data_through for r in out.values()} == {DAY0 + dt.timedelta(days=148)}
    assert {(r.home, r.away) for r in out.values()} == {(f"h{i}", f"a{i}") for i in range(894, 900)}
    # the slate's outcomes are not read, and the folds before it are those of a walk without it
    again = {r.game_id: r for r in models.forecast_slate(done, slate.withColumn("home_margin", F.lit(99.0)), *args).collect()}
    figures = ("pred_margin", "p_home_win", "sigma")  # equal but for the order in which sums are added up
    assert all(again[i][c] == pytest.approx(r[c], abs=1e-9) for i, r in out.items() for c in figures) and set(again) == set(out)
    oos, _ = models.walk_forward(done, *args)
    blend = models.ensembled(oos, "game_id").join(done, "game_id")
    sigma = blend.agg(F.stddev_samp(F.col("home_margin") - F.col("pred_ensemble"))).first()[0]
    assert {round(r.sigma, 9) for r in out.values()} == {round(sigma, 9)}
    scale = calibration.fit_probit_scale(blend.select("fold", F.col("pred_ensemble").alias("x"), (F.col("home_margin") > 0).cast("int").alias("y")), "fold", [99], 3.0, 60.0, 1e-12)[99]
    weights = models.final_weights(oos)
    plain = {r.game_id: r.pred_margin for r in models.forecast(done, slate, "game_date", "game_id", ["x", "empty"], ["linear", "elastic"], 300, weights).collect()}
    for i, r in out.items():
        assert r.pred_margin == pytest.approx(plain[i], abs=1e-6)
        assert r.p_home_win == pytest.approx(0.5 * math.erfc(-r.pred_margin / scale / math.sqrt(2)), abs=1e-9)
    with pytest.raises(ValueError):
        models.forecast_slate(df, slate, *args)


def test_sweep_equals_separate_fits(spark):
    from lagwise.operators import sweep

    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        x, z = rng.normal(), rng.normal()
        line = float(rng.integers(-10, 10))
        rows.append((i, DAY0 + dt.timedelta(days=i // 6), float(x), float(5 + z) if i % 7 else None, None, 1.0, float(3 * x - z - line + rng.normal()) if i % 13 else None, line))
    df = spark.createDataFrame(rows, "game_id bigint, game_date date, x double, z double, empty double, same double, home_margin double, spread_signed double").repartition(5)
    features = ["x", "z", "empty", "same"]
    settings = [sweep.Setting(), sweep.Setting(0.3), sweep.Setting(0.2, 1.0), sweep.Setting(5.0, 1.0)]
    got = {(r.setting, r.fold): r for r in sweep.sweep(df, "game_date", "game_id", features, settings, 400, 150).collect()}
    cal = folds.fold_calendar(df, "game_date", 400, 150).collect()
    assert set(got) == {(i, c.fold) for i in range(4) for c in cal} and len(cal) > 2
    known = [(r[2], r[3], r[6] + r[7] if r[6] is not None else None) for r in rows]
    for c in cal:
        learn = [k for k in known[c.train_from : c.test_from] if k[2] is not None]
        test = [k for k in known[c.test_from : c.test_to] if k[2] is not None]
        ordered = sorted(k[1] for k in learn if k[1] is not None)
        median = ordered[(len(ordered) + 1) // 2 - 1]
        a, b = (np.array([[k[0], median if k[1] is None else k[1]] for k in part]) for part in (learn, test))
        ya, yb = np.array([k[2] for k in learn]), np.array([k[2] for k in test])
        m, sd = a.mean(axis=0), a.std(axis=0)
        u, v = (a - m) / sd, (b - m) / sd
        for i, reg in ((0, 0.0), (1, 0.3)):  # ridge has a closed form
            w = np.linalg.solve(u.T @ u / len(u) + reg * np.eye(2), u.T @ (ya - ya.mean()) / len(u))
            want = math.sqrt(np.mean((yb - ya.mean() - v @ w) ** 2))
            assert got[i, c.fold].rmse == pytest.approx(want, rel=1e-7) and got[i, c.fold].test_rows == len(yb)
        assert got[3, c.fold].coefficients == 0 and got[3, c.fold].rmse == pytest.approx(math.sqrt(np.mean((yb - ya.mean()) ** 2)), rel=1e-7)
        # lasso: the conditions of the minimum hold for the coefficients
        z = np.column_stack([np.ones(len(a)), a, np.ones(len(a)), ya])
        _, w = sweep.fit_from_sums(z.T @ z, settings[2])
        slope = u.T @ (ya - ya.mean() - u @ (w[:2] * sd)) / len(u)
        assert all(abs(g - 0.2 * np.sign(q)) < 1e-8 if q else abs(g) <= 0.2 for g, q in zip(slope, w[:2])) and w[2] == 0
    best = sweep.best_settings(sweep.sweep(df, "game_date", "game_id", features, settings, 400, 150)).collect()
    assert [r.rank for r in best] == [1, 2, 3, 4] and best[-1].setting == 3


def test_staleness_gate(spark):
    df = spark.createDataFrame([(DAY0,)], "d date")
    models.require_fresh(df, "d", DAY0 + dt.timedelta(days=2))
    with pytest.raises(ValueError):
        models.require_fresh(df, "d", DAY0 + dt.timedelta(days=9))


def test_styles_are_prior_only(spark):
    rows = []
    for team in range(10):
        for day in range(60):
            rows.append((0, 2024, DAY0 + dt.timedelta(days=day), team, float(100 + 10 * (team % 4) + day % 3), float(team % 4 == 1) * 5, float(team % 4 == 2) * 7))
    kind = "pool_id int, season int, game_date date, team int, pace double, three_pa_rate double, paint_points double"
    cols = ["pace", "three_pa_rate", "paint_points"]

    def ids(data):
        p = styles.prior_profiles(spark.createDataFrame(data, kind), ["pool_id"], "team", "game_date", cols)
        return {(r["month"], r["team"]): r["style_id"] for r in styles.style_ids(p, ["pool_id"], "team", cols).collect()}

    base = ids(rows)
    assert {m for m, _ in base} == {dt.date(2024, 2, 1)} and len(base) == 10
    assert all(base[dt.date(2024, 2, 1), t] == base[dt.date(2024, 2, 1), t % 4] for t in range(10))
    few = styles.style_ids(styles.prior_profiles(spark.createDataFrame([r for r in rows if r[3] < 5], kind), ["pool_id"], "team", "game_date", cols), ["pool_id"], "team", cols).collect()
    assert len(few) == 5 and {(r["style_id"], r["reason"]) for r in few} == {(None, "few teams")}
    later = [(*r[:4], r[4] * 9, r[5], r[6]) if r[2] >= dt.date(2024, 2, 1) and r[3] == 0 else r for r in rows]
    assert ids(later) == base


def test_queries_fit_all_regressors(monkeypatch):
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    from lagwise.plans.catalog import learning, pipelines

    asked = []
    monkeypatch.setattr(learning, "cut_lineage", lambda df: df)
    monkeypatch.setattr(learning, "model_table", MagicMock())
    monkeypatch.setattr(learning.models, "walk_forward", lambda *a, **k: asked.append(list(a[4])) or (None, None))
    rows = SimpleNamespace(count=lambda: 100)
    learning.walk(None, rows=rows)
    for name in ("model_table", "cut_lineage", "repaired_prices", "blended_line", "valid_payout", "F"):
        monkeypatch.setattr(pipelines, name, MagicMock(return_value=(MagicMock(), MagicMock())) if name == "repaired_prices" else MagicMock())
    pipelines.cut_lineage.return_value.count.return_value = 100
    monkeypatch.setattr(pipelines, "run_experiment", lambda *a: asked.append(list(a[2])) or {"score": None})
    pipelines.experiment_score(MagicMock())
    assert asked == [list(models.REGRESSORS)] * 2 and len(models.REGRESSORS) == 4
