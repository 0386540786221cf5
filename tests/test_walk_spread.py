import datetime as dt
from types import SimpleNamespace

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lagwise.operators import models
from lagwise.plans import adapters
from lagwise.plans.catalog import learning

DAY0 = dt.date(2024, 1, 1)


def test_model_table_works_games_out_once(spark):
    rng = np.random.default_rng(3)
    rows = []
    for day in range(30):
        teams = rng.permutation(8)
        for k in range(4):
            line = None if len(rows) % 9 == 4 else float(rng.integers(-9, 9))
            rows.append((len(rows), DAY0 + dt.timedelta(days=day), 2024, day, 0, int(teams[2 * k]), int(teams[2 * k + 1]), int(rng.integers(90, 120)), int(rng.integers(90, 120)), line))
    kind = "game_id long, game_date date, season int, d long, pool_id long, home long, away long, score_home long, score_away long, home_handicap double"
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    games = spark.createDataFrame(rows, kind).repartition(3).mapInArrow(counted, kind)
    out = learning.model_table(SimpleNamespace(games=games, team_games=adapters.team_games(games), predictions=adapters.predictions(games)))
    got = {r["game_id"]: tuple(r[c] for c in learning.FEATURES) for r in out.collect()}
    assert seen.value == len(rows)
    past = {t: [] for t in range(8)}
    want = {}
    for g, _, _, _, _, h, a, sh, sa, line in rows:
        five = [np.array(past[t][-5:], dtype=float) for t in (h, a)]
        form, scoring = ([float(x[:, i].mean()) if len(x) else None for x in five] for i in (0, 1))
        if line is not None:
            want[g] = (*form, *scoring, None)
        past[h].append((sh - sa, sh))
        past[a].append((sa - sh, sa))
    assert got == want


def test_fits_have_few_even_tasks(spark, monkeypatch):
    assert [models.fit_tasks(n) for n in (0, 49_999, 60_000, 600_000, 3_600_000)] == [1, 1, 2, 3, 15]
    assert [models.position_block(n) for n in (1, 40_000, 2_250_000)] == [1, 10_000, 50_000]
    rng = np.random.default_rng(2)
    rows = [(i, DAY0 + dt.timedelta(days=i // 6), float(rng.normal()), float(rng.normal()), float(rng.integers(-10, 10))) for i in range(600)]
    df = spark.createDataFrame(rows, "game_id bigint, game_date date, x double, home_margin double, spread_signed double")
    args = (df, "game_date", "game_id", ["x"], ["linear"], 300, 200)
    plain = {r.game_id: (r.fold, r.pred, r.sigma) for r in models.walk_forward(*args)[0].collect()}
    sizes = []

    def fit(train):
        sizes.append(train.rdd.glom().map(len).collect())
        return LinearRegression(standardization=False).fit(train)

    monkeypatch.setattr(models, "FIT_ROWS", 10)
    monkeypatch.setattr(models, "WIDE_ROWS", 150)
    monkeypatch.setitem(models.REGRESSORS, "linear", lambda: SimpleNamespace(fit=fit))
    again = {r.game_id: (r.fold, r.pred, r.sigma) for r in models.walk_forward(*args)[0].collect()}
    assert set(again) == set(plain) and all(np.allclose(again[i], plain[i], atol=1e-9) for i in plain)
    whole = [s for s in sizes if sum(s) >= 300]
    assert len(whole) == 2 and all(len(s) <= 3 and max(s) <= 160 for s in whole)
