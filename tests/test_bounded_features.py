"""Feature families over one shuffle by team: same rows as apart, and few exchanges."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lagwise.operators import audits
from lagwise.operators import windows as W
from lagwise.operators.timeline import short_histories
from lagwise.plans import features
from lagwise.plans.features import FeatureSettings


def games(spark, days=40, teams=8):
    rng, rows = random.Random(3), []
    for day in range(days):
        order = rng.sample(range(teams), teams)
        for i in range(0, teams, 2):
            date = dt.date(2024, 1, 1) + dt.timedelta(days=2 * day)
            rows.append((len(rows), date, 2024, 2 * day, 0, order[i], order[i + 1], rng.randint(80, 120), rng.randint(80, 120), rng.randint(-9, 9) / 2))
    kinds = "game_id long, game_date date, season int, d long, pool_id long, home long, away long, score_home long, score_away long, home_handicap double"
    return spark.createDataFrame(rows, kinds)


def venues(spark):
    return spark.createDataFrame([(t, 30.0 + t, -90.0 - 2.0 * t) for t in range(8)], "team long, lat double, lon double")


def table(df):
    return sorted((tuple(None if v is None else round(float(v), 9) for v in r) for r in df.collect()), key=lambda r: r[:2])


def test_bounded_families_equal_the_joined_ones(spark):
    g, v, cfg = games(spark), venues(spark), FeatureSettings()
    kept = features.form(g, cfg)
    assert sorted(kept.collect()) == sorted(features.form(g, cfg, bounded=True).collect())
    assert table(features.team_families(kept, v, cfg)) == table(features.team_families(kept, v, cfg, bounded=True))
    assert table(features.team_ratings(kept, cfg)) == table(features.team_ratings(kept, cfg, bounded=True))


def test_bounded_families_take_one_shuffle_by_team(spark):
    g, cfg = games(spark).localCheckpoint(), FeatureSettings()
    small = F.broadcast(venues(spark))
    plan = features.team_families(g, small, cfg, bounded=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_calendar_windows_on_rows_equal_those_on_days(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 2, None]), rng.choice([*range(30), None]), float(rng.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, k long, day long, v double")
    for fn in (
        lambda b: W.recent_counts(df, ["k"], "day", [3, 7], b), lambda b: W.inverse_gap_load(df, ["k"], "day", bounded=b),
        lambda b: W.recent_sums(df, ["k"], "day", F.col("v"), [1, 5], "t", b),
    ):
        names = ["i", *[c for c in fn(True).columns if c not in df.columns]]
        assert table(fn(False).select(*names)) == table(fn(True).select(*names))


def test_short_histories(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"))
    assert short_histories(df, ["k"], 5) and not short_histories(df, ["k"], 4)
    assert short_histories(df.where("k > 5"), ["k"], 0)


def test_builds_are_compared_by_group_in_one_pass(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, "y", 3.0)], "id long, part string, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5)], "id long, v double")
    out = {r["part"]: (r["column"], r["rows"], r["missing_keys"], r["differing"]) for r in audits.compare_builds(a, b, ["id"], by=["part"]).collect()}
    assert out == {"x": ("v", 1, 0, 0), "y": ("v", 1, 1, 1)}
