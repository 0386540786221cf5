import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lagwise.operators import audits
from lagwise.plans.features import build_feature_table
from lagwise.sources import runs

random.seed(8)
DAY0 = dt.date(2024, 1, 1)


def schedule():
    rows = []
    for d in range(45):
        teams = random.sample(range(8), 8)
        for k in range(3):
            h, a = teams[2 * k], teams[2 * k + 1]
            rows.append((len(rows), DAY0 + dt.timedelta(days=2 * d), 2024, 2 * d, 0, h, a, random.randint(85, 120), random.randint(85, 120), random.choice([None, -3.5, 2.0, 5.0])))
    return rows


KIND = "game_id bigint, game_date date, season int, d int, pool_id int, home int, away int, score_home int, score_away int, home_handicap double"
IDS = ["season", "d", "pool_id", "home", "away", "home_handicap"]


@pytest.fixture(scope="module")
def games(spark):
    return spark.createDataFrame(schedule(), KIND).cache()


@pytest.fixture(scope="module")
def venues(spark):
    return spark.createDataFrame([(t, 30.0 + t, -100.0 + 2 * t) for t in range(8)], "team int, lat double, lon double")


def test_feature_table_is_point_in_time(games, venues):
    on = DAY0 + dt.timedelta(days=60)
    out = audits.point_in_time_audit(games, lambda g: build_feature_table(g, venues), "game_date", on, ["score_home", "score_away"], "game_id", ["game_id"], skip=IDS)
    rows = out.collect()
    assert len(rows) > 60 and all(r["rows"] == 3 and r["missing_keys"] == 0 for r in rows)
    assert [r["column"] for r in rows if r["differing"]] == []


def test_flipped_outcome_changes_later_features_only(games, venues):
    on = DAY0 + dt.timedelta(days=40)
    base = build_feature_table(games, venues)
    flipped = build_feature_table(audits.outcome_flip(games, "game_date", on, "score_home", "score_away"), venues)
    upto, after = F.col("game_date") <= F.lit(on), F.col("game_date") > F.lit(on)
    skip = [*IDS, "score_home", "score_away"]
    same = audits.compare_builds(base.where(upto), flipped.where(upto), ["game_id"], skip).agg(F.sum("differing")).first()[0]
    moved = audits.compare_builds(base.where(after), flipped.where(after), ["game_id"], skip).agg(F.sum("differing")).first()[0]
    assert same == 0 and moved > 0


def test_planted_leak_is_reported(games):
    def leaky(g):
        return g.withColumn("leak", F.col("score_home") * 2).withColumn("clean", F.col("home") * 2)

    on = DAY0 + dt.timedelta(days=60)
    out = audits.point_in_time_audit(games, leaky, "game_date", on, ["score_home", "score_away"], "game_id", ["game_id"], skip=IDS)
    assert {r["column"]: r["differing"] > 0 for r in out.collect()} == {"leak": True, "clean": False}


def test_leak_screen_flags_the_plant(spark):
    rows = [(i, float(random.randint(-30, 30)), float(random.randint(-9, 9))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, m double, line double")
    noise = [F.xxhash64(F.lit(k), "id").cast("double").alias(f"n{k}") for k in range(9)]
    df = df.select("*", *noise, (F.abs("m") + F.rand(1) * 10).alias("plant"), F.lit(None).cast("double").alias("empty"))
    out = audits.linear_leak_screen(df, F.abs("m"), F.abs("line"), [f"n{k}" for k in range(9)] + ["plant", "empty"])
    flags = {r["feature"]: r["flagged"] for r in out.collect()}
    assert flags["plant"] and "empty" not in flags and sum(flags.values()) <= 2


def test_slate_rows(games, venues):
    on = DAY0 + dt.timedelta(days=80)
    past, slate = games.where(F.col("game_date") < F.lit(on)), games.where(F.col("game_date") == F.lit(on))
    build = lambda g: build_feature_table(g, venues)
    got = audits.slate_features(past, slate, build, "game_date", "game_id", ["score_home", "score_away"])
    full = build(games).where(F.col("game_date") == F.lit(on))
    diff = audits.compare_builds(full, got, ["game_id"], [*IDS, "score_home", "score_away"]).collect()
    assert all(r["rows"] == 3 and r["differing"] == 0 for r in diff)
    with pytest.raises(ValueError):
        audits.slate_features(past, slate, lambda g: build(g).where("game_id < 0"), "game_date", "game_id", ["score_home", "score_away"])


def test_parity_and_children(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    audits.require_parity(a, a.withColumn("v", F.col("v") + 1e-12), ["k"])
    for other in (a.withColumn("v", F.col("v") + 1), a.where("k = 1"), a.withColumn("v", F.coalesce("v", F.lit(0.0)))):
        with pytest.raises(ValueError):
            audits.require_parity(a, other, ["k"])
    with pytest.raises(ValueError):
        audits.require_children(a, a.where("k = 1"), ["k"])


def run_tables(spark):
    pred = spark.createDataFrame([(str(i), "2024-01-01", 1, 0.5, i % 2) for i in range(6)], "game_id string, game_date string, fold int, p_home double, home_win int")
    bets = spark.createDataFrame([(str(i), "2024-01-01", "HOME", "matched", 0.6, 0.1, 0.01, 1, 0.01, 1.0 + i) for i in range(4)],
                                 "game_id string, game_date string, bet_side string, odds_tier string, prob double, edge double, kelly_fraction double, win int, pnl double, bankroll double")
    folds = spark.createDataFrame([(1, "2024-01-01", "2024-01-31", 3, 1.0, 1.0), (2, "2024-01-31", "2024-02-20", 3, 1.0, 1.0)], "fold int, test_start string, test_end string, rows int, rmse double, mae double")
    audit = pred.select("game_id", "game_date", F.lit("matched").alias("odds_tier"))
    metrics = spark.createDataFrame([(1.0,)], "score double")
    return {"predictions": pred, "bets": bets, "fold_metrics": folds, "odds_audit": audit, "metrics": metrics}


def test_captured_run(spark, tmp_path):
    root = str(tmp_path / "runs")
    t = run_tables(spark)
    manifest = runs.capture_run(t, "r1", root)
    assert {r["table_name"]: r["rows"] for r in manifest.collect()} == {"predictions": 6, "bets": 4, "fold_metrics": 2, "odds_audit": 6, "metrics": 1}
    assert runs.check_run(spark, root, "r1") == []
    with pytest.raises(ValueError):
        runs.capture_run(t, "r1", root)
    with pytest.raises(ValueError):
        runs.capture_run({**t, "bets": t["bets"].unionByName(t["bets"])}, "r2", root)
    overlap = spark.createDataFrame([(1, "2024-01-01", "2024-01-31", 3, 1.0, 1.0), (2, "2024-01-20", "2024-02-20", 3, 1.0, 1.0)], t["fold_metrics"].schema)
    runs.capture_run({**t, "fold_metrics": overlap}, "r3", root, ["late data"])
    t["predictions"].withColumn("p_home", F.lit(0.9)).write.mode("overwrite").parquet(f"{root}/predictions/run_id=r1")
    assert runs.check_run(spark, root, "r1") == ["predictions: content changed since capture"]
    t["predictions"].limit(2).write.mode("append").parquet(f"{root}/bets/run_id=r1")
    listed = {r["run_id"]: (r["status"], r["problems"]) for r in runs.list_runs(spark, root).collect()}
    assert listed["r1"][0] == "partial" and any("bets: row count" in p for p in listed["r1"][1])
    assert "late data" in listed["r3"][1] and "fold_metrics: test windows overlap or are out of order" in listed["r3"][1]


def test_run_status_of_every_kind(spark, tmp_path):
    root = str(tmp_path / "runs")
    t = run_tables(spark)
    assert runs.catalogue(spark, root).collect() == []
    runs.capture_run(t, "whole", root)
    runs.capture_run({**t, "bets": t["bets"].limit(0)}, "quiet", root)  # a table without rows is not a missing table
    runs.capture_run({**t, "bets": t["bets"].drop("pnl"), "predictions": t["predictions"].withColumn("extra", F.lit(1))}, "lacking", root)
    t["predictions"].write.parquet(f"{root}/predictions/run_id=stopped")
    spark.read.parquet(f"{root}/manifest").where("run_id = 'whole'").withColumns({"run_id": F.lit("old"), "schema_version": F.lit(0)}).write.mode("append").parquet(f"{root}/manifest")
    got = {r["run_id"]: (r["status"], r["rows"], r["problems"]) for r in runs.catalogue(spark, root).collect()}
    assert got == {
        "whole": ("complete", 19, []), "quiet": ("complete", 15, []), "lacking": ("partial", 19, ["bets: missing columns pnl"]),
        "stopped": ("failed", 6, ["manifest missing"]), "old": ("failed", 0, ["unsupported schema_version 0"]),
    }
    assert runs.read_run_table(spark, root, "bets", "whole").count() == 4
    for bad in ("lacking", "stopped", "old", "never"):
        with pytest.raises(ValueError):
            runs.read_run_table(spark, root, "bets", bad)
    assert runs.check_run(spark, root, "lacking") == ["bets: missing columns pnl"] and runs.check_run(spark, root, "never") == ["not found"]


def test_fingerprint_sees_values_moving_between_columns(spark):
    a = spark.createDataFrame([("x", None), (None, None)], "a string, b string")
    b = spark.createDataFrame([(None, "x"), (None, None)], "a string, b string")
    assert audits.fingerprint(a).first() != audits.fingerprint(b).first()
    assert audits.fingerprint(a).first() == audits.fingerprint(a.select("b", "a").repartition(3)).first()
