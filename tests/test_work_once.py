import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from lagwise.functions import market
from lagwise.operators import nested
from lagwise.plans.catalog import ledgers, reports


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def counted_bets(spark):
    rows = [
        (m, g, dt.date(1995, 1, 1) + dt.timedelta(g // 4), g // 4, 1 + g // 40, "HOME" if g % 3 else "AWAY", "HOME" if g % 2 else "AWAY", "matched", 1.0 + g % 7, 0.002 + g % 5 / 1000)
        for m in ("m1", "m2") for g in range(80)
    ]
    kind = "model string, game_id long, game_date date, d long, fold int, bet_side string, covered string, tier string, edge double, kelly double"
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    bets = spark.createDataFrame(rows, kind).mapInArrow(counted, kind).withColumns({"payout_home": F.lit(0.9), "payout_away": F.lit(0.8)})
    return bets, seen, len(rows)


def test_selected_bets_are_worked_out_once(spark):
    bets, seen, n = counted_bets(spark)
    out = ledgers.ledger_summary(SimpleNamespace(model_bets=bets)).collect()
    assert {(r["model"], r["bets"]) for r in out} == {("m1", 60), ("m2", 60)}
    assert seen.value == n


def test_reports_work_the_bets_out_once(spark):
    more = {
        "home": F.lit(1), "away": F.lit(2), "season": F.lit(1995), "win_prob": F.lit(0.5), "sigma_ensemble": F.lit(14.0), "home_margin": F.col("edge"),
        "pred_ensemble": -F.col("edge"), "spread_signed": F.lit(-2.0), "ev_home": F.lit(0.1), "ev_away": F.lit(0.2), "pnl": F.col("kelly"),
    }
    for report, rows in ((reports.metric_table_query, 22), (reports.rule_findings_query, 10), (reports.iteration_score, 1), (reports.model_statistics, 2)):
        bets, seen, n = counted_bets(spark)
        assert len(report(SimpleNamespace(model_bets=bets.withColumns(more))).collect()) == rows
        assert seen.value == n


def test_probability_is_not_copied_into_columns_and_filters(spark):
    rows = spark.createDataFrame([(3.0, -1.0, 14.0, 0.9, 0.9), (-9.0, 1.0, 14.0, 0.9, 0.9)], "pred_ensemble double, spread_signed double, sigma_ensemble double, payout_home double, payout_away double")
    priced = market.priced_bets(rows.repartition(2), 0.02, 0.05, 0.005).where("bet_side <> 'NONE'")
    assert [r["bet_side"] for r in priced.orderBy("edge").collect()] == ["AWAY", "HOME"]
    assert optimized(priced).count("EXP(") <= 4


def test_box_score_is_parsed_once(spark):
    document = '{"players": [{"team": {"abbreviation": "T1"}, "statistics": [{"keys": ["minutes", "points"], "athletes": [{"athlete": {"id": "7", "displayName": "A B"}, "stats": ["12", "5"]}, {"athlete": {"id": "8", "displayName": "C D"}, "didNotPlay": true}]}]}]}'
    raw = spark.createDataFrame([(1, document), (2, "{}"), (3, None)], "game_id long, doc string").repartition(2)
    out = nested.box_rows(raw.select("game_id", F.from_json("doc", nested.BOX_SCHEMA).alias("boxscore"))).select("game_id", "source_player_id", "points", "minutes")
    assert {tuple(r) for r in out.collect()} == {(1, 7, 5.0, "12:00"), (1, 8, 0.0, None)}
    assert optimized(out).count("from_json(") == 1
