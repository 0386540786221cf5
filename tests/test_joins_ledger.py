import random

import pytest
from pyspark.sql import functions as F

from lagwise.operators import aggregates, joins, ledger, schema, sets
from lagwise.operators.timeline import Timeline

random.seed(4)


def test_contracts(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    assert joins.contract_join(left, right, ["k"]).count() == 3
    with pytest.raises(ValueError):
        joins.contract_join(left, right, ["k"], contract="1:1")
    with pytest.raises(ValueError):
        joins.contract_join(right, left, ["k"])
    with pytest.raises(ValueError):
        joins.require_count(left, ["k"], 2)


def test_repeated_family_rows_do_not_multiply(spark):
    adv = spark.createDataFrame([("g", 1, 10.0), ("g", 1, 20.0), ("h", 2, 5.0)], "game string, player int, pts double")
    usg = spark.createDataFrame([("g", 1, 1.0), ("g", 1, 1.0), ("i", 3, 2.0)], "game string, player int, usg double")
    out = {(r["game"], r["player"]): (r["adv_pts"], r["usg_usg"]) for r in joins.merge_families({"adv": adv, "usg": usg}, ["game", "player"]).collect()}
    assert out == {("g", 1): (15.0, 1.0), ("h", 2): (5.0, None), ("i", 3): (None, 2.0)}


def test_asof_against_brute_force(spark):
    quotes = [(i, "hot" if i % 5 else "cold", random.randint(0, 400_000), random.randint(1, 99)) for i in range(300)]
    events = [(i, "hot" if i % 4 else "cold", random.randint(0, 400_000)) for i in range(120)]
    q = spark.createDataFrame(quotes, "qid int, k string, s int, price int").withColumn("ts", F.timestamp_seconds("s"))
    e = spark.createDataFrame(events, "eid int, k string, s int").withColumn("at", F.timestamp_seconds("s"))
    got = {r["eid"]: r["asof_qid"] for r in joins.asof(e.repartition(4), q, ["k"], "at", "ts", ["qid", "price"], ["qid"]).collect()}
    for eid, k, s in events:
        seen = [(x[2], x[0]) for x in quotes if x[1] == k and x[2] <= s]
        assert got[eid] == (max(seen)[1] if seen else None)
    assert len(got) == len(events)


def test_unique_names(spark):
    new = spark.createDataFrame([(1, "stephen curry"), (2, "pat spencer"), (3, "x y")], "ext bigint, name string")
    known = spark.createDataFrame([(201939, "stephen curry"), (201939, "stephen curry"), (5, "pat spencer"), (6, "pat spencer")], "id bigint, name string")
    out = {r["ext"]: r["entity_id"] for r in joins.match_unique_names(new, known, "name", "id", "ext", 10**8).collect()}
    assert out == {1: 201939, 2: 100000002, 3: 100000003}


def test_concentration_shares(spark):
    rows = [("g", "A", 1, 50.0), ("g", "A", 2, 30.0), ("g", "A", 3, 10.0), ("g", "A", 4, 10.0), ("g", "B", 5, 20.0), ("g", "B", 6, 20.0), ("g", "B", 7, 20.0), ("g", "B", 8, 20.0), ("g", "B", 9, 20.0), ("g", "C", 1, 0.0)]
    df = spark.createDataFrame(rows, "game string, team string, player int, fga double")
    out = {r["team"]: (r["usg_top2_share"], r["usg_top3_share"]) for r in aggregates.concentration(df, ["game", "team"], F.col("fga"), (2, 3), ["player"]).collect()}
    assert out["A"] == pytest.approx((0.8, 0.9)) and out["B"] == pytest.approx((0.4, 0.6)) and out["C"] == (0.0, 0.0)


def test_outside_top_sum(spark):
    df = spark.createDataFrame([("t", i, float(40 - i), i) for i in range(8)] + [("t", 99, 0.0, 1000)], "team string, p int, minutes double, pm int")
    out = aggregates.outside_top_sum(df, ["team"], "minutes", "p", "pm", 5, F.col("minutes") > 0, "bench").first()
    assert out["bench"] == 5 + 6 + 7


def test_same_day_bets_share_the_opening_bankroll(spark):
    rows = [(1, 1, 0.1), (1, 2, 0.05), (2, 3, -0.0034782608695652)]
    out = ledger.attach_bankroll(spark.createDataFrame(rows, "d int, game_id int, pnl double"), [], "d", "pnl").orderBy("game_id").collect()
    assert [round(r["bankroll_open"], 6) for r in out] == [1.0, 1.0, 1.15]
    assert round(out[0]["bankroll"], 6) == 1.15 and round(out[2]["bankroll"], 4) == 1.146


@pytest.mark.parametrize("bounded", [False, True])
def test_stop_loss_equals_loop(spark, bounded):
    rows = [(d, i, random.uniform(-1, 1)) for d in range(40) for i in range(25)]
    df = spark.createDataFrame(rows, "d int, rank int, pnl double")
    got = {(r["d"], r["rank"]): r["pnl_kept"] for r in ledger.stop_loss(df, Timeline("d", "rank", "floor(rank / 4)"), "pnl", F.lit(-1.5), bounded=bounded).collect()}
    for d in range(40):
        total = 0.0
        for _, i, p in [r for r in rows if r[0] == d]:
            kept = 0.0 if total <= -1.5 else p
            assert abs(got[d, i] - kept) < 1e-12
            total += kept


@pytest.mark.parametrize("bounded", [False, True])
def test_compounded_and_drawdown(spark, bounded):
    pnl = [0.1, -0.2, 0.05, 0.4, -0.3]
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate(pnl)], "m int, i int, pnl double")
    out = ledger.compounded(df, Timeline("m", "i", "floor(i / 2)"), "pnl", 100.0, bounded=bounded).orderBy("i").collect()
    money, peak = 100.0, 0.0
    for r, p in zip(out, pnl):
        money *= 1 + p
        peak = max(peak, money)
        assert r["bankroll"] == pytest.approx(money) and r["drawdown"] == pytest.approx(money / peak - 1)


def test_ledger_bases(spark):
    rows = [("r", "2024-01-01", 1, 0.1, 0.1, 1.1, 1.0, 1), ("r", "2024-01-02", 2, 0.2, -0.2, 0.88, 1.1, 0)]
    df = spark.createDataFrame(rows, "run string, game_date string, game_id int, kelly_fraction double, pnl double, bankroll double, bankroll_open double, win int")
    for basis, roi in (("open", (0.1 - 0.22) / (0.1 + 0.22)), ("current", (0.1 - 0.22) / (0.1 + 0.22)), ("start", -0.1 / 0.3)):
        r = ledger.ledger_summary(df, ["run"], F.lit(basis)).first()
        assert r["roi"] == pytest.approx(roi) and r["max_drawdown"] == pytest.approx(0.2) and r["win_rate"] == 0.5


def test_exposure_cap(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.2), (2, 0.1)], "d int, k double")
    assert sorted(round(r["stake"], 6) for r in ledger.cap_exposure(df, [], "d", "k", 0.25).collect()) == [0.1, 0.125, 0.125]


def test_schema_tools(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "gameId int, fieldGoalsMade double, name string")
    out = schema.resolve_aliases(df, {"game_id": ["GAME_ID", "gameId"], "none": ["zzz"]})
    assert "game_id" in out.columns and "none" not in out.columns
    assert schema.family_columns(df, ["gameId"], "adv").columns == ["gameId", "adv_field_goals_made"]
    names = schema.feature_names(["a", "b", "pnl_x", "home_margin"], ["a", "b", "zz"], include=["pnl_x", "home_margin"], deny=["home_margin"], exclude=["b"])
    assert names == ["a"]
    assert schema.keep_and_match(["k", "home_adv_x_r5", "home_adv_x"], ["k", "gone"], ["home_adv_"], ["_r5"]) == ["k", "home_adv_x_r5"]
    report = {r["column"]: r["present"] for r in schema.schema_report(df, ["gameId", "pnl*"], ["name"]).collect()}
    assert report == {"gameId": True, "pnl*": False, "name": True}
    with pytest.raises(ValueError):
        schema.schema_report(df, ["pnl*"], [], strict=True)


def test_merge_newer_and_model_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert sorted(tuple(r) for r in sets.merge_newer(old, new, ["id"]).collect()) == [(1, "a"), (2, "B"), (3, "C")]
    wide = spark.createDataFrame([(1, 0.5, 0.7, "HOME")], "id int, pnl_a double, pnl_b double, side_a string")
    rows = sorted(tuple(r) for r in sets.model_rows(wide, ["id"], ["pnl", "side"]).select("model", "pnl", "side").collect())
    assert rows == [("a", 0.5, "HOME"), ("b", 0.7, None)]


def test_selection_beyond_a_short_day(spark):
    rows = [(i, i % 2, float(i * 37 % 1501) if i % 9 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "game_id int, d int, score double")
    got = {r["game_id"]: r["rank"] for r in ledger.select_daily(df, [], "d", F.col("score"), ["game_id"], 1200).collect()}
    want = {}
    for day in (0, 1):
        order = sorted((r for r in rows if r[1] == day), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        want |= {r[0]: k + 1 for k, r in enumerate(order[:1200])}
    assert got == want
    stakes = df.select("game_id", "d", (F.col("game_id") % 7).cast("double").alias("k"))
    plain, short = ({r["game_id"]: r["stake"] for r in ledger.cap_exposure(stakes, [], "d", "k", 5.0, bounded=b).collect()} for b in (False, True))
    assert plain == pytest.approx(short)
