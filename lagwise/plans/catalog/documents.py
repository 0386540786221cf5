"""Queries that build nested documents from the tables and flatten them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.operators import nested
from lagwise.plans.adapters import GAMES, PLAYER_BOX
from lagwise.plans.registry import query
from lagwise.sources.documents import slate_document


def envelopes_a(s):
    """One envelope per event row, as JSON text of the first document form."""
    eid = F.col("event_id")
    line = F.when(eid % 3 == 0, None).otherwise(F.col("value").cast("string"))
    book = F.to_json(F.struct(
        F.when(eid % 7 == 0, "N/A").otherwise((eid % 200 - 100).cast("string")).alias("odds"), line.alias("spread"),
        F.lit("112.5").alias("overUnder"), (eid % 2 == 0).alias("available"),
    ))
    odd_id = F.when(eid % 5 == 0, "weird").when(eid % 5 == 1, "points-all-1h-ou-over").otherwise(F.concat(F.lit("p+r-U"), F.col("user_id"), F.lit("-game-ou-under")))
    start = F.when(eid % 11 == 0, "not-a-date").otherwise(F.date_format(F.col("ts").cast("timestamp") + F.expr("INTERVAL 90 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    odds = F.concat(F.lit('{"'), odd_id, F.lit('":{"byBookmaker":{"b1":'), book, F.lit(',"'), F.col("event_type"), F.lit('":'), book, F.lit("}}}"))
    teams = F.when(eid % 13 == 0, "null").otherwise(F.concat(F.lit('{"home":{"names":{"long":"T'), F.col("user_id"), F.lit('"}}}')))
    payload = F.concat(
        F.lit('[{"data":[{"eventID":"E'), eid, F.lit('"},{"eventID":"E'), eid, F.lit('","teams":'), teams, F.lit(',"status":{"startsAt":"'), start, F.lit('"},"odds":'), odds, F.lit("}]}]"),
    )
    return s.table("events").select(
        F.concat(F.lit("r"), eid).alias("request_id"), F.lit("open").alias("slot"),
        F.date_format("ts", "yyyy-MM-dd").alias("slate_date"), F.lit("sgo").alias("provider"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at_utc"), F.from_json(payload, nested.PAYLOAD_A).alias("payload"),
    )


@query(
    "flatten_quotes_a", "N-01 N-03 N-04 F-05",
    """WITH e AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 5 = 0 THEN 'weird' WHEN event_id % 5 = 1 THEN 'points-all-1h-ou-over' ELSE 'p+r-U' || user_id || '-game-ou-under' END AS odd_id FROM events),
b AS (SELECT *, unnest([('b1'), (event_type)]) AS bookmaker_id FROM e)
SELECT 'r' || event_id AS request_id, 'E' || event_id AS event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(90.0 AS DOUBLE) END AS minutes_to_tip,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'T' || user_id END AS home_team, odd_id,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'points' ELSE 'p+r' END AS stat_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'all' ELSE 'U' || user_id END AS stat_entity_id,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '1h' ELSE 'game' END AS period_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'over' ELSE 'under' END AS side_id, bookmaker_id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 200 - 100 AS DOUBLE) END AS odds_american, CASE WHEN event_id % 3 = 0 THEN 112.5 ELSE value END AS line, event_id % 2 = 0 AS available FROM b""",
)
def flatten_quotes_a(s):
    return nested.quote_rows_a(envelopes_a(s)).select(
        "request_id", "event_id", "minutes_to_tip", "home_team", "odd_id", "stat_id", "stat_entity_id", "period_id", "side_id", "bookmaker_id", "odds_american", "line", "available"
    )


@query(
    "flatten_quotes_b", "N-02",
    """WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)
SELECT 'O' || l_orderkey AS event_id, 'S' || l_suppkey AS bookmaker_key, CASE WHEN l_linenumber % 2 = 0 THEN 'spreads' ELSE 'totals' END AS market_key, 'P' || l_partkey AS outcome_name,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS point, CAST(l_partkey % 300 - 150 AS DOUBLE) AS price_american, CAST(30.0 AS DOUBLE) AS minutes_to_tip FROM o""",
)
def flatten_quotes_b(s):
    outcome = F.array(F.struct(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("name"), (F.col("l_partkey") % 300 - 150).cast("string").alias("price"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("string")).alias("point"),
    ))
    market = F.array(F.struct(F.when(F.col("l_linenumber") % 2 == 0, "spreads").otherwise("totals").alias("key"), F.lit("t").alias("last_update"), outcome.alias("outcomes")))
    books = F.array(F.struct(F.concat(F.lit("S"), F.col("l_suppkey")).alias("key"), F.lit("t").alias("last_update"), market.alias("markets")))
    ev = F.array(F.struct(
        F.concat(F.lit("O"), F.col("l_orderkey")).alias("id"), F.lit("2026-10-22T02:30:00Z").alias("commence_time"),
        F.lit("h").alias("home_team"), F.lit("a").alias("away_team"), books.alias("bookmakers"),
    ))
    doc = s.table("lineitem").select(
        F.lit("r").alias("request_id"), F.lit("open").alias("slot"), F.lit("2026-10-22T02:00:00Z").alias("captured_at_utc"),
        F.from_json(F.to_json(ev), nested.PAYLOAD_B).alias("payload"),
    )
    return nested.quote_rows_b(doc).select("event_id", "bookmaker_key", "market_key", "outcome_name", "point", "price_american", "minutes_to_tip")


@query(
    "flatten_candles", "N-05 N-06",
    """SELECT 'L' || l_orderkey || '-' || l_partkey || '-' || l_suppkey AS ticker, CAST(epoch(l_shipdate) - 3 * 3600 AS BIGINT) AS tip_ts, k.end_ts AS end_period_ts,
  CASE WHEN k.end_ts IS NOT NULL THEN l_quantity END AS bid, CASE WHEN k.end_ts IS NOT NULL THEN l_quantity + 1 END AS ask, CASE WHEN k.end_ts = 2 THEN l_tax END AS price
FROM lineitem, (VALUES (0, 0, NULL::BIGINT), (1, 3, 1::BIGINT), (1, 3, 2::BIGINT), (4, 7, 1::BIGINT)) k(lo, hi, end_ts) WHERE l_linenumber BETWEEN lo AND hi OR l_linenumber NOT BETWEEN 1 AND 7 AND k.end_ts IS NULL""",
)
def flatten_candles(s):
    def candle(i, price):
        return F.struct(
            F.lit(i).cast("bigint").alias("end_period_ts"), F.struct(F.col("l_quantity").alias("close")).alias("yes_bid"),
            F.struct((F.col("l_quantity") + 1).alias("close")).alias("yes_ask"), F.when(F.lit(price), F.struct(F.col("l_tax").alias("close"))).alias("price"), F.lit(1).alias("volume"),
        )

    n = F.col("l_linenumber")
    candles = F.when(n.between(1, 3), F.array(candle(1, False), candle(2, True))).when(n.between(4, 7), F.array(candle(1, False)))
    m = s.table("lineitem").select(
        F.concat(F.lit("L"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")).alias("ticker"), F.col("l_shipdate").cast("timestamp").alias("expiry"), candles.alias("candlesticks")
    )
    return nested.candle_rows(m).drop("volume")


@query(
    "flatten_box_scores", "N-07",
    f"""WITH {PLAYER_BOX} SELECT game_id, 'T' || team AS team, player_id AS source_player_id, line,
  CASE WHEN minutes = '0:00' THEN CASE WHEN comment = ' dnd_injury-Illness ' THEN 'DNP - Dnd_injury-illness' ELSE 'DNP - Coach''s Decision' END END AS comment,
  CASE WHEN minutes <> '0:00' THEN CAST(split_part(minutes, ':', 1) AS INTEGER) || ':00' END AS minutes,
  CAST(CASE WHEN minutes = '0:00' THEN 0 ELSE points END AS DOUBLE) AS points, CAST(CASE WHEN minutes = '0:00' THEN 0 ELSE plus_minus END AS DOUBLE) AS plus_minus,
  CAST(CASE WHEN minutes = '0:00' THEN 0 ELSE fga END AS DOUBLE) AS fga, CAST(CASE WHEN minutes = '0:00' THEN 0 ELSE ftm END AS DOUBLE) AS ftm FROM player_box""",
)
def flatten_box_scores(s):
    p = s.player_box.withColumn("dnp", F.col("minutes") == "0:00")
    stats = F.when(~F.col("dnp"), F.array(
        F.split("minutes", ":")[0], F.col("points").cast("string"), F.concat(F.when(F.col("plus_minus") > 0, "+").otherwise(""), F.col("plus_minus")),
        F.concat_ws("-", F.col("fga") % 3, F.col("fga")), F.concat_ws("-", F.col("ftm"), F.col("fta")),
    ))
    athlete = F.struct(
        F.struct(F.col("player_id").cast("string").alias("id"), F.concat(F.lit("First Last"), F.col("line")).alias("displayName"), F.lit("F").alias("shortName")).alias("athlete"),
        F.lit(True).alias("starter"), F.col("dnp").alias("didNotPlay"), F.col("comment").alias("reason"), stats.alias("stats"),
    )
    keys = F.array(*[F.lit(k) for k in ("minutes", "points", "plusMinus", "fieldGoalsMade-fieldGoalsAttempted", "freeThrowsMade-freeThrowsAttempted")])
    st = F.array(F.struct(keys.alias("keys"), F.array(athlete).alias("athletes")))
    doc = F.struct(F.array(F.struct(F.struct(F.concat(F.lit("T"), F.col("team")).alias("abbreviation")).alias("team"), st.alias("statistics"))).alias("players"))
    d = p.select("game_id", F.from_json(F.to_json(doc), nested.BOX_SCHEMA).alias("boxscore"))
    return nested.box_rows(d).select(
        "game_id", "team", "source_player_id", F.regexp_extract("familyName", "[0-9]+", 0).cast("bigint").alias("line"), "comment", "minutes", "points",
        F.col("plusMinusPoints").alias("plus_minus"), F.col("fieldGoalsAttempted").alias("fga"), F.col("freeThrowsMade").alias("ftm"),
    )


@query(
    "team_total_metrics", "N-08",
    f"""WITH {PLAYER_BOX}, t AS (SELECT game_id, team, CAST(sum(fga) + 60 AS DOUBLE) AS fga, CAST(sum(fga % 3) + 20 AS DOUBLE) AS fgm, CAST(sum(fta) AS DOUBLE) AS fta, CAST(sum(ftm) AS DOUBLE) AS ftm, CAST(sum(three_pm) AS DOUBLE) AS tpm,
  CAST(sum(oreb) AS DOUBLE) AS oreb, CAST(sum(rebounds) + 10 AS DOUBLE) AS dreb, CAST(sum(turnovers) AS DOUBLE) AS tov FROM player_box GROUP BY 1, 2),
u AS (SELECT *, 2 * fgm + tpm + ftm AS pts, fga + CAST(0.44 AS DOUBLE) * fta - oreb + tov AS est, count(*) OVER (PARTITION BY game_id) AS n FROM t),
v AS (SELECT *, CAST(5.6798 AS DOUBLE) + CAST(0.9330 AS DOUBLE) * avg(est) OVER (PARTITION BY game_id) AS poss, sum(pts) OVER (PARTITION BY game_id) - pts AS opp, sum(dreb) OVER (PARTITION BY game_id) - dreb AS odreb FROM u WHERE n = 2)
SELECT game_id, 'T' || team AS team, round(100 * pts / poss - 100 * opp / poss, 1) AS adv_net_rating, round(poss, 0) AS adv_possessions FROM v""",
)
def team_total_metrics(s):
    t = s.player_box.groupBy("game_id", "team").agg(
        (F.sum("fga") + 60).alias("fga"), (F.sum(F.col("fga") % 3) + 20).alias("fgm"), F.sum("fta").alias("fta"), F.sum("ftm").alias("ftm"),
        F.sum("three_pm").alias("tpm"), F.sum("oreb").alias("oreb"), (F.sum("rebounds") + 10).alias("dreb"), F.sum("turnovers").alias("tov"),
    )

    def stat(name, *cols):
        return F.struct(F.lit(name).alias("name"), F.concat_ws("-", *[F.col(c).cast("string") for c in cols]).alias("displayValue"))

    st = F.array(
        stat("fieldGoalsMade-fieldGoalsAttempted", "fgm", "fga"), stat("threePointFieldGoalsMade-threePointFieldGoalsAttempted", "tpm", "fga"),
        stat("freeThrowsMade-freeThrowsAttempted", "ftm", "fta"), stat("offensiveRebounds", "oreb"), stat("defensiveRebounds", "dreb"),
        stat("turnovers", "tov"), stat("totalTurnovers", "tov"),
    )
    entry = F.struct(F.struct(F.concat(F.lit("T"), F.col("team")).alias("abbreviation")).alias("team"), st.alias("statistics"))
    docs = t.groupBy("game_id").agg(F.collect_list(entry).alias("teams")).where(F.size("teams") == 2)
    d = docs.select("game_id", F.from_json(F.to_json(F.struct("teams")), nested.BOX_SCHEMA).alias("boxscore"))
    return nested.team_total_rows(d).select("game_id", "team", "adv_net_rating", "adv_possessions")


@query(
    "scoreboard_games", "N-09",
    """SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CAST(year(o_orderdate) AS INTEGER) AS season, 'C' || o_custkey AS home, o_orderpriority AS away,
  CAST(o_custkey % 60 AS DOUBLE) AS score_home, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) END AS score_away FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus = 'F' AND o_orderkey % 7 <> 0""",
)
def scoreboard_games(s):
    o = s.table("orders")
    k = F.col("o_orderkey")

    def side(which, code, score):
        return F.struct(F.lit(which).alias("homeAway"), score.cast("string").alias("score"), F.struct(code.alias("abbreviation")).alias("team"))

    comp = F.struct(
        F.struct(F.when(k % 5 == 0, "ALLSTAR").when(k % 2 == 0, "STD").alias("abbreviation")).alias("type"),
        F.struct(F.struct(F.when(F.col("o_orderstatus") == "F", "STATUS_FINAL").otherwise("STATUS_SCHEDULED").alias("name")).alias("type")).alias("status"),
        F.array(side("away", F.col("o_orderpriority"), F.when(k % 4 == 0, "--").otherwise((k % 60).cast("string"))), side("home", F.concat(F.lit("C"), F.col("o_custkey")), F.col("o_custkey") % 60)).alias("competitors"),
    )
    ev = F.struct(k.cast("string").alias("id"), F.struct(F.year("o_orderdate").alias("year"), F.when(k % 7 == 0, 3).otherwise(2).alias("type")).alias("season"), F.array(comp).alias("competitions"))
    docs = o.select(F.to_date("o_orderdate").alias("day"), F.from_json(F.to_json(F.array(ev)), nested.SCOREBOARD_SCHEMA).alias("events"))
    return nested.scoreboard_rows(docs).select("source_id", "season", "home", "away", "score_home", "score_away")


@query(
    "first_priced_line", "N-10",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber <> 4 AND l_linenumber <= 6 AND l_partkey % 3 <> 0 THEN l_tax WHEN l_suppkey % 4 <> 0 THEN l_discount WHEN l_partkey % 3 <> 0 THEN l_tax END AS line FROM lineitem""",
)
def first_priced_line(s):
    n = F.col("l_linenumber")
    items = F.array(
        F.struct(F.struct(F.when(n != 4, n).alias("priority")).alias("provider"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_tax")).alias("spread")),
        F.struct(F.struct(F.lit(6).alias("priority")).alias("provider"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_discount")).alias("spread")),
    )
    return s.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", nested.first_priced_line(items).alias("line"))


@query(
    "slate_documents", "S-14",
    f"""WITH {GAMES} SELECT strftime(game_date, '%Y-%m-%d') AS slate_date, pool_id, count(*) AS n_games, max(game_id) AS last_game, CAST(sum(score_home) AS BIGINT) AS total FROM games GROUP BY 1, 2""",
)
def slate_documents(s):
    f = s.games.select(F.date_format("game_date", "yyyy-MM-dd").alias("slate_date"), "pool_id", "game_id", F.col("score_home").alias("pred"))
    d = slate_document(f, ("slate_date", "pool_id"))
    return d.select(
        "slate_date", "pool_id", F.size("games").cast("bigint").alias("n_games"), F.array_max(F.transform("games", lambda g: g["game_id"])).alias("last_game"),
        F.aggregate("games", F.lit(0).cast("bigint"), lambda acc, g: acc + g["pred"]).alias("total"),
    )
