"""Views that give the driver tables the shapes the operators expect.

Each view exists twice: as DataFrame code and as SQL text for the DuckDB twins.
Only integer and half-integer arithmetic is used, so both sides agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.functions.market import covered_side, odds_tier, priced_bets, repaired_prices, settle, valid_payout
from lagwise.functions.numeric import normal_cdf_sql
from lagwise.operators.sets import team_view
from lagwise.operators.timeline import Timeline, positions

EPOCH = "1995-01-01"
DAY_STEP = (1, 7, 11, 13, 17, 19, 23, 29)
EV_THRESHOLD, KELLY_FRACTION, KELLY_CAP = 0.02, 0.05, 0.005


def games(orders: DataFrame) -> DataFrame:
    """One row per order; every team plays at most once a day."""
    step = F.element_at(F.array(*[F.lit(s) for s in DAY_STEP]), (F.col("d") % 8 + 1).cast("int"))
    o = orders.select(
        F.col("o_orderkey").alias("game_id"),
        "o_custkey",
        F.col("o_orderdate").cast("date").alias("game_date"),
        F.year("o_orderdate").alias("season"),
        F.floor("o_totalprice").cast("bigint").alias("px"),
    )
    o = o.withColumn("d", F.datediff("game_date", F.lit(EPOCH).cast("date")).cast("bigint"))
    # id blocks keep a very full day out of a single task
    o = positions(o, Timeline("game_date", "game_id", "shiftright(game_id, 20)"), "rn")
    o = o.withColumn("pool_id", F.floor(F.col("rn") / 15.0).cast("bigint")).withColumn("slot", F.col("rn") % 15)
    o = o.withColumn("m", step)
    handicap = F.when(F.col("game_id") % 97 != 0, (F.col("game_id") * 13) % 29 / 2.0 - 7.0)
    return o.select(
        "game_id", "game_date", "season", "d", "pool_id",
        (F.col("pool_id") * 100 + (2 * F.col("slot") * F.col("m") + F.col("d")) % 30).alias("home"),
        (F.col("pool_id") * 100 + ((2 * F.col("slot") + 1) * F.col("m") + F.col("d")) % 30).alias("away"),
        (90 + F.col("px") % 41).alias("score_home"),
        (90 + (F.col("o_custkey") * 31 + F.col("game_id")) % 41).alias("score_away"),
        handicap.cast("double").alias("home_handicap"),
    )


GAMES = """games0 AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS game_date, year(o_orderdate) AS season,
  CAST(floor(o_totalprice) AS BIGINT) AS px, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS d,
  row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) - 1 AS rn FROM orders),
games1 AS (SELECT *, CAST(floor(rn / 15.0) AS BIGINT) AS pool_id, rn % 15 AS slot,
  CASE d % 8 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 11 WHEN 3 THEN 13 WHEN 4 THEN 17 WHEN 5 THEN 19 WHEN 6 THEN 23 ELSE 29 END AS m
  FROM games0),
games AS (SELECT o_orderkey AS game_id, game_date, season, d, pool_id,
  pool_id * 100 + (2 * slot * m + d) % 30 AS home, pool_id * 100 + ((2 * slot + 1) * m + d) % 30 AS away,
  90 + px % 41 AS score_home, 90 + (o_custkey * 31 + o_orderkey) % 41 AS score_away,
  CAST(CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE (o_orderkey * 13) % 29 / 2.0 - 7.0 END AS DOUBLE) AS home_handicap
  FROM games1)"""


def team_games(g: DataFrame) -> DataFrame:
    """Two rows per game with the signs seen from each team."""
    return team_view(
        g,
        same=["game_id", "game_date", "season", "d", "pool_id"],
        home={
            "team": F.col("home"), "opp": F.col("away"), "is_home": F.lit(1),
            "pts": F.col("score_home"), "opp_pts": F.col("score_away"),
            "margin": F.col("score_home") - F.col("score_away"), "handicap": F.col("home_handicap"),
        },
        away={
            "team": F.col("away"), "opp": F.col("home"), "is_home": F.lit(0),
            "pts": F.col("score_away"), "opp_pts": F.col("score_home"),
            "margin": F.col("score_away") - F.col("score_home"), "handicap": -F.col("home_handicap"),
        },
    )


TEAM_GAMES = GAMES + """,
tg AS (SELECT game_id, game_date, season, d, pool_id, home AS team, away AS opp, 1 AS is_home, score_home AS pts,
  score_away AS opp_pts, score_home - score_away AS margin, home_handicap AS handicap FROM games
  UNION ALL SELECT game_id, game_date, season, d, pool_id, away, home, 0, score_away, score_home,
  score_away - score_home, -home_handicap FROM games)"""


def prices(g: DataFrame) -> DataFrame:
    """American prices with one or both sides missing, some games absent altogether."""
    gid = F.col("game_id")
    home = (
        F.when(gid % 7 == 0, None).when(gid % 53 == 0, 0)
        .when(gid % 2 == 0, -(100 + gid * 17 % 60)).otherwise(100 + gid * 17 % 45)
    )
    away = F.when(gid % 11 == 0, None).when(gid % 2 == 1, -(100 + gid * 13 % 60)).otherwise(100 + gid * 13 % 45)
    book = F.when(gid % 5 != 0, (gid % 5 - 2) / 2.0 - F.col("home_handicap"))
    return g.where(gid % 29 != 0).select(
        "game_id", "game_date", "home", "away",
        home.cast("double").alias("home_american"), away.cast("double").alias("away_american"),
        book.cast("double").alias("book_spread"),
    )


PRICES = GAMES + """,
prices AS (SELECT game_id, game_date, home, away,
  CAST(CASE WHEN game_id % 7 = 0 THEN NULL WHEN game_id % 53 = 0 THEN 0 WHEN game_id % 2 = 0 THEN -(100 + game_id * 17 % 60)
       ELSE 100 + game_id * 17 % 45 END AS DOUBLE) AS home_american,
  CAST(CASE WHEN game_id % 11 = 0 THEN NULL WHEN game_id % 2 = 1 THEN -(100 + game_id * 13 % 60)
       ELSE 100 + game_id * 13 % 45 END AS DOUBLE) AS away_american,
  CAST(CASE WHEN game_id % 5 <> 0 THEN (game_id % 5 - 2) / 2.0 - home_handicap END AS DOUBLE) AS book_spread
  FROM games WHERE game_id % 29 <> 0)"""


def player_box(lineitem: DataFrame, g: DataFrame) -> DataFrame:
    """Player counts per game; a (game, player) can occur more than once on purpose."""
    key, part, supp, line = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    qty = F.floor("l_quantity").cast("bigint")
    price = F.floor("l_extendedprice").cast("bigint")
    minute = F.when((part + supp) % 6 == 0, 0).otherwise(price % 41)
    rows = lineitem.select(
        key.alias("game_id"), part.alias("player_id"), supp.alias("supp"), line.cast("bigint").alias("line"),
        (line % 2).alias("is_home"),
        (qty % 25).alias("fga"), (supp % 9).alias("fta"), ((part + line) % 6).alias("turnovers"),
        (price % 31).alias("points"), (qty % 5).alias("oreb"), (price % 9).alias("rebounds"), (supp % 7).alias("assists"),
        ((qty + supp) % 4).alias("three_pm"), ((qty + supp) % 4 + part % 5).alias("three_pa"), (supp % 5).alias("ftm"),
        ((supp + line) % 31 - 15).cast("bigint").alias("plus_minus"),
        F.concat(minute.cast("string"), F.lit(":"), F.lpad(F.when(minute == 0, 0).otherwise(part % 60).cast("string"), 2, "0")).alias("minutes"),
        F.when(minute > 0, None)
        .when(F.col("l_returnflag") == "A", "DNP - Coach's_Decision")
        .when(F.col("l_returnflag") == "R", " dnd_injury-Illness ")
        .alias("comment"),
    )
    side = g.select("game_id", "game_date", "d", "season", "home", "away")
    return rows.join(side, "game_id").withColumn("team", F.when(F.col("is_home") == 1, F.col("home")).otherwise(F.col("away"))).drop("home", "away")


PLAYER_BOX = TEAM_GAMES + """,
pb0 AS (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS qty, CAST(floor(l_extendedprice) AS BIGINT) AS price,
  CASE WHEN (l_partkey + l_suppkey) % 6 = 0 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) % 41 END AS minute FROM lineitem),
player_box AS (SELECT l_orderkey AS game_id, l_partkey AS player_id, l_suppkey AS supp, CAST(l_linenumber AS BIGINT) AS line,
  l_linenumber % 2 AS is_home, qty % 25 AS fga, l_suppkey % 9 AS fta, (l_partkey + l_linenumber) % 6 AS turnovers,
  price % 31 AS points, qty % 5 AS oreb, price % 9 AS rebounds, l_suppkey % 7 AS assists, (qty + l_suppkey) % 4 AS three_pm,
  (qty + l_suppkey) % 4 + l_partkey % 5 AS three_pa, l_suppkey % 5 AS ftm, (l_suppkey + l_linenumber) % 31 - 15 AS plus_minus,
  minute || ':' || lpad(CAST(CASE WHEN minute = 0 THEN 0 ELSE l_partkey % 60 END AS VARCHAR), 2, '0') AS minutes,
  CASE WHEN minute > 0 THEN NULL WHEN l_returnflag = 'A' THEN 'DNP - Coach''s_Decision'
       WHEN l_returnflag = 'R' THEN ' dnd_injury-Illness ' END AS comment,
  game_date, d, season, CASE WHEN l_linenumber % 2 = 1 THEN home ELSE away END AS team
  FROM pb0 JOIN games ON l_orderkey = game_id)"""


def predictions(g: DataFrame) -> DataFrame:
    """Deterministic predictions of two models with a fold number."""
    gid = F.col("game_id")
    return g.select(
        "game_id", "game_date", "season", "d", "home", "away",
        (F.col("score_home") - F.col("score_away")).alias("home_margin"),
        F.col("home_handicap").alias("spread_signed"),
        (1 + F.floor(F.col("d") / 300)).cast("int").alias("fold"),
        ((gid * 37 + F.col("d")) % 61 / 2.0 - 15.0 + (F.col("score_home") - F.col("score_away")) / 16.0).alias("pred_m1"),
        ((gid * 53 + F.col("d")) % 47 / 2.0 - 11.5 + (F.col("score_home") - F.col("score_away")) / 32.0).alias("pred_m2"),
    )


PREDICTIONS = GAMES + """,
predictions AS (SELECT game_id, game_date, season, d, home, away, score_home - score_away AS home_margin,
  home_handicap AS spread_signed, CAST(1 + floor(d / 300) AS INTEGER) AS fold,
  CAST((game_id * 37 + d) % 61 AS DOUBLE) / 2.0 - 15.0 + (score_home - score_away) / 16.0 AS pred_m1,
  CAST((game_id * 53 + d) % 47 AS DOUBLE) / 2.0 - 11.5 + (score_home - score_away) / 32.0 AS pred_m2 FROM games)"""


def quotes(events: DataFrame) -> DataFrame:
    """Price quotes per entity and market."""
    return events.select(
        F.col("event_id").alias("quote_id"), F.col("user_id").alias("entity"), F.col("event_type").alias("market"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "props",
    )


QUOTES = """quotes AS (SELECT event_id AS quote_id, user_id AS entity, event_type AS market, ts, value AS price, props FROM events)"""


def model_bets(pred: DataFrame, price: DataFrame) -> DataFrame:
    """One row per (model, game with a line): price quality, side, stake and settled P&L."""
    raw = price.select("game_id", "home_american", "away_american", F.lit(True).alias("in_join"))
    j = pred.join(raw, "game_id", "left").where(F.col("spread_signed").isNotNull())
    home, away = repaired_prices(F.col("home_american"), F.col("away_american"))
    j = j.withColumn("tier", odds_tier(F.col("in_join"), F.col("home_american"), F.col("away_american")))
    j = j.withColumn("payout_home", valid_payout(home)).withColumn("payout_away", valid_payout(away))
    j = j.withColumn("m", F.explode(F.array(
        F.struct(F.lit("m1").alias("model"), F.col("pred_m1").alias("pred")),
        F.struct(F.lit("m2").alias("model"), F.col("pred_m2").alias("pred")),
    )))
    j = j.withColumn("model", F.col("m.model")).withColumn("pred_ensemble", F.col("m.pred"))
    j = j.withColumn("sigma_ensemble", F.lit(14.0))
    j = priced_bets(j, EV_THRESHOLD, KELLY_FRACTION, KELLY_CAP)
    j = j.withColumn("covered", covered_side(F.col("home_margin"), F.col("spread_signed")))
    j = j.withColumn("pnl", settle(F.col("kelly"), F.col("bet_side"), F.col("covered"), F.col("ph"), F.col("pa")))
    return j.select(
        "model", "game_id", "game_date", "season", "d", "home", "away", "fold", "home_margin", "spread_signed", "tier",
        "payout_home", "payout_away", "pred_ensemble", "sigma_ensemble", "edge", "win_prob", "ev_home", "ev_away",
        "bet_side", "kelly", "covered", "pnl",
    )


MODEL_BETS = PREDICTIONS + PRICES[len(GAMES):] + f""",
mb0 AS (SELECT p.*, q.home_american, q.away_american, q.game_id IS NOT NULL AS in_join,
  coalesce(q.home_american, q.away_american, -110.0) AS h, coalesce(q.away_american, q.home_american, -110.0) AS a
  FROM predictions p LEFT JOIN prices q ON p.game_id = q.game_id WHERE p.spread_signed IS NOT NULL),
mb1 AS (SELECT *, CASE WHEN NOT in_join THEN 'unmatched' WHEN home_american IS NOT NULL AND away_american IS NOT NULL THEN 'matched'
  WHEN home_american IS NOT NULL OR away_american IS NOT NULL THEN 'mirrored' ELSE 'default' END AS tier,
  CASE WHEN h < 0 THEN 100.0 / abs(h) WHEN h > 0 THEN h / 100.0 ELSE 100.0 / 110.0 END AS payout_home,
  CASE WHEN a < 0 THEN 100.0 / abs(a) WHEN a > 0 THEN a / 100.0 ELSE 100.0 / 110.0 END AS payout_away FROM mb0),
mb2 AS (SELECT *, 'm1' AS model, pred_m1 AS pred_ensemble FROM mb1 UNION ALL SELECT *, 'm2', pred_m2 FROM mb1),
mb3 AS (SELECT *, CAST(14.0 AS DOUBLE) AS sigma_ensemble, pred_ensemble + spread_signed AS edge, (pred_ensemble + spread_signed) / 14.0 AS z,
  greatest(payout_home, 0.01) AS ph, greatest(payout_away, 0.01) AS pa FROM mb2),
mb4 AS (SELECT *, {normal_cdf_sql('z')} AS win_prob FROM mb3),
mb5 AS (SELECT *, win_prob * ph - (1 - win_prob) AS ev_home, (1 - win_prob) * pa - win_prob AS ev_away FROM mb4),
mb6 AS (SELECT *, CASE WHEN ev_home > {EV_THRESHOLD} THEN 'HOME' WHEN ev_away > {EV_THRESHOLD} THEN 'AWAY' ELSE 'NONE' END AS bet_side,
  CASE WHEN home_margin = -spread_signed THEN 'PUSH' WHEN home_margin > -spread_signed THEN 'HOME' ELSE 'AWAY' END AS covered FROM mb5),
mb7 AS (SELECT *, least(greatest({KELLY_FRACTION} * CASE bet_side WHEN 'HOME' THEN (win_prob * (ph + 1) - 1) / ph
  WHEN 'AWAY' THEN ((1 - win_prob) * (pa + 1) - 1) / pa ELSE 0.0 END, 0.0), {KELLY_CAP}) AS kelly FROM mb6),
mb AS (SELECT model, game_id, game_date, season, d, home, away, fold, home_margin, spread_signed, tier, payout_home, payout_away,
  pred_ensemble, sigma_ensemble, edge, win_prob, ev_home, ev_away, bet_side, kelly, covered,
  CASE WHEN bet_side = 'NONE' OR covered = 'PUSH' THEN 0.0 WHEN covered = bet_side
       THEN kelly * CASE bet_side WHEN 'HOME' THEN ph ELSE pa END ELSE -kelly END AS pnl FROM mb7)"""
