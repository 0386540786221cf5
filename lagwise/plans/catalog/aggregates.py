"""Queries over entity aggregates, ratings, ranks and simple statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.functions import market, text
from lagwise.operators import aggregates, ranking, sets
from lagwise.operators import joins as J
from lagwise.plans.adapters import GAMES, MODEL_BETS, PLAYER_BOX, PREDICTIONS, QUOTES, TEAM_GAMES
from lagwise.plans.catalog.common import r6
from lagwise.plans.registry import query

CLEAN = PLAYER_BOX + """,
cl AS (SELECT *, CAST(split_part(minutes, ':', 1) AS DOUBLE) + CAST(split_part(minutes, ':', 2) AS DOUBLE) / 60 AS minutes_played FROM (
  SELECT *, row_number() OVER (PARTITION BY game_id, player_id ORDER BY line DESC, supp DESC, points DESC, fga DESC, minutes DESC) AS k FROM player_box) WHERE k = 1)"""


def clean_players(s):
    one = sets.latest(s.player_box, ["game_id", "player_id"], ["line", "supp", "points", "fga", "minutes"])
    return one.withColumn("minutes_played", text.minutes_lenient(F.col("minutes")))


@query("keep_last_copy", "A-03", f"WITH {CLEAN} SELECT game_id, player_id, line, supp, fga, points FROM cl")
def keep_last_copy(s):
    return clean_players(s).select("game_id", "player_id", "line", "supp", "fga", "points")


@query(
    "team_totals", "A-01",
    f"WITH {CLEAN} SELECT game_id, team, CAST(sum(points) AS BIGINT) AS points, CAST(sum(fga) AS BIGINT) AS fga, round(sum(minutes_played), 6) AS minutes_played FROM cl GROUP BY 1, 2",
)
def team_totals(s):
    out = aggregates.totals(clean_players(s), ["game_id", "team"], ["points", "fga", "minutes_played"])
    return out.withColumn("minutes_played", r6("minutes_played"))


@query(
    "mean_of_copies", "A-02",
    """SELECT l_orderkey, l_linenumber, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1, 2""",
)
def mean_of_copies(s):
    out = aggregates.mean_of_copies(s.table("lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", r6("l_quantity").alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query(
    "mixed_aggregate", "A-04",
    f"""WITH {CLEAN} SELECT game_id, team, arg_min(points, (line, supp, player_id)) AS first_points, max(fga) AS max_fga, CAST(sum(oreb) AS BIGINT) AS oreb,
  bool_or(minutes_played = 0) AS any_absent FROM cl GROUP BY 1, 2""",
)
def mixed_aggregate(s):
    return aggregates.mixed(
        clean_players(s), ["game_id", "team"], ["line", "supp", "player_id"], first={"first_points": "points"}, largest={"max_fga": "fga"},
        total={"oreb": "oreb"}, any_of={"any_absent": F.col("minutes_played") == 0},
    )


@query(
    "usage_share", "A-05",
    f"""WITH {CLEAN}, u AS (SELECT *, fga + 0.44 * fta + turnovers AS used FROM cl)
SELECT game_id, player_id, team, round(CAST(used AS DOUBLE) / nullif(sum(CAST(used AS DOUBLE)) OVER (PARTITION BY game_id, team), 0), 12) AS share FROM u""",
)
def usage_share(s):
    p = clean_players(s)
    out = J.share_of_group(p.withColumn("used", aggregates.usage(p)), ["game_id", "team"], "used")
    return out.select("game_id", "player_id", "team", F.round("share", 12).alias("share"))


@query(
    "usage_concentration", "A-06",
    f"""WITH {CLEAN}, u AS (SELECT *, CAST(fga + 0.44 * fta + turnovers AS DOUBLE) AS used FROM cl),
h AS (SELECT *, used / nullif(sum(used) OVER (PARTITION BY game_id, team), 0) AS share FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY game_id, team ORDER BY share DESC NULLS LAST, player_id) AS rn FROM h)
SELECT game_id, team, round(coalesce(sum(share) FILTER (rn <= 2), 0), 10) AS usg_top2_share, round(coalesce(sum(share) FILTER (rn <= 3), 0), 10) AS usg_top3_share FROM r GROUP BY 1, 2""",
)
def usage_concentration(s):
    p = clean_players(s)
    out = aggregates.concentration(p, ["game_id", "team"], aggregates.usage(p), (2, 3), ["player_id"])
    return out.select("game_id", "team", *[F.round(c, 10).alias(c) for c in ("usg_top2_share", "usg_top3_share")])


@query(
    "top_player_mean", "A-07 T-03",
    f"""WITH {CLEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY game_id, team ORDER BY minutes_played DESC, player_id) AS rn FROM cl)
SELECT game_id, team, round(avg(points), 6) AS top3_points FROM r WHERE rn <= 3 GROUP BY 1, 2""",
)
def top_player_mean(s):
    out = aggregates.top_mean(clean_players(s), ["game_id", "team"], "minutes_played", "player_id", "points", 3, "v")
    return out.select("game_id", "team", r6("v").alias("top3_points"))


@query(
    "bench_sum", "A-08",
    f"""WITH {CLEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY game_id, team ORDER BY minutes_played DESC, player_id) AS rn FROM cl),
b AS (SELECT game_id, team, CAST(coalesce(sum(plus_minus) FILTER (rn > 2 AND minutes_played > 0), 0) AS BIGINT) AS bench_plus_minus,
  greatest(CAST(sum(fga) + 0.44 * sum(fta) - sum(oreb) + sum(turnovers) AS DOUBLE), 1.0) AS poss FROM r GROUP BY 1, 2)
SELECT game_id, team, bench_plus_minus, round(bench_plus_minus / poss * 100, 6) AS bench_net_rating FROM b""",
)
def bench_sum(s):
    p = clean_players(s)
    bench = aggregates.outside_top_sum(p, ["game_id", "team"], "minutes_played", "player_id", "plus_minus", 2, F.col("minutes_played") > 0, "bench_plus_minus")
    t = aggregates.totals(p, ["game_id", "team"], ["fga", "fta", "oreb", "turnovers"])
    poss = F.greatest(aggregates.possessions(), F.lit(1.0))
    return t.join(bench, ["game_id", "team"]).select("game_id", "team", "bench_plus_minus", r6(F.col("bench_plus_minus") / poss * 100).alias("bench_net_rating"))


@query(
    "team_ratings", "A-09 J-04",
    f"""WITH {CLEAN}, t AS (SELECT game_id, team, sum(points) AS points, sum(rebounds) AS rebounds, sum(oreb) AS oreb, sum(turnovers) AS turnovers, sum(fga) AS fga, sum(fta) AS fta,
  sum(ftm) AS ftm, sum(three_pm) AS three_pm, sum(three_pa) AS three_pa, sum(minutes_played) AS mp FROM cl GROUP BY 1, 2),
j AS (SELECT a.*, b.points AS po, b.rebounds AS ro, CAST(0.5 * ((a.fga + 0.44 * a.fta - a.oreb + a.turnovers) + (b.fga + 0.44 * b.fta - b.oreb + b.turnovers)) AS DOUBLE) AS poss
  FROM t a JOIN t b ON a.game_id = b.game_id AND a.team <> b.team)
SELECT game_id, team, round(poss, 6) AS possessions, round(coalesce(48 * poss / nullif(mp / 5, 0), 0), 6) AS pace, round(coalesce(points / nullif(poss, 0) * 100, 0), 6) AS off_rating,
  round(coalesce(points / nullif(poss, 0) * 100, 0) - coalesce(po / nullif(poss, 0) * 100, 0), 6) AS net_rating, round(CAST(three_pa AS DOUBLE) / (fga + 0.000001), 6) AS three_pa_rate,
  greatest(CAST(points - 3 * three_pm - ftm AS DOUBLE), 0.0) AS paint_points, round(rebounds / (rebounds + ro + CAST(0.000001 AS DOUBLE)), 6) AS rebound_rate FROM j""",
)
def team_ratings(s):
    out = aggregates.team_ratings(clean_players(s))
    return out.select("game_id", "team", "paint_points", *[r6(c).alias(c) for c in ("possessions", "pace", "off_rating", "net_rating", "three_pa_rate", "rebound_rate")])


@query(
    "exact_quantiles", "A-18",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1""",
)
def exact_quantiles(s):
    out = ranking.quantiles(s.table("lineitem"), ["l_returnflag"], F.col("l_extendedprice"), {"median": 0.5, "p90": 0.9})
    return out.select("l_returnflag", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"))


@query(
    "mad_cutoff", "A-18",
    """WITH m AS (SELECT market, quantile_cont(price, 0.5) AS median FROM (SELECT event_type AS market, value AS price FROM events) GROUP BY 1),
d AS (SELECT market, quantile_cont(abs(value - median), 0.5) AS mad FROM events JOIN m ON market = event_type GROUP BY 1)
SELECT m.market, round(median, 6) AS median, round(mad, 6) AS mad, round(median + 4 * 1.4826 * mad, 5) AS cutoff FROM m JOIN d ON m.market = d.market""",
)
def mad_cutoff(s):
    out = ranking.outlier_cutoff(s.quotes, ["market"], F.col("price"))
    return out.select("market", r6("median").alias("median"), r6("mad").alias("mad"), F.round("cutoff", 5).alias("cutoff"))


@query(
    "best_row_per_group", "A-19",
    f"WITH {GAMES} SELECT home, max(score_home) AS best_score_home, arg_min(game_id, (-score_home, game_id)) AS best_game_id FROM games GROUP BY home",
)
def best_row_per_group(s):
    return aggregates.best_rows(s.games, ["home"], "score_home", ["game_id"], tie="game_id")


@query(
    "probability_scores", "A-22",
    f"""WITH {MODEL_BETS}, x AS (SELECT model, least(greatest(win_prob, 0.01), 0.99) AS q, win_prob AS p, CASE WHEN covered = 'HOME' THEN 1 ELSE 0 END AS y FROM mb WHERE covered <> 'PUSH')
SELECT model, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM x GROUP BY model""",
)
def probability_scores(s):
    b = s.model_bets.where("covered <> 'PUSH'").withColumn("y", (F.col("covered") == "HOME").cast("int"))
    return b.groupBy("model").agg(
        r6(aggregates.log_loss(F.col("y"), F.col("win_prob"))).alias("log_loss"), r6(aggregates.brier(F.col("y"), F.col("win_prob"))).alias("brier")
    )


REG = PREDICTIONS + """,
r AS (SELECT game_date AS g, home_margin + spread_signed AS y, pred_m1 + spread_signed AS x FROM predictions WHERE spread_signed IS NOT NULL),
m AS (SELECT count(*) AS n, CAST(sum(x) AS DOUBLE) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM r)"""
REG_SE = """d AS (SELECT n * sxx - sx * sx AS det, * FROM m), i AS (SELECT sxx / det AS i00, -sx / det AS i01, n / det AS i11, * FROM d),
v AS (SELECT i00 * i00 * m00 + 2 * i00 * i01 * m01 + i01 * i01 * m11 AS v0, i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11 AS v1, * FROM i, meat)
SELECT 'intercept' AS term, round(b0, 6) AS coef, round(sqrt(v0), 6) AS se, n FROM v UNION ALL SELECT 'x', round(b1, 6), round(sqrt(v1), 6), n FROM v"""


@query(
    "ols_hc1", "A-23",
    f"""WITH {REG}, meat AS (SELECT sum(u * u) * max(n) / (max(n) - 2) AS m00, sum(x * u * u) * max(n) / (max(n) - 2) AS m01, sum(x * x * u * u) * max(n) / (max(n) - 2) AS m11
  FROM (SELECT x, y - b0 - b1 * x AS u, n FROM r, m)), {REG_SE}""",
)
def ols_hc1(s):
    p = s.predictions.where("spread_signed IS NOT NULL")
    out = aggregates.ols(p, F.col("home_margin") + F.col("spread_signed"), {"x": F.col("pred_m1") + F.col("spread_signed")})
    return out.select("term", r6("coef").alias("coef"), r6("se").alias("se"), "n")


@query(
    "ols_clustered", "A-23 R-24",
    f"""WITH {REG}, c AS (SELECT g, sum(u) AS s0, sum(x * u) AS s1 FROM (SELECT g, x, y - b0 - b1 * x AS u FROM r, m) GROUP BY g),
meat AS (SELECT sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM c), {REG_SE}""",
)
def ols_clustered(s):
    p = s.predictions.where("spread_signed IS NOT NULL")
    out = aggregates.ols(p, F.col("home_margin") + F.col("spread_signed"), {"x": F.col("pred_m1") + F.col("spread_signed")}, cluster="game_date")
    return out.select("term", r6("coef").alias("coef"), r6("se").alias("se"), "n")


@query(
    "mean_and_error", "A-24",
    f"""WITH {MODEL_BETS} SELECT model, round(avg(pnl), 8) AS mean, round(stddev_samp(pnl) / sqrt(count(*)), 8) AS se, count(*) AS n FROM mb WHERE bet_side <> 'NONE' GROUP BY model""",
)
def mean_and_error(s):
    out = aggregates.mean_and_error(s.model_bets.where("bet_side <> 'NONE'"), F.col("pnl"), ["model"])
    return out.select("model", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"), "n")


@query("permutation_placebo", "R-25")
def permutation_placebo(s):
    p = s.predictions.where("spread_signed IS NOT NULL").withColumn("x", F.col("pred_m1") + F.col("spread_signed"))
    mixed = aggregates.permuted(p, "x", "game_id", 7, "x_shuffled")
    return aggregates.ols(mixed, F.col("home_margin") + F.col("spread_signed"), {"x_shuffled": F.col("x_shuffled")})


@query(
    "usage_counter", "A-34 ST-07",
    """WITH l AS (SELECT event_type AS provider, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS tried, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS objects,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS q FROM events),
u AS (SELECT provider, substr(tried, 1, 7) AS month, CAST(sum(coalesce(objects, 0)) AS BIGINT) AS objects FROM l GROUP BY 1, 2),
k AS (SELECT provider, max(tried) AS mx FROM l WHERE q <> '' GROUP BY 1), k2 AS (SELECT l.provider, min(CAST(q AS BIGINT)) AS lo, max(CAST(q AS BIGINT)) AS hi FROM l JOIN k ON l.provider = k.provider AND tried = mx WHERE q <> '' GROUP BY 1)
SELECT u.provider, month, objects, hi AS quota_used FROM u JOIN k2 ON u.provider = k2.provider""",
)
def usage_counter(s):
    e = s.table("events").select(
        F.col("event_type").alias("provider"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("attempted_at_utc"),
        F.when(F.col("event_id") % 9 != 0, F.floor("value").cast("string")).alias("objects"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_id").cast("string")).alias("quota_used"),
    )
    return aggregates.usage_by_month(e)


@query(
    "duplicate_collisions", "A-35 Q-07",
    """SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_collisions FROM lineitem""",
)
def duplicate_collisions(s):
    return aggregates.collisions(s.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "rank_in_group", "W-15",
    f"""WITH {TEAM_GAMES} SELECT game_id, team, row_number() OVER (PARTITION BY season ORDER BY handicap DESC NULLS LAST, game_id, team) AS rank FROM tg""",
)
def rank_in_group(s):
    return ranking.group_rank(s.team_games, ["season"], F.col("handicap"), ["game_id", "team"], "rank").select("game_id", "team", "rank")


@query(
    "top_n_per_day", "T-02 T-04",
    f"""WITH {MODEL_BETS}, r AS (SELECT model, game_id, d, round(abs(edge), 9) AS e, row_number() OVER (PARTITION BY model, d ORDER BY round(abs(edge), 9) DESC, game_id) AS rank FROM mb WHERE bet_side <> 'NONE')
SELECT model, game_id, d, round(e, 6) AS edge_abs, rank FROM r WHERE rank <= 2""",
)
def top_n_per_day(s):
    b = s.model_bets.where("bet_side <> 'NONE'").withColumn("e", F.round(F.abs("edge"), 9))
    out = ranking.top_n(b, ["model", "d"], [F.col("e").desc(), "game_id"], 2, "rank")
    return out.select("model", "game_id", "d", r6("e").alias("edge_abs"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "top_quantile_slice", "T-05",
    f"""WITH {PREDICTIONS}, e AS (SELECT game_id, pred_m1 + spread_signed AS edge FROM predictions WHERE spread_signed IS NOT NULL)
SELECT game_id, round(edge, 6) AS edge FROM e WHERE abs(edge) >= (SELECT quantile_cont(abs(edge), 0.8) FROM e)""",
)
def top_quantile_slice(s):
    e = s.predictions.where("spread_signed IS NOT NULL").select("game_id", (F.col("pred_m1") + F.col("spread_signed")).alias("edge"))
    return ranking.top_share(e, F.col("edge"), 0.8).select("game_id", r6("edge").alias("edge"))


@query(
    "largest_groups", "T-06",
    """WITH g AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, first) AS k FROM g)
SELECT strftime(day, '%Y-%m-%d') AS day, o_orderpriority, n, k <= 3 AS kept FROM r""",
)
def largest_groups(s):
    g = s.table("orders").groupBy(F.to_date("o_orderdate").alias("day"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
    out = ranking.largest_groups(g, ["day"], "n", "first", 3)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "o_orderpriority", "n", "kept")


@query(
    "top_report", "T-07",
    f"WITH {QUOTES} SELECT entity, count(*) AS n, round(sum(price), 4) AS total FROM quotes GROUP BY entity ORDER BY n DESC, entity LIMIT 15",
)
def top_report(s):
    g = s.quotes.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("total"))
    return ranking.top_report(g, [F.col("n").desc(), "entity"], 15)


@query(
    "settlement", "M-05 M-06",
    f"""WITH {MODEL_BETS} SELECT model, game_id, bet_side, covered, round(win_prob, 6) AS win_prob, round(ev_home, 6) AS ev_home, round(ev_away, 6) AS ev_away, round(kelly, 12) AS kelly, round(pnl, 12) AS pnl FROM mb""",
)
def settlement(s):
    return s.model_bets.select("model", "game_id", "bet_side", "covered", *[r6(c).alias(c) for c in ("win_prob", "ev_home", "ev_away")], *[F.round(c, 12).alias(c) for c in ("kelly", "pnl")])


@query(
    "entry_comparison", "R-24 C-23",
    f"""WITH {MODEL_BETS}, x AS (SELECT *, 1 + payout_home AS dh, 1 + payout_away AS da, (1 / (1 + payout_home)) / (1 / (1 + payout_home) + 1 / (1 + payout_away)) AS pc,
  CASE WHEN home_margin > 0 THEN 1.0 ELSE 0.0 END AS win, least(greatest(win_prob, 0.01), 0.99) AS p FROM mb),
y AS (SELECT *, p * dh - 1 AS evh, (1 - p) * da - 1 AS eva FROM x),
z AS (SELECT *, evh > 0.03 AND evh >= eva AS hb FROM y WHERE evh > 0.03 AND evh >= eva OR eva > 0.03),
w AS (SELECT model, CASE WHEN hb THEN pc * dh ELSE (1 - pc) * da END - 1 AS clv, CASE WHEN hb THEN CASE WHEN win = 1 THEN dh - 1 ELSE -1 END ELSE CASE WHEN win = 0 THEN da - 1 ELSE -1 END END AS ret FROM z)
SELECT model, count(*) AS n, round(avg(clv), 6) AS mean_clv, round(stddev_samp(clv) / sqrt(count(*)), 6) AS clv_se, round(avg(ret), 6) AS roi, round(stddev_samp(ret) / sqrt(count(*)), 6) AS roi_se FROM w GROUP BY model""",
)
def entry_comparison(s):
    b = s.model_bets.withColumns({"dh": 1 + F.col("payout_home"), "da": 1 + F.col("payout_away"), "win": (F.col("home_margin") > 0).cast("int")})
    b = b.withColumn("pc", market.devig(F.col("dh"), F.col("da"))[0]).withColumn("p", F.least(F.greatest("win_prob", F.lit(0.01)), F.lit(0.99)))
    b = b.withColumns({"evh": F.col("p") * F.col("dh") - 1, "eva": (1 - F.col("p")) * F.col("da") - 1})
    home = (F.col("evh") > 0.03) & (F.col("evh") >= F.col("eva"))
    b = b.where(home | (F.col("eva") > 0.03))
    clv = F.when(home, F.col("pc") * F.col("dh")).otherwise((1 - F.col("pc")) * F.col("da")) - 1
    ret = F.when(home, F.when(F.col("win") == 1, F.col("dh") - 1).otherwise(-1.0)).otherwise(F.when(F.col("win") == 0, F.col("da") - 1).otherwise(-1.0))
    b = b.withColumn("clv", clv).withColumn("ret", ret)
    return b.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("clv")).alias("mean_clv"), r6(F.stddev_samp("clv") / F.sqrt(F.count(F.lit(1)))).alias("clv_se"),
        r6(F.avg("ret")).alias("roi"), r6(F.stddev_samp("ret") / F.sqrt(F.count(F.lit(1)))).alias("roi_se"),
    )


ENTRY_HOURS = {"open": 20.0, "timed": 9.0, "close": 0.0}
# Quotes of a game: six in the day before it, each a little off the last; the newest at or before each entry counts.
ENTRIES = PREDICTIONS + """,
qt AS (SELECT game_id, h, 1.6 + (game_id * 7 + h * 3) % 11 / 20.0 AS dh, 1.0 / (1.04 - 1.0 / (1.6 + (game_id * 7 + h * 3) % 11 / 20.0)) AS da FROM predictions, (VALUES (21), (15), (10), (6), (3), (1)) v(h) WHERE (game_id + h) % 17 <> 0),
en AS (SELECT p.game_id, e.entry, p.game_date, p.home_margin, arg_min(dh, h) AS dh, arg_min(da, h) AS da FROM predictions p, (VALUES ('open', 20), ('timed', 9), ('close', 0)) e(entry, h0) JOIN qt ON qt.game_id = p.game_id AND qt.h >= e.h0 GROUP BY ALL),
fu AS (SELECT game_id, max(CASE WHEN entry = 'close' THEN (1 / dh) / (1 / dh + 1 / da) END) AS pc FROM en GROUP BY 1 HAVING count(*) = 3),
er AS (SELECT en.*, pc, (1 / dh) / (1 / dh + 1 / da) AS pe, least(greatest(1 / (1 + exp(-pred_m1 / 9.0)), 0.01), 0.99) AS p, CASE WHEN en.home_margin > 0 THEN 1.0 ELSE 0.0 END AS win FROM en JOIN fu ON fu.game_id = en.game_id JOIN predictions q ON q.game_id = en.game_id),
ev AS (SELECT *, p * dh - 1 AS eh, (1 - p) * da - 1 AS ea FROM er),
eb AS (SELECT *, eh > 0.03 AND eh >= ea AS oh, (eh > 0.03 AND eh >= ea) OR ea > 0.03 AS bet FROM ev),
ec AS (SELECT *, CASE WHEN bet THEN CASE WHEN oh THEN pc * dh ELSE (1 - pc) * da END - 1 END AS clv, CASE WHEN bet THEN CASE WHEN (oh AND win = 1) OR (NOT oh AND win = 0) THEN CASE WHEN oh THEN dh ELSE da END - 1 ELSE -1 END END AS ret FROM eb)"""


@query(
    "entry_report", "R-24 J-10",
    f"""WITH {ENTRIES} SELECT entry, count(*) AS n, round(CASE WHEN entry <> 'close' THEN regr_slope(ln(pc / (1 - pc)) - ln(pe / (1 - pe)), ln(p / (1 - p)) - ln(pe / (1 - pe))) END, 7) AS clv_slope,
  count(clv) AS bets, round(avg(clv), 7) AS mean_clv, round(avg(ret), 7) AS roi, round((SELECT regr_slope(win - pc, p - pc) FROM ec WHERE entry = 'close'), 7) AS close_slope FROM ec GROUP BY entry""",
)
def entry_report(s):
    """A forecast against the prices at open, nine hours before and at the close."""
    from lagwise.operators import entries

    p = s.predictions.select("game_id", "game_date", F.col("game_date").cast("timestamp").alias("start"), (F.col("home_margin") > 0).cast("double").alias("win"), (1 / (1 + F.exp(-F.col("pred_m1") / 9.0))).alias("p_m1"))
    h = F.explode(F.array(*[F.lit(x) for x in (21, 15, 10, 6, 3, 1)])).alias("h")
    q = p.select("game_id", "start", h).where((F.col("game_id") + F.col("h")) % 17 != 0)
    home = 1.6 + (F.col("game_id") * 7 + F.col("h") * 3) % 11 / 20.0
    q = q.select("game_id", F.timestamp_micros(F.unix_micros("start") - F.col("h") * F.lit(3_600_000_000)).alias("at"), home.alias("decimal_home"), (1.0 / (1.04 - 1.0 / home)).alias("decimal_away"))
    rows = entries.entry_prices(p, q, "game_id", "start", "at", ENTRY_HOURS)
    out = entries.entry_report(rows, {"m1": "p_m1"}, "win", "game_date")
    return out.select("entry", "n", F.round("clv_slope", 7).alias("clv_slope"), "bets", *[F.round(c, 7).alias(c) for c in ("mean_clv", "roi", "close_slope")])


@query(
    "spread_report", "R-24 T-05",
    f"""WITH {PREDICTIONS}, u AS (SELECT 'pred_m1' AS forecast, home_margin + spread_signed AS error, pred_m1 + spread_signed AS edge FROM predictions WHERE spread_signed IS NOT NULL
  UNION ALL SELECT 'pred_m2', home_margin + spread_signed, pred_m2 + spread_signed FROM predictions WHERE spread_signed IS NOT NULL),
c AS (SELECT forecast, quantile_cont(abs(edge), 0.8) AS cut FROM u GROUP BY 1), v AS (SELECT u.*, 'all' AS slice FROM u UNION ALL SELECT u.*, 'top' FROM u JOIN c ON c.forecast = u.forecast AND abs(edge) >= cut)
SELECT forecast, slice, count(*) AS n, round(sqrt(avg(error * error)), 7) AS line_rmse, round(sqrt(avg((error - edge) * (error - edge))), 7) AS model_rmse, round(regr_slope(error, edge), 7) AS slope FROM v GROUP BY 1, 2""",
)
def spread_report(s):
    from lagwise.operators import entries

    out = entries.spread_report(s.predictions, "home_margin", "spread_signed", ["pred_m1", "pred_m2"], "game_date")
    return out.select("forecast", "slice", "n", *[F.round(c, 7).alias(c) for c in ("line_rmse", "model_rmse", "slope")])
