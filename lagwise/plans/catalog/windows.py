"""Queries over lagged, calendar and season windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.operators import aggregates, sets
from lagwise.operators import windows as W
from lagwise.operators.timeline import Timeline, framed
from lagwise.plans.adapters import GAMES, PLAYER_BOX, TEAM_GAMES
from lagwise.plans.catalog.common import TEAM_LINE, r6, text_date
from lagwise.plans.registry import query

FORM = """SELECT {cols} FROM (SELECT *, {x} FROM tg WINDOW w AS (PARTITION BY team ORDER BY d, game_id)) t"""


@query(
    "form_difference", "U-01 W-01 J-01 C-32 T-01",
    f"""WITH {TEAM_GAMES},
f AS (SELECT game_id, is_home,
  CASE WHEN count(pts) OVER w = 5 THEN avg(pts) OVER w END AS p,
  CASE WHEN count(margin) OVER w = 5 THEN avg(margin) OVER w END AS mg
  FROM tg WINDOW w AS (PARTITION BY team ORDER BY d, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT g.game_id, strftime(g.game_date, '%Y-%m-%d') AS game_date, g.home, g.away,
  round(h.p, 6) AS home_pts_last5, round(a.p, 6) AS away_pts_last5,
  round(h.p - a.p, 6) AS pts_diff_last5, round(h.mg - a.mg, 6) AS margin_diff_last5
FROM games g JOIN f h ON g.game_id = h.game_id AND h.is_home = 1 JOIN f a ON g.game_id = a.game_id AND a.is_home = 0""",
)
def form_difference(s):
    form = W.lagged_means(s.team_games, TEAM_LINE, {"p": F.col("pts"), "mg": F.col("margin")}, 5)
    sides = form.groupBy("game_id").agg(
        *[F.max(F.when(F.col("is_home") == k, F.col(c))).alias(f"{n}_{c}") for k, n in ((1, "home"), (0, "away")) for c in ("p", "mg")]
    )
    return (
        s.games.join(sides, "game_id")
        .select(
            "game_id", text_date("game_date").alias("game_date"), "home", "away",
            r6("home_p").alias("home_pts_last5"), r6("away_p").alias("away_pts_last5"),
            r6(F.col("home_p") - F.col("away_p")).alias("pts_diff_last5"),
            r6(F.col("home_mg") - F.col("away_mg")).alias("margin_diff_last5"),
        )
        .orderBy("game_date", "game_id")
    )


@query(
    "lagged_mean_min_periods", "W-02 F-01",
    f"""WITH {TEAM_GAMES} SELECT game_id, team,
  round(CASE WHEN count(handicap) OVER w >= 3 THEN avg(handicap) OVER w END, 6) AS handicap_r10,
  round(CASE WHEN count(pts) OVER w >= 3 THEN avg(pts) OVER w END, 6) AS pts_r10
FROM tg WINDOW w AS (PARTITION BY team ORDER BY d, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def lagged_mean_min_periods(s):
    out = W.lagged_means(s.team_games, TEAM_LINE, {"h": F.col("handicap"), "p": F.col("pts")}, 10, 3)
    return out.select("game_id", "team", r6("h").alias("handicap_r10"), r6("p").alias("pts_r10"))


@query(
    "lagged_std", "W-03",
    f"""WITH {TEAM_GAMES} SELECT game_id, team,
  round(CASE WHEN count(margin) OVER w >= 3 THEN stddev_samp(margin) OVER w END, 6) AS margin_std_last_10
FROM tg WINDOW w AS (PARTITION BY team ORDER BY d, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def lagged_std(s):
    out = W.lagged_stds(s.team_games, TEAM_LINE, {"x": F.col("margin")}, 10, 3)
    return out.select("game_id", "team", r6("x").alias("margin_std_last_10"))


@query(
    "prior_mean", "W-04",
    f"""WITH {TEAM_GAMES} SELECT game_id, team, round(avg(CASE WHEN abs(margin) >= 15 THEN 1 ELSE 0 END) OVER w, 6) AS blowout_pct
FROM tg WINDOW w AS (PARTITION BY team ORDER BY d, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def prior_mean(s):
    flag = (F.abs("margin") >= 15).cast("int")
    out = W.prior_means(s.team_games, TEAM_LINE, {"x": flag})
    return out.select("game_id", "team", r6("x").alias("blowout_pct"))


SEASON_LINE = Timeline(("team", "season"), ("d", "game_id"))


@query(
    "season_to_date_mean", "W-05",
    f"""WITH {TEAM_GAMES} SELECT game_id, team, season,
  round(CASE WHEN count(pts) OVER w >= 3 THEN avg(pts) OVER w END, 6) AS pts_s2d,
  round(CASE WHEN count(handicap) OVER w >= 3 THEN avg(handicap) OVER w END, 6) AS handicap_s2d
FROM tg WINDOW w AS (PARTITION BY team, season ORDER BY d, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def season_to_date_mean(s):
    out = W.prior_means(s.team_games, SEASON_LINE, {"p": F.col("pts"), "h": F.col("handicap")}, 3)
    return out.select("game_id", "team", "season", r6("p").alias("pts_s2d"), r6("h").alias("handicap_s2d"))


@query(
    "prior_zscore", "W-06",
    f"""WITH {TEAM_GAMES},
z AS (SELECT game_id, team, season, pts, count(pts) OVER w AS n, avg(pts) OVER w AS m, stddev_samp(pts) OVER w AS sd
  FROM tg WINDOW w AS (PARTITION BY team, season ORDER BY d, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT game_id, team, season, round(CASE WHEN n >= 5 AND sd > 1e-9 THEN (pts - m) / sd ELSE 0.0 END, 6) AS pts_z FROM z""",
)
def prior_zscore(s):
    out = W.prior_zscores(s.team_games.withColumn("x", F.col("pts")), SEASON_LINE, {"x": F.col("pts")}, 5)
    return out.select("game_id", "team", "season", r6("x").alias("pts_z"))


def _decay_sql(col: str, n: int, decay: float) -> str:
    total = sum(decay**k for k in range(n))
    return "(" + " + ".join(f"lag({col}, {k + 1}) OVER w * {decay**k!r}" for k in range(n)) + f") / {total!r}"


@query(
    "decay_weighted_mean", "W-07 F-02",
    f"""WITH {TEAM_GAMES} SELECT game_id, team, round({_decay_sql('pts', 5, 0.8)}, 6) AS pts_ewm5,
  round({_decay_sql('handicap', 10, 0.8)}, 6) AS handicap_ewm10
FROM tg WINDOW w AS (PARTITION BY team ORDER BY d, game_id)""",
)
def decay_weighted_mean(s):
    out = framed(
        s.team_games, TEAM_LINE,
        lambda w: {"p": W.last_decayed(w, F.col("pts"), 5, 0.8), "h": W.last_decayed(w, F.col("handicap"), 10, 0.8)},
        reach=10,
    )
    return out.select("game_id", "team", r6("p").alias("pts_ewm5"), r6("h").alias("handicap_ewm10"))


@query(
    "rest_and_back_to_back", "W-08 M-04 D-01",
    f"""WITH {TEAM_GAMES}, r AS (SELECT game_id, team, d - lag(d) OVER (PARTITION BY team ORDER BY d, game_id) AS rest FROM tg)
SELECT game_id, team, rest, CASE WHEN rest = 1 THEN 1 ELSE 0 END AS b2b,
  CASE WHEN rest IS NULL THEN NULL ELSE CAST(least(greatest(rest, 0), 5) AS DOUBLE) END AS rest_clipped FROM r""",
)
def rest_and_back_to_back(s):
    from lagwise.functions.numeric import clip

    out = W.rest_days(s.team_games, TEAM_LINE, "game_date")
    return out.select("game_id", "team", "rest", "b2b", clip(F.col("rest"), 0, 5).alias("rest_clipped"))


@query(
    "streaks", "W-09 F-03",
    f"""WITH {TEAM_GAMES},
p AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY d, game_id) AS n FROM tg),
q AS (SELECT game_id, team, n,
  max(CASE WHEN margin <= 0 THEN n ELSE 0 END) OVER w AS last_loss, max(CASE WHEN margin > 0 THEN n ELSE 0 END) OVER w AS last_win
  FROM p WINDOW w AS (PARTITION BY team ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT game_id, team, n - 1 - coalesce(last_loss, 0) AS win_streak, n - 1 - coalesce(last_win, 0) AS loss_streak,
  coalesce(last_win, 0) - coalesce(last_loss, 0) AS streak_length FROM q""",
)
def streaks(s):
    return W.streaks(s.team_games, TEAM_LINE, F.col("margin") > 0).select("game_id", "team", "win_streak", "loss_streak", "streak_length")


@query(
    "calendar_counts", "W-10",
    f"""WITH {TEAM_GAMES} SELECT game_id, team,
  count(*) OVER (PARTITION BY team ORDER BY d RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS games_last_3_days,
  count(*) OVER (PARTITION BY team ORDER BY d RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS games_last_5_days,
  count(*) OVER (PARTITION BY team ORDER BY d RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS games_last_7_days FROM tg""",
)
def calendar_counts(s):
    out = W.recent_counts(s.team_games, ["team"], "d", [3, 5, 7])
    return out.select("game_id", "team", "games_last_3_days", "games_last_5_days", "games_last_7_days")


@query(
    "inverse_gap_load", "W-11",
    f"""WITH {TEAM_GAMES} SELECT t.game_id, t.team, round(coalesce(sum(1.0 / (t.d - e.d)), 0), 6) AS rest_weighted_load
FROM tg t LEFT JOIN tg e ON e.team = t.team AND e.d < t.d AND e.d >= t.d - 7 GROUP BY t.game_id, t.team""",
)
def inverse_gap_load(s):
    out = W.inverse_gap_load(s.team_games, ["team"], "d")
    return out.select("game_id", "team", r6("rest_weighted_load").alias("rest_weighted_load"))


# Venue positions are derived from the home team number.
VENUE_LAT = "30.0 + (home * 7) % 17"
VENUE_LON = "-120.0 + (home * 11) % 45"
LEGS = TEAM_GAMES + f""",
pos AS (SELECT t.game_id, t.team, t.d, t.season, t.is_home, {VENUE_LAT} AS lat, {VENUE_LON} AS lon FROM tg t JOIN games g ON t.game_id = g.game_id),
lg AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM pos WINDOW w AS (PARTITION BY team ORDER BY d, game_id)),
legs AS (SELECT *, coalesce(2 * 3958.8 * asin(sqrt(pow(sin((radians(lat) - radians(plat)) / 2), 2)
  + cos(radians(plat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2))), 0.0) AS travel_dist FROM lg)"""


def venue_legs(s):
    side = s.team_games.withColumn("home", F.when(F.col("is_home") == 1, F.col("team")).otherwise(F.col("opp")))
    placed = side.withColumn("lat", F.expr(VENUE_LAT).cast("double")).withColumn("lon", F.expr(VENUE_LON).cast("double"))
    return W.travel_legs(placed, TEAM_LINE, "lat", "lon")


@query(
    "travel_legs", "W-13 M-01",
    f"WITH {LEGS} SELECT game_id, team, round(travel_dist, 4) AS travel_dist FROM legs",
)
def travel_legs(s):
    return venue_legs(s).select("game_id", "team", F.round("travel_dist", 4).alias("travel_dist"))


@query(
    "calendar_sums", "W-12",
    f"""WITH {LEGS} SELECT game_id, team,
  round(coalesce(sum(travel_dist) OVER (PARTITION BY team ORDER BY d RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), 4) AS travel_3d,
  round(coalesce(sum(travel_dist) OVER (PARTITION BY team ORDER BY d RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 0), 4) AS travel_10d
FROM legs""",
)
def calendar_sums(s):
    out = W.recent_sums(venue_legs(s), ["team"], "d", F.col("travel_dist"), [3, 10], "travel")
    return out.select("game_id", "team", F.round("travel_3d", 4).alias("travel_3d"), F.round("travel_10d", 4).alias("travel_10d"))


@query(
    "previous_row_flag", "W-14 C-35",
    f"""WITH {TEAM_GAMES}, x AS (SELECT *, game_id % 13 = 0 AS unknown FROM tg)
SELECT game_id, team, CASE WHEN coalesce(lag(unknown) OVER w, FALSE) THEN NULL ELSE coalesce(lag(pts) OVER w, 0) END AS prev_pts
FROM x WINDOW w AS (PARTITION BY team ORDER BY d, game_id)""",
)
def previous_row_flag(s):
    marked = s.team_games.withColumn("unknown", F.col("game_id") % 13 == 0)
    return W.previous_known(marked, TEAM_LINE, "pts", "unknown", "prev_pts").select("game_id", "team", "prev_pts")


@query(
    "previous_day_snapshot", "J-12 A-07",
    f"""WITH {PLAYER_BOX},
dd AS (SELECT *, row_number() OVER (PARTITION BY game_id, player_id ORDER BY line DESC, supp DESC, points DESC, fga DESC, minutes DESC) AS k FROM player_box),
rk AS (SELECT game_id, team, d, points, row_number() OVER (PARTITION BY game_id, team
  ORDER BY CAST(split_part(minutes, ':', 1) AS INTEGER) DESC, player_id) AS r FROM dd WHERE k = 1),
dy AS (SELECT team, d, avg(points) AS top2 FROM rk WHERE r <= 2 GROUP BY team, d),
pv AS (SELECT team, d, lag(top2) OVER (PARTITION BY team ORDER BY d) AS prev_top2 FROM dy)
SELECT DISTINCT k.game_id, k.team, round(prev_top2, 6) AS prev_top2 FROM rk k JOIN pv ON k.team = pv.team AND k.d = pv.d""",
)
def previous_day_snapshot(s):
    box = sets.latest(s.player_box, ["game_id", "player_id"], ["line", "supp", "points", "fga", "minutes"])
    box = box.withColumn("minute", F.split("minutes", ":")[0].cast("int"))
    top = aggregates.top_mean(box, ["game_id", "team", "d"], "minute", "player_id", "points", 2, "v")
    # a team plays once a day, so a game's mean is the day's mean
    out = W.previous_day_value(top, ["team"], "d", F.avg("v"), "prev_top2")
    return out.select("game_id", "team", r6("prev_top2").alias("prev_top2"))


@query(
    "running_peak", "W-24",
    f"""WITH {TEAM_GAMES} SELECT game_id, team, max(pts) OVER (PARTITION BY team ORDER BY d, game_id) AS peak FROM tg""",
)
def running_peak(s):
    return W.running_peak(s.team_games, TEAM_LINE, "pts").select("game_id", "team", "peak")


@query(
    "fold_window_check", "W-25",
    f"""WITH {GAMES}, f AS (SELECT CAST(floor(d / 300) AS INTEGER) AS fold, min(d) - CASE WHEN floor(d / 300) % 3 = 0 THEN 5 ELSE 0 END AS test_start,
  max(d) AS test_end FROM games GROUP BY floor(d / 300)),
p AS (SELECT *, lag(test_end) OVER (ORDER BY fold) AS pe FROM f)
SELECT fold, test_start, test_end FROM p WHERE test_start > test_end OR test_start < pe""",
)
def fold_window_check(s):
    fold = F.floor(F.col("d") / 300).cast("int")
    f = s.games.groupBy(fold.alias("fold")).agg(F.min("d").alias("a"), F.max("d").alias("test_end"))
    f = f.select("fold", (F.col("a") - F.when(F.col("fold") % 3 == 0, 5).otherwise(0)).alias("test_start"), "test_end")
    return W.overlapping_folds(f)


@query(
    "team_long_view", "U-01",
    f"WITH {TEAM_GAMES} SELECT game_id, team, opp, is_home, pts, opp_pts, margin, handicap FROM tg",
)
def team_long_view(s):
    return s.team_games.select("game_id", "team", "opp", "is_home", "pts", "opp_pts", "margin", "handicap")
