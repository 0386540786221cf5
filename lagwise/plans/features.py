"""Feature build: games to a leak-free model table.

The order of filters is part of the result. Form windows see all games; games
without a full form history are then dropped, and every later family (streaks,
cover rates, ratings, travel) sees only the survivors.

The families are computed from the same survivors: where no team's history is longer than a chunk, as windows over one
shuffle by team, else apart and joined on (game_id, team). Games, survivors and families are materialised (in ``store``,
else in the shared folder), so no stage is rebuilt by the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.functions.numeric import clip, logistic, signed_square
from lagwise.operators import ratings
from lagwise.operators import windows as W
from lagwise.operators.joins import sides_to_wide
from lagwise.operators.sets import team_view
from lagwise.operators.timeline import Timeline, cum_count, cum_sum, framed, running, short_histories
from lagwise.session import shared_folder
from lagwise.sources.tables import read_or_build


@dataclass(frozen=True)
class FeatureSettings:
    """Fixed values of the feature build."""

    form_rows: int = 5
    recent_days: tuple[int, ...] = (3, 5, 7)
    travel_days: tuple[int, ...] = (1, 3, 7, 10)
    blowout_margin: int = 15
    rating_rows: int = 164
    fatigue: dict = field(default_factory=lambda: {1: 0.5, 3: 0.3, 7: 0.2})
    altitude_feet: int = 1000


LINE = Timeline("team", ("d", "game_id"))
PAIRED_ZERO = ("win_streak", "loss_streak", "games_last_3_days", "games_last_5_days", "games_last_7_days", "rest_weighted_load")
PAIRED_NULL = ("margin_std_last_10", "blowout_pct_last20", "blowout_pct_season", "ats_roll_last20", "pts_last5", "margin_last5")


def long_view(games: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Two rows per game with day number, points, margin and handicap from the team's side, and ``more`` of the game."""
    margin = F.col("score_home") - F.col("score_away")
    return team_view(
        games, ["game_id", "game_date", "season", "d", "pool_id", *more],
        {"team": F.col("home"), "is_home": F.lit(1), "pts": F.col("score_home"), "margin": margin, "handicap": F.col("home_handicap")},
        {"team": F.col("away"), "is_home": F.lit(0), "pts": F.col("score_away"), "margin": -margin, "handicap": -F.col("home_handicap")},
    )


def form(games: DataFrame, cfg: FeatureSettings, bounded: bool = False) -> DataFrame:
    """Games with a full form history on both sides, with form and rest columns."""
    n = cfg.form_rows
    rows = framed(
        long_view(games), LINE,
        lambda w: {
            f"pts_last{n}": W.last_mean(w, F.col("pts"), n), f"margin_last{n}": W.last_mean(w, F.col("margin"), n),
            "rest": F.datediff("game_date", F.lag("game_date").over(w)),
        },
        n, bounded=bounded,
    )
    wide = sides_to_wide(rows, "game_id", F.col("is_home") == 1, [f"pts_last{n}", f"margin_last{n}", "rest"])
    return games.join(wide, "game_id").dropna(subset=[f"{s}_{c}_last{n}" for s in ("home", "away") for c in ("pts", "margin")])


def team_families(survivors: DataFrame, venues: DataFrame, cfg: FeatureSettings, bounded: bool = False) -> DataFrame:
    """Every per-team family but the ratings on the survivors, one row per (game_id, team).

    ``bounded`` families are windows over one shuffle by team; others are computed apart and joined.
    """
    placed = survivors.join(venues.select(F.col("team").alias("home"), "lat", "lon"), "home", "left")
    long = long_view(placed, ["lat", "lon"])
    cover = F.col("margin") + F.col("handicap")
    blowout = (F.abs("margin") >= cfg.blowout_margin).cast("int")
    long = long.withColumns({
        "cover": F.when(cover > 0, 1.0).when(cover < 0, 0.0).when(cover == 0, 0.5),
        "blowout": blowout,
    })
    rows = framed(
        long, LINE,
        lambda w: {
            "margin_std_last_10": W.last_std(w, F.col("margin"), 10, 3),
            "blowout_pct_last20": W.last_mean(w, F.col("blowout"), 20, 5),
            "ats_roll_last20": W.last_mean(w, F.col("cover"), 20, 5),
            "roll_5": clip(W.last_mean(w, F.col("margin"), 5, 3), -20, 20),
            "roll_10": clip(W.last_mean(w, F.col("margin"), 10, 5), -20, 20),
            "travel_dist": F.coalesce(W.haversine_miles(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0)),
        },
        20, bounded=bounded,
    )

    def season(t: DataFrame) -> DataFrame:
        sums = running(t, LINE, {"__s": cum_sum(F.col("blowout")), "__n": cum_count()}, bounded=bounded)
        return sums.withColumn("blowout_pct_season", F.col("__s") / F.nullif(F.col("__n"), F.lit(0))).drop("__s", "__n")

    def recent(t: DataFrame) -> DataFrame:
        counts = W.recent_counts(t, ["team"], "d", cfg.recent_days, bounded)
        return W.inverse_gap_load(counts, ["team"], "d", bounded=bounded)

    def travel(t: DataFrame) -> DataFrame:
        return W.recent_sums(t, ["team"], "d", F.col("travel_dist"), cfg.travel_days, "travel", bounded)

    key = ["game_id", "team"]
    families = [
        (long, season, ["blowout_pct_season"]),
        (long, lambda t: W.streaks(t, LINE, F.col("margin") > 0, bounded), ["win_streak", "loss_streak", "streak_length"]),
        (long, recent, [*[f"games_last_{k}_days" for k in cfg.recent_days], "rest_weighted_load"]),
        (rows, travel, [f"travel_{k}d" for k in cfg.travel_days]),
    ]
    own = [*key, "is_home", "margin_std_last_10", "blowout_pct_last20", "ats_roll_last20", "roll_5", "roll_10"]
    if not bounded:
        out = rows.select(*own)
        for base, family, names in families:
            out = out.join(family(base).select(*key, *names), key, "left")
        return out
    for _, family, _ in families:
        rows = family(rows)
    known = F.col("team").isNotNull()  # a row without a team has no history of one
    return rows.select(*own, *[F.when(known, F.col(c)).alias(c) for _, _, names in families for c in names])


def team_ratings(survivors: DataFrame, cfg: FeatureSettings, bounded: bool = False) -> DataFrame:
    """Rating of each team before each game, and its lagged long-run mean."""
    rated = survivors.select("game_id", "d", "home", "away").join(ratings.pair_ratings(survivors), "game_id", "left")
    long = team_view(
        rated, ["game_id", "d"], {"team": F.col("home"), "is_home": F.lit(1), "elo": F.col("elo_home")}, {"team": F.col("away"), "is_home": F.lit(0), "elo": F.col("elo_away")},
    )
    out = ratings.rating_windows(long.where(F.col("team").isNotNull()), LINE, n=cfg.rating_rows, bounded=bounded)
    return out.select("game_id", "team", "is_home", "elo", "elo_roll")


def build_feature_table(games: DataFrame, venues: DataFrame, cfg: FeatureSettings = FeatureSettings(), store: str | None = None) -> DataFrame:
    """The model table: one row per surviving game, home-minus-away features.

    ``venues`` has team, lat, lon and may have altitude (feet; a team without one plays at sea level): then visitors'
    recent travel counts as a penalty at venues above ``altitude_feet``.
    """
    spark: SparkSession = games.sparkSession
    store = store or f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"

    def kept(name: str, build) -> DataFrame:
        return read_or_build(spark, f"{store}/{name}", build)

    games, venues = kept("games", lambda: games), kept("venues", lambda: venues)
    bounded = short_histories(long_view(games), LINE.keys)
    survivors = kept("form", lambda: form(games, cfg, bounded))
    per_team = kept("team_families", lambda: team_families(survivors, venues, cfg, bounded))
    rated = kept("team_ratings", lambda: team_ratings(survivors, cfg, bounded))
    # scores against a home team's earlier games: on few columns, before the wide join
    legs = {f"__z_{k}d": F.max(f"travel_{k}d").alias(f"__z_{k}d") for k in cfg.travel_days}
    out = survivors.join(per_team.where("is_home = 1").groupBy("game_id").agg(*legs.values()), "game_id")
    if "altitude" in venues.columns:
        high = venues.select(F.col("team").alias("home"), F.col("altitude").cast("double").alias("away_altitude"))
        out = out.join(high, "home", "left").withColumn("away_altitude", F.coalesce("away_altitude", F.lit(0.0)))
    z = {f"travel_{k}d_z": F.col(f"__z_{k}d") for k in cfg.travel_days}
    out = W.prior_zscores(out, Timeline(("home", "season"), ("d", "game_id")), z, bounded=bounded).drop(*legs)
    columns = [c for c in per_team.columns if c not in ("game_id", "team", "is_home")]
    scored = out.columns
    for rows, names, how in ((per_team, columns, "inner"), (rated, ["elo", "elo_roll"], "left")):
        out = out.join(sides_to_wide(rows, "game_id", F.col("is_home") == 1, names), "game_id", how)
    first = ["home", "game_id"] if "altitude" in venues.columns else ["game_id"]
    last = ["away_altitude", *z]
    sides = [f"{side}_{c}" for side in ("home", "away") for c in [*columns, "elo", "elo_roll"]]
    out = out.select(*first, *[c for c in scored if c not in (*first, *last)], *sides, *[c for c in last if c in scored])

    def gap(c: str, zero: bool = False):
        h, a = F.col(f"home_{c}"), F.col(f"away_{c}")
        return F.coalesce(h, F.lit(0)) - F.coalesce(a, F.lit(0)) if zero else h - a

    out = out.withColumns({c: gap(c, True) for c in PAIRED_ZERO} | {f"{c}_diff" if c.endswith("last5") else c: gap(c) for c in PAIRED_NULL})
    out = out.withColumns({
        "elo_diff": gap("elo"),
        "rest_diff": gap("rest"),
        "streak_length_squared": F.pow(gap("streak_length", True), 2),
        "rolling_margin_diff_5": clip(gap("roll_5"), -20, 20),
        "rolling_margin_diff_10": clip(gap("roll_10"), -15, 15),
        "rest_advantage": clip(clip(F.col("home_rest"), 0, 5) - clip(F.col("away_rest"), 0, 5), -3, 3),
        "home_b2b": F.coalesce(F.col("home_rest") == 1, F.lit(False)).cast("int"),
        "away_b2b": F.coalesce(F.col("away_rest") == 1, F.lit(False)).cast("int"),
        **{f"travel_diff_{k}d": gap(f"travel_{k}d") for k in cfg.travel_days},
        "fatigue_diff": -sum((w * gap(f"travel_{k}d") for k, w in cfg.fatigue.items()), F.lit(0.0)),
        "away_travel_rest_penalty": F.col("away_travel_3d") / (F.col("away_rest") + 1),
    })
    out = out.withColumns({
        "abs_elo_diff": F.abs("elo_diff"), "elo_diff_squared": F.pow("elo_diff", F.lit(2)), "sigmoid_elo_diff": logistic(F.col("elo_diff") / 100),
        "rest_advantage_sq": signed_square(F.col("rest_advantage").cast("double")), "rest_diff_elo_diff": F.col("rest_diff") * F.col("elo_diff"),
    })
    if "altitude" in venues.columns:
        out = out.withColumn("altitude_travel_penalty", F.col("away_travel_3d") * (F.col("away_altitude") > cfg.altitude_feet).cast("int"))
    tail = [c for c in ("away_altitude", "altitude_travel_penalty", *z) if c in out.columns]
    return out.select(*[c for c in out.columns if c not in tail], *tail)
