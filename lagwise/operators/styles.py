"""Monthly play-style clusters from earlier games only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.session import cut_lineage

# Style ids and the column whose largest centroid names the style, in order.
STYLE_RULES = ((1, "pace"), (3, "three_pa_rate"), (4, "paint_points"))
OTHER_STYLE = 2
MIN_GAMES, MIN_TEAMS, CLUSTERS = 5, 8, 4


def prior_profiles(df: DataFrame, pool: Sequence[str], team: str, date: str, columns: Sequence[str], min_games: int = MIN_GAMES) -> DataFrame:
    """Mean profile per (pool, season, month, team) from games before the month.

    A team with too few earlier games uses its previous season; with none it has no row.
    Everything is computed from (team, season, month) sums.
    """
    month = F.trunc(date, "month")
    sums = df.groupBy(*pool, "season", month.alias("month"), team).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__s_{c}") for c in columns], *[F.count(c).alias(f"__k_{c}") for c in columns]
    )
    months = sums.select(*pool, "season", "month").distinct()
    teams = sums.select(*pool, "season", team).distinct()
    grid = teams.join(months, [*pool, "season"]).join(sums, [*pool, "season", "month", team], "left")
    earlier = Window.partitionBy(*pool, "season", team).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    current = grid.select(
        *pool, "season", "month", team, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__games"),
        *[(F.sum(f"__s_{c}").over(earlier) / F.nullif(F.sum(f"__k_{c}").over(earlier), F.lit(0))).alias(c) for c in columns],
    )
    season = sums.groupBy(*pool, "season", team).agg(*[(F.sum(f"__s_{c}") / F.nullif(F.sum(f"__k_{c}"), F.lit(0))).alias(f"__p_{c}") for c in columns])
    previous = season.withColumn("season", F.col("season") + 1).withColumn("__has", F.lit(True))
    j = current.join(previous, [*pool, "season", team], "left")
    enough = F.col("__games") >= min_games
    return j.where(enough | F.col("__has")).select(
        *pool, "season", "month", team, *[F.when(enough, F.col(c)).otherwise(F.col(f"__p_{c}")).alias(c) for c in columns]
    )


def _scaled(profiles: DataFrame, keys: Sequence[str], columns: Sequence[str], least: int) -> DataFrame:
    """Profiles as vectors ``x`` in deviations of their group, for groups of at least ``least`` complete profiles."""
    stats = profiles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__d_{c}") for c in columns]
    ).where(F.col("__n") >= least)
    x = F.array(*[(F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__d_{c}") + 1e-6) for c in columns])
    return profiles.join(stats, list(keys)).withColumn("x", x)


def _apart(a: Column, b: Column, width: int) -> Column:
    """Squared distance of two vectors, rounded so that the order of equal distances does not hang on summation."""
    return F.round(sum(((F.get(a, F.lit(i)) - F.get(b, F.lit(i))) * (F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(width)), F.lit(0.0)), 9)


def _starts(points: DataFrame, keys: Sequence[str], team: str, width: int, k: int) -> DataFrame:
    """``keys, centres``: the profile farthest from the mean, then again and again the one farthest from all chosen."""
    middle = F.array(*[F.lit(0.0)] * width)
    far = points.groupBy(*keys).agg(F.max_by("x", F.struct(_apart(F.col("x"), middle, width), team)).alias("x"))
    chosen = far.select(*keys, F.array("x").alias("centres"))
    for _ in range(k - 1):
        near = F.array_min(F.transform("centres", lambda c: _apart(F.col("x"), c, width)))
        far = points.join(chosen, list(keys)).groupBy(*keys).agg(F.max_by("x", F.struct(near, team)).alias("x"), F.first("centres").alias("centres"))
        chosen = cut_lineage(far.select(*keys, F.concat("centres", F.array("x")).alias("centres")))
    return chosen


def _nearest(points: DataFrame, centres: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """``points`` with ``cluster``, the first of the nearest centres of their group."""
    away = F.transform("centres", lambda c: _apart(F.col("x"), c, width))
    return points.join(centres, list(keys)).withColumn("cluster", F.array_position(away, F.array_min(away)).cast("int") - 1)


def _open_values(taken: Column, at: int):
    """Of each centre, by its place: the value in one column, or null if the place is taken."""
    return lambda centre, i: F.when(~F.array_contains(taken, i), F.get(centre, F.lit(at)))


def style_ids(profiles: DataFrame, pool: Sequence[str], team: str, columns: Sequence[str], k: int = CLUSTERS, min_teams: int = MIN_TEAMS) -> DataFrame:
    """``pool, season, month, team, style_id, reason``; a group is the teams of one league in one month.

    All groups are clustered together: a round assigns every profile to the nearest centre of its group and takes the
    mean of each cluster, as one join and one sum with map-side combination, until no profile changes its cluster.
    Groups too small to cluster and incomplete profiles stay, with a null style and the reason.
    """
    keys, width = [*pool, "season", "month"], len(columns)
    known = profiles.dropna(subset=list(columns))
    points = cut_lineage(_scaled(known, keys, columns, max(min_teams, k)).select(*keys, team, "x"))
    centres = _starts(points, keys, team, width, k)
    mark = F.sum(F.xxhash64(*keys, team, "cluster").cast("decimal(38,0)"))
    seen = None
    while True:
        assigned = _nearest(points, centres, keys, width)
        sign = assigned.agg(mark.alias("s")).first().s
        if sign == seen:
            break
        seen = sign
        means = assigned.groupBy(*keys, "cluster").agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(width)]).alias("m"))
        moved = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "m"))).alias("m"))  # k entries
        kept = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("m", i), c))
        centres = cut_lineage(centres.join(moved, keys).select(*keys, kept.alias("centres")))
    # the style of a rule is the cluster, not yet named, with the largest centre in the rule's column
    named = F.array().cast("array<int>")
    ids = F.lit(None).cast("int")
    for style, column in STYLE_RULES:
        value = F.transform("centres", _open_values(named, list(columns).index(column)))
        pick = F.array_position(value, F.array_max(value)).cast("int") - 1
        ids = F.coalesce(ids, F.when(F.col("cluster") == pick, F.lit(style)))
        named = F.concat(named, F.array(pick))
    styled = assigned.select(*keys, team, F.coalesce(ids, F.lit(OTHER_STYLE)).alias("style_id"))
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    reason = F.when(F.col("style_id").isNull(), F.when(whole, F.lit("few teams")).otherwise(F.lit("no profile")))
    return profiles.join(styled, [*keys, team], "left").select(*keys, team, "style_id", reason.alias("reason"))
