"""Entity aggregates, ratings, regression and simple statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions.numeric import clip, ratio
from lagwise.operators.joins import opponent_rows, share_of_group
from lagwise.operators.ranking import top_n
from lagwise.operators.timeline import Timeline, positions


def totals(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def mean_of_copies(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def mixed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], first: dict[str, str] | None = None, largest: dict[str, str] | None = None,
    total: dict[str, str] | None = None, any_of: dict[str, Column] | None = None,
) -> DataFrame:
    """First value in ``order`` (a null is a value), maximum, sum and "any" side by side, from one map-side aggregate; result names are the keys."""
    parts = [F.min_by(c, F.struct(*order)).alias(n) for n, c in (first or {}).items()]
    parts += [F.max(c).alias(n) for n, c in (largest or {}).items()] + [F.sum(c).alias(n) for n, c in (total or {}).items()]
    return df.groupBy(*keys).agg(*parts, *[F.bool_or(c).alias(n) for n, c in (any_of or {}).items()])


def usage(df: DataFrame) -> Column:
    return F.col("fga") + 0.44 * F.col("fta") + F.col("turnovers")


def concentration(df: DataFrame, keys: Sequence[str], used: Column, sizes: Sequence[int] = (2, 3), tie: Sequence[str] = ()) -> DataFrame:
    """Share of the group total held by its N largest members; null when the total is 0."""
    rows = share_of_group(df.withColumn("__u", used), keys, "__u", "__share")
    largest = top_n(rows, keys, [F.col("__share").desc_nulls_last(), *tie], max(sizes), rank="__rn")
    return largest.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("__rn") <= n, F.col("__share"))), F.lit(0.0)).alias(f"usg_top{n}_share") for n in sizes]
    )


def top_mean(df: DataFrame, keys: Sequence[str], rank_by: str, tie: str, value: str, n: int, name: str) -> DataFrame:
    """Mean of ``value`` over the n members with the largest ``rank_by``."""
    best = top_n(df, keys, [F.col(rank_by).desc_nulls_last(), F.col(tie).asc()], n)
    return best.groupBy(*keys).agg(F.avg(value).alias(name))


def outside_top_sum(df: DataFrame, keys: Sequence[str], rank_by: str, tie: str, value: str, n: int, played: Column, name: str) -> DataFrame:
    """Sum over the played members ranked below n: the played total minus the top-n part.

    Neither part needs a full ranking of a group.
    """
    whole = df.groupBy(*keys).agg(F.sum(F.when(played, F.col(value))).alias("__all"))
    best = top_n(df, keys, [F.col(rank_by).desc_nulls_last(), F.col(tie).asc()], n)
    part = best.groupBy(*keys).agg(F.sum(F.when(played, F.col(value))).alias("__top"))
    both = whole.join(part, list(keys), "left")
    return both.select(*keys, (F.coalesce("__all", F.lit(0)) - F.coalesce("__top", F.lit(0))).alias(name))


def possessions(suffix: str = "") -> Column:
    return F.col(f"fga{suffix}") + 0.44 * F.col(f"fta{suffix}") - F.col(f"oreb{suffix}") + F.col(f"turnovers{suffix}")


TEAM_COLUMNS = ("points", "rebounds", "oreb", "turnovers", "fga", "fta", "ftm", "three_pm", "three_pa", "minutes_played")


def team_ratings(players: DataFrame, game: str = "game_id", team: str = "team") -> DataFrame:
    """Team totals, the opponent's totals, possessions, pace, ratings and rates; two rows per game."""
    team_rows = totals(players, [game, team], TEAM_COLUMNS)
    j = opponent_rows(team_rows, game, team, TEAM_COLUMNS)
    poss = 0.5 * (possessions() + possessions("_opp"))
    zero = F.lit(0.0)
    j = j.withColumn("possessions", poss)
    j = j.withColumns({
        "pace": F.coalesce(48 * ratio(F.col("possessions"), F.col("minutes_played") / 5), zero),
        "off_rating": F.coalesce(ratio(F.col("points"), F.col("possessions")) * 100, zero),
        "def_rating": F.coalesce(ratio(F.col("points_opp"), F.col("possessions")) * 100, zero),
        "three_pa_rate": F.coalesce(F.col("three_pa") / (F.col("fga") + 1e-6), zero),
        "paint_points": clip(F.col("points") - 3 * F.col("three_pm") - F.col("ftm"), low=0.0),
        "rebound_rate": F.coalesce(F.col("rebounds") / (F.col("rebounds") + F.col("rebounds_opp") + 1e-6), zero),
        **{f"net_{c}": F.col(c) - F.col(f"{c}_opp") for c in TEAM_COLUMNS},
    })
    return j.withColumn("net_rating", F.col("off_rating") - F.col("def_rating"))


def best_rows(df: DataFrame, keys: Sequence[str], metric: str, columns: Sequence[str], prefix: str = "best_", tie: str | None = None) -> DataFrame:
    """Columns of the row with the largest metric, ties by the smallest ``tie`` value."""
    if tie is None:
        pick = F.max_by(F.struct(*columns, metric), F.col(metric))
    else:
        pick = F.min_by(F.struct(*columns, metric), F.struct((-F.col(metric)).alias("m"), F.col(tie).alias("t")))
    grouped = df.groupBy(*keys).agg(pick.alias("__b")) if keys else df.agg(pick.alias("__b"))
    return grouped.select(*keys, *[F.col(f"__b.{c}").alias(f"{prefix}{c}") for c in [*columns, metric]])


def mean_and_error(df: DataFrame, value: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, standard error and count; fewer than two rows give 0, 0, n."""
    n = F.count(value)
    aggs = [
        F.when(n >= 2, F.avg(value)).otherwise(F.lit(0.0)).alias("mean"),
        F.when(n >= 2, F.stddev_samp(value) / F.sqrt(n)).otherwise(F.lit(0.0)).alias("se"),
        n.alias("n"),
    ]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def log_loss(y: Column, p: Column, low: float = 0.01, high: float = 0.99) -> Column:
    q = clip(p, low, high)
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def ols(df: DataFrame, y: Column, xs: dict[str, Column], cluster: str | None = None) -> DataFrame:
    """Least squares with intercept; HC1 or cluster-robust errors.

    Two aggregations over the rows; only the k x k normal equations reach the driver.
    """
    names = ["intercept", *xs]
    rows = df.select(
        y.cast("double").alias("__y"), F.lit(1.0).alias("__x0"),
        *[x.cast("double").alias(f"__x{i}") for i, x in enumerate(xs.values(), 1)],
        *([F.col(cluster).alias("__g")] if cluster else []),
    ).dropna(subset=["__y", *[f"__x{i}" for i in range(1, len(names))]])
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"a{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"__x{i}") * F.col("__y")).alias(f"b{i}") for i in range(k)],
    ).first()
    n = first["n"]
    if n <= k:
        raise ValueError(f"{n} complete rows are too few for {k} coefficients")

    def symmetric(row, stem: str) -> np.ndarray:
        m = np.zeros((k, k))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"{stem}{i}_{j}"]
        return m

    inverse = np.linalg.inv(symmetric(first, "a"))
    beta = inverse @ np.array([first[f"b{i}"] for i in range(k)])
    fitted = F.lit(0.0)
    for i in range(k):
        fitted = fitted + F.col(f"__x{i}") * F.lit(float(beta[i]))
    scores = rows.select(*(["__g"] if cluster else []), *[(F.col(f"__x{i}") * (F.col("__y") - fitted)).alias(f"__s{i}") for i in range(k)])
    if cluster:
        scores = scores.groupBy("__g").agg(*[F.sum(f"__s{i}").alias(f"__s{i}") for i in range(k)])
    second = scores.agg(*[F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    meat = symmetric(second, "m") * (1.0 if cluster else n / (n - k))
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    out = [
        (name, float(b), float(e), math.erfc(abs(b / e) / math.sqrt(2)) if e > 0 else None, int(n))
        for name, b, e in zip(names, beta, se)
    ]
    return df.sparkSession.createDataFrame(out, "term string, coef double, se double, p double, n bigint")


def permuted(df: DataFrame, column: str, id_column: str, seed: int, name: str) -> DataFrame:
    """The column in a seeded random order, other columns unchanged.

    The two orders are numbered independently and joined by number. Numbering is
    done in hash buckets, so it needs no global sort.
    """
    keyed = df.withColumn("__h1", F.xxhash64(F.lit(seed), F.col(id_column))).withColumn("__h2", F.xxhash64(F.lit(seed + 1), F.col(id_column)))
    a = positions(keyed, Timeline((), ("__h1", id_column), F.shiftright("__h1", 48)), "__p")
    b = positions(keyed.select("__h2", id_column, F.col(column).alias(name)), Timeline((), ("__h2", id_column), F.shiftright("__h2", 48)), "__p")
    return a.join(b.select("__p", name), "__p").drop("__p", "__h1", "__h2")


def pivot_last(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], values: Sequence[str], order: Column) -> DataFrame:
    """Last value of each column per (key, kind) as ``<column>_<kind>``."""
    return df.groupBy(*keys).agg(
        *[F.max_by(F.col(v), F.when((F.col(kind) == k) & F.col(v).isNotNull(), order)).alias(f"{v}_{k}") for v in values for k in kinds]
    )


def usage_by_month(log: DataFrame) -> DataFrame:
    """Objects per provider and UTC month, and the newest quota counter of the provider."""
    month = F.substring("attempted_at_utc", 1, 7)
    used = log.groupBy("provider", month.alias("month")).agg(
        F.sum(F.coalesce(F.col("objects").try_cast("double"), F.lit(0.0))).cast("bigint").alias("objects")
    )
    known = F.when(F.length("quota_used") > 0, F.col("attempted_at_utc"))
    latest = log.groupBy("provider").agg(F.max_by(F.col("quota_used").try_cast("double"), known).cast("bigint").alias("quota_used"))
    return used.join(latest, "provider")


def collisions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and surplus copies of a key set."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.sum("c").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"), F.sum(F.col("c") - 1).alias("duplicate_collisions")
    )
