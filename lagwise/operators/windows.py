"""Lagged, calendar-range and season-to-date features.

"Lagged" means the current row is never inside its own frame. All functions use
:mod:`lagwise.operators.timeline`, so one very long history does not end up in
one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.numeric import haversine_miles
from lagwise.operators.timeline import (
    CHUNK_ROWS,
    Timeline,
    by_day,
    cum_count,
    cum_max,
    cum_min,
    cum_sum,
    framed,
    positions,
    running,
)


def last_mean(w, x: Column, n: int, min_count: int | None = None) -> Column:
    """Mean of the last n rows before this one; null below ``min_count`` values (default: all n)."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) >= (n if min_count is None else min_count), F.avg(x).over(frame))


def last_std(w, x: Column, n: int, min_count: int) -> Column:
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) >= min_count, F.stddev_samp(x).over(frame))


def last_decayed(w, x: Column, n: int, decay: float) -> Column:
    """Weights 1, decay, decay^2, ... from the newest earlier row; null unless all n values exist."""
    weights = [decay**k for k in range(n)]
    total = sum(weights)
    out = None
    for k, weight in enumerate(weights):
        term = F.lag(x, k + 1).over(w) * F.lit(weight)
        out = term if out is None else out + term
    return out / F.lit(total)


def lagged_means(
    df: DataFrame, line: Timeline, values: dict[str, Column], n: int, min_count: int | None = None, chunk_rows: int = CHUNK_ROWS,
    bounded: bool = False,
) -> DataFrame:
    return framed(df, line, lambda w: {k: last_mean(w, x, n, min_count) for k, x in values.items()}, n, chunk_rows, bounded)


def lagged_stds(
    df: DataFrame, line: Timeline, values: dict[str, Column], n: int, min_count: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    return framed(df, line, lambda w: {k: last_std(w, x, n, min_count) for k, x in values.items()}, n, chunk_rows)


def decayed_means(
    df: DataFrame, line: Timeline, values: dict[str, Column], n: int, decay: float, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    return framed(df, line, lambda w: {k: last_decayed(w, x, n, decay) for k, x in values.items()}, n, chunk_rows)


def prior_means(df: DataFrame, line: Timeline, values: dict[str, Column], min_count: int = 1) -> DataFrame:
    """Mean of all earlier rows of the key (season-to-date when the season is a key)."""
    aggs = {}
    for name, x in values.items():
        aggs[f"__s_{name}"] = cum_sum(x.cast("double"))
        aggs[f"__n_{name}"] = cum_count(x)
    out = running(df, line, aggs)
    kept = [c for c in df.columns if c not in values]
    return out.select(
        *kept,
        *[F.when(F.col(f"__n_{n}") >= min_count, F.col(f"__s_{n}") / F.nullif(F.col(f"__n_{n}"), F.lit(0))).alias(n) for n in values],
    )


def prior_zscores(df: DataFrame, line: Timeline, values: dict[str, Column], min_count: int = 5, bounded: bool = False) -> DataFrame:
    """Distance from the mean of the earlier rows in their standard deviations; 0 where undefined."""
    aggs = {}
    for name, x in values.items():
        aggs[f"__s_{name}"] = cum_sum(x.cast("double"))
        aggs[f"__q_{name}"] = cum_sum(x.cast("double") * x)
        aggs[f"__n_{name}"] = cum_count(x)
        aggs[f"__lo_{name}"] = cum_min(x.cast("double"))
        aggs[f"__hi_{name}"] = cum_max(x.cast("double"))

    def score(name: str, x: Column) -> Column:
        n, s, q = F.col(f"__n_{name}"), F.col(f"__s_{name}"), F.col(f"__q_{name}")
        spread = q - s * s / F.nullif(n, F.lit(0))
        # a history of one value has no spread, whatever its sums round to
        real = (n >= F.greatest(F.lit(min_count), F.lit(2))) & (F.col(f"__lo_{name}") < F.col(f"__hi_{name}")) & (spread > 0)
        z = F.when(real, (x - s / F.nullif(n, F.lit(0))) / F.sqrt(spread / F.nullif(n - 1, F.lit(0))))
        return F.coalesce(z, F.lit(0.0))

    out = running(df, line, aggs, bounded=bounded)
    kept = [c for c in df.columns if c not in values]
    return out.select(*kept, *[score(n, x).alias(n) for n, x in values.items()])


def rest_days(df: DataFrame, line: Timeline, date: str, name: str = "rest", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Days since the previous row and whether that is exactly one."""
    out = framed(df, line, lambda w: {name: F.datediff(F.col(date), F.lag(date).over(w))}, 1, chunk_rows)
    return out.withColumn("b2b", F.coalesce(F.col(name) == 1, F.lit(False)).cast("int"))


def streaks(df: DataFrame, line: Timeline, won: Column, bounded: bool = False) -> DataFrame:
    """Win and loss streak before this row. Anything but a win counts as a loss.

    The streak is the distance to the last row of the other kind, so it needs a
    running maximum of positions and no loop.
    """
    win = F.coalesce(won, F.lit(False))
    placed = positions(df, line, "__p", bounded)
    last = running(
        placed,
        line,
        {
            "__last_loss": cum_max(F.when(~win, F.col("__p"))),
            "__last_win": cum_max(F.when(win, F.col("__p"))),
        },
        bounded=bounded,
    )
    wins = F.col("__p") - 1 - F.coalesce(F.col("__last_loss"), F.lit(-1))
    losses = F.col("__p") - 1 - F.coalesce(F.col("__last_win"), F.lit(-1))
    return last.select(
        *df.columns, wins.alias("win_streak"), losses.alias("loss_streak"), (wins - losses).alias("streak_length")
    )


def _dated(df: DataFrame, keys: Sequence[str], day: str, columns: Callable[..., dict[str, Column]]) -> DataFrame:
    """Calendar-window columns on the rows themselves, for ``bounded`` entities; null without a key or day, as in a join."""
    known = F.col(day).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    new = columns(Window.partitionBy(*keys).orderBy(day))
    return df.select("*", *[F.when(known, c).alias(n) for n, c in new.items()])


def recent_counts(df: DataFrame, keys: Sequence[str], day: str, spans: Sequence[int], bounded: bool = False) -> DataFrame:
    """Rows in the previous w days, today excluded."""
    if bounded:
        return _dated(df, keys, day, lambda w: {f"games_last_{s}_days": F.count(F.lit(1)).over(w.rangeBetween(-s, -1)) for s in spans})
    return by_day(
        df, keys, day, {"__n": F.count(F.lit(1))},
        lambda w: {f"games_last_{s}_days": F.coalesce(F.sum("__n").over(w.rangeBetween(-s, -1)), F.lit(0)) for s in spans},
    )


def recent_sums(df: DataFrame, keys: Sequence[str], day: str, value: Column, spans: Sequence[int], stem: str, bounded: bool = False) -> DataFrame:
    """Sum of a measure over the previous w days, today excluded; no rows is 0."""
    if bounded:
        return _dated(df, keys, day, lambda w: {f"{stem}_{s}d": F.coalesce(F.sum(value).over(w.rangeBetween(-s, -1)), F.lit(0.0)) for s in spans})
    return by_day(
        df, keys, day, {"__v": F.sum(value)},
        lambda w: {f"{stem}_{s}d": F.coalesce(F.sum("__v").over(w.rangeBetween(-s, -1)), F.lit(0.0)) for s in spans},
    )


def inverse_gap_load(df: DataFrame, keys: Sequence[str], day: str, span: int = 7, name: str = "rest_weighted_load", bounded: bool = False) -> DataFrame:
    """Sum of 1 / (days ago) over the rows of the previous ``span`` days (at most ``span`` array entries)."""
    if bounded:
        per_day = lambda w: [F.count(F.lit(1)).over(w.rangeBetween(-k, -k)) / k for k in range(span, 0, -1)]
        return _dated(df, keys, day, lambda w: {name: sum(per_day(w), F.lit(0.0))})

    def load(w) -> dict[str, Column]:
        near = F.collect_list(F.struct(F.col(day).alias("t"), F.col("__n").alias("n"))).over(w.rangeBetween(-span, -1))
        return {name: F.aggregate(near, F.lit(0.0), lambda acc, e: acc + e["n"] / (F.col(day) - e["t"]))}

    return by_day(df, keys, day, {"__n": F.count(F.lit(1))}, load)


def travel_legs(
    df: DataFrame, line: Timeline, lat: str, lon: str, name: str = "travel_dist", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Miles from the previous row's position; the first row travels 0."""

    def leg(w) -> dict[str, Column]:
        miles = haversine_miles(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
        return {name: F.coalesce(miles, F.lit(0.0))}

    return framed(df, line, leg, 1, chunk_rows)


def previous_known(
    df: DataFrame, line: Timeline, value: str, unknown: str, name: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Value of the previous row: 0 when there is none, null when that row is marked unknown."""

    def prev(w) -> dict[str, Column]:
        bad = F.coalesce(F.lag(unknown).over(w), F.lit(False))
        return {name: F.when(~bad, F.coalesce(F.lag(value).over(w), F.lit(0)))}

    return framed(df, line, prev, 1, chunk_rows)


def previous_day_value(df: DataFrame, keys: Sequence[str], day: str, value: Column, name: str) -> DataFrame:
    """Value of the previous *day* that has one (not of the previous row)."""
    return by_day(df, keys, day, {"__v": value}, lambda w: {name: F.lag("__v").over(w)})


def running_peak(df: DataFrame, line: Timeline, value: str, name: str = "peak") -> DataFrame:
    return running(df, line, {name: cum_max(F.col(value))}, inclusive=True)


def overlapping_folds(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Folds whose window is reversed or starts before the previous fold ends; empty when all is well."""
    w = Window.partitionBy(*keys).orderBy("fold")
    previous_end = F.lag("test_end").over(w)
    return folds.withColumn("__pe", previous_end).where(
        (F.col("test_start") > F.col("test_end")) | (F.col("test_start") < F.col("__pe"))
    ).drop("__pe")
