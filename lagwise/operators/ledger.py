"""Stake selection, exposure limits, settlement and drawdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.ranking import group_rank, top_n
from lagwise.operators.timeline import Timeline, cum_max, cum_min, cum_product, cum_sum, running


#: Bets a day up to which plain windows over a day are used.
SHORT_DAY = 1000


def select_daily(bets: DataFrame, keys: Sequence[str], day: str, score: Column, tie: Sequence[str], n: int, rank: str = "rank") -> DataFrame:
    """The n best bets of each day by score (ties by ``tie``), for any n.

    Up to ``SHORT_DAY`` Spark drops the rest before the shuffle; beyond, the ranking that splits large groups gives the
    same ranks.
    """
    if n > SHORT_DAY:
        return group_rank(bets, [*keys, day], score, tie, rank).where(F.col(rank) <= n)
    return top_n(bets, [*keys, day], [score.desc_nulls_last(), *tie], n, rank)


def cap_exposure(bets: DataFrame, keys: Sequence[str], day: str, stake: str, cap: Column | float, name: str = "stake", bounded: bool = False) -> DataFrame:
    """Scale the day's stakes so that they do not exceed the cap together.

    ``bounded``: a day holds only a fixed number of bets, so their sum is a plain
    window, which keeps the partitioning that a top-n selection left.
    """
    group = [*keys, day]
    limit = cap if isinstance(cap, Column) else F.lit(float(cap))
    scale = F.when(F.col("__total") > limit, limit / F.col("__total")).otherwise(F.lit(1.0))
    if bounded:
        summed = bets.withColumn("__total", F.sum(stake).over(Window.partitionBy(*group)))
    else:
        summed = bets.join(bets.groupBy(*group).agg(F.sum(stake).alias("__total")), group)
    return summed.withColumn(name, F.col(stake) * scale).drop("__total")


def stop_loss(bets: DataFrame, line: Timeline, pnl: str, limit: Column, name: str = "pnl_kept", bounded: bool = False) -> DataFrame:
    """Zero the P&L of bets placed once the day's running P&L has reached the limit.

    The running P&L is frozen by the first breach, so "any earlier running sum at
    or below the limit" is the same condition and needs no loop. ``bounded``: a
    day holds only a fixed number of bets (after a top-n selection).
    """
    before = running(bets, line, {"__sum": cum_sum(F.col(pnl))}, bounded=bounded)
    before = before.withColumn("__sum", F.coalesce("__sum", F.lit(0.0)))
    lowest = running(before, line, {"__low": cum_min(F.col("__sum"))}, inclusive=True, bounded=bounded)
    stopped = F.coalesce(F.col("__low") <= limit, F.lit(False))
    return lowest.withColumn(name, F.when(stopped, F.lit(0.0)).otherwise(F.col(pnl))).drop("__sum", "__low")


def settle_days(bets: DataFrame, keys: Sequence[str], day: str, pnl: str) -> DataFrame:
    """One settlement per day: all stakes of a day use the opening bankroll.

    Returns (keys, day, bets, day_pnl, bankroll_open, bankroll). Bets are reduced
    to days before anything is ordered.
    """
    days = bets.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("bets"), F.sum(pnl).alias("day_pnl"))
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("bankroll", F.product(1 + F.col("day_pnl")).over(w))
    previous = F.lag("bankroll", 1, 1.0).over(Window.partitionBy(*keys).orderBy(day))
    return days.withColumn("bankroll_open", previous)


def attach_bankroll(bets: DataFrame, keys: Sequence[str], day: str, pnl: str) -> DataFrame:
    days = settle_days(bets, keys, day, pnl).select(*keys, day, "bankroll_open", "bankroll")
    return bets.join(days, [*keys, day])


def compounded(bets: DataFrame, line: Timeline, pnl: str, start: float = 1.0, floor: float | None = None, initial_peak: float | None = None, bounded: bool = False) -> DataFrame:
    """Row-by-row compounded bankroll, running peak and drawdown (never above 0).

    ``floor`` bounds a single growth factor from below; ``initial_peak`` is a peak
    that holds before the first row. ``bounded``: the bets of a ledger are limited
    per day, so one ledger is small.
    """
    growth = 1 + F.coalesce(F.col(pnl), F.lit(0.0))
    if floor is not None:
        growth = F.greatest(growth, F.lit(floor))
    money = running(bets, line, {"bankroll": cum_product(growth)}, inclusive=True, bounded=bounded)
    money = money.withColumn("bankroll", F.col("bankroll") * start)
    out = running(money, line, {"peak": cum_max(F.col("bankroll"))}, inclusive=True, bounded=bounded)
    if initial_peak is not None:
        out = out.withColumn("peak", F.greatest("peak", F.lit(initial_peak)))
    peak = F.nullif(F.col("peak"), F.lit(0.0))
    return out.withColumn("drawdown", (F.col("bankroll") - peak) / peak)


def growth_objective(ledger: DataFrame, keys: Sequence[str], pnl: str, weight: float, floor: float = 1e-12) -> DataFrame:
    """mean log growth minus weight x |maximum drawdown|, from a compounded ledger."""
    growth = F.greatest(1 + F.col(pnl), F.lit(floor))
    out = ledger.groupBy(*keys).agg(F.avg(F.log(growth)).alias("mean_log_growth"), F.min("drawdown").alias("max_drawdown"))
    return out.withColumn("objective", F.col("mean_log_growth") - weight * F.abs("max_drawdown"))


def ledger_summary(bets: DataFrame, keys: Sequence[str], basis: Column) -> DataFrame:
    """ROI and drawdown of recorded ledgers in common bankroll units.

    ``basis`` says what a stake fraction refers to: ``open`` (the recorded opening
    bankroll), ``current`` (the bankroll before the row) or ``start`` (1.0).
    Needs game_date, game_id, kelly_fraction, pnl, bankroll, bankroll_open, win.
    """
    opening = (
        F.when(basis == "open", F.col("bankroll_open"))
        .when(basis == "current", F.col("bankroll") / (1.0 + F.col("pnl")))
        .otherwise(F.lit(1.0))
    )
    peaks = running(bets, Timeline(keys, ("game_date", "game_id")), {"__peak": cum_max(F.col("bankroll"))}, inclusive=True)
    peak = F.greatest(F.col("__peak"), F.lit(1.0))
    staked, won = F.sum(F.col("kelly_fraction") * opening), F.sum(F.col("pnl") * opening)
    return peaks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bets"),
        F.avg("win").alias("win_rate"),
        F.coalesce(won / F.nullif(staked, F.lit(0.0)), F.lit(0.0)).alias("roi"),
        F.max((peak - F.col("bankroll")) / peak).alias("max_drawdown"),
    )


def daily_volatility(daily: DataFrame, keys: Sequence[str], day: str, value: str, window: int = 28, min_rows: int = 10, low: float = 1 / 3, high: float = 2 / 3, min_valid: int = 30) -> DataFrame:
    """Rolling standard deviation of daily values and its regime label.

    Works on day rows: a key has at most one per calendar day.
    """
    whole = Window.partitionBy(*keys)
    frame = whole.orderBy(day).rowsBetween(-(window - 1), 0)
    vol = daily.withColumn("vol", F.when(F.count(value).over(frame) >= min_rows, F.stddev_samp(value).over(frame)))
    cuts = F.percentile("vol", F.array(F.lit(low), F.lit(high))).over(whole)
    out = vol.withColumn("__cut", cuts).withColumn("__n", F.count("vol").over(whole))
    label = (
        F.when((F.col("__n") < min_valid) | F.col("vol").isNull(), "unknown_vol")
        .when(F.col("vol") <= F.col("__cut")[0], "low_vol")
        .when(F.col("vol") <= F.col("__cut")[1], "mid_vol")
        .otherwise("high_vol")
    )
    return out.withColumn("vol_bucket", label).drop("__cut", "__n")


def regime_plan(daily: DataFrame, profiles: dict[str, str], default: str, bucket: str = "vol_bucket") -> DataFrame:
    """The ``profile`` to bet with in each day's regime; regimes without one of their own take the default."""
    table = F.create_map(*[F.lit(x) for pair in profiles.items() for x in pair]) if profiles else None
    own = F.try_element_at(table, F.col(bucket)) if profiles else F.lit(None)
    return daily.withColumn("profile", F.coalesce(own, F.lit(default)))


def regime_plan_summary(plan: DataFrame, keys: Sequence[str], bucket: str = "vol_bucket") -> DataFrame:
    """Days, bets and mean daily figures per regime and profile; needs daily_bets, daily_win_rate, daily_pnl."""
    return plan.groupBy(*keys, bucket, "profile").agg(
        F.count(F.lit(1)).alias("days"), F.sum("daily_bets").alias("total_bets"), F.avg("daily_bets").alias("avg_daily_bets"),
        F.avg("daily_win_rate").alias("avg_daily_win_rate"), F.avg("daily_pnl").alias("avg_daily_pnl"),
    )


def exposure_and_pnl(bets: DataFrame, keys: Sequence[str | Column], stake: str = "stake", pnl: str = "profit") -> DataFrame:
    """Bets, staked fraction and P&L of any slice: per day for the exposure, per price tier for the P&L."""
    return bets.groupBy(*keys).agg(F.count(F.lit(1)).alias("bets"), F.sum(stake).alias("exposure"), F.sum(pnl).alias("pnl"))


def fold_risk(bets: DataFrame, keys: Sequence[str], fold: str = "fold", stake: str = "stake", pnl: str = "profit") -> DataFrame:
    """Mean and spread of fold ROI, their ratio, and the deepest fall of the equity from its peak, at fold ends.

    The equity starts at 1 and compounds the folds' P&L. The ratio is 0 where all folds have the same ROI and null with
    fewer than two folds. The windows run over one row per fold.
    """
    folds = bets.groupBy(*keys, fold).agg(F.sum(pnl).alias("__pnl"), (F.sum(pnl) / F.nullif(F.sum(stake), F.lit(0.0))).alias("__roi"))
    upto = Window.partitionBy(*keys).orderBy(fold).rowsBetween(Window.unboundedPreceding, 0)
    curve = folds.withColumn("__equity", F.product(1 + F.col("__pnl")).over(upto))
    curve = curve.withColumn("__peak", F.greatest(F.lit(1.0), F.max("__equity").over(upto)))
    mean, spread = F.avg("__roi"), F.stddev_samp("__roi")
    return curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), mean.alias("mean_roi"), spread.alias("volatility"),
        F.when(spread == 0, 0.0).otherwise(mean / spread).alias("sharpe"), F.min(F.col("__equity") / F.col("__peak") - 1).alias("max_drawdown"),
    )
