"""Walk-forward folds on whole dates, fixed-row folds, causal weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.timeline import RANGE, Timeline, cum_count, in_ranges, running


def fold_calendar(df: DataFrame, day: str, train_rows: int, test_rows: int) -> DataFrame:
    """Whole-date walk-forward folds as row targets; one row per fold.

    A test block starts at the first date boundary with at least ``train_rows``
    rows before it and ends at the first boundary at least ``test_rows`` later; the
    last, partial block is kept. Training is the last ``train_rows`` rows extended
    to a date boundary. Rows are reduced to one count per date first; only that
    list (a calendar) is folded into one array.
    """
    if train_rows <= 0 or test_rows <= 0:
        raise ValueError("train_rows and test_rows must be positive")
    if df.where(F.col(day).isNull()).limit(1).count():
        raise ValueError("walk-forward rows need valid dates")
    days = df.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)  # one row per calendar day
    days = days.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    days = days.withColumn("t", F.col("before") + F.col("n"))
    total = F.col("total")
    one = days.agg(
        F.array_sort(F.collect_list("before")).alias("starts"), F.max("t").alias("total"),
    ).withColumn("bounds", F.concat("starts", F.array(total)))
    empty = F.array().cast("array<bigint>")

    def step(cuts: Column, b: Column) -> Column:
        first = (F.size(cuts) == 0) & (b >= train_rows) & (F.col("total") >= train_rows)
        later = (F.size(cuts) > 0) & ((b >= F.element_at(cuts, -1) + test_rows) | ((b == F.col("total")) & (b > F.element_at(cuts, -1))))
        return F.when(first | later, F.array_append(cuts, b)).otherwise(cuts)

    cuts = one.withColumn("cuts", F.aggregate("bounds", empty, step))
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("cuts") - 1, F.lit(1))),
        lambda i: F.struct(i.alias("fold"), F.try_element_at("cuts", i).alias("test_from"), F.try_element_at("cuts", i + 1).alias("test_to")),
    )
    rows = cuts.select("starts", F.explode(pairs).alias("f")).select("starts", "f.*").where("test_to IS NOT NULL")
    train_from = F.array_max(F.filter("starts", lambda b: b <= F.greatest(F.col("test_from") - train_rows, F.lit(0))))
    numbered = rows.select("fold", train_from.alias("train_from"), "test_from", "test_to")
    lookup = days.select("before", "t", F.col(day).alias("__day"))

    def day_at(position: str, name: str, edge: str) -> DataFrame:
        return lookup.select(F.col(edge).alias(position), F.col("__day").alias(name))

    return (
        numbered.join(day_at("train_from", "train_start", "before"), "train_from")
        .join(day_at("test_from", "test_start", "before"), "test_from")
        .join(day_at("test_to", "test_end", "t"), "test_to")
        .select("fold", "train_start", "test_start", "test_end", "train_from", "test_from", "test_to")
    )


def assign_folds(df: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """Test rows with their fold. The calendar is expanded to one row per day, so this is an equi-join."""
    dates = calendar.select("fold", F.explode(F.sequence("test_start", "test_end", F.expr("INTERVAL 1 DAY"))).alias(day))
    return df.join(dates.withColumn(day, F.col(day).cast("date")), day)


def training_rows(df: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """Training rows of every fold (a row belongs to several folds)."""
    last = F.date_sub("test_start", 1)
    dates = calendar.where("train_start < test_start").select(
        "fold", F.explode(F.sequence("train_start", last, F.expr("INTERVAL 1 DAY"))).alias(day)
    )
    return df.join(dates.withColumn(day, F.col(day).cast("date")), day)


def fixed_row_folds(df: DataFrame, order: Sequence[str], train_rows: int, test_rows: int) -> DataFrame:
    """Fold number of each test row by position; the incomplete tail gets none.

    Positions come from counts of sampled ranges, so a day with many rows is no single task.
    """
    placed = running(in_ranges(df, (), order), Timeline((), order, RANGE), {"__p": cum_count()}, overall={"__n": cum_count()})
    number = F.floor((F.col("__p") - train_rows) / test_rows) + 1
    complete = train_rows + number * test_rows <= F.col("__n")
    fold = F.when((F.col("__p") >= train_rows) & complete, number.cast("int"))
    return placed.withColumn("fold", fold).drop("__p", "__n", RANGE)


def season_split(df: DataFrame, season: str, held_out: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    return df.where(~F.col(season).isin(*held_out)), df.where(F.col(season).isin(*held_out))


def causal_weights(fold_rmse: DataFrame, manual: dict[str, float] | None = None) -> DataFrame:
    """Ensemble weights per (fold, model) from earlier folds only: inverse mean RMSE, equal at the first fold.

    ``fold_rmse`` has fold, model, rmse: a table of folds, not of rows.
    """
    if manual:
        table = F.create_map(*[F.lit(v) for pair in manual.items() for v in pair])
        raw = F.try_element_at(table, F.col("model"))
    else:
        earlier = Window.partitionBy("model").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
        raw = F.coalesce(1.0 / F.avg("rmse").over(earlier), F.lit(1.0))
    out = fold_rmse.withColumn("__raw", raw)
    return out.withColumn("weight", F.col("__raw") / F.sum("__raw").over(Window.partitionBy("fold"))).drop("__raw")


def ensemble(predictions: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted prediction and mean sigma per row from (keys, fold, model, pred, sigma)."""
    j = predictions.join(weights.select("fold", "model", "weight"), ["fold", "model"])
    return j.groupBy(*keys, "fold").agg(F.sum(F.col("pred") * F.col("weight")).alias("pred_ensemble"), F.avg("sigma").alias("sigma_ensemble"))
