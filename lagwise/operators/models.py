"""Walk-forward models on Spark ML, causal ensemble and forecasts."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.calibration import probit_probability
from lagwise.operators.folds import causal_weights, ensemble, fold_calendar
from lagwise.operators.timeline import RANGE, Timeline, cum_count, cum_sum, in_ranges, positions, running
from lagwise.session import cut_lineage, shared_folder, stored

# Model id -> estimator factory. All learn from a "features" vector and a "label".
REGRESSORS: dict[str, Callable] = {
    "linear": lambda: LinearRegression(standardization=False),
    "elastic": lambda: LinearRegression(elasticNetParam=0.5, regParam=0.1, standardization=False),
    "forest": lambda: RandomForestRegressor(numTrees=60, maxDepth=6, seed=1),
    "boosted": lambda: GBTRegressor(maxIter=40, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, seed=1),
}


#: Rows of a training window for one task of a fit; the many short jobs of a fit cost more than they gain on fewer.
#: Also the most rows of a block of positions, so that a window's blocks can be dealt out evenly.
FIT_ROWS = 50_000
#: The same where that makes more than ``FEW_TASKS``: every task of the hundreds of passes has a fixed cost, whatever its rows.
WIDE_ROWS = 250_000
FEW_TASKS = 2


@dataclass(frozen=True)
class FoldSpec:
    """Positions [train_from, test_from) train, [test_from, test_to) test."""

    fold: int
    train_from: int
    test_from: int
    test_to: int


def fold_specs(calendar: DataFrame) -> list[FoldSpec]:
    rows = calendar.select("fold", "train_from", "test_from", "test_to").orderBy("fold").collect()
    return [FoldSpec(*r) for r in rows]


def usable_features(train: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with at least one value in training, from one aggregate."""
    counts = train.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if counts[c] > 0]


def standardised(train: DataFrame, other: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Scale both frames by the training mean and deviation; a deviation of 0 counts as 1."""
    stats = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    ).first()

    def scaled(df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(float(stats[f"m_{c}"] or 0.0))) / F.lit(float(stats[f"s_{c}"] or 1.0)) for c in columns
        })

    return scaled(train), scaled(other)


def regression_pipeline(estimator, features: Sequence[str]) -> Pipeline:
    """Exact median imputation fitted on the training rows, one vector, one estimator."""
    imputed = [f"{c}__imp" for c in features]
    return Pipeline(stages=[
        Imputer(strategy="median", relativeError=0.0, inputCols=list(features), outputCols=imputed),
        VectorAssembler(inputCols=imputed, outputCol="features"),
        estimator,
    ])


def _placed(rows: DataFrame, day: str, key: str) -> DataFrame:
    """Rows with their position in time and the label, the market's error."""
    order = (day, key)
    placed = positions(in_ranges(rows, (), order), Timeline((), order, RANGE), "__pos").drop(RANGE)
    return placed.withColumn("label", (F.col("home_margin") + F.col("spread_signed")).cast("double"))


def last_window(history: DataFrame, day: str, train_rows: int) -> tuple[int, int]:
    """First position of the newest training window, ``train_rows`` rows extended back to a date boundary, and all rows."""
    days = history.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar day
    ends = days.withColumn("t", F.sum("n").over(ordered)).withColumn("b", F.col("t") - F.col("n"))
    total = ends.agg(F.max("t")).first()[0] or 0
    first = ends.where(F.col("b") <= max(total - train_rows, 0)).agg(F.max("b")).first()[0]
    return first or 0, total


def by_position(placed: DataFrame, block: int) -> DataFrame:
    """``placed`` as a table stored by blocks of positions, so that a fold reads the blocks of its rows only."""
    path = f"{shared_folder(placed.sparkSession)}/positions-{uuid.uuid4().hex}"
    kept = placed.withColumn("__block", F.floor(F.col("__pos") / block).cast("int"))
    kept.repartition("__block").write.partitionBy("__block").parquet(path)
    return placed.sparkSession.read.schema(kept.schema).parquet(path)


def between(table: DataFrame, first: int, end: int, block: int) -> DataFrame:
    blocks = F.col("__block").between(first // block, max(end - 1, first) // block)
    return table.where(blocks & (F.col("__pos") >= first) & (F.col("__pos") < end))


def window_values(
    table: DataFrame, windows: Sequence[tuple[int, str, int, int]], features: Sequence[str], bins: int = 1,
) -> tuple[dict[tuple[int, str], dict[str, float]], dict[tuple[int, str], dict[str, np.ndarray]]]:
    """Per (fold, part) the median of each feature that has a value there, and inner edges of its ``bins`` bins.

    ``windows``: (fold, part, first position, end). Both are exact and elements of the data. Rows are counted by value and
    stretch between ends of windows, so a task holds counts and no sketches; the driver gets at most ``bins`` values per
    window and feature. A feature of at most ``bins`` values has an edge at each but the largest.
    """
    ends = sorted({x for _, _, a, z in windows for x in (a, z)})
    stretch = sum(((F.col("__pos") >= e).cast("int") for e in ends), F.lit(0))
    values = F.array(*[F.struct(F.lit(i).alias("f"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("v")) for i, c in enumerate(features)])
    rows = table.where("label IS NOT NULL").select(stretch.alias("g"), F.explode(values).alias("c")).select("g", "c.f", "c.v").where("v IS NOT NULL")
    marks = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(ends.index(a) + 1).alias("a"), F.lit(ends.index(z)).alias("z")) for w, (_, _, a, z) in enumerate(windows)])
    inside = F.explode(F.filter(marks, lambda w: F.col("g").between(w["a"], w["z"])))
    counted = rows.groupBy("g", "f", "v").agg(F.count(F.lit(1)).alias("n")).select(inside.alias("m"), "f", "v", "n")
    counted = counted.groupBy(F.col("m.w").alias("w"), "f", "v").agg(F.sum("n").alias("n"))
    line = Timeline(("w", "f"), ("v",), RANGE)
    ranked = running(in_ranges(counted, line.keys, line.order), line, {"b": cum_sum(F.col("n"))}, overall={"t": cum_sum(F.col("n")), "d": cum_count()})
    ranked = ranked.withColumn("b", F.coalesce("b", F.lit(0)))
    middle = F.expr("b < (t + 1) div 2 AND (t + 1) div 2 <= b + n").alias("middle")
    edge = F.expr(f"{bins} > 1 AND (d <= {bins} OR least((b + n) * {bins} div t, {bins - 1}) > b * {bins} div t)").alias("edge")
    medians: dict = {}
    found: dict = {}
    few = {}
    for r in ranked.select("w", "f", "v", "d", middle, edge).where("middle OR edge").collect():
        at, name = windows[r["w"]][:2], features[r["f"]]
        few[at, name] = r["d"] <= bins
        if r["middle"]:
            medians.setdefault(at, {})[name] = r["v"]
        if r["edge"]:
            found.setdefault((at, name), []).append(r["v"])
    medians = {at: {c: m[c] for c in features if c in m} for at, m in medians.items()}
    edges = {at: {c: np.array(sorted(found.get((at, c), []))[: -1 if few[at, c] else None]) for c in m} for at, m in medians.items()}
    return medians, edges


def window_medians(table: DataFrame, windows: Sequence[tuple[int, str, int, int]], features: Sequence[str]) -> dict[tuple[int, str], dict[str, float]]:
    return window_values(table, windows, features)[0]


def imputed_vector(df: DataFrame, medians: dict[str, float], name: str) -> DataFrame:
    """``df`` with a vector of the features in ``medians``; a missing value takes the median."""
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)).alias(f"__i_{i}") for i, (c, m) in enumerate(medians.items())]
    wide = df.select("*", *filled)
    names = [f"__i_{i}" for i in range(len(filled))]
    return VectorAssembler(inputCols=names, outputCol=name).transform(wide).drop(*names)


def fit_tasks(rows: int) -> int:
    """Tasks of each pass of a fit over ``rows`` rows. The fits of all folds run side by side, so few tasks each keep all cores busy."""
    return min(1 + rows // FIT_ROWS, max(FEW_TASKS, 1 + rows // WIDE_ROWS))


def position_block(test_rows: int) -> int:
    """Rows of a stored block: a quarter of a test block, at most the rows of one task."""
    return max(1, min(test_rows // 4, FIT_ROWS))


def fit_fold(table: DataFrame, spec: FoldSpec, medians: dict, block: int, models: Sequence[str], key: str, pool: ThreadPoolExecutor) -> list[DataFrame]:
    """Predictions of all models on one fold, with the out-of-sample sigma of the last fifth of training.

    The models share one imputed vector; their fits are submitted together. They learn the market's error (label), so a prediction of the margin is the
    predicted error minus the line.
    """
    cut = early_end(spec)
    train = imputed_vector(between(table, spec.train_from, spec.test_from, block).where("label IS NOT NULL"), medians[spec.fold, "all"], "features")
    train = imputed_vector(train, medians[spec.fold, "early"], "__early").select("__pos", "label", "features", "__early")
    train = train.coalesce(fit_tasks(spec.test_from - spec.train_from)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train.count()  # the fits start together; without it executors work out the same partitions several times
        test = imputed_vector(between(table, spec.test_from, spec.test_to, block), medians[spec.fold, "all"], "features")
        early = train.where(F.col("__pos") < cut).select("label", F.col("__early").alias("features"))
        late = train.where(F.col("__pos") >= cut).select("label", F.col("__early").alias("features"))
        residual = F.stddev_pop(F.col("label") - F.col("prediction")).alias("s")
        checks = [pool.submit(lambda m=m: REGRESSORS[m]().fit(early).transform(late).agg(residual).first()["s"]) for m in models]
        fits = [pool.submit(lambda m=m: REGRESSORS[m]().fit(train.select("label", "features"))) for m in models]
        parts = [
            fit.result().transform(test).select(
                key, F.lit(spec.fold).alias("fold"), F.lit(m).alias("model"), (F.col("prediction") - F.col("spread_signed")).alias("pred"),
                F.lit(float(check.result() or 1.0)).alias("sigma"), "home_margin",
            )
            for m, fit, check in zip(models, fits, checks)
        ]
        return parts
    finally:
        train.unpersist()


def early_end(spec: FoldSpec) -> int:
    return spec.train_from + int((spec.test_from - spec.train_from) * 0.8)


def _walk_on_cells(
    rows: DataFrame, day: str, key: str, features: Sequence[str], models: Sequence[str], specs: Sequence[FoldSpec], windows: Sequence[tuple[int, str, int, int]],
) -> DataFrame | None:
    """The walk on long windows, by ``cells``; None where rows are few, a model has no such fit or the grid would be large."""
    from lagwise.operators import cells  # it imports the sweep, which imports this module

    estimators = {m: REGRESSORS[m]() for m in models}
    if max(z - a for _, _, a, z in windows) <= cells.CELL_ROWS or not all(cells.kind(e) for e in estimators.values()):
        return None
    narrow = rows.select(*dict.fromkeys([day, key, "home_margin", "spread_signed", *features]))
    label = F.nanvl((F.col("home_margin") + F.col("spread_signed")).cast("double"), F.lit(None))
    table = stored(cells.placed_by_day(narrow, day, key, [early_end(s) for s in specs]).withColumn("label", label))
    medians, edges = window_values(table, windows, features, cells.BINS)
    if any(w[:2] not in medians for w in windows) or max(map(cells.grid_size, edges.values())) > cells.MOST_CELLS:
        return None
    return cells.cell_walk(table, specs, [early_end(s) for s in specs], medians, edges, estimators, key)


def walk_forward(
    rows: DataFrame, day: str, key: str, features: Sequence[str], models: Sequence[str], train_rows: int, test_rows: int, workers: int = 4,
    slate: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-sample predictions per (fold, model, row) and the fold calendar.

    ``rows`` needs home_margin and spread_signed. A ``slate`` of coming rows, all later than ``rows``, is one more fold,
    trained on the newest window, so that weights and calibrations of earlier folds reach it like any other. Rows are
    stored by position once; counts and medians of all windows come from one pass. Folds are independent: their jobs
    are submitted from a few driver threads so that the cluster overlaps them. Windows of more than ``cells.CELL_ROWS``
    rows are fitted from sums per cell instead, for all folds together. Predictions are materialised.
    """
    calendar = fold_calendar(rows, day, train_rows, test_rows)
    specs = fold_specs(calendar)
    if not specs:
        raise ValueError("not enough rows for one fold")
    if slate is not None:
        first, total = last_window(rows, day, train_rows)
        if slate.agg(F.min(day)).first()[0] <= rows.agg(F.max(day)).first()[0]:
            raise ValueError("the slate must be later than the history")
        specs.append(FoldSpec(specs[-1].fold + 1, first, total, total + slate.count()))
        unknown = slate.withColumn("home_margin", F.lit(None).cast(dict(rows.dtypes)["home_margin"]))
        rows = rows.unionByName(unknown.select(rows.columns))
    windows = [w for s in specs for w in ((s.fold, "all", s.train_from, s.test_from), (s.fold, "early", s.train_from, early_end(s)))]
    whole = _walk_on_cells(rows, day, key, features, models, specs, windows)
    if whole is not None:
        return whole, calendar
    block = position_block(test_rows)
    table = by_position(_placed(rows, day, key), block)
    medians = window_medians(table, windows, features)
    with ThreadPoolExecutor(max_workers=workers) as pool, ThreadPoolExecutor(max_workers=2 * workers * len(models)) as fits:
        parts = [p for ps in pool.map(lambda s: fit_fold(table, s, medians, block, models, key, fits), specs) for p in ps]
    return cut_lineage(reduce(DataFrame.unionByName, parts)), calendar


def forecast_slate(
    history: DataFrame, slate: DataFrame, day: str, key: str, features: Sequence[str], models: Sequence[str], train_rows: int, test_rows: int,
) -> DataFrame:
    """``day, home, away, key, pred_margin, p_home_win, sigma, data_through, model_version`` for a coming slate, from one walk.

    The slate is the last fold: its weights come from all folds before it, ``sigma`` is the deviation of their
    out-of-sample ensemble errors, and ``p_home_win`` a probit of the margin whose scale fits their results (null with
    too few rows). ``model_version`` names features, models and window sizes.
    """
    predictions, _ = walk_forward(history, day, key, features, models, train_rows, test_rows, slate=slate)
    margins = predictions.where(F.col("model") == models[0]).select(key, "home_margin").distinct()  # every model has all rows
    both = cut_lineage(ensembled(predictions, key).join(margins, key))
    last = both.agg(F.max("fold")).first()[0]
    error = both.agg(F.stddev_samp(F.col("home_margin") - F.col("pred_ensemble")).alias("s")).first()["s"]
    judged = probit_probability(both.withColumn("__won", F.when(F.col("home_margin").isNotNull(), (F.col("home_margin") > 0).cast("int"))), "pred_ensemble", "__won")
    version = hashlib.sha256(repr((sorted(features), sorted(models), train_rows, test_rows)).encode()).hexdigest()[:12]
    through = history.agg(F.max(day)).first()[0]
    return slate.select(day, "home", "away", key).join(judged.where(F.col("fold") == last), key).select(
        day, "home", "away", key, F.col("pred_ensemble").alias("pred_margin"), F.col("p_model").alias("p_home_win"),
        F.lit(error).cast("double").alias("sigma"), F.lit(through).alias("data_through"), F.lit(version).alias("model_version"),
    )


def fold_rmse(predictions: DataFrame) -> DataFrame:
    error = F.col("home_margin") - F.col("pred")
    return predictions.groupBy("fold", "model").agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def ensembled(predictions: DataFrame, key: str, manual: dict[str, float] | None = None) -> DataFrame:
    """Ensemble prediction and sigma per row, weighted by earlier folds only."""
    weights = causal_weights(fold_rmse(predictions), manual)
    return ensemble(predictions, weights, [key])


def final_weights(predictions: DataFrame) -> dict[str, float]:
    """Weights for a block after the last fold: inverse mean RMSE of all folds."""
    mean = fold_rmse(predictions).groupBy("model").agg((1.0 / F.avg("rmse")).alias("w")).collect()
    total = sum(r["w"] for r in mean)
    return {r["model"]: r["w"] / total for r in mean}


def forecast(
    history: DataFrame, slate: DataFrame, day: str, key: str, features: Sequence[str], models: Sequence[str], train_rows: int,
    weights: dict[str, float],
) -> DataFrame:
    """Ensemble margin for a coming slate from the newest training window.

    The window is the last ``train_rows`` rows extended back to a date boundary.
    """
    placed = _placed(history, day, key)
    total = history.count()
    starts = history.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = starts.withColumn("b", before).where(F.col("b") <= max(total - train_rows, 0)).agg(F.max("b").alias("b")).first()["b"]
    train = placed.where((F.col("__pos") >= first) & F.col("label").isNotNull())
    cols = usable_features(train, features)
    out = None
    for m in models:
        fitted = regression_pipeline(REGRESSORS[m](), cols).fit(train)
        part = fitted.transform(slate).select(key, (F.col("prediction") - F.col("spread_signed")).alias("pred"), F.lit(float(weights[m])).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.sum(F.col("pred") * F.col("w")).alias("pred_margin"))


def logistic_by_fold(rows: DataFrame, x: str, won: str, min_rows: int = 250, key: str = "game_id", workers: int = 4) -> DataFrame:
    """P(win) from one feature, for every row of every fold, fitted on the folds before it.

    ``p`` is null, with the ``reason``, where the feature is null (``no feature``), fewer than ``min_rows`` earlier rows
    have both feature and outcome (``few rows``), or these have one outcome only (``one outcome``).
    """
    narrow = rows.select(key, "fold", F.col(x).cast("double").alias("__x"), F.col(won).cast("double").alias("label"))
    known = narrow.where("__x IS NOT NULL AND label IS NOT NULL")
    per_fold = known.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("won"))
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row per fold
    counts = narrow.select("fold").distinct().join(per_fold, "fold", "left").select(
        "fold", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("won").over(before), F.lit(0.0)).alias("won")
    ).where("fold IS NOT NULL").collect()
    reasons = {r.fold: "few rows" if r.n < min_rows else "one outcome" if r.won in (0, r.n) else None for r in counts}
    ready = VectorAssembler(inputCols=["__x"], outputCol="features").transform(known)

    def fit(fold):
        model = LogisticRegression(regParam=0.0).fit(ready.where(F.col("fold") < fold))
        return fold, float(model.intercept), float(model.coefficients[0])

    with ThreadPoolExecutor(max_workers=workers) as pool:
        fitted = list(pool.map(fit, [f for f, reason in reasons.items() if reason is None]))
    kinds = dict(narrow.dtypes)
    lines = rows.sparkSession.createDataFrame(
        [(f, None, None, reason) for f, reason in reasons.items() if reason] + [(*f, None) for f in fitted],
        f"fold {kinds['fold']}, a double, b double, reason string",
    )
    j = narrow.join(lines, "fold", "left")
    p = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("__x"))))
    return j.select(key, "fold", p.alias("p"), F.coalesce("reason", F.when(F.col("__x").isNull(), F.lit("no feature"))).alias("reason"))


def require_fresh(df: DataFrame, date: str, today, max_gap_days: int = 3) -> None:
    """Stop when the newest row is too old, or lies in the future."""
    newest = df.agg(F.max(date).alias("d")).first()["d"]
    gap = None if newest is None else (today - newest).days
    if gap is None or not 0 < gap <= max_gap_days:
        raise ValueError(f"data through {newest}: gap of {gap} days to {today}")
