"""Probability calibration fitted on earlier folds only."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions.numeric import clip, normal_cdf
from lagwise.operators.ranking import attach, edge_bin, quantile_edges, with_group

NO_BET_MULTIPLIER = 100.0
MIN_ROWS = 250
POINTS = 33


def fold_losses(rows: DataFrame, fold: str, candidates: Sequence[float], floor: float) -> DataFrame:
    """Probit loss of every fold at every candidate c, with its slope and bend in log c: ``fold, i, n, loss, slope, bend``.

    ``rows`` has the fold, x and y (0 or 1). The candidates are exploded next to each row and summed on the map side, so
    only one partial sum per (fold, candidate) is shuffled. Probabilities are clipped at ``floor``; a clipped row is flat.
    """
    grid = F.posexplode(F.array(*[F.lit(float(c)) for c in candidates])).alias("i", "c")
    cells = rows.select(fold, F.when(F.col("y") == 1, F.col("x")).otherwise(-F.col("x")).alias("x"), grid)
    cells = cells.select(fold, "i", (F.col("x") / F.col("c")).alias("t")).withColumn("p", normal_cdf(F.col("t")))
    cells = cells.withColumn("q", clip(F.col("p"), floor, 1 - floor)).withColumn("flat", (F.col("p") <= floor) | (F.col("p") >= 1 - floor))
    t, ratio = F.col("t"), F.col("ratio")
    cells = cells.withColumn("ratio", F.when(F.col("flat"), 0.0).otherwise(F.exp(-t * t / 2) / (math.sqrt(2 * math.pi) * F.col("q"))))
    return cells.groupBy(fold, "i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(-F.log("q")).alias("loss"),
        F.sum(ratio * t).alias("slope"), F.sum(ratio * (ratio + t) * t * t - ratio * t).alias("bend"),
    )


def lowest_point(left: Sequence[float], right: Sequence[float], width: float) -> float:
    """Where in a cell (0 to 1) the quintic through (loss, slope, bend) at both ends has its minimum; its slope rises through 0."""
    a0, a1, a2 = left[0], left[1] * width, left[2] * width**2 / 2
    rise, tilt, turn = right[0] - a0 - a1 - a2, right[1] * width - a1 - 2 * a2, right[2] * width**2 - 2 * a2
    powers = (a1, 2 * a2, 3 * (10 * rise - 4 * tilt + turn / 2), 4 * (7 * tilt - 15 * rise - turn), 5 * (6 * rise - 3 * tilt + turn / 2))
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if sum(a * middle**k for k, a in enumerate(powers)) > 0:
            high = middle
        else:
            low = middle
    return low


def fit_probit_scale(
    rows: DataFrame, fold: str, folds: Sequence[int], low: float, high: float, floor: float, points: int = POINTS, min_rows: int = MIN_ROWS,
) -> dict[int, float | None]:
    """Per fold, the c in [low, high] for which CDF(x / c) fits y best over the earlier folds.

    ``rows`` has the fold, x and y (0 or 1). One pass: all folds share one grid of ``points`` values, however many folds
    there are, and a fold's loss is the running sum of the folds before it. Between grid points the loss is the quintic
    with the same values, slopes and bends, which is within a few 1e-7 of the exact minimum. Folds with fewer than
    ``min_rows`` earlier rows get None. Only a table of folds x grid reaches the driver.
    """
    step = math.log(high / low) / (points - 1)
    grid = [low * math.exp(step * i) for i in range(points)]
    sums: dict[int, list] = {}
    sizes: dict[int, int] = {}
    for r in fold_losses(rows, fold, grid, floor).collect():
        sums.setdefault(r[fold], [None] * points)[r["i"]] = (r["loss"], r["slope"], r["bend"])
        sizes[r[fold]] = r["n"]
    best: dict[int, float | None] = {}
    known, total, seen = sorted(sums), np.zeros((points, 3)), 0
    for f in sorted(folds):
        while known and known[0] < f:
            total, seen = total + np.array(sums[known[0]]), seen + sizes[known.pop(0)]
        if seen < min_rows:
            best[f] = None
            continue
        at = int(total[:, 0].argmin())
        at -= total[at, 1] > 0
        inside = 0 <= at < points - 1
        best[f] = grid[at] * math.exp(step * lowest_point(total[at], total[at + 1], step)) if inside else low if at < 0 else high
    return best


def sigma_multipliers(rows: DataFrame, fold: str = "fold") -> dict[int, float]:
    """Multiplier of sigma per fold, fitted to cover outcomes of earlier folds; pushes do not count.

    Needs pred_ensemble, spread_signed, settle_signed, home_margin, sigma_ensemble.
    """
    usable = rows.select(
        fold, ((F.col("pred_ensemble") + F.col("spread_signed")) / F.col("sigma_ensemble")).alias("x"),
        F.col("home_margin").alias("m"), (-F.col("settle_signed")).alias("line"),
    ).dropna().where("m <> line").withColumn("y", (F.col("m") > F.col("line")).cast("int"))
    folds = [r[0] for r in rows.select(fold).dropna().distinct().collect()]
    found = fit_probit_scale(usable, fold, folds, 1.0, 50.0, 1e-6)
    return {f: (NO_BET_MULTIPLIER if v is None else v) for f, v in found.items()}


def by_fold(values: dict[int, float], fold: str = "fold") -> Column:
    """Fold table (one entry per fold) as a column expression."""
    table = F.create_map(*[F.lit(v) for f, x in sorted(values.items()) for v in (int(f), float(x))])
    return F.try_element_at(table, F.col(fold).cast("int"))


def calibrate_sigma(rows: DataFrame, fold: str = "fold") -> DataFrame:
    mult = sigma_multipliers(rows, fold)
    out = rows.withColumn("sigma_multiplier", by_fold(mult, fold))
    out = out.withColumn("sigma_ensemble", F.col("sigma_ensemble") * F.col("sigma_multiplier"))
    return out.withColumn("bettable", F.col("sigma_multiplier") < NO_BET_MULTIPLIER)


def probit_probability(rows: DataFrame, x: str, won: str, fold: str = "fold") -> DataFrame:
    """P(win) = CDF(x / s) with s in [3, 60] fitted on earlier folds; null where too few rows exist."""
    usable = rows.select(fold, F.col(x).cast("double").alias("x"), F.col(won).cast("int").alias("y")).dropna()
    folds = [r[0] for r in rows.select(fold).dropna().distinct().collect()]
    scale = {f: s for f, s in fit_probit_scale(usable, fold, folds, 3.0, 60.0, 1e-12).items() if s is not None}
    fitted = by_fold(scale, fold) if scale else F.lit(None).cast("double")
    out = rows.withColumn("probit_scale", fitted).withColumn("__z", F.col(x) / F.col("probit_scale"))
    return out.withColumn("p_model", normal_cdf(F.col("__z"))).drop("__z")


def shrunken_bins(df: DataFrame, p: Column, y: Column, keys: Sequence[str] = (), bins: int = 10, alpha: float = 25.0, min_rows: int = 200) -> DataFrame:
    """Binned calibration: the bin's hit rate shrunk to the global rate; identity with too few rows."""
    q = clip(p, 1e-4, 1 - 1e-4)
    rows = df.withColumn("__p", q).withColumn("__y", F.when(q.isNotNull(), y.cast("double")))
    edges = quantile_edges(rows.where("__y IS NOT NULL"), keys, F.col("__p"), bins)
    placed = attach(rows, edges, keys).withColumn("__bin", edge_bin(F.col("__p"), F.col("edges"))).drop("edges")
    known = placed.where("__y IS NOT NULL")
    cells = known.groupBy(*keys, "__bin").agg(F.sum("__y").alias("__s"), F.count(F.lit(1)).alias("__n"))
    cells = with_group(cells, keys, {"__gs": F.sum("__s"), "__gn": F.sum("__n")})
    rate = (F.col("__s") + F.col("__gs") / F.col("__gn") * alpha) / (F.col("__n") + alpha)
    cells = cells.select(*keys, "__bin", F.when(F.col("__gn") >= min_rows, rate).alias("__c"))
    out = placed.join(cells, [*keys, "__bin"], "left")
    calibrated = clip(F.coalesce("__c", "__p"), 1e-4, 1 - 1e-4)
    return out.select(*df.columns, calibrated.alias("p_calibrated"))
