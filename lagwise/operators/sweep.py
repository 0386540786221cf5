"""Model-parameter sweep: every setting of a linear model for every fold from one pass over the rows.

A penalised least-squares fit needs of its training rows only the sums of products of (1, features, label), and so does
its squared error on test rows. The sums of all folds' training and test windows come from one aggregate; a setting is
then a row of a small table, fitted from the same sums as all others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators import models


@dataclass(frozen=True)
class Setting:
    """Penalty ``reg * (mix * |b| + (1 - mix) / 2 * b^2)`` on the coefficients of standardised features."""

    reg: float = 0.0
    mix: float = 0.0


def product_sums(table: DataFrame, windows: Sequence[tuple[int, str, int, int]], medians: dict[int, dict[str, float]]) -> dict[tuple[int, str], np.ndarray]:
    """Per (fold, part) the matrix of sums of products of (1, features, label); missing features take the fold's median.

    ``windows``: (fold, part, first position, end). A task adds up one matrix per window and sends each once; the driver
    gets windows x (features + 2)^2 numbers.
    """
    columns = sorted({c for m in medians.values() for c in m})
    rows = table.where("label IS NOT NULL").select("__pos", F.col("label").cast("double"), *[F.col(c).cast("double") for c in columns])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in batches:
            pos, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = {c: b.column(2 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
            for fold, part, lo, hi in windows:
                at = (pos >= lo) & (pos < hi)
                if at.any():
                    own = [np.where(np.isnan(x[c][at]), m, x[c][at]) for c, m in medians[fold].items()]
                    z = np.column_stack([np.ones(int(at.sum())), *own, y[at]])
                    sums[fold, part] = sums.get((fold, part), 0.0) + z.T @ z
        for (fold, part), s in sums.items():
            flat = s.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array([fold] * len(flat), pa.int32()), pa.array([part] * len(flat)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["fold", "part", "i", "v"]
            )

    out: dict[tuple[int, str], np.ndarray] = {}
    for r in rows.mapInArrow(of, "fold int, part string, i int, v double").groupBy("fold", "part", "i").agg(F.sum("v").alias("v")).collect():
        side = len(medians[r["fold"]]) + 2
        out.setdefault((r["fold"], r["part"]), np.zeros((side, side))).flat[r["i"]] = r["v"]
    return out


def fit_from_sums(s: np.ndarray, setting: Setting, rounds: int = 10_000, close: float = 1e-12) -> tuple[float, np.ndarray]:
    """Intercept and coefficients that minimise ``mean squared error / 2 + penalty``, by cyclic coordinate descent."""
    n = s[0, 0]
    mean = s[0, 1:] / n
    cov = s[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
    real = spread > 1e-9 * np.maximum(1.0, np.abs(mean[:-1]))  # a constant feature gets no coefficient
    scale = np.where(real, spread, 1.0)
    g, c = cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale
    b = np.zeros(len(c))
    for _ in range(rounds):
        largest = 0.0
        for j in np.flatnonzero(real):
            r = c[j] - g[j] @ b + g[j, j] * b[j]
            new = np.sign(r) * max(abs(r) - setting.reg * setting.mix, 0.0) / (g[j, j] + setting.reg * (1 - setting.mix))
            largest = max(largest, abs(new - b[j]))
            b[j] = new
        if largest < close:
            break
    b = b / scale
    return float(mean[-1] - b @ mean[:-1]), b


def error_from_sums(s: np.ndarray, a: float, b: np.ndarray) -> float:
    """Root mean squared error of ``a + b x`` on the rows behind ``s``."""
    w = np.concatenate([[-a], -b, [1.0]])
    return float(np.sqrt(max(w @ s @ w, 0.0) / s[0, 0]))


def sweep(rows: DataFrame, day: str, key: str, features: Sequence[str], settings: Sequence[Setting], train_rows: int, test_rows: int) -> DataFrame:
    """``setting, reg, mix, fold, train_rows, test_rows, coefficients, rmse``: every setting on every walk-forward fold.

    ``rows`` needs home_margin and spread_signed, as in ``walk_forward``; a feature without a value in a fold's training
    window is left out there. Folds without known outcomes in a window are left out.
    """
    calendar = models.fold_calendar(rows, day, train_rows, test_rows)
    specs = models.fold_specs(calendar)
    block = max(1, test_rows // 4)
    table = models.by_position(models._placed(rows, day, key), block)
    train = [(s.fold, "train", s.train_from, s.test_from) for s in specs]
    found = models.window_medians(table, train, features)
    medians = {s.fold: found.get((s.fold, "train"), {}) for s in specs}
    sums = product_sums(table, [*train, *((s.fold, "test", s.test_from, s.test_to) for s in specs)], medians)
    out = []
    for s in specs:
        learned, tested = sums.get((s.fold, "train")), sums.get((s.fold, "test"))
        if learned is None or tested is None:
            continue
        for i, setting in enumerate(settings):
            a, b = fit_from_sums(learned, setting)
            out.append((i, setting.reg, setting.mix, s.fold, int(learned[0, 0]), int(tested[0, 0]), int((b != 0).sum()), error_from_sums(tested, a, b)))
    return rows.sparkSession.createDataFrame(out, "setting int, reg double, mix double, fold int, train_rows long, test_rows long, coefficients int, rmse double")


def best_settings(swept: DataFrame) -> DataFrame:
    """Settings by mean RMSE over the folds: ``setting, reg, mix, folds, mean_rmse, rank``; equal ones by number."""
    mean = swept.groupBy("setting", "reg", "mix").agg(F.count(F.lit(1)).alias("folds"), F.avg("rmse").alias("mean_rmse"))
    return mean.withColumn("rank", F.row_number().over(Window.orderBy("mean_rmse", "setting")))  # a row per setting
