"""Leak screen: does a feature alone tell the outcome out of fold, in whatever shape?

Boosted trees on two quantised columns see nothing of a row but its cell on the grid (base bin, feature bin). So counts
and sums per cell are all that fitting and scoring need: they come from one pass over the table for all features and
time blocks together, and what is left, one small grid per feature and fold, is fitted in parallel, exactly as it would
be on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.audits import flag_outliers
from lagwise.session import cut_lineage, stored

BASE = "__base"
#: Rows whose values a task counts at a time, and points that it keeps of them.
POINTS_OF = 200_000
POINTS = 10_000


@dataclass(frozen=True)
class Trees:
    """Boosting settings; a tree has ``2 ** depth`` leaves of at least ``least`` rows."""

    count: int = 150
    rate: float = 0.05
    depth: int = 3
    least: int = 60
    bins: int = 32


def _best_split(n: np.ndarray, r: np.ndarray, least: int) -> tuple[float, int, int]:
    """Gain, axis and place of the best cut of a rectangle of counts ``n`` and residual sums ``r``."""
    best = (1e-9, -1, 0)
    total_n, total_r = n.sum(), r.sum()
    if total_n < 2 * least:
        return best
    whole = total_r * total_r / total_n
    for axis in (0, 1):
        left_n, left_r = np.cumsum(n.sum(axis=1 - axis))[:-1], np.cumsum(r.sum(axis=1 - axis))[:-1]
        right_n = total_n - left_n
        ok = (left_n >= least) & (right_n >= least)
        if not ok.any():
            continue
        gain = np.where(ok, left_r**2 / np.maximum(left_n, 1) + (total_r - left_r) ** 2 / np.maximum(right_n, 1) - whole, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), axis, at + 1)
    return best


def boosted(n: np.ndarray, s: np.ndarray, trees: Trees) -> np.ndarray:
    """Prediction for every cell of least-squares boosting on cells with ``n`` rows whose targets sum to ``s``."""
    f = np.full(n.shape, s.sum() / n.sum())
    for _ in range(trees.count):
        r = s - n * f
        leaves = [(0, n.shape[0], 0, n.shape[1])]
        for _ in range(trees.depth):
            grown = []
            for a, b, c, d in leaves:
                _, axis, at = _best_split(n[a:b, c:d], r[a:b, c:d], trees.least)
                grown += [(a, b, c, d)] if axis < 0 else [(a, a + at, c, d), (a + at, b, c, d)] if axis == 0 else [(a, b, c, c + at), (a, b, c + at, d)]
            if len(grown) == len(leaves):
                break
            leaves = grown
        for a, b, c, d in leaves:
            rows = n[a:b, c:d].sum()
            if rows:
                f[a:b, c:d] += trees.rate * r[a:b, c:d].sum() / rows
    return f


def time_blocks(df: DataFrame, day: str, blocks: int, name: str = "__block") -> DataFrame:
    """``df`` with the number of its time block: whole days, about equally many rows in each."""
    days = df.groupBy(day).agg(F.count(F.lit(1)).alias("__n"))
    ordered = Window.orderBy(day)  # one row per calendar day
    before = F.coalesce(F.sum("__n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__n").over(Window.partitionBy())
    return df.join(F.broadcast(days.select(day, F.floor(before * blocks / total).cast("int").alias(name))), day)


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, np.ndarray]:
    """Inner quantiles of each column, without repeats: ``columns`` x ``bins`` numbers, up to ``POINTS_OF`` rows from one aggregate.

    Of more rows, a task counts the values of ``POINTS_OF`` rows at a time; more than ``POINTS`` are thinned to that many even ranks, so a
    rank is off by 1 / (2 ``POINTS``) of the rows at most. Each column's points meet in a task of its own.
    """
    if df.count() <= POINTS_OF:
        ranks = [k / bins for k in range(1, bins)]
        one = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), ranks, 10_000).alias(c) for c in columns]).first()
        return {c: np.unique(np.array(one[c] or [], float)) for c in columns}

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def counted() -> pa.RecordBatch:
            found = []
            for i in range(len(columns)):
                x = np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held])
                v, n = np.unique(x[~np.isnan(x)], return_counts=True)
                if len(v) > POINTS:
                    ranks = np.linspace(0, n.sum(), POINTS + 1).astype(np.int64)
                    middle = (ranks[:-1] + ranks[1:] + 1) // 2
                    v, n = v[np.searchsorted(np.cumsum(n), middle)], np.diff(ranks)
                found.append((i, v.tobytes(), n.astype(np.int64).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), *[pa.array([f[k] for f in found], pa.binary()) for k in (1, 2)]], ["c", "v", "n"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= POINTS_OF:
                yield counted()
                held, rows = [], 0
        if rows:
            yield counted()

    def cuts(t: pa.Table) -> pa.Table:
        v, n = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("v", np.float64), ("n", np.int64)))
        order = np.argsort(v, kind="stable")
        upto = np.cumsum(n[order])
        total = int(upto[-1]) if len(upto) else 0
        found = np.unique(v[order][np.searchsorted(upto, [-(-k * total // bins) for k in range(1, bins)])]) if total else np.zeros(0)
        return pa.table({"c": pa.array([t.column("c")[0].as_py()], pa.int32()), "e": pa.array([found], pa.list_(pa.float64()))})

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(columns)])
    found = rows.mapInArrow(points, "c int, v binary, n binary").groupBy("c").applyInArrow(cuts, "c int, e array<double>").collect()
    edges = {r["c"]: np.array(r["e"], float) for r in found}
    return {c: edges.get(i, np.zeros(0)) for i, c in enumerate(columns)}


def grid_sums(rows: DataFrame, edges: dict[str, np.ndarray], features: Sequence[str], blocks: int, bins: int) -> DataFrame:
    """``feature, block, base_bin, bin, n, s, q``: rows, sum and sum of squares of ``__y`` in every cell that has rows.

    ``rows`` has ``__block, __y, __base`` and the features as doubles. Bin 0 holds missing values, bin k the values above
    k - 1 edges. A task holds one grid per feature and block and sends each of their cells at most once.
    """
    narrow = rows.select("__block", "__y", BASE, *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    shape = (len(features) + 1, blocks, bins + 1, bins + 1)

    def numbered(values: pa.Array, cuts: np.ndarray) -> np.ndarray:
        x = values.to_numpy(zero_copy_only=False)
        return np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts, x, side="left"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, *shape))
        flat = sums.reshape(3, shape[0], -1)
        for b in batches:
            y = b.column(1).to_numpy()
            squares = y * y
            at = (b.column(0).to_numpy().astype(np.int64) * shape[2] + numbered(b.column(2), edges[BASE])) * shape[3]
            for i in range(shape[0]):
                cell = at + numbered(b.column(3 + i), edges[features[i]]) if i < len(features) else at
                for k, w in enumerate((None, y, squares)):
                    flat[k, i] += np.bincount(cell, w, flat.shape[2])
        f, block, base, bin_ = np.nonzero(sums[0])
        if len(f):
            kept = sums[:, f, block, base, bin_]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x.astype(np.int32)) for x in (f, block, base, bin_)], pa.array(kept[0].astype(np.int64)), pa.array(kept[1]), pa.array(kept[2])],
                ["f", "block", "base_bin", "bin", "n", "s", "q"],
            )

    cells = narrow.mapInArrow(of, "f int, block int, base_bin int, bin int, n long, s double, q double")
    names = F.element_at(F.array(*[F.lit(c) for c in [*features, BASE]]), F.col("f") + 1).alias("feature")
    return cells.groupBy("f", "block", "base_bin", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).select(names, "block", "base_bin", "bin", "n", "s", "q")


def out_of_fold(cells: DataFrame, blocks: int, train_blocks: int, trees: Trees, least_known: int) -> DataFrame:
    """``feature, rows, r2``: each block after the first ``train_blocks`` is predicted from the ``train_blocks`` before it.

    ``r2`` is null where some training part has fewer than ``least_known`` known values, or nothing varies.
    """
    side = trees.bins + 1

    def of(t: pa.Table) -> pa.Table:
        grid = np.zeros((3, blocks, side, side))
        at = tuple(t.column(c).to_numpy() for c in ("block", "base_bin", "bin"))
        for k, c in enumerate(("n", "s", "q")):
            grid[(k, *at)] = t.column(c).to_numpy()
        name = t.column("feature")[0].as_py()
        error, tested = 0.0, np.zeros(3)
        known = True
        for k in range(train_blocks, blocks):
            n, s, _ = grid[:, k - train_blocks : k].sum(axis=1)
            known &= (n if name == BASE else n[:, 1:]).sum() >= least_known
            if not known:
                break
            p = boosted(n, s, trees)
            tn, ts, tq = grid[:, k]
            error += float((tq - 2 * p * ts + p * p * tn).sum())
            tested += [tn.sum(), ts.sum(), tq.sum()]
        spread = tested[2] - tested[1] ** 2 / tested[0] if tested[0] else 0.0
        r2 = 1 - error / spread if known and spread > 0 else None
        return pa.table({"feature": [name], "rows": pa.array([int(grid[0].sum())], pa.int64()), "r2": pa.array([r2], pa.float64())})

    return cells.groupBy("feature").applyInArrow(of, "feature string, rows long, r2 double")


def tree_leak_screen(
    df: DataFrame, target: Column, base: Column, features: Sequence[str], day: str, factor: float = 4.0, blocks: int = 10, train_blocks: int = 5,
    trees: Trees = Trees(), least_known: int = 200,
) -> DataFrame:
    """What each feature adds out of fold to the base, for all ``features`` at once.

    Boosted trees on (base, feature) learn the target on ``train_blocks`` blocks of time and predict the next one;
    ``d_r2`` is their R-squared less that of trees on the base alone. Flagged are values above median + ``factor`` x
    1.4826 x MAD of all features. Trees follow any shape, so a leak need not be monotone to be seen. Rows without target
    or base take no part; a missing value is a bin of its own. A feature that has fewer than ``least_known`` values in
    some training part is listed with a null ``d_r2`` and never flagged. An empty table gives an empty result.
    """
    if not 0 < train_blocks < blocks:
        raise ValueError("train_blocks must be between 1 and blocks - 1")
    rows = df.select(
        F.col(day).alias("__day"), target.cast("double").alias("__y"), base.cast("double").alias(BASE),
        *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(c) for c in features],
    ).where(F.col("__y").isNotNull() & F.col(BASE).isNotNull() & F.col("__day").isNotNull())
    rows = time_blocks(stored(rows), "__day", blocks)  # in columns, most of which have few values; the days are counted on one of them
    edges = bin_edges(rows, [BASE, *features], trees.bins)
    cells = grid_sums(rows, edges, features, blocks, trees.bins)
    scored = cut_lineage(out_of_fold(cells, blocks, train_blocks, trees, least_known))
    alone = scored.where(F.col("feature") == BASE).select(F.col("r2").alias("base_r2"), F.lit(1).alias("__one"))
    out = scored.where(F.col("feature") != BASE).withColumn("__one", F.lit(1)).join(F.broadcast(alone), "__one").drop("__one")  # one row
    return flag_outliers(out.withColumn("d_r2", F.col("r2") - F.col("base_r2")), "d_r2", factor)
