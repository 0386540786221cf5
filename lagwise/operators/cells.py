"""Walk-forward fits on long training windows, from sums per cell of binned features instead of passes over rows.

A tree on features of at most ``BINS`` bins sees nothing of a row but its cell, and a linear fit nothing but the sums of
products. One pass over the rows sends each to its cell; there the bootstrap or subsample of every tree is drawn row by
row and added up. What is left of a tree's draw is one grid of counts and sums, whose size has nothing to do with the
rows, and the trees of all folds grow on such grids in parallel. Predictions are read off a grid per model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.operators.sweep import product_sums
from lagwise.operators.timeline import RANGE, Timeline, in_ranges, positions
from lagwise.session import stored

#: Windows of more rows than this are fitted from cells, if their grid has at most ``MOST_CELLS``: 32 bins of four features.
CELL_ROWS = 400_000
MOST_CELLS = 1 << 20
BINS = 32
#: Rows that a task holds while it draws, and rows for one such task.
CHUNK = 1_000_000
DRAW_ROWS = 200_000
#: Trees of a forest that grow in one task.
TREES = 10


def kind(estimator) -> str | None:
    """How ``estimator`` is fitted from cells; None if only on rows."""
    if isinstance(estimator, LinearRegression) and estimator.getLoss() == "squaredError":
        return "linear"
    if isinstance(estimator, RandomForestRegressor) and estimator.getMinInfoGain() == 0 and estimator.getBootstrap():
        return "forest"
    if isinstance(estimator, GBTRegressor) and estimator.getMinInfoGain() == 0 and estimator.getLossType() == "squared" and estimator.getFeatureSubsetStrategy() == "all":
        return "boosted"
    return None


def grid_size(edges: dict[str, np.ndarray]) -> int:
    return int(np.prod([len(e) + 1 for e in edges.values()], dtype=float))


def placed_by_day(rows: DataFrame, day: str, key: str, cuts: Sequence[int]) -> DataFrame:
    """``rows`` with ``__pos``: the position of the day's first row, exact on days that a cut of ``cuts`` divides.

    That is all that windows need whose ends are ``cuts`` or ends of days. Only the divided days are sorted.
    """
    days = [(r[day], r["n"]) for r in rows.where(F.col(day).isNotNull()).groupBy(day).agg(F.count(F.lit(1)).alias("n")).orderBy(day).collect()]
    marks, before, sorted_rows = [], 0, 0
    for d, n in days:
        split = any(before < c < before + n for c in cuts)
        marks.append((d, before, split, before - sorted_rows))
        before, sorted_rows = before + n, sorted_rows + n * split
    kinds = dict(rows.dtypes)
    table = rows.sparkSession.createDataFrame(marks, f"`{day}` {kinds[day]}, __pos long, __split boolean, __shift long")
    joined = rows.join(F.broadcast(table), day)  # one row per calendar day
    whole = joined.where("NOT __split").drop("__split", "__shift")
    if not any(m[2] for m in marks):
        return whole
    order = (day, key)
    some = positions(in_ranges(joined.where("__split").drop("__pos"), (), order), Timeline((), order, RANGE), "__at").drop(RANGE)
    return whole.unionByName(some.withColumn("__pos", F.col("__at") + F.col("__shift")).select(whole.columns))


def cell_numbers(x: dict[str, np.ndarray], medians: dict[str, float], edges: dict[str, np.ndarray]) -> np.ndarray:
    """Cell of each row: bin k of a feature holds the values above k edges; a missing value takes the median."""
    out = np.zeros(len(next(iter(x.values()))), dtype=np.int64)
    for c, m in medians.items():
        out = out * (len(edges[c]) + 1) + np.searchsorted(edges[c], np.where(np.isnan(x[c]), m, x[c]), side="left")
    return out


def grown(n: np.ndarray, s: np.ndarray, depth: int, least: int, choose) -> list[tuple[tuple, float]]:
    """Leaves, as (box, mean), of a regression tree on a grid of counts ``n`` and sums ``s``; ``choose`` gives a node's axes."""
    leaves, nodes = [], [(tuple(slice(0, k) for k in n.shape), 0)]
    while nodes:
        box, level = nodes.pop()
        a, b = n[box], s[box]
        rows, total = a.sum(), b.sum()
        best, axis, at = 1e-12 * max(1.0, total * total / max(rows, 1)), None, 0
        for i in choose() if level < depth and rows >= 2 * least else ():
            others = tuple(k for k in range(n.ndim) if k != i)
            left, left_s = np.cumsum(a.sum(axis=others))[:-1], np.cumsum(b.sum(axis=others))[:-1]
            right = rows - left
            ok = (left >= least) & (right >= least)
            if ok.any():
                gain = np.where(ok, left_s**2 / np.maximum(left, 1) + (total - left_s) ** 2 / np.maximum(right, 1) - total * total / rows, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, axis, at = float(gain[k]), i, box[i].start + k + 1
        if axis is None:
            leaves.append((box, float(total / rows) if rows else 0.0))
        else:
            nodes += [((*box[:axis], half, *box[axis + 1 :]), level + 1) for half in (slice(box[axis].start, at), slice(at, box[axis].stop))]
    return leaves


def grid_of(shape: Sequence[int], trees: Sequence[tuple[float, list]]) -> np.ndarray:
    """Prediction for every cell of a sum of (weight, leaves)."""
    out = np.zeros(shape)
    for w, leaves in trees:
        for box, value in leaves:
            out[box] += w * value
    return out


def rows_by_cell(table: DataFrame, windows: Sequence[tuple[int, int]], medians: Sequence[dict], edges: Sequence[dict]) -> DataFrame:
    """``w, cell, y``: every row with a label once for each window it lies in."""
    columns = sorted({c for m in medians for c in m})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = {c: b.column(2 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
            for w, (lo, hi) in enumerate(windows):
                at = (pos >= lo) & (pos < hi)
                if at.any():
                    cell = cell_numbers({c: v[at] for c, v in x.items()}, medians[w], edges[w])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), w, np.int32)), pa.array(cell.astype(np.int32)), pa.array(y[at])], ["w", "cell", "y"])

    known = table.where("label IS NOT NULL").select("__pos", "label", *[F.col(c).cast("double").alias(c) for c in columns])
    return known.mapInArrow(of, "w int, cell int, y double")


def chances(sort: str, rate: float) -> np.ndarray:
    """Chances of being drawn at most 0, 1, ... times: Poisson, or once with the chance ``rate``."""
    if sort != "forest":
        return np.array([1.0 - rate])
    k = np.arange(1, 40 + int(8 * rate))
    return np.cumsum(np.exp(-rate) * np.concatenate([[1.0], np.cumprod(rate / k)]))


def quick_table(cdf: np.ndarray) -> np.ndarray:
    """Times drawn for each 16-bit random number; -1 where more digits decide."""
    low, high = (np.searchsorted(cdf, (np.arange(1 << 16) + x) / (1 << 16), side="right") for x in (0.0, 1.0))
    return np.where(low == high, low, -1).astype(np.int8)


def drawn_times(rng, cdf: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """``n`` independent draws by inversion of ``cdf``; the table answers for nearly all of them."""
    short = np.frombuffer(rng.bytes(2 * n), np.uint16)
    out = table[short]
    rest = np.flatnonzero(out < 0)
    out[rest] = np.searchsorted(cdf, (short[rest] + rng.random(len(rest))) / (1 << 16), side="right")
    return out


def draws(cells: DataFrame, plans: Sequence[tuple]) -> DataFrame:
    """``fit, draw, block, cell, k, s``: per tree and block of rows the cells, the rows drawn and their sums, as bytes.

    ``plans``: (kind, first draw, end, rate, seed) per fit. Every row is drawn by itself: a Poisson number of times, or
    with the chance ``rate``. Draw -1 of a fit holds the cells of its blocks, which are the same for all its draws.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, block = [], 0, 0
        laws = {(sort, rate): (cdf, quick_table(cdf)) for sort, _, _, rate, _ in plans for cdf in [chances(sort, rate)]}

        def drawn() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            w, cell, y = (t.column(c).to_numpy() for c in ("w", "cell", "y"))
            order = np.lexsort((y, cell, w))
            w, cell, y = w[order], cell[order], y[order]
            for one in np.unique(w):
                at = slice(*np.searchsorted(w, [one, one + 1]))
                c, v = cell[at], y[at]
                first_of = np.concatenate([[True], c[1:] != c[:-1]])
                own, inside = c[first_of], np.cumsum(first_of) - 1
                number = int(c[0]) << 31 | block  # the block's own: a cell lies in one partition
                for i, (sort, first, end, rate, seed) in enumerate(plans):
                    out = [(-1, own.tobytes(), b"", b"")]
                    for k in range(first, end):
                        rng = np.random.default_rng([abs(seed), k, int(one), number, int(sort == "forest")])
                        times = drawn_times(rng, *laws[sort, rate], len(v))
                        n = np.bincount(inside, times, len(own)).astype(np.int64)
                        s = np.bincount(inside, times * v, len(own))
                        short = s.astype(np.float32)
                        out.append((k, b"", n.astype(np.min_scalar_type(n.max())).tobytes(), (short if (short == s).all() else s).tobytes()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(one) * len(plans) + i] * len(out), pa.int32()), pa.array([o[0] for o in out], pa.int32()), pa.array([number] * len(out), pa.int64()),
                         *[pa.array([o[j] for o in out], pa.binary()) for j in (1, 2, 3)]], ["fit", "draw", "block", "cell", "k", "s"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK:
                yield from drawn()
                held, rows, block = [], 0, block + 1
        if rows:
            yield from drawn()

    return cells.mapInArrow(of, "fit int, draw int, block long, cell binary, k binary, s binary")


def fitted_trees(cells: DataFrame, rows: int, shapes: Sequence[tuple], estimators: dict) -> dict[tuple[int, str], list]:
    """Per (window, model) its trees, as (weight, leaves), for all tree models of ``estimators``."""
    plans, owners = [], []
    for m, (sort, e) in estimators.items():
        if sort == "forest":
            count, rate = e.getNumTrees(), e.getSubsamplingRate()
            some = [(k, min(k + TREES, count)) for k in range(0, count, TREES)]
        else:
            count, rate = e.getMaxIter(), e.getSubsamplingRate()
            some = [(0, count)]
        plans += [(sort, a, z, rate, e.getSeed()) for a, z in some]
        owners += [(m, sort, e.getMaxDepth(), e.getMinInstancesPerNode(), e.getStepSize() if sort == "boosted" else 1 / count, e.getSeed(), count)] * len(some)
    if not plans:
        return {}
    parts = max(1, -(-rows // DRAW_ROWS))
    sent = draws(cells.repartition(parts, "w", "cell"), plans)
    fits = len(plans) * len(shapes)

    def grow(found):
        fit, at, held, model = None, None, [], None
        draw, n, s = None, None, None

        def tree():
            m, sort, depth, least, weight, seed, count = owners[fit % len(plans)]
            f = n.ndim
            rng = np.random.default_rng([abs(seed), fit, draw])
            if sort == "forest":
                some = f if count == 1 else -(-f // 3)
                return fit, draw, weight, grown(n, s, depth, least, lambda: rng.choice(f, some, replace=False))
            leaves = grown(n, s if draw == 0 else 2 * (s - n * model), depth, least, lambda: range(f))
            step = 1.0 if draw == 0 else weight
            for box, value in leaves:
                model[box] += step * value
            return fit, draw, step, leaves

        for r in found:
            if (r.fit, r.draw) != (fit, draw):
                if draw is not None and draw >= 0:
                    yield tree()
                if r.fit != fit:
                    fit, held = r.fit, []
                    shape = shapes[fit // len(plans)]
                    model = np.zeros(shape)
                draw, at = r.draw, 0
                n, s = np.zeros(shape), np.zeros(shape)
            if draw < 0:
                held.append((r.block, np.frombuffer(r.cell, np.int32)))
                continue
            block, cell = held[at]
            assert block == r.block
            at += 1
            width = len(r.k) // len(cell)
            n.reshape(-1)[cell] += np.frombuffer(r.k, f"u{width}")  # a block has each cell once
            s.reshape(-1)[cell] += np.frombuffer(r.s, f"f{len(r.s) // len(cell)}")
        if draw is not None and draw >= 0:
            yield tree()

    found = sent.repartition(fits, "fit").sortWithinPartitions("fit", "draw", "block").rdd.mapPartitions(grow).collect()
    out: dict[tuple[int, str], list] = {}
    for fit, draw, weight, leaves in sorted(found, key=lambda r: r[:2]):
        out.setdefault((fit // len(plans), owners[fit % len(plans)][0]), []).append((weight, leaves))
    return out


def fitted_line(spark, sums: np.ndarray, estimator) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of ``estimator`` on rows with these sums of products of (1, features, label).

    The normal equations see only means and products, so the fit is run on a few weighted points that have the same.
    """
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    flat = np.diag(cov) <= 1e-12 * np.maximum(mean * mean, 1e-12)
    cov[flat] = 0.0
    cov[:, flat] = 0.0
    values, vectors = np.linalg.eigh(cov)
    arms = vectors * np.sqrt(np.maximum(values, 0.0) * len(mean))
    arms[flat] = 0.0
    points = [mean + sign * arms[:, j] for j in range(len(mean)) for sign in (1, -1)]
    rows = spark.createDataFrame([(Vectors.dense(p[:-1]), float(p[-1]), float(n) / len(points)) for p in points], ["features", "label", "__w"])
    model = estimator.setWeightCol("__w").fit(rows.coalesce(1))
    return float(model.intercept), np.array(model.coefficients.toArray())


def predictor(medians: dict, edges: dict, lines: dict, trees: dict):
    """``predict(x)``: per model the predictions of rows given as one array per feature. Grids are made on first use."""
    grids = {}
    shape = [len(edges[c]) + 1 for c in medians]

    def predict(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {m: a + sum((b * np.where(np.isnan(x[c]), v, x[c]) for b, (c, v) in zip(bs, medians.items(), strict=True)), 0.0) for m, (a, bs) in lines.items()}
        if trees:
            cell = cell_numbers(x, medians, edges)
            for m, t in trees.items():
                if m not in grids:
                    grids[m] = grid_of(shape, t).reshape(-1)
                out[m] = grids[m][cell]
        return out

    return predict


def late_spread(table: DataFrame, parts: Sequence[tuple], columns: Sequence[str]) -> dict[tuple[int, str], float | None]:
    """Per (fold, model) the deviation of its errors; ``parts``: (fold, first, end, arguments of ``predictor``)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sums = {}, {}
        for b in batches:
            pos, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = {c: b.column(2 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
            for fold, lo, hi, what in parts:
                at = (pos >= lo) & (pos < hi)
                if at.any():
                    made.setdefault(fold, predictor(*what))
                    for m, p in made[fold]({c: v[at] for c, v in x.items()}).items():
                        r = y[at] - p
                        sums[fold, m] = sums.get((fold, m), 0.0) + np.array([len(r), r.sum(), (r * r).sum()])
        for (fold, m), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([m]), *[pa.array([float(q)]) for q in v]], ["fold", "model", "n", "r", "q"])

    known = table.where("label IS NOT NULL").select("__pos", "label", *[F.col(c).cast("double").alias(c) for c in columns])
    known = known.where(" OR ".join(f"(__pos >= {lo} AND __pos < {hi})" for _, lo, hi, _ in parts))
    rows = known.mapInArrow(of, "fold int, model string, n double, r double, q double").groupBy("fold", "model").agg(*[F.sum(c).alias(c) for c in ("n", "r", "q")]).collect()
    return {(r.fold, r.model): float(np.sqrt(max(r.q / r.n - (r.r / r.n) ** 2, 0.0))) for r in rows}


def fold_predictions(table: DataFrame, parts: Sequence[tuple], columns: Sequence[str], models: Sequence[str], key: str) -> DataFrame:
    """``key, fold, model, pred, sigma, home_margin``; ``parts``: (fold, first, end, arguments of ``predictor``, sigma per model).

    Predictions of all models are stored side by side, one row per row of a fold.
    """
    names = [key, "spread_signed", "home_margin", "fold", *[f"__{x}{i}" for x in "ps" for i in range(len(models))]]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for b in batches:
            pos = b.column(0).to_numpy()
            x = {c: b.column(4 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
            for fold, lo, hi, what, sigma in parts:
                at = (pos >= lo) & (pos < hi)
                if at.any():
                    made.setdefault(fold, predictor(*what))
                    known = b.filter(pa.array(at))
                    n = known.num_rows
                    found = made[fold]({c: v[at] for c, v in x.items()})
                    yield pa.RecordBatch.from_arrays([
                        *[known.column(i) for i in (1, 2, 3)], pa.array(np.full(n, fold, np.int32)),
                        *[pa.array(found[m]) for m in models], *[pa.array(np.full(n, sigma[m])) for m in models],
                    ], names)

    kinds = dict(table.dtypes)
    rows = table.select("__pos", key, "spread_signed", "home_margin", *[F.col(c).cast("double").alias(c) for c in columns])
    rows = rows.where(" OR ".join(f"(__pos >= {lo} AND __pos < {hi})" for _, lo, hi, _, _ in parts))
    types = [f"`{key}` {kinds[key]}", f"spread_signed {kinds['spread_signed']}", f"home_margin {kinds['home_margin']}", "fold int", *[f"{c} double" for c in names[4:]]]
    side = stored(rows.mapInArrow(of, ", ".join(types)))
    each = [F.struct(F.lit(m).alias("model"), (F.col(f"__p{i}") - F.col("spread_signed")).alias("pred"), F.col(f"__s{i}").alias("sigma")) for i, m in enumerate(models)]
    return side.select(key, "fold", F.explode(F.array(*each)).alias("m"), "home_margin").select(key, "fold", "m.model", "m.pred", "m.sigma", "home_margin")


def cell_walk(table: DataFrame, specs: Sequence, ends: Sequence[int], medians: dict, edges: dict, estimators: dict, key: str) -> DataFrame:
    """Predictions of all models on all folds of ``table``, with the out-of-sample sigma of each window's last part.

    ``ends``: where the early part of each fold's window ends. ``medians`` and ``edges`` are by (fold, part).
    """
    names = [(s.fold, part) for s in specs for part in ("all", "early")]
    windows = [w for s, end in zip(specs, ends, strict=True) for w in ((s.train_from, s.test_from), (s.train_from, end))]
    med, cuts = [medians[x] for x in names], [edges[x] for x in names]
    kinds = {m: (kind(e), e) for m, e in estimators.items()}
    columns = sorted({c for m in med for c in m})
    shapes = [tuple(len(cuts[w][c]) + 1 for c in med[w]) for w in range(len(windows))]
    trees = fitted_trees(rows_by_cell(table, windows, med, cuts), sum(z - a for a, z in windows), shapes, {m: k for m, k in kinds.items() if k[0] != "linear"})
    lines = {}
    if any(k == "linear" for k, _ in kinds.values()):
        sums = product_sums(table, [(w, "all", a, z) for w, (a, z) in enumerate(windows)], dict(enumerate(med)))
        lines = {(w, m): fitted_line(table.sparkSession, sums[w, "all"], e) for w in range(len(windows)) for m, (k, e) in kinds.items() if k == "linear"}

    def of(w):
        return med[w], cuts[w], {m: v for (x, m), v in lines.items() if x == w}, {m: v for (x, m), v in trees.items() if x == w}

    late = late_spread(table, [(s.fold, end, s.test_from, of(2 * i + 1)) for i, (s, end) in enumerate(zip(specs, ends, strict=True))], columns)
    sigma = [{m: late.get((s.fold, m)) or 1.0 for m in kinds} for s in specs]
    return fold_predictions(table, [(s.fold, s.test_from, s.test_to, of(2 * i), sigma[i]) for i, s in enumerate(specs)], columns, list(kinds), key)
