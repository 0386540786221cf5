"""Isotonic calibration of many groups in one job.

Adjacent groups of points whose means do not rise belong to one block of the fit, whatever else there is. So every
sampled range of values is pooled by itself, and only the blocks that are left are pooled again per group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.operators.timeline import RANGE, Timeline, cum_max, in_ranges, running

KEY, VALUE = "__key", "__value"
BLOCK = f"{KEY} string, lo double, hi double, won double, n double"
Blocks = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _merged(blocks: Blocks, first: np.ndarray) -> Blocks:
    lo, hi, won, n = blocks
    return lo[first], hi[np.append(first[1:], len(lo)) - 1], np.add.reduceat(won, first), np.add.reduceat(n, first)


def pooled(blocks: Blocks) -> Blocks:
    """Blocks in order of value, merged until their means rise.

    Whole falling runs are merged at a time as long as that removes a tenth of the blocks; a stack does the rest, so
    the time stays linear.
    """
    while len(blocks[0]):
        mean = blocks[2] / blocks[3]
        first = np.flatnonzero(np.append(True, mean[1:] > mean[:-1]))
        if len(first) == len(mean):
            return blocks
        few = len(first) > 0.9 * len(mean)
        blocks = _merged(blocks, first)
        if few:
            break
    starts: list[int] = []
    won: list[float] = []
    n: list[float] = []
    for i, (s, w) in enumerate(zip(blocks[2].tolist(), blocks[3].tolist())):
        start = i
        while starts and won[-1] / n[-1] >= s / w:
            start, s, w = starts.pop(), s + won.pop(), w + n.pop()
        starts.append(start)
        won.append(s)
        n.append(w)
    return _merged(blocks, np.array(starts, dtype=np.int64)) if starts else blocks


def _arrays(part: pd.DataFrame) -> Blocks:
    return tuple(part[c].to_numpy(dtype=np.float64) for c in ("lo", "hi", "won", "n"))


def _frame(key: str, blocks: Blocks) -> pd.DataFrame:
    return pd.DataFrame({KEY: key, **dict(zip(("lo", "hi", "won", "n"), blocks))})


def _pool_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pool the points of one sorted range; only the blocks of the current group are held."""
    key, held = None, None
    for batch in batches:
        for k, part in batch.groupby(KEY, sort=False):
            if k == key:
                held = pooled(tuple(np.concatenate(both) for both in zip(held, _arrays(part))))
                continue
            if held is not None:
                yield _frame(key, held)
            key, held = k, pooled(_arrays(part))
    if held is not None:
        yield _frame(key, held)


def _pool_group(part: pd.DataFrame) -> pd.DataFrame:
    """The fit of one group: its blocks, each with the next one, and the value from which it holds (none for the first)."""
    lo, hi, won, n = pooled(_arrays(part.sort_values("lo")))
    fit = won / n
    return pd.DataFrame({
        KEY: part[KEY].iloc[0], VALUE: np.append(-np.inf, lo[1:]), "lo": lo, "hi": hi, "fit": fit,
        "next_lo": np.append(lo[1:], np.nan), "next_fit": np.append(fit[1:], np.nan),
    })


def group_key(keys: Sequence[str]) -> Column:
    """One string per combination of keys, null keys included."""
    return F.to_json(F.struct(*keys)) if keys else F.lit("")


def number(x: str) -> Column:
    value = F.col(x).cast("double")
    return F.when(~F.isnan(value), value)


def isotonic_blocks(train: DataFrame, p: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Blocks of the isotonic fit of ``y`` (0 or 1) on ``p`` per group: ``__key, __value, lo, hi, fit, next_lo, next_fit``.

    Rows become one weighted point per value on the map side. Points are dealt to sampled ranges of (group, value), so a
    hot group is spread, and pooled there. The blocks of a group are then pooled in one task: their means are different
    fractions whose denominators add up to the group's n rows, so there are at most about n^(2/3) of them.
    """
    known = train.select(group_key(keys).alias(KEY), number(p).alias("lo"), number(y).alias("y")).dropna()
    points = known.groupBy(KEY, "lo").agg(F.sum("y").alias("won"), F.count(F.lit(1)).cast("double").alias("n"))
    points = points.select(KEY, "lo", F.col("lo").alias("hi"), "won", "n")
    dealt = points.repartitionByRange(KEY, "lo").sortWithinPartitions(KEY, "lo")
    fit = f"{KEY} string, {VALUE} double, lo double, hi double, fit double, next_lo double, next_fit double"
    return dealt.mapInPandas(_pool_range, BLOCK).groupBy(KEY).applyInPandas(_pool_group, fit)


def isotonic(train: DataFrame, test: DataFrame, p: str, y: str, keys: Sequence[str] = (), name: str = "p_isotonic") -> DataFrame:
    """``test`` with the isotonic calibration of ``p`` learnt from ``train``, separately for every group of ``keys``.

    Between two blocks the fit is interpolated, outside it is constant. Null where p is null or NaN, or where the group
    has no training row with both p and y. Each test row finds its block as the newest one on a shared timeline of
    values; ties are dealt out, so one value in most rows is no single task.
    """
    blocks = isotonic_blocks(train, p, y, keys).select(
        KEY, VALUE, F.struct("lo", "hi", "fit", F.nanvl("next_lo", F.lit(None)).alias("next_lo"), F.nanvl("next_fit", F.lit(None)).alias("next_fit")).alias("__block"),
        F.lit(-1).cast("bigint").alias("__tie"),
    )
    rows = test.select(group_key(keys).alias(KEY), number(p).alias(VALUE), F.monotonically_increasing_id().alias("__tie"), F.struct(*[c for c in test.columns if c != name]).alias("__row"))
    both = in_ranges(blocks.unionByName(rows, allowMissingColumns=True), [KEY], [VALUE, "__tie"])
    found = running(both, Timeline(KEY, (VALUE, "__tie"), RANGE), {"__at": cum_max(F.col("__block"))}).where("__tie >= 0")
    at, value = F.col("__at"), F.col(VALUE)
    slope = (at["next_fit"] - at["fit"]) / (at["next_lo"] - at["hi"])
    inside = (value <= at["hi"]) | at["next_lo"].isNull()
    fitted = F.when(value.isNotNull(), F.when(inside, at["fit"]).otherwise(at["fit"] + (value - at["hi"]) * slope))
    return found.select("__row.*", fitted.alias(name))
