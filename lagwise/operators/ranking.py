"""Ranks, quantiles and top-k that stay exact for very large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.timeline import RANGE, Timeline, cum_count, cum_sum, in_ranges, running

_ONE = "__one"


def with_group(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Attach group aggregates to every row (a join, so a big group is not one task)."""
    if not keys:
        total = df.agg(*[a.alias(n) for n, a in aggs.items()]).withColumn(_ONE, F.lit(1))
        return df.withColumn(_ONE, F.lit(1)).join(F.broadcast(total), _ONE).drop(_ONE)  # exactly one row
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(totals, list(keys), "left")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str | None = None) -> DataFrame:
    """First n rows of each group. The rank filter is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")


def _ranked(df: DataFrame, keys: Sequence[str], metric: Column, tie: Sequence, name: str, descending: bool, size: str | None) -> DataFrame:
    order = F.col("__m").desc_nulls_last() if descending else F.col("__m").asc_nulls_last()
    rows = in_ranges(df.withColumn("__m", metric.cast("double")), keys, (order, *tie))
    line = Timeline(keys, (order, *tie), RANGE)
    overall = {size: cum_count(F.col("__m"))} if size else None
    out = running(rows, line, {name: cum_count()}, overall=overall)
    return out.withColumn(name, (F.col(name) + 1).cast("bigint")).drop("__m", RANGE)


def group_rank(df: DataFrame, keys: Sequence[str], metric: Column, tie: Sequence, name: str, descending: bool = True) -> DataFrame:
    """One-based rank of every row in its group, nulls last, ties by ``tie``."""
    return _ranked(df, keys, metric, tie, name, descending, None)


def equal_count_bins(df: DataFrame, keys: Sequence[str], metric: Column, tie: Sequence, q: int, name: str, label: str) -> DataFrame:
    """Quantile bins of the ranks (not of the values): label1 .. labelq; null metric gets no bin.

    The bins are the right-closed intervals between equally spaced ranks, which
    differ from ``ntile`` in where the remainder rows go.
    """
    ranked = _ranked(df, keys, metric, tie, "__r", False, "__n")
    step = F.ceil((F.col("__r") - 1) * q / F.nullif(F.col("__n") - 1, F.lit(0)))
    bin_no = F.greatest(F.coalesce(step, F.lit(1)), F.lit(1)).cast("int")
    text = F.when(F.col("__r") <= F.col("__n"), F.concat(F.lit(label), bin_no.cast("string")))
    return ranked.withColumn(name, text).drop("__r", "__n")


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group with linear interpolation.

    Values are counted first; the distinct values are then accumulated in order,
    range by range, so no group is sorted or held in one task.
    """
    rows = df.select(*keys, value.cast("double").alias("__v")).where("__v IS NOT NULL")
    counts = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    counts = in_ranges(counts, keys, ["__v"])
    line = Timeline(tuple(keys), "__v", RANGE)
    size = cum_sum(F.col("__n"))
    j = running(counts, line, {"__b": size}, overall={"__t": size}).withColumn("__b", F.coalesce("__b", F.lit(0)))

    def at(rank: Column) -> Column:
        here = (F.col("__b") <= rank) & (rank < F.col("__b") + F.col("__n"))
        return F.max(F.when(here, F.col("__v")))

    picks, outs = [], []
    for name, p in probs.items():
        h = (F.col("__t") - 1) * F.lit(float(p))
        picks += [at(F.floor(h)).alias(f"__lo_{name}"), at(F.ceil(h)).alias(f"__hi_{name}")]
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        hh = (F.col("__all") - 1) * F.lit(float(p))
        outs.append((lo + (hi - lo) * (hh - F.floor(hh))).alias(name))
    out = (j.groupBy(*keys) if keys else j).agg(F.max("__t").alias("__all"), *picks)
    return out.select(*keys, *outs)


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-group results back; without keys ``small`` is one row."""
    if keys:
        return df.join(small, list(keys), "left")
    one = small.withColumn(_ONE, F.lit(1))
    return df.withColumn(_ONE, F.lit(1)).join(F.broadcast(one), _ONE, "left").drop(_ONE)  # exactly one row


def outlier_cutoff(df: DataFrame, keys: Sequence[str], value: Column, factor: float = 4.0) -> DataFrame:
    """median + factor x 1.4826 x MAD per group (two exact passes)."""
    med = quantiles(df, keys, value, {"median": 0.5})
    spread = attach(df.select(*keys, value.alias("__x")), med, keys).withColumn("__d", F.abs(F.col("__x") - F.col("median")))
    mad = quantiles(spread, keys, F.col("__d"), {"mad": 0.5})
    out = attach(med, mad, keys)
    return out.withColumn("cutoff", F.col("median") + factor * 1.4826 * F.col("mad"))


def quantile_edges(df: DataFrame, keys: Sequence[str], value: Column, q: int) -> DataFrame:
    """Distinct quantile edges per group as one sorted array."""
    probs = {f"e{i}": i / q for i in range(q + 1)}
    edges = quantiles(df, keys, value, probs)
    return edges.select(*keys, F.array_sort(F.array_distinct(F.array(*probs))).alias("edges"))


def edge_bin(value: Column, edges: Column) -> Column:
    """One-based bin of a value among right-closed edges, the lowest edge included."""
    inner = F.size(F.filter(edges, lambda e: e < value))
    return F.when(
        (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1)), F.greatest(inner, F.lit(1))
    )


def top_share(df: DataFrame, value: Column, quantile: float) -> DataFrame:
    """Rows whose absolute value reaches the given quantile of absolute values."""
    cut = quantiles(df, [], F.abs(value), {"__cut": quantile})
    return attach(df, cut, []).where(F.abs(value) >= F.col("__cut")).drop("__cut")


def largest_groups(groups: DataFrame, keys: Sequence[str], size: str, first: str, k: int) -> DataFrame:
    """Mark the k largest groups; ties keep the earlier one."""
    w = Window.partitionBy(*keys).orderBy(F.col(size).desc(), F.col(first).asc())
    return groups.withColumn("kept", F.row_number().over(w) <= k)


def top_report(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
