"""Ordered per-entity computations that do not put an entity into one task.

A plain ``Window.partitionBy(entity)`` sends the whole history of an entity to
one task. When one entity holds a large part of all rows that task never ends.
The functions here split every history by a coarse, order-preserving *bucket*
(usually the day):

``running``
    cumulative aggregates. Each (entity, bucket) is aggregated on the map side,
    the small bucket table is accumulated per entity, and every row combines the
    carry of the earlier buckets with a window inside its own bucket.
``framed``
    windows over the last N rows. Rows get their exact position in the entity,
    are cut into chunks of ``chunk_rows``, and the last N rows of a chunk are
    copied into the next one, so no frame is ever incomplete.
``by_day``
    calendar windows. Rows are aggregated to (entity, day) first; the window
    runs over days, of which an entity has only a few thousand.

Entity keys and the time column must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.session import cut_lineage

CHUNK_ROWS = 1_000_000
_BUCKET = "__bucket"
RANGE = "__range"


class Timeline:
    """Entity keys, a total row order, and a coarse bucket that follows that order.

    ``order`` holds column names or sort expressions. ``bucket`` must be
    non-decreasing along ``order``; it is a column, a SQL expression or, by
    default, the first order column.
    """

    def __init__(self, keys: Sequence[str] | str, order: Sequence | str, bucket: Column | str | None = None):
        self.keys = (keys,) if isinstance(keys, str) else tuple(keys)
        self.order = (order,) if isinstance(order, str) else tuple(order)
        self._bucket = self.order[0] if bucket is None else bucket

    @property
    def bucket(self) -> Column:
        return F.expr(self._bucket) if isinstance(self._bucket, str) else self._bucket


@dataclass(frozen=True)
class Cumulative:
    """An aggregate that can be continued from a carried value."""

    kind: str
    expr: Column

    def aggregate(self, expr: Column | None = None) -> Column:
        expr = self.expr if expr is None else expr
        return {
            "sum": F.sum,
            "count": F.count,
            "min": F.min,
            "max": F.max,
            "product": F.product,
        }[self.kind](expr)

    def accumulate(self, totals: Column) -> Column:
        """Combine bucket totals: counts add up, everything else repeats itself."""
        return F.sum(totals) if self.kind == "count" else self.aggregate(totals)

    def merge(self, carried: Column, local: Column) -> Column:
        if self.kind == "count":
            return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        if self.kind == "min":
            return F.least(carried, local)
        if self.kind == "max":
            return F.greatest(carried, local)
        both = carried + local if self.kind == "sum" else carried * local
        return F.coalesce(both, carried, local)


def cum_sum(expr: Column) -> Cumulative:
    return Cumulative("sum", expr)


def cum_count(expr: Column | None = None) -> Cumulative:
    return Cumulative("count", F.lit(1) if expr is None else expr)


def cum_min(expr: Column) -> Cumulative:
    return Cumulative("min", expr)


def cum_max(expr: Column) -> Cumulative:
    return Cumulative("max", expr)


def cum_product(expr: Column) -> Cumulative:
    return Cumulative("product", expr)


def running(
    df: DataFrame,
    line: Timeline,
    aggs: dict[str, Cumulative],
    inclusive: bool = False,
    overall: dict[str, Cumulative] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add cumulative aggregates over all earlier rows (and this one if ``inclusive``).

    ``overall`` adds aggregates over the whole entity; they come from the bucket
    table at no extra cost. ``bounded`` declares that no entity can have many rows
    (for example a top-n per day over a calendar): then one plain window is used
    and the input is read once. The input is read twice otherwise, so materialise
    an expensive input first.
    """
    overall = overall or {}
    upto = 0 if inclusive else -1
    kept = [c for c in df.columns if c not in aggs and c not in overall]
    if bounded:
        whole = Window.partitionBy(*line.keys)
        frame = whole.orderBy(*line.order).rowsBetween(Window.unboundedPreceding, upto)
        zero = F.lit(0)
        return df.select(
            *kept,
            *[(F.coalesce(a.aggregate().over(frame), zero) if a.kind == "count" else a.aggregate().over(frame)).alias(n) for n, a in aggs.items()],
            *[a.aggregate().over(whole).alias(n) for n, a in overall.items()],
        )
    group = [*line.keys, _BUCKET]
    rows = df.withColumn(_BUCKET, line.bucket)
    totals = rows.groupBy(*group).agg(*[a.aggregate().alias(f"__t_{n}") for n, a in {**aggs, **overall}.items()])
    buckets = Window.partitionBy(*line.keys)
    earlier = buckets.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *group,
        *[a.accumulate(F.col(f"__t_{n}")).over(earlier).alias(f"__c_{n}") for n, a in aggs.items()],
        *[a.accumulate(F.col(f"__t_{n}")).over(buckets).alias(f"__o_{n}") for n, a in overall.items()],
    )
    inside = Window.partitionBy(*group).orderBy(*line.order).rowsBetween(Window.unboundedPreceding, upto)
    local = rows.select("*", *[a.aggregate().over(inside).alias(f"__l_{n}") for n, a in aggs.items()])
    return local.join(carry, group, "left").select(
        *kept,
        *[a.merge(F.col(f"__c_{n}"), F.col(f"__l_{n}")).alias(n) for n, a in aggs.items()],
        *[F.col(f"__o_{n}").alias(n) for n in overall],
    )


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """``df`` with ``__range``, a bucket for any order: the ranges of (keys, order) that Spark samples for a sort.

    Ranges hold about equally many rows whatever the values are, since the whole
    order decides, ties included. The frame is checkpointed, because the ranges of
    another run would differ.
    """
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()))


def short_histories(df: DataFrame, keys: Sequence[str], rows: int = CHUNK_ROWS) -> bool:
    """Whether no entity has more than ``rows`` rows, from one count: then ``bounded`` windows hold a chunk at most."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0]
    return (largest or 0) <= rows


def positions(df: DataFrame, line: Timeline, name: str = "pos", bounded: bool = False) -> DataFrame:
    """Zero-based row number inside the entity, exact for any group size."""
    return running(df, line, {name: cum_count()}, bounded=bounded)


def framed(
    df: DataFrame,
    line: Timeline,
    columns: Callable[..., dict[str, Column]],
    reach: int,
    chunk_rows: int = CHUNK_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Add window columns that look back at most ``reach`` rows.

    ``columns`` receives a window specification without a frame and returns the
    new columns; it may use ``lag(k)`` for k <= reach and ``rowsBetween(-k, ...)``.
    ``bounded``: no entity has more rows than a chunk, so a history is one chunk and
    the input is read and shuffled once.
    """
    if reach > chunk_rows:
        raise ValueError("chunk_rows must not be smaller than reach")
    if bounded:
        new = columns(Window.partitionBy(*line.keys).orderBy(*line.order))
        return df.select(*[c for c in df.columns if c not in new], *[c.alias(n) for n, c in new.items()])
    offset = F.col("__pos") % chunk_rows
    home = F.floor(F.col("__pos") / chunk_rows)
    copies = F.when(offset >= chunk_rows - reach, F.array(home, home + 1)).otherwise(F.array(home))
    spread = positions(df, line, "__pos").withColumn("__chunk", F.explode(copies))
    window = Window.partitionBy(*line.keys, "__chunk").orderBy("__pos")
    new = columns(window)
    kept = [c for c in df.columns if c not in new]
    return (
        spread.select("*", *[c.alias(f"__n_{n}") for n, c in new.items()])
        .where(F.col("__chunk") == home)
        .select(*kept, *[F.col(f"__n_{n}").alias(n) for n in new])
    )


def by_day(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    daily: dict[str, Column],
    columns: Callable[..., dict[str, Column]],
) -> DataFrame:
    """Add calendar-window columns computed on one row per (entity, day).

    ``daily`` are the per-day aggregates; ``columns`` receives a window over the
    days of one entity, ordered by the integer ``day`` column.
    """
    keys = list(keys)
    days = df.groupBy(*keys, day).agg(*[a.alias(n) for n, a in daily.items()])
    new = columns(Window.partitionBy(*keys).orderBy(day))
    feature = days.select(*keys, day, *[c.alias(n) for n, c in new.items()])
    return df.join(feature, [*keys, day], "left")
