"""Audits: is a feature table free of the future, complete, unchanged?"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lagwise.operators.aggregates import permuted


def numeric_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in but]


def differs(a: Column, b: Column, rtol: float = 1e-7, atol: float = 1e-7) -> Column:
    """Not close; null equals null only."""
    close = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return ~F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


def compare_builds(full: DataFrame, rebuilt: DataFrame, keys: Sequence[str], skip: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """One row per numeric column: rows compared, rows that differ, largest difference; plus missing keys.

    One join and one aggregation over all columns, for each group ``by`` of the full build's rows if any.
    """
    cols = [c for c in numeric_columns(full, [*keys, *by, *skip]) if c in rebuilt.columns]
    a = full.select(*keys, *by, *[F.col(c).cast("double").alias(f"a_{c}") for c in cols], F.lit(1).alias("__a"))
    b = rebuilt.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in cols], F.lit(1).alias("__b"))
    j = a.join(b, list(keys), "left")
    both = F.col("__b").isNotNull()
    aggs = [F.count(F.when(both, 1)).alias("__rows"), F.count(F.when(~both, 1)).alias("__missing")]
    for c in cols:
        bad = both & differs(F.col(f"a_{c}"), F.col(f"b_{c}"))
        aggs += [F.count(F.when(bad, 1)).alias(f"n_{c}"), F.max(F.when(bad, F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")))).alias(f"x_{c}")]
    one = j.groupBy(*by).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("__rows").alias("rows"), F.col("__missing").alias("missing_keys"),
                 F.col(f"n_{c}").alias("differing"), F.col(f"x_{c}").alias("max_difference"))
        for c in cols
    ])
    return one.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def point_in_time_audit(
    games: DataFrame, build: Callable[[DataFrame], DataFrame], date: str, on, outcomes: Sequence[str], key: str, keys: Sequence[str],
    skip: Sequence[str] = (), seed: int = 0,
) -> DataFrame:
    """Rebuild with data up to a day whose outcomes are shuffled; that day's features must not move."""
    day = F.lit(on).cast("date")
    past = games.where(F.col(date) < day)
    today = games.where(F.col(date) == day)
    mixed = today
    for i, c in enumerate(outcomes):
        mixed = permuted(mixed, c, key, seed + 10 * i, f"__{c}")
    mixed = mixed.select(*[(F.col(f"__{c}") + (1 if c == outcomes[0] else 0)).alias(c) if c in outcomes else F.col(c) for c in games.columns])
    full = build(games).where(F.col(date) == day)
    again = build(past.unionByName(mixed)).where(F.col(date) == day)
    return compare_builds(full, again, keys, [*outcomes, *skip])


def outcome_flip(df: DataFrame, date: str, on, home: str, away: str) -> DataFrame:
    """The same games with the scores of one day swapped."""
    day = F.col(date) == F.lit(on).cast("date")
    return df.withColumn("__h", F.when(day, F.col(away)).otherwise(F.col(home))).withColumn(
        away, F.when(day, F.col(home)).otherwise(F.col(away))
    ).withColumn(home, F.col("__h")).drop("__h")


def linear_leak_screen(df: DataFrame, target: Column, base: Column, features: Sequence[str], factor: float = 4.0) -> DataFrame:
    """Gain in R-squared of each feature over the base alone, from one pass of sums.

    Flags gains above median + factor x 1.4826 x MAD over the screened features.
    """
    t, b = target.cast("double"), base.cast("double")
    aggs = []
    for c in features:
        x = F.col(c).cast("double")
        ok = t.isNotNull() & b.isNotNull() & x.isNotNull()
        y, z, v = F.when(ok, t), F.when(ok, b), F.when(ok, x)
        aggs += [
            F.corr(y, z).alias(f"yb_{c}"), F.corr(y, v).alias(f"yx_{c}"), F.corr(z, v).alias(f"bx_{c}"),
        ]
    one = df.agg(*aggs)

    def gain(c: str) -> Column:
        yb, yx, bx = F.col(f"yb_{c}"), F.col(f"yx_{c}"), F.coalesce(F.nanvl(F.col(f"bx_{c}"), F.lit(0.0)), F.lit(0.0))
        both = (yb * yb + yx * yx - 2 * yb * yx * bx) / F.nullif(1 - bx * bx, F.lit(0.0))
        return both - yb * yb

    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.nanvl(gain(c), F.lit(None)).alias("d_r2")) for c in features])
    rows = one.select(F.explode(cells).alias("e")).select("e.*").where("d_r2 IS NOT NULL")
    return flag_outliers(rows, "d_r2", factor)


def flag_outliers(rows: DataFrame, value: str, factor: float = 4.0) -> DataFrame:
    """``rows``, one per feature, with ``median, mad, cutoff, flagged``: is the value above median + factor x 1.4826 x MAD?

    A missing value is never flagged. The table of features is small: it goes through one row.
    """
    one = rows.agg(F.collect_list(F.struct(*[F.col(c) for c in rows.columns])).alias("cells"))

    def median(values: Column) -> Column:
        ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
        n = F.size(ordered)
        return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2

    one = one.withColumn("median", median(F.transform("cells", lambda e: e[value])))
    one = one.withColumn("mad", median(F.transform("cells", lambda e: F.abs(e[value] - F.col("median")))))
    one = one.withColumn("cutoff", F.col("median") + factor * 1.4826 * F.col("mad"))
    out = one.select(F.explode("cells").alias("e"), "median", "mad", "cutoff").select("e.*", "median", "mad", "cutoff")
    return out.withColumn("flagged", F.coalesce(F.col(value) > F.col("cutoff"), F.lit(False)))


def with_slate_stubs(games: DataFrame, slate: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """History plus rows of a coming slate whose outcomes are unknown."""
    stubs = slate.drop(*[c for c in outcomes if c in slate.columns])
    return games.unionByName(stubs, allowMissingColumns=True)


def slate_features(games: DataFrame, slate: DataFrame, build: Callable[[DataFrame], DataFrame], date: str, key: str, outcomes: Sequence[str]) -> DataFrame:
    """Features of a coming slate from the same builder; stops when a slate row gets lost."""
    dates = slate.select(date).distinct()
    out = build(with_slate_stubs(games, slate, outcomes)).join(dates, date, "left_semi")
    lost = slate.join(out, key, "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"slate rows without features: {[r[key] for r in lost]}")
    return out


def require_parity(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Stop when two builds do not have the same keys and values."""
    only = left.select(*keys).join(right.select(*keys), list(keys), "left_anti").limit(1).count()
    only += right.select(*keys).join(left.select(*keys), list(keys), "left_anti").limit(1).count()
    bad = compare_builds(left, right, keys).where("differing > 0").collect()
    if only or bad:
        raise ValueError(f"builds disagree: unmatched keys={bool(only)}, columns={[r['column'] for r in bad]}")


def content_hash(columns: Sequence[str]) -> Column:
    """Hash of a row by column name and value. A column that is null, or absent, adds nothing, so it does not matter
    whether other files of a table have more columns; a value that moves to another column or row shows."""
    cells = [F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.lit(c), F.col(f"`{c}`"))).otherwise(F.lit(0).cast("long")) for c in sorted(columns)]
    mixed = cells[0] if cells else F.lit(0).cast("long")
    for cell in cells[1:]:
        mixed = mixed.bitwiseXOR(cell)
    return F.xxhash64(mixed)


def fingerprint(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row count and an order-free content fingerprint, in one aggregate, for the whole table or for each ``keys``."""
    own = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(content_hash(own).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def require_children(parents: DataFrame, children: DataFrame, keys: Sequence[str]) -> None:
    """Stop unless every parent has at least one child row."""
    missing = parents.join(children, list(keys), "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"parents without children, e.g. {missing}")
