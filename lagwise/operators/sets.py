"""Reshaping and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def team_view(df: DataFrame, same: Sequence[str], home: dict[str, Column], away: dict[str, Column]) -> DataFrame:
    """Two rows per game from one scan: a struct per side, exploded."""
    if list(home) != list(away):
        raise ValueError("both sides need the same columns in the same order")
    sides = F.array(
        F.struct(*[c.alias(n) for n, c in home.items()]),
        F.struct(*[c.alias(n) for n, c in away.items()]),
    )
    return df.select(*same, F.explode(sides).alias("__side")).select(*same, "__side.*")


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


#: Rows of both sides that a task sorts for a join.
DEALT_ROWS = 2_000_000


def dealt_alike(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int = DEALT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both frames dealt out by ``keys`` to so many tasks that one meets about ``rows`` rows of both; few rows stay as they are.

    Joins on the keys then need no shuffle of their own, and Spark, which judges by compressed bytes, merges no tasks.
    """
    parts = -(-(left.count() + right.count()) // rows)
    if parts <= 1:
        return left, right
    return left.repartition(parts, *keys), right.repartition(parts, *keys)


def key_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of either side with its status: both, left_only, right_only."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(1))
    status = (
        F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), "both")
        .when(F.col("__l").isNotNull(), "left_only")
        .otherwise("right_only")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence, keep: str = "last") -> DataFrame:
    """One row per key. The ``= 1`` filter lets Spark keep a single row per key
    before the shuffle, so a key with very many copies costs nothing extra.
    ``order`` must be a total order of the copies."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranked = [c.desc() for c in cols] if keep == "last" else [c.asc() for c in cols]
    w = Window.partitionBy(*keys).orderBy(*ranked)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def merge_newer(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union by key where a new row replaces the old one and other old rows stay."""
    both = union_by_name(old.withColumn("__new", F.lit(0)), new.withColumn("__new", F.lit(1)))
    return latest(both, keys, ["__new", *order]).drop("__new")


def model_rows(
    df: DataFrame, same: Sequence[str], stems: Sequence[str], models: Sequence[str] | None = None, id_name: str = "model"
) -> DataFrame:
    """Columns ``<stem>_<model>`` to one row per model; a stem a model lacks becomes null.

    Without ``models`` they are the suffixes the schema has for the first stem.
    """
    lead = stems[0] + "_"
    models = models or [c[len(lead):] for c in df.columns if c.startswith(lead)]
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def column(stem: str, model: str) -> Column:
        kind = next((kinds[f"{stem}_{m}"] for m in models if f"{stem}_{m}" in kinds), "double")
        value = F.col(f"{stem}_{model}") if f"{stem}_{model}" in kinds else F.lit(None)
        return value.cast(kind).alias(stem)

    rows = F.array(*[F.struct(F.lit(m).alias(id_name), *[column(s, m) for s in stems]) for m in models])
    return df.select(*same, F.explode(rows).alias("__m")).select(*same, "__m.*")


def any_model_filter(df: DataFrame, side_stem: str = "bet_side", pnl_stem: str = "pnl_kelly") -> DataFrame:
    """Rows on which at least one model bets; the P&L decides where no side column exists."""
    suffixes = sorted({c[len(pnl_stem) + 1:] for c in df.columns if c.startswith(pnl_stem + "_")})
    keep = F.lit(False)
    for s in suffixes:
        if f"{side_stem}_{s}" in df.columns:
            keep = keep | (F.coalesce(F.col(f"{side_stem}_{s}"), F.lit("NO BET")) != "NO BET")
        else:
            keep = keep | (F.coalesce(F.col(f"{pnl_stem}_{s}"), F.lit(0.0)) != 0)
    return df.where(keep)
