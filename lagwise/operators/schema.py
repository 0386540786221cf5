"""Plan-time column work: aliases, renames, allow and deny lists, schema reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lagwise.operators.timeline import Timeline, positions

# Columns that carry the result of the row's own event.
LEAKY_EXACT = (
    "home_margin", "away_margin", "did_home_cover", "team_that_covered", "favorite_margin", "favorite_cover",
    "favorite_cover_numeric", "market_error", "abs_edge", "edge_rank_today", "edge_percentile_last_30_days",
    "model_error_roll_last20",
)
LEAKY_PREFIXES = ("pnl_", "cum_pnl_", "bet_win", "edge_", "error_")
# Name parts that never belong to a model feature.
DENY_PARTS = (
    "model_error", "market_error", "result", "outcome", "postgame", "pred_", "sigma_", "error_", "abs_error", "edge_",
    "kelly_", "pnl_", "cum_pnl", "bet_",
)


def resolve_aliases(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Add each canonical column from the first alias present; existing ones are kept."""
    have = set(df.columns)
    new = {}
    for target, names in aliases.items():
        source = next((n for n in names if n in have), None)
        if target not in have and source is not None:
            new[target] = F.col(source)
    return df.withColumns(new) if new else df


def snake_case(name: str) -> str:
    """camelCase to snake_case."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def family_columns(df: DataFrame, keys: Sequence[str], family: str) -> DataFrame:
    """Keys as they are, numeric columns as ``family_snake_name``, everything else dropped."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in keys]
    return df.select(*keys, *[F.col(c).alias(f"{family}_{snake_case(c)}") for c in numeric])


def column_or_null(df: DataFrame, name: str) -> Column:
    """Numeric column, or null when the table does not have it."""
    return F.col(name).try_cast("double") if name in df.columns else F.lit(None).cast("double")


def fill_trusted(df: DataFrame, columns: Sequence[str], trusted: Column) -> DataFrame:
    """Nulls become 0 in rows of a trusted source, where a missing figure means none; other rows keep theirs, also where ``trusted`` is null."""
    return df.withColumns({c: F.when(trusted, F.coalesce(F.col(c), F.lit(0))).otherwise(F.col(c)) for c in columns})


def feature_names(
    columns: Sequence[str], allow: Sequence[str], deny: Sequence[str] = (), deny_parts: Sequence[str] = DENY_PARTS,
    include: Sequence[str] = (), exclude: Sequence[str] = (),
) -> list[str]:
    """Allowed names that are present; exact and part denials win, also over extra inclusions."""
    banned = set(deny) | set(exclude)
    wanted = [c for c in [*allow, *include] if c in set(columns)]
    return sorted({c for c in wanted if c not in banned and not any(p in c.lower() for p in deny_parts)})


def keep_and_match(columns: Sequence[str], keep: Sequence[str], prefixes: Sequence[str], suffixes: Sequence[str]) -> list[str]:
    """The keep list (if present) then every prefix x suffix match, in table order, once each."""
    matched = [c for c in columns if c.startswith(tuple(prefixes)) and c.endswith(tuple(suffixes))]
    return list(dict.fromkeys([c for c in keep if c in set(columns)] + matched))


def is_leaky(name: str) -> bool:
    n = name.strip().lower()
    return n in LEAKY_EXACT or n.startswith(LEAKY_PREFIXES)


def feature_manifest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: numeric?, leaky?, included?, non-null rows, reason. One pass over the data."""
    kinds = {f.name: isinstance(f.dataType, NumericType) for f in df.schema.fields}

    def row(c: str) -> Column:
        numeric, leaky = kinds[c], is_leaky(c)
        reason = "excluded_leakage" if leaky else "ok" if numeric else "excluded_non_numeric"
        return F.struct(
            F.lit(c).alias("column"), F.lit(numeric).alias("is_numeric"), F.lit(leaky).alias("is_leaky"),
            F.lit(numeric and not leaky).alias("include_for_factor_slicing"),
            F.col(f"__n_{c}").alias("non_null_rows"), F.lit(reason).alias("reason"),
        )

    counts = df.agg(*[F.count(c).alias(f"__n_{c}") for c in columns])
    return counts.select(F.explode(F.array(*[row(c) for c in columns])).alias("r")).select("r.*")


def schema_report(df: DataFrame, hard: Sequence[str], soft: Sequence[str], strict: bool = False) -> DataFrame:
    """Presence of required columns; a name ending in ``*`` stands for any column with that prefix."""
    def present(name: str) -> bool:
        return any(c.startswith(name[:-1]) for c in df.columns) if name.endswith("*") else name in df.columns

    missing = [c for c in hard if not present(c)]
    if strict and missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    rows = [(c, True, present(c), "error") for c in hard] + [(c, False, present(c), "warning") for c in soft]
    return df.sparkSession.createDataFrame(rows, "column string, is_hard_required boolean, present boolean, severity string")


def assign_ids(
    new: DataFrame, known: DataFrame, season: str, order: Sequence[str], known_id: str, base: Column, known_season: Column, name: str = "game_id"
) -> DataFrame:
    """Continue each season's reserved id range: the highest known id (or ``base``), then +1 per new row.

    ``base`` is an expression over the season column of ``new``; ``known_season``
    gives the season a known id was reserved for, or null for other ids.
    """
    top = known.where(known_season.isNotNull()).groupBy(known_season.alias(season)).agg(F.max(known_id).alias("__last"))
    placed = positions(new, Timeline(season, order), "__p")
    last = F.coalesce(F.col("__last"), base)
    return placed.join(top, season, "left").withColumn(name, last + 1 + F.col("__p")).drop("__last", "__p")
