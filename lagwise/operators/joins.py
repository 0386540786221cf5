"""Join operators: side attach, opponent, as-of, two-phase match, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.operators.ranking import with_group
from lagwise.operators.sets import latest
from lagwise.operators.timeline import Timeline, cum_max, running


def attach_side(games: DataFrame, features: DataFrame, side: str, key: str, entity: str, columns: Sequence[str]) -> DataFrame:
    """Left join of entity features onto one side of a game, renamed with the side's prefix."""
    f = features.select(key, F.col(entity).alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    return games.join(f, [key, side], "left")


def sides_to_wide(long: DataFrame, key: str, is_home: Column, columns: Sequence[str]) -> DataFrame:
    """One row per side to one row per game, in one aggregation."""
    return long.groupBy(key).agg(
        *[F.max(F.when(is_home, F.col(c))).alias(f"home_{c}") for c in columns],
        *[F.max(F.when(~is_home, F.col(c))).alias(f"away_{c}") for c in columns],
    )


def opponent_rows(df: DataFrame, game: str, team: str, columns: Sequence[str]) -> DataFrame:
    """Each team's row with the other team's values as ``<col>_opp``.

    A game has two rows (``require_count`` checks it). Both sides are reduced to one
    row per game before the join, so a game never multiplies its rows by themselves.
    """
    side = F.struct(F.col(team).alias("t"), *columns)
    both = df.groupBy(game).agg(F.min(side).alias("__lo"), F.max(side).alias("__hi")).where("__lo.t <> __hi.t")
    other = F.when(F.col(team) == F.col("__lo.t"), F.col("__hi")).otherwise(F.col("__lo"))
    j = df.join(both, game).withColumn("__o", other)
    return j.select(*df.columns, F.col("__o.t").alias("opp_team"), *[F.col(f"__o.{c}").alias(f"{c}_opp") for c in columns])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """Stop when a key repeats; returns the input."""
    bad = duplicate_keys(df, keys).limit(3).collect()
    if bad:
        raise ValueError(f"{what}: key {list(keys)} repeats, e.g. {bad}")
    return df


def require_count(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Stop unless every key has exactly ``rows`` rows."""
    bad = df.groupBy(*keys).count().where(F.col("count") != rows).limit(3).collect()
    if bad:
        raise ValueError(f"key {list(keys)} does not have {rows} rows each, e.g. {bad}")
    return df


def contract_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", contract: str = "m:1") -> DataFrame:
    """Join that refuses to multiply rows: ``m:1`` or ``1:1``."""
    if contract not in ("m:1", "1:1"):
        raise ValueError("contract must be m:1 or 1:1")
    require_unique(right, keys, "right side")
    if contract == "1:1":
        require_unique(left, keys, "left side")
    return left.join(right, list(keys), how)


def two_phase_match(
    left: DataFrame, right: DataFrame, primary: Sequence[str], fallback: Sequence[str], values: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Match on the primary key; rows without any value try the fallback key. ``order`` breaks duplicate keys."""
    first = latest(right.where(_all_known(primary)), primary, order)
    first = first.select(*primary, *[F.col(v).alias(f"__p_{v}") for v in values])
    second = latest(right.where(_all_known(fallback)), fallback, order)
    second = second.select(*fallback, *[F.col(v).alias(f"__f_{v}") for v in values])
    j = left.join(first, list(primary), "left").join(second, list(fallback), "left")
    hit = F.coalesce(*[F.col(f"__p_{v}").cast("string") for v in values]).isNotNull()
    alt = F.coalesce(*[F.col(f"__f_{v}").cast("string") for v in values]).isNotNull()
    how = F.when(hit, "primary").when(alt, "fallback").otherwise("none")
    return j.select(
        *left.columns,
        *[F.when(hit, F.col(f"__p_{v}")).otherwise(F.col(f"__f_{v}")).alias(v) for v in values],
        how.alias("match"),
    )


def _all_known(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def merge_families(frames: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of metric families; repeated keys inside a family are averaged first."""
    out = None
    for family, df in frames.items():
        metrics = [c for c in df.columns if c not in keys]
        part = df.groupBy(*keys).agg(*[F.avg(m).alias(f"{family}_{m}") for m in metrics])
        out = part if out is None else out.join(part, list(keys), "full_outer")
    return out


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
    payload: Sequence[str], tie: Sequence[str] = (), prefix: str = "asof_", bucket: str = "day",
) -> DataFrame:
    """Last right row at or before the left time, per key; ties by time then ``tie``.

    Both sides are put on one timeline and the newest quote is carried forward as
    a running maximum. No pair of rows is ever formed, so a hot key is cheap.
    """
    quote = F.struct(F.col(right_time).alias("__at"), *[F.col(c) for c in tie], *[F.col(c) for c in payload if c not in tie])
    kind = right.select(quote.alias("q")).schema["q"].dataType
    seeker = F.struct(*[F.col(c) for c in left.columns])
    seeker_kind = left.select(seeker.alias("s")).schema["s"].dataType
    lefts = left.select(
        *keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), seeker.alias("__left"), F.lit(None).cast(kind).alias("__q")
    )
    rights = right.select(
        *keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(seeker_kind).alias("__left"), quote.alias("__q")
    )
    line = Timeline(keys, ("__t", "__side"), F.date_trunc(bucket, F.col("__t")))
    out = running(lefts.unionByName(rights), line, {"__last": cum_max(F.col("__q"))}, inclusive=True)
    return out.where("__side = 1").select(
        "__left.*",
        F.col("__last.__at").alias(f"{prefix}time"),
        *[F.col(f"__last.{c}").alias(f"{prefix}{c}") for c in payload],
    )


def asof_at_horizons(
    events: DataFrame, quotes: DataFrame, keys: Sequence[str], event_time: str, quote_time: str, bid: str, ask: str,
    tie: Sequence[str], hours: Sequence[int], max_age_hours: float, max_width: float,
) -> DataFrame:
    """Last two-sided quote at least h hours before each event, for several h at once.

    Only quotes at most ``max_age_hours`` older than the cutoff and at most
    ``max_width`` wide count.
    """
    cuts = events.withColumn("h", F.explode(F.array(*[F.lit(h) for h in hours])))
    cuts = cuts.withColumn("cutoff", F.timestamp_micros(F.unix_micros(event_time) - F.col("h") * F.lit(3_600_000_000)))
    two_sided = quotes.where(F.col(bid).isNotNull() & F.col(ask).isNotNull())
    found = asof(cuts, two_sided, keys, "cutoff", quote_time, [bid, ask], tie)
    age = (F.unix_micros("cutoff") - F.unix_micros("asof_time")) / 3.6e9
    return found.where((age <= max_age_hours) & (F.col(f"asof_{ask}") - F.col(f"asof_{bid}") <= max_width))


def period_attribute(games: DataFrame, attributes: DataFrame, period: Sequence[str], entity: str, value: str, sides=("home", "away"), missing=0) -> DataFrame:
    """Attach a per-period entity attribute to both sides of a game; missing becomes ``missing``."""
    out = games
    for side in sides:
        a = attributes.select(*period, F.col(entity).alias(side), F.col(value).alias(f"{side}_{value}"))
        out = out.join(a, [*period, side], "left").withColumn(f"{side}_{value}", F.coalesce(f"{side}_{value}", F.lit(missing)))
    return out


def match_unique_names(new: DataFrame, known: DataFrame, name: str, known_id: str, external_id: str, offset: int) -> DataFrame:
    """Use the known id when the name belongs to exactly one known entity, else the offset external id."""
    single = known.groupBy(name).agg(F.min(known_id).alias("__a"), F.max(known_id).alias("__b")).where("__a = __b")
    j = new.join(single.select(name, F.col("__a").alias("__id")), name, "left")
    return j.withColumn("entity_id", F.coalesce("__id", F.col(external_id) + offset)).drop("__id")


def groups_with_set(df: DataFrame, group: Sequence[str], code: str, expected: DataFrame, expected_set: str) -> DataFrame:
    """Groups whose set of codes equals the expected array; ``expected`` holds one row per group."""
    found = df.select(*group, code).distinct().groupBy(*group).agg(F.array_sort(F.collect_set(code)).alias("__codes"))
    want = expected.withColumn("__want", F.array_sort(expected_set)).drop(expected_set)
    return found.join(want, list(group)).where("__codes = __want").drop("__codes", "__want")


def attach_features(base: DataFrame, features: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Attach only new columns, one row per key; also returns a one-row match report."""
    usable = features.where(F.col(key).isNotNull())
    single = latest(usable, [key], order, keep="first")
    new = [c for c in features.columns if c != key and c not in base.columns]
    out = base.join(single.select(key, *new), key, "left")
    any_value = F.coalesce(*[F.col(c).cast("string") for c in new]).isNotNull() if new else F.lit(False)
    report = out.agg(
        F.count(F.lit(1)).alias("model_rows"),
        F.count(key).alias("rows_with_join_key"),
        F.count(F.when(any_value, 1)).alias("rows_with_any_feature_match"),
        F.avg(any_value.cast("int")).alias("feature_match_rate"),
    )
    return out, report


def with_parameters(df: DataFrame, rows: Sequence[dict], name: str = "p") -> DataFrame:
    """Every row with every parameter set: an exploded literal array, not a cross join."""
    def literal(v) -> Column:
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)

    kinds: dict[str, str] = {}
    for row in rows:
        for key, v in row.items():
            if v is None:
                continue
            kind = (
                "array<string>" if isinstance(v, (list, tuple)) else "boolean" if isinstance(v, bool)
                else "double" if isinstance(v, float) else "bigint" if isinstance(v, int) else "string"
            )
            kinds[key] = "double" if {kinds.get(key), kind} == {"double", "bigint"} else kind
    sets = F.array(*[F.struct(*[literal(row.get(k)).cast(t).alias(k) for k, t in kinds.items()]) for row in rows])
    return df.withColumn(name, F.explode(sets))


def share_of_group(df: DataFrame, keys: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Value over the group total; a total of 0 gives null."""
    out = with_group(df, keys, {"__total": F.sum(value)})
    return out.withColumn(name, F.col(value) / F.nullif(F.col("__total").cast("double"), F.lit(0.0))).drop("__total")
