"""Prices, expected value, stakes and settlement as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagwise.functions.numeric import clip, normal_cdf

# Default price, its payout, and the penalty weight of each match tier.
DEFAULT_AMERICAN = -110.0
DEFAULT_PAYOUT = 100.0 / 110.0


def signed_handicap(favourite: Column, spread: Column) -> Column:
    """Home handicap: negative when home is the favourite; a missing line stays null."""
    return F.when(F.coalesce(favourite == "home", F.lit(False)), -spread).otherwise(spread)


def blended_line(model_line: Column, book_line: Column) -> dict[str, Column]:
    """Settlement line (book if present) and model line (mean of both if both exist).

    ``book_line`` is the home margin the book implies, hence the sign change.
    """
    settle = F.coalesce(-book_line, model_line)
    blended = F.when(book_line.isNotNull(), (model_line + settle) / 2).otherwise(model_line)
    return {"settle_signed": settle, "spread_signed": blended}


def american_payout(price: Column) -> Column:
    """Profit per unit staked; 0 and null have none."""
    return F.when(price < 0, 100.0 / F.abs(price)).when(price > 0, price / 100.0)


def repaired_prices(home: Column, away: Column, default: float = DEFAULT_AMERICAN) -> tuple[Column, Column]:
    """A missing side takes the other side's price, then the default."""
    fallback = F.lit(float(default))
    return F.coalesce(home, away, fallback), F.coalesce(away, home, fallback)


def valid_payout(price: Column, default: float = DEFAULT_PAYOUT) -> Column:
    p = american_payout(price)
    return F.when(p > 0, p).otherwise(F.lit(default))


def first_with_source(columns: Sequence[str]) -> tuple[Column, Column]:
    """First non-null column and its name."""
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])
    return F.coalesce(*[F.col(c) for c in columns]), source


def odds_tier(in_join: Column, home: Column, away: Column) -> Column:
    """matched / mirrored / default / unmatched, from the raw (unrepaired) prices."""
    return (
        F.when(~F.coalesce(in_join, F.lit(False)), "unmatched")
        .when(home.isNotNull() & away.isNotNull(), "matched")
        .when(home.isNotNull() | away.isNotNull(), "mirrored")
        .otherwise("default")
    )


def devig(decimal_home: Column, decimal_away: Column) -> tuple[Column, Column]:
    """Fair home probability and overround of decimal prices."""
    over = 1 / decimal_home + 1 / decimal_away
    return (1 / decimal_home) / over, over


def expected_values(p_home: Column, payout_home: Column, payout_away: Column) -> tuple[Column, Column]:
    return p_home * payout_home - (1 - p_home), (1 - p_home) * payout_away - p_home


def choose_side(ev_home: Column, ev_away: Column, threshold: float) -> Column:
    return F.when(ev_home > threshold, "HOME").when(ev_away > threshold, "AWAY").otherwise("NONE")


def kelly_fraction(p_home: Column, side: Column, payout_home: Column, payout_away: Column) -> Column:
    """Full Kelly fraction of the chosen side (may be negative); no side is 0."""
    home = (p_home * (payout_home + 1) - 1) / payout_home
    away = ((1 - p_home) * (payout_away + 1) - 1) / payout_away
    return F.when(side == "HOME", home).when(side == "AWAY", away).otherwise(F.lit(0.0))


def priced_bets(df, ev_threshold: float, fraction: float, cap: float):
    """Win probability, both expected values, side and stake from a predicted margin.

    Reads pred_ensemble, spread_signed, sigma_ensemble, payout_home, payout_away
    and, when present, the flags odds_matched and bettable.
    """
    sigma = F.coalesce(F.nullif(F.col("sigma_ensemble"), F.lit(0.0)), F.lit(1.0))
    df = df.withColumn("edge", F.col("pred_ensemble") + F.col("spread_signed"))
    # out of an explode the probability is worked out once; Spark would copy it into every column and filter that reads it
    df = df.withColumn("z", F.col("edge") / sigma).withColumn("win_prob", F.explode(F.array(normal_cdf(F.col("z")))))
    df = df.withColumns({"ph": clip(F.col("payout_home"), 0.01), "pa": clip(F.col("payout_away"), 0.01)})
    ev_home, ev_away = expected_values(F.col("win_prob"), F.col("ph"), F.col("pa"))
    df = df.withColumn("ev_home", ev_home).withColumn("ev_away", ev_away)
    side = choose_side(F.col("ev_home"), F.col("ev_away"), ev_threshold)
    for flag in ("odds_matched", "bettable"):
        if flag in df.columns:
            side = F.when(F.coalesce(F.col(flag), F.lit(False)), side).otherwise(F.lit("NONE"))
    df = df.withColumn("bet_side", side)
    df = df.withColumn("raw", kelly_fraction(F.col("win_prob"), F.col("bet_side"), F.col("ph"), F.col("pa")) * fraction)
    return df.withColumn("kelly", clip(F.col("raw"), 0.0, cap)).drop("z", "raw")


def covered_side(home_margin: Column, handicap: Column) -> Column:
    """HOME, AWAY or PUSH against the line; a missing line settles as AWAY, never as a push."""
    return (
        F.when(home_margin == -handicap, "PUSH")
        .when(home_margin > -handicap, "HOME")
        .otherwise("AWAY")
    )


def settle(stake: Column, side: Column, covered: Column, payout_home: Column, payout_away: Column) -> Column:
    """Win pays stake x payout, loss costs the stake, push and no bet are 0."""
    payout = F.when(side == "HOME", payout_home).otherwise(payout_away)
    return (
        F.when((side == "NONE") | (covered == "PUSH"), 0.0)
        .when(covered == side, stake * payout)
        .otherwise(-stake)
    )


def favourite_side(handicap: Column) -> Column:
    return F.when(handicap < 0, "HOME").when(handicap > 0, "AWAY").otherwise("PICKEM")


def bet_type(side: Column, favourite: Column) -> Column:
    return F.when(favourite == "PICKEM", "pickem").when(side == favourite, "favorite").otherwise("underdog")


def band(x: Column, edges: Sequence[float], labels: Sequence[str], right_closed: bool = True) -> Column:
    """Fixed-edge bins with open ends; ``labels`` has one more entry than ``edges``."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one more label than edges")
    out = None
    for edge, label in zip(edges, labels):
        inside = (x <= edge) if right_closed else (x < edge)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return F.when(x.isNotNull(), out.otherwise(labels[-1]))


# Penalty weight of each market-match tier.
MATCH_WEIGHTS = {
    "tier_a_market": 1.00,
    "tier_b_moneyline": 0.92,
    "tier_c_mirrored": 0.80,
    "tier_d_default": 0.65,
    "tier_e_unknown": 0.75,
}


def price_tag(source: Column, price: Column) -> Column:
    """Provenance tag of one side from its source column name and its repaired price."""
    return (
        F.when(source.isNull() | (source == ""), F.when(price == DEFAULT_AMERICAN, "default_-110").otherwise("mirrored"))
        .when(F.startswith(source, F.lit("moneyline")), "moneyline")
        .otherwise("spread_or_market")
    )


def match_tier(label: Column, used_default: Column) -> Column:
    """Five match tiers from the provenance label of both sides."""
    text = F.lower(label)
    return (
        F.when(F.coalesce(used_default, F.lit(False)), "tier_d_default")
        .when(F.contains(text, F.lit("mirrored")), "tier_c_mirrored")
        .when(F.contains(text, F.lit("moneyline")), "tier_b_moneyline")
        .when(F.contains(text, F.lit("spread_or_market")), "tier_a_market")
        .otherwise("tier_e_unknown")
    )


def match_weight(tier: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in MATCH_WEIGHTS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, tier), F.lit(MATCH_WEIGHTS["tier_e_unknown"]))


def objective_score(edge: Column, ev: Column, risk: Column, median_risk: Column, kelly: Column, penalised: Column, weight: Column) -> Column:
    """Ranking signal: expected value (else the absolute edge), divided by a risk penalty when asked for."""
    typical = F.when(median_risk > 0, median_risk).otherwise(F.lit(1.0))
    norm = clip(F.coalesce(F.abs(risk) / typical, F.lit(1.0)), 0.5, 3.0)
    signal = F.when(F.coalesce(ev, F.lit(0.0)) == 0, F.coalesce(F.abs(edge), F.lit(0.0))).otherwise(ev)
    penalty = 1.0 + weight * norm + weight * F.coalesce(kelly, F.lit(0.0))
    return F.when(penalised, signal / penalty).otherwise(signal)
