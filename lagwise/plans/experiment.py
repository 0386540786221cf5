"""Walk-forward experiment: folds, models, ensemble, calibration, stakes, score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions.market import covered_side, priced_bets, settle
from lagwise.operators import calibration, ledger, models
from lagwise.operators.aggregates import mean_and_error
from lagwise.session import cut_lineage

MIN_BETS = 100


@dataclass(frozen=True)
class StakeRule:
    """Fixed values of selection and staking."""

    ev_threshold: float = 0.0
    fraction: float = 0.25
    cap: float = 0.05
    top_n: int = 5
    daily_exposure: float = 0.25


def score_of(mean: Column, error: Column, bets: Column) -> Column:
    """Mean flat return minus one standard error; -1 with too few bets."""
    return F.when(bets >= MIN_BETS, mean - error).otherwise(F.lit(-1.0))


def place_bets(rows: DataFrame, rule: StakeRule = StakeRule(), day: str = "game_date", key: str = "game_id") -> DataFrame:
    """Priced rows to selected, capped and settled bets with the day's bankroll.

    Needs pred_ensemble, sigma_ensemble, spread_signed, settle_signed, home_margin,
    payout_home, payout_away and optionally odds_matched and bettable.
    """
    priced = priced_bets(rows, rule.ev_threshold, rule.fraction, rule.cap)
    picked = ledger.select_daily(priced.where("bet_side <> 'NONE'"), [], day, F.abs("edge"), [key], rule.top_n)
    capped = ledger.cap_exposure(picked, [], day, "kelly", rule.daily_exposure)
    covered = covered_side(F.col("home_margin"), F.col("settle_signed"))
    bets = capped.withColumn("covered", covered)
    bets = bets.withColumn("pnl", settle(F.col("stake"), F.col("bet_side"), F.col("covered"), F.col("ph"), F.col("pa")))
    return ledger.attach_bankroll(bets, [], day, "pnl")


def score_bets(bets: DataFrame) -> DataFrame:
    """Flat-stake mean, error, count and score of selected bets, and the compound return."""
    flat = settle(F.lit(1.0), F.col("bet_side"), F.col("covered"), F.col("ph"), F.col("pa"))
    s = mean_and_error(bets, flat)
    end = bets.agg((F.coalesce(F.max_by("bankroll", "game_date"), F.lit(1.0)) - 1).alias("roi"))
    one = F.lit(1).alias("__one")
    j = s.select("*", one).join(F.broadcast(end.select("*", one)), "__one").drop("__one")  # one row each
    return j.select(
        F.col("mean").alias("flat_roi"), F.col("se").alias("flat_roi_se"), F.col("n").alias("n_bets"), "roi",
        score_of(F.col("mean"), F.col("se"), F.col("n")).alias("score"),
    )


def run_experiment(rows: DataFrame, features: Sequence[str], model_ids: Sequence[str], train_rows: int, test_rows: int, rule: StakeRule = StakeRule()) -> dict[str, DataFrame]:
    """Everything from the model table to the score; returns the stages by name."""
    oos, calendar = models.walk_forward(rows, "game_date", "game_id", features, model_ids, train_rows, test_rows)
    blended = models.ensembled(oos, "game_id")
    keep = ["game_id", "game_date", "home_margin", "spread_signed", "settle_signed", "payout_home", "payout_away", "odds_matched"]
    out = cut_lineage(blended.join(rows.select(*keep), "game_id"))
    out = calibration.calibrate_sigma(out)
    bets = place_bets(out, rule)
    return {"predictions": out, "folds": calendar, "bets": bets, "score": score_bets(bets)}
