"""Strategy sweep: every parameter set and model in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.functions.market import kelly_fraction, objective_score, settle
from lagwise.functions.numeric import clip
from lagwise.operators import ledger
from lagwise.operators.joins import with_parameters
from lagwise.operators.ranking import attach, quantiles
from lagwise.operators.timeline import Timeline
from lagwise.session import cut_lineage


#: Rows with parameters that a task sorts to find the best of each day.
SWEEP_ROWS = 2_000_000


def _spread(bets: DataFrame, sets: int, rows: int = SWEEP_ROWS) -> DataFrame:
    """``bets`` over so many tasks that each meets at most about ``rows`` of them times the parameter ``sets``."""
    n, parts = bets.select(F.spark_partition_id().alias("p")).agg(F.count("p"), F.count_distinct("p")).first()
    return bets if n * sets <= rows * parts else bets.repartition(-(-n * sets // rows), "game_id")


def strategy_selection(bets: DataFrame, strategies: Sequence[dict]) -> DataFrame:
    """Gate, scale, score and rank: the selected bets of each (strategy, model, day).

    Strategy fields: strategy_id, kelly_scale, kelly_cap, top_n, exposure,
    penalised, weight, skip_default, tiers, max_daily_loss, min_edge.
    """
    largest = max(s["top_n"] for s in strategies)
    bets = cut_lineage(bets)  # read for the median, and once more for the sweep
    median = quantiles(bets, ["model"], F.abs("pred_ensemble"), {"__median": 0.5})
    base = attach(_spread(bets, len(strategies)), F.broadcast(median), ["model"])  # one row per model; a shuffle by model makes one task of each
    j = with_parameters(base, strategies)
    full = kelly_fraction(F.col("win_prob"), F.col("bet_side"), F.col("payout_home"), F.col("payout_away"))
    j = j.withColumn("full", full).withColumn("full", clip(F.col("full"), 0.0, 1.0))
    j = j.withColumn("k", clip(F.col("full") * F.col("p.kelly_scale"), 0.0, F.col("p.kelly_cap")))
    allowed = F.lit(True)
    if any(s.get("tiers") for s in strategies):
        allowed = F.col("p.tiers").isNull() | F.array_contains("p.tiers", F.col("tier"))
    j = j.where(
        (F.col("bet_side") != "NONE") & (F.col("k") > 0) & (F.abs("edge") >= F.col("p.min_edge"))
        & ~(F.col("p.skip_default") & F.col("tier").isin("default", "unmatched")) & allowed
    )
    ev = F.when(F.col("bet_side") == "HOME", F.col("ev_home")).otherwise(F.col("ev_away"))
    score = objective_score(F.col("edge"), ev, F.abs("pred_ensemble"), F.col("__median"), F.col("k"), F.col("p.penalised"), F.col("p.weight"))
    j = j.withColumn("score", F.round(score, 9)).withColumn("strategy_id", F.col("p.strategy_id"))
    ranked = ledger.select_daily(j, ["strategy_id", "model"], "d", F.col("score"), ["game_id"], largest)
    return ranked.where(F.col("rank") <= F.col("p.top_n")).drop("__median")


def short_days(strategies: Sequence[dict]) -> bool:
    """Whether top-n bounds a day's bets so far that plain windows over a day are fine."""
    return max(s["top_n"] for s in strategies) <= ledger.SHORT_DAY


def strategy_ledger(bets: DataFrame, strategies: Sequence[dict]) -> DataFrame:
    """Selected bets with exposure cap, settlement and daily stop-loss."""
    sel = strategy_selection(bets, strategies)
    capped = ledger.cap_exposure(sel, ["strategy_id", "model"], "d", "k", F.col("p.exposure"), bounded=short_days(strategies))
    raw = settle(F.col("stake"), F.col("bet_side"), F.col("covered"), F.col("payout_home"), F.col("payout_away"))
    capped = capped.withColumn("raw_pnl", raw)
    if not any(s.get("max_daily_loss") is not None for s in strategies):
        return capped.withColumn("strategy_pnl", F.col("raw_pnl"))
    line = Timeline(("strategy_id", "model", "d"), "rank")
    return ledger.stop_loss(capped, line, "raw_pnl", F.col("p.max_daily_loss"), "strategy_pnl", bounded=short_days(strategies))


def strategy_matrix(bets: DataFrame, strategies: Sequence[dict]) -> DataFrame:
    """One row per (strategy, model) with bets, win rate, P&L, ROI and drawdown.

    A small top-n per day bounds a ledger, so its windows are plain ones.
    """
    rows = strategy_ledger(bets, strategies).select(
        "strategy_id", "model", "d", "game_id", "bet_side", "covered", "stake", "strategy_pnl"
    )
    money = ledger.compounded(rows, Timeline(("strategy_id", "model"), ("d", "game_id")), "strategy_pnl", floor=1e-12, bounded=short_days(strategies))
    return money.groupBy("strategy_id", "model").agg(
        F.count(F.lit(1)).alias("bets_placed"),
        F.count(F.when(F.col("bet_side") == "HOME", 1)).alias("home_bets"),
        F.avg((F.col("covered") == F.col("bet_side")).cast("int")).alias("win_rate"),
        F.sum("strategy_pnl").alias("total_pnl"),
        F.avg("stake").alias("avg_kelly"),
        (F.max_by("bankroll", F.struct("d", "game_id")) - 1).alias("roi"),
        F.min("drawdown").alias("max_drawdown"),
    )
