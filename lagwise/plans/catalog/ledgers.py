"""Queries over stakes, settlement, drawdown, regimes and strategy sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.operators import aggregates, diagnostics, ledger
from lagwise.operators.timeline import Timeline, cum_sum, running
from lagwise.plans.adapters import MODEL_BETS
from lagwise.plans.catalog.common import r6
from lagwise.plans.catalog.joins import STRATEGIES
from lagwise.plans.registry import query
from lagwise.plans.strategies import strategy_matrix
from lagwise.session import cut_lineage

SELECTED = MODEL_BETS + """,
sr AS (SELECT *, row_number() OVER (PARTITION BY model, d ORDER BY round(abs(edge), 9) DESC, game_id) AS rank FROM mb WHERE bet_side <> 'NONE'),
sel AS (SELECT * FROM sr WHERE rank <= 3),
cap AS (SELECT *, kelly * CASE WHEN sum(kelly) OVER (PARTITION BY model, d) > 0.0075 THEN 0.0075 / sum(kelly) OVER (PARTITION BY model, d) ELSE 1.0 END AS stake FROM sel),
led AS (SELECT *, CASE WHEN covered = 'PUSH' THEN 0.0 WHEN covered = bet_side THEN stake * CASE bet_side WHEN 'HOME' THEN payout_home ELSE payout_away END ELSE -stake END AS profit FROM cap)"""


def selected_bets(s):
    from lagwise.functions.market import settle

    b = s.model_bets.where("bet_side <> 'NONE'")
    b = cut_lineage(ledger.select_daily(b, ["model"], "d", F.round(F.abs("edge"), 9), ["game_id"], 3))  # three a day and model, read again and again below
    b = ledger.cap_exposure(b, ["model"], "d", "kelly", 0.0075)
    return b.withColumn("profit", settle(F.col("stake"), F.col("bet_side"), F.col("covered"), F.col("payout_home"), F.col("payout_away")))


@query(
    "daily_exposure_cap", "W-16 T-04",
    f"WITH {SELECTED} SELECT model, game_id, CAST(rank AS BIGINT) AS rank, round(stake, 12) AS stake, round(profit, 12) AS profit FROM led",
)
def daily_exposure_cap(s):
    return selected_bets(s).select("model", "game_id", F.col("rank").cast("bigint").alias("rank"), F.round("stake", 12).alias("stake"), F.round("profit", 12).alias("profit"))


LINE = ("d", "game_id")


@query(
    "cumulative_pnl", "W-17",
    f"WITH {MODEL_BETS} SELECT model, game_id, CAST(sum(CAST(round(pnl * 1e12) AS BIGINT)) OVER (PARTITION BY model ORDER BY d, game_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_pnl_e12 FROM mb",
)
def cumulative_pnl(s):
    out = running(s.model_bets, Timeline("model", LINE), {"cum_pnl_e12": cum_sum(F.round(F.col("pnl") * 1e12).cast("bigint"))}, inclusive=True)
    return out.select("model", "game_id", "cum_pnl_e12")


ROW_LEDGER = SELECTED + """,
bk AS (SELECT *, 100.0 * product(1 + profit) OVER (PARTITION BY model ORDER BY d, game_id ROWS UNBOUNDED PRECEDING) AS bankroll FROM led),
dd AS (SELECT *, max(bankroll) OVER (PARTITION BY model ORDER BY d, game_id ROWS UNBOUNDED PRECEDING) AS peak FROM bk),
rl AS (SELECT *, (bankroll - peak) / peak AS drawdown FROM dd)"""


def row_ledger(s):
    return ledger.compounded(selected_bets(s), Timeline("model", LINE), "profit", 100.0, bounded=True)


@query(
    "compounded_bankroll", "W-18 W-24",
    f"WITH {ROW_LEDGER} SELECT model, game_id, round(ln(bankroll), 8) AS log_bankroll, round(ln(bankroll / peak), 9) AS log_drawdown FROM rl",
)
def compounded_bankroll(s):
    return row_ledger(s).select("model", "game_id", F.round(F.log("bankroll"), 8).alias("log_bankroll"), F.round(F.log(F.col("bankroll") / F.col("peak")), 9).alias("log_drawdown"))


@query(
    "day_settled_bankroll", "W-19",
    f"""WITH {SELECTED}, dy AS (SELECT model, d, sum(profit) AS day_pnl FROM led GROUP BY 1, 2),
e AS (SELECT model, d, product(1 + day_pnl) OVER (PARTITION BY model ORDER BY d ROWS UNBOUNDED PRECEDING) AS bankroll FROM dy),
o AS (SELECT *, lag(bankroll, 1, 1.0) OVER (PARTITION BY model ORDER BY d) AS bankroll_open FROM e)
SELECT led.model, game_id, round(ln(bankroll_open), 9) AS log_open, round(ln(bankroll), 9) AS log_bankroll FROM led JOIN o ON o.model = led.model AND o.d = led.d""",
)
def day_settled_bankroll(s):
    out = ledger.attach_bankroll(selected_bets(s), ["model"], "d", "profit")
    return out.select("model", "game_id", F.round(F.log("bankroll_open"), 9).alias("log_open"), F.round(F.log("bankroll"), 9).alias("log_bankroll"))


@query(
    "growth_objective", "W-20",
    f"""WITH {ROW_LEDGER} SELECT model, round(avg(ln(greatest(1 + profit, 1e-12))), 9) AS mean_log_growth, round(min(drawdown), 8) AS max_drawdown,
  round(avg(ln(greatest(1 + profit, 1e-12))) - 0.5 * abs(min(drawdown)), 8) AS objective FROM rl GROUP BY model""",
)
def growth_objective(s):
    out = ledger.growth_objective(row_ledger(s), ["model"], "profit", 0.5)
    return out.select("model", F.round("mean_log_growth", 9).alias("mean_log_growth"), F.round("max_drawdown", 8).alias("max_drawdown"), F.round("objective", 8).alias("objective"))


@query(
    "stop_loss", "W-21",
    f"""WITH {SELECTED}, a AS (SELECT model, game_id, d, rank, profit, coalesce(sum(profit) OVER (PARTITION BY model, d ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM led),
b AS (SELECT *, min(before) OVER (PARTITION BY model, d ORDER BY rank ROWS UNBOUNDED PRECEDING) AS low FROM a)
SELECT model, game_id, round(CASE WHEN low <= -0.003 THEN 0.0 ELSE profit END, 12) AS pnl_kept FROM b""",
)
def stop_loss(s):
    out = ledger.stop_loss(selected_bets(s), Timeline(("model", "d"), "rank"), "profit", F.lit(-0.003))
    return out.select("model", "game_id", F.round("pnl_kept", 12).alias("pnl_kept"))


DAILY = SELECTED + """,
dy AS (SELECT model, d, min(game_date) AS game_date, sum(profit) AS daily_pnl, count(*) AS daily_bets, avg(CASE WHEN covered = bet_side THEN 1 ELSE 0 END) AS daily_win_rate FROM led GROUP BY model, d),
v AS (SELECT *, CASE WHEN count(daily_pnl) OVER w >= 10 THEN stddev_samp(daily_pnl) OVER w END AS vol FROM dy WINDOW w AS (PARTITION BY model ORDER BY d ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)),
qs AS (SELECT model, quantile_cont(round(vol, 12), 1.0 / 3) AS ql, quantile_cont(round(vol, 12), 2.0 / 3) AS qh, count(vol) AS n FROM v GROUP BY model),
vb AS (SELECT v.*, CASE WHEN n < 30 OR vol IS NULL THEN 'unknown_vol' WHEN round(vol, 12) <= ql + 1e-13 THEN 'low_vol' WHEN round(vol, 12) <= qh + 1e-13 THEN 'mid_vol' ELSE 'high_vol' END AS vol_bucket FROM v JOIN qs ON qs.model = v.model)"""


def daily_regimes(s):
    b = selected_bets(s).withColumn("won", (F.col("covered") == F.col("bet_side")).cast("int"))
    daily = b.groupBy("model", "d").agg(
        F.min("game_date").alias("game_date"), F.sum("profit").alias("daily_pnl"), F.count(F.lit(1)).alias("daily_bets"), F.avg("won").alias("daily_win_rate")
    )
    return ledger.daily_volatility(daily, ["model"], "d", "daily_pnl")


@query(
    "volatility_regimes", "W-22",
    f"WITH {DAILY} SELECT model, d, round(daily_pnl, 12) AS daily_pnl, round(vol, 8) AS vol, vol_bucket FROM vb",
)
def volatility_regimes(s):
    return daily_regimes(s).select("model", "d", F.round("daily_pnl", 12).alias("daily_pnl"), F.round("vol", 8).alias("vol"), "vol_bucket")


@query(
    "regime_plan_summary", "W-23",
    f"""WITH {DAILY}, p AS (SELECT *, CASE WHEN vol_bucket = 'high_vol' THEN 'R2' ELSE 'R1' END AS profile FROM vb)
SELECT model, vol_bucket, profile, count(*) AS days, CAST(sum(daily_bets) AS BIGINT) AS total_bets, round(avg(daily_bets), 6) AS avg_daily_bets, round(avg(daily_win_rate), 6) AS avg_daily_win_rate,
  round(avg(daily_pnl), 8) AS avg_daily_pnl FROM p GROUP BY 1, 2, 3""",
)
def regime_plan_summary(s):
    out = ledger.regime_plan_summary(ledger.regime_plan(daily_regimes(s), {"high_vol": "R2"}, "R1"), ["model"])
    return out.withColumns({"avg_daily_bets": r6("avg_daily_bets"), "avg_daily_win_rate": r6("avg_daily_win_rate"), "avg_daily_pnl": F.round("avg_daily_pnl", 8)})


@query(
    "ledger_summary", "A-26",
    f"""WITH {SELECTED}, dy AS (SELECT model, d, sum(profit) AS day_pnl FROM led GROUP BY 1, 2),
e AS (SELECT model, d, product(1 + day_pnl) OVER (PARTITION BY model ORDER BY d ROWS UNBOUNDED PRECEDING) AS bankroll FROM dy),
o AS (SELECT *, lag(bankroll, 1, 1.0) OVER (PARTITION BY model ORDER BY d) AS bankroll_open FROM e),
j AS (SELECT led.model, led.d, game_id, stake, profit, bankroll, bankroll_open, CASE WHEN covered = bet_side THEN 1 ELSE 0 END AS win,
  CASE WHEN led.model = 'm1' THEN bankroll_open ELSE bankroll / (1 + profit) END AS base FROM led JOIN o ON o.model = led.model AND o.d = led.d),
k AS (SELECT *, greatest(1.0, max(bankroll) OVER (PARTITION BY model ORDER BY d, game_id ROWS UNBOUNDED PRECEDING)) AS peak FROM j)
SELECT model, count(*) AS bets, round(avg(win), 6) AS win_rate, round(sum(profit * base) / sum(stake * base), 8) AS roi, round(max((peak - bankroll) / peak), 8) AS max_drawdown FROM k GROUP BY model""",
)
def ledger_summary(s):
    b = ledger.attach_bankroll(selected_bets(s), ["model"], "d", "profit")
    b = b.withColumns({"win": (F.col("covered") == F.col("bet_side")).cast("int"), "kelly_fraction": F.col("stake"), "pnl": F.col("profit")})
    out = ledger.ledger_summary(b, ["model"], F.when(F.col("model") == "m1", "open").otherwise("current"))
    return out.select("model", "bets", r6("win_rate").alias("win_rate"), F.round("roi", 8).alias("roi"), F.round("max_drawdown", 8).alias("max_drawdown"))


@query(
    "daily_exposure_and_tier_pnl", "A-27",
    f"""WITH {SELECTED} SELECT model, tier, strftime(game_date, '%Y-%m') AS month, count(*) AS bets, round(sum(stake), 12) AS exposure, round(sum(profit), 12) AS pnl FROM led GROUP BY 1, 2, 3""",
)
def daily_exposure_and_tier_pnl(s):
    out = ledger.exposure_and_pnl(selected_bets(s), ["model", "tier", F.date_format("game_date", "yyyy-MM").alias("month")])
    return out.withColumns({"exposure": F.round("exposure", 12), "pnl": F.round("pnl", 12)})


SUMMARY = SELECTED + """,
bk AS (SELECT *, 100.0 * product(1 + profit) OVER (PARTITION BY model ORDER BY d, game_id ROWS UNBOUNDED PRECEDING) AS bankroll FROM led),
dd AS (SELECT *, bankroll / max(bankroll) OVER (PARTITION BY model ORDER BY d, game_id ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM bk),
sm AS (SELECT model, 100.0 AS start, arg_max(bankroll, (d, game_id)) AS ending, sum(profit) AS total_pnl, count(*) AS num_bets, avg(CASE WHEN covered = bet_side THEN 1 ELSE 0 END) AS win_rate,
  avg(edge) AS avg_edge, avg(CASE WHEN bet_side = 'HOME' THEN ev_home ELSE ev_away END) AS avg_ev, min(drawdown) AS max_drawdown FROM dd GROUP BY model)"""


def model_summary(s):
    led = row_ledger(s).withColumn("pnl", F.col("profit")).withColumn("bet_win", (F.col("covered") == F.col("bet_side")).cast("int"))
    return diagnostics.side_ledger_summary(led, 100.0)


@query(
    "model_ledger_summary", "A-36 A-33",
    f"""WITH {SUMMARY} SELECT row_number() OVER (ORDER BY ending DESC, model) AS profit_rank, model, ending > start AS profitable_flag, round(ending, 6) AS ending_bankroll, round((ending - start) / start, 8) AS roi,
  round(total_pnl, 8) AS total_pnl, num_bets, round(win_rate, 6) AS win_rate, round(avg_edge, 6) AS avg_edge, round(avg_ev, 6) AS avg_ev_selected_side, round(max_drawdown, 8) AS max_drawdown FROM sm""",
)
def model_ledger_summary(s):
    out = diagnostics.profit_rank(model_summary(s))
    return out.select(
        F.col("profit_rank").cast("bigint").alias("profit_rank"), "model", "profitable_flag", r6("ending_bankroll").alias("ending_bankroll"), F.round("roi", 8).alias("roi"),
        F.round("total_pnl", 8).alias("total_pnl"), "num_bets", r6("win_rate").alias("win_rate"), r6("avg_edge").alias("avg_edge"),
        r6("avg_ev_selected_side").alias("avg_ev_selected_side"), F.round("max_drawdown", 8).alias("max_drawdown"),
    )


MATRIX = MODEL_BETS + """,
s AS (SELECT * FROM (VALUES ('R0', 0.1, 0.01, 2, 0.015, FALSE, 0.0, FALSE, NULL::VARCHAR[], NULL, 0.0), ('R1', 0.05, 0.005, 3, 0.01, TRUE, 0.5, TRUE, NULL, NULL, 1.0),
  ('R2', 0.05, 0.005, 5, 0.008, TRUE, 1.0, FALSE, ['matched', 'mirrored'], -0.003, 0.0)) v(strategy_id, scale, cap, top_n, exposure, penalised, weight, skip_default, tiers, max_loss, min_edge)),
x0 AS (SELECT s.*, mb.*, CASE bet_side WHEN 'HOME' THEN (win_prob * (payout_home + 1) - 1) / payout_home WHEN 'AWAY' THEN ((1 - win_prob) * (payout_away + 1) - 1) / payout_away ELSE 0.0 END AS base,
  CASE bet_side WHEN 'HOME' THEN ev_home WHEN 'AWAY' THEN ev_away END AS ev, abs(pred_ensemble) AS risk FROM mb, s),
med AS (SELECT model, quantile_cont(abs(pred_ensemble), 0.5) AS m FROM mb GROUP BY model),
x1 AS (SELECT x0.*, m, least(greatest(least(greatest(base, 0.0), 1.0) * scale, 0.0), cap) AS k FROM x0 JOIN med ON med.model = x0.model),
x2 AS (SELECT *, CAST(CASE WHEN coalesce(ev, 0) = 0 THEN abs(edge) ELSE ev END / CASE WHEN penalised THEN 1 + weight * least(greatest(risk / m, 0.5), 3.0) + weight * k ELSE 1.0 END AS DOUBLE) AS score FROM x1
  WHERE bet_side <> 'NONE' AND k > 0 AND abs(edge) >= min_edge AND NOT (skip_default AND tier IN ('default', 'unmatched')) AND (tiers IS NULL OR list_contains(tiers, tier))),
x3 AS (SELECT *, row_number() OVER (PARTITION BY strategy_id, model, d ORDER BY round(score, 9) DESC, game_id) AS rank FROM x2),
x4 AS (SELECT *, sum(k) OVER (PARTITION BY strategy_id, model, d) AS tot FROM x3 WHERE rank <= top_n),
x5 AS (SELECT *, CAST(k * CASE WHEN tot > exposure THEN exposure / tot ELSE 1.0 END AS DOUBLE) AS stake FROM x4),
x6 AS (SELECT *, CASE WHEN covered = 'PUSH' THEN 0.0 WHEN covered = bet_side THEN stake * CASE bet_side WHEN 'HOME' THEN payout_home ELSE payout_away END ELSE -stake END AS raw FROM x5),
x7 AS (SELECT *, coalesce(sum(raw) OVER (PARTITION BY strategy_id, model, d ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x6),
x8 AS (SELECT *, min(before) OVER (PARTITION BY strategy_id, model, d ORDER BY rank ROWS UNBOUNDED PRECEDING) AS low FROM x7),
x9 AS (SELECT *, CASE WHEN max_loss IS NOT NULL AND low <= max_loss THEN 0.0 ELSE raw END AS pl FROM x8),
b1 AS (SELECT *, product(greatest(1 + pl, 1e-12)) OVER (PARTITION BY strategy_id, model ORDER BY d, game_id ROWS UNBOUNDED PRECEDING) AS bk FROM x9),
b2 AS (SELECT *, bk / max(bk) OVER (PARTITION BY strategy_id, model ORDER BY d, game_id ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM b1),
mx AS (SELECT strategy_id, model, count(*) AS bets_placed, count(*) FILTER (bet_side = 'HOME') AS home_bets, avg(CASE WHEN covered = bet_side THEN 1 ELSE 0 END) AS win_rate, sum(pl) AS total_pnl,
  avg(stake) AS avg_kelly, arg_max(bk, (d, game_id)) - 1 AS roi, min(dd) AS max_drawdown FROM b2 GROUP BY 1, 2)"""


def matrix(s):
    return strategy_matrix(s.model_bets, STRATEGIES)


@query(
    "strategy_matrix", "R-21 R-20 J-20",
    f"""WITH {MATRIX} SELECT strategy_id, model, bets_placed, home_bets, round(win_rate, 6) AS win_rate, round(total_pnl, 6) AS total_pnl, round(avg_kelly, 8) AS avg_kelly, round(roi, 6) AS roi, round(max_drawdown, 6) AS max_drawdown FROM mx""",
)
def strategy_matrix_query(s):
    m = matrix(s)
    return m.select("strategy_id", "model", "bets_placed", "home_bets", r6("win_rate").alias("win_rate"), r6("total_pnl").alias("total_pnl"), F.round("avg_kelly", 8).alias("avg_kelly"), r6("roi").alias("roi"), r6("max_drawdown").alias("max_drawdown"))


@query(
    "strategy_summary", "A-20 A-19",
    f"""WITH {MATRIX} SELECT strategy_id, round(avg(roi), 6) AS avg_roi, round(quantile_cont(roi, 0.5), 6) AS median_roi, round(avg(max_drawdown), 6) AS avg_max_drawdown, CAST(sum(bets_placed) AS BIGINT) AS total_bets,
  (max({{'roi': roi, 'model': model}})).model AS best_model, round(max(roi), 6) AS best_roi FROM mx GROUP BY 1""",
)
def strategy_summary(s):
    out = diagnostics.strategy_summary(matrix(s))
    return out.withColumns({c: r6(c) for c in ("avg_roi", "median_roi", "avg_max_drawdown", "best_roi")})


@query(
    "run_score", "R-22 A-24",
    f"""WITH {SELECTED}, r AS (SELECT model, CASE WHEN covered = 'PUSH' THEN 0.0 WHEN covered = bet_side THEN CASE bet_side WHEN 'HOME' THEN payout_home ELSE payout_away END ELSE -1.0 END AS r FROM led)
SELECT model, round(avg(r), 6) AS flat_roi, round(stddev_samp(r) / sqrt(count(*)), 6) AS flat_roi_se, count(*) AS n_bets, round(CASE WHEN count(*) >= 100 THEN avg(r) - stddev_samp(r) / sqrt(count(*)) ELSE -1.0 END, 6) AS score FROM r GROUP BY model""",
)
def run_score(s):
    from lagwise.functions.market import settle
    from lagwise.plans.experiment import score_of

    flat = settle(F.lit(1.0), F.col("bet_side"), F.col("covered"), F.col("payout_home"), F.col("payout_away"))
    stats = aggregates.mean_and_error(selected_bets(s), flat, ["model"])
    return stats.select("model", r6("mean").alias("flat_roi"), r6("se").alias("flat_roi_se"), F.col("n").alias("n_bets"), r6(score_of(F.col("mean"), F.col("se"), F.col("n"))).alias("score"))


@query(
    "fold_risk", "R-23",
    f"""WITH {SELECTED}, f AS (SELECT model, fold, sum(profit) AS pnl, sum(profit) / nullif(sum(stake), 0) AS roi FROM led GROUP BY 1, 2),
q AS (SELECT *, product(1 + pnl) OVER (PARTITION BY model ORDER BY fold ROWS UNBOUNDED PRECEDING) AS equity FROM f),
k AS (SELECT *, greatest(1.0, max(equity) OVER (PARTITION BY model ORDER BY fold ROWS UNBOUNDED PRECEDING)) AS peak FROM q)
SELECT model, count(*) AS folds, round(avg(roi), 6) AS mean_roi, round(stddev_samp(roi), 6) AS volatility, round(CASE WHEN stddev_samp(roi) = 0 THEN 0 ELSE avg(roi) / stddev_samp(roi) END, 6) AS sharpe,
  round(min(equity / peak - 1), 6) AS max_drawdown FROM k GROUP BY model""",
)
def fold_risk(s):
    out = ledger.fold_risk(selected_bets(s), ["model"])
    return out.withColumns({c: r6(c) for c in ("mean_roi", "volatility", "sharpe", "max_drawdown")})
