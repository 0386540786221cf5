"""Queries over grouped diagnostics, findings and run tables."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from lagwise.functions import market
from lagwise.operators import diagnostics, ranking, schema
from lagwise.plans.adapters import MODEL_BETS
from lagwise.plans.catalog.common import r6
from lagwise.plans.catalog.ledgers import DAILY, SUMMARY, daily_regimes, model_summary
from lagwise.plans.registry import query
from lagwise.session import stored

# Digits that keep sums of short decimals away from rounding ties.
FINE = 11
BETS = MODEL_BETS + """,
bt AS (SELECT *, CASE WHEN covered = bet_side THEN 1 ELSE 0 END AS bet_win, CASE WHEN bet_side = 'HOME' THEN ev_home ELSE ev_away END AS selected_ev, tier IN ('default', 'unmatched') AS used_default,
  strftime(game_date, '%Y-%m') AS month, strftime(game_date, '%A') AS day_of_week, abs(spread_signed) AS sa,
  CASE WHEN spread_signed < 0 THEN 'HOME' WHEN spread_signed > 0 THEN 'AWAY' ELSE 'PICKEM' END AS fav FROM mb WHERE bet_side <> 'NONE')"""


def bets(s):
    b = s.model_bets.where("bet_side <> 'NONE'")
    fav = market.favourite_side(F.col("spread_signed"))
    return b.withColumns({
        "bet_win": (F.col("covered") == F.col("bet_side")).cast("int"),
        "selected_ev": F.when(F.col("bet_side") == "HOME", F.col("ev_home")).otherwise(F.col("ev_away")),
        "used_default": F.col("tier").isin("default", "unmatched"),
        "month": F.date_format("game_date", "yyyy-MM"), "day_of_week": F.date_format("game_date", "EEEE"),
        "spread_bucket": market.band(F.abs("spread_signed"), [2, 5, 8], ["0-2", "2-5", "5-8", "8+"]),
        "bet_type": market.bet_type(F.col("bet_side"), fav),
    })


def fine(*names):
    return [F.round(n, FINE).alias(n) for n in names]


@query(
    "outcome_summary", "A-10",
    f"""WITH {BETS} SELECT model, count(*) AS total_bets, round(sum(pnl), {FINE}) AS total_pnl, round(avg(pnl), {FINE}) AS avg_pnl_per_bet, round(stddev_pop(pnl), {FINE}) AS std_pnl_per_bet,
  count(*) FILTER (bet_side = 'HOME') AS home_bets, round(sum(pnl) FILTER (bet_side = 'HOME'), {FINE}) AS home_pnl, count(*) FILTER (bet_side = 'AWAY') AS away_bets, round(avg(pnl) FILTER (bet_side = 'AWAY'), {FINE}) AS away_avg_pnl,
  round(avg(bet_win), 6) AS win_rate, round(avg(bet_win) FILTER (bet_side = 'HOME'), 6) AS home_win_rate, CAST(sum(bet_win) FILTER (bet_side = 'AWAY') AS BIGINT) AS away_wins FROM bt GROUP BY model""",
)
def outcome_summary(s):
    out = diagnostics.outcome_summary(bets(s))
    return out.select("model", "total_bets", "home_bets", "away_bets", "away_wins", *fine("total_pnl", "avg_pnl_per_bet", "std_pnl_per_bet", "home_pnl", "away_avg_pnl"), r6("win_rate").alias("win_rate"), r6("home_win_rate").alias("home_win_rate"))


@query(
    "quality_crosstab", "A-11",
    f"""WITH {BETS} SELECT model, used_default, tier, CASE grouping_id(model, used_default, tier) WHEN 1 THEN 'flag' WHEN 2 THEN 'tier' ELSE 'flag_tier' END AS level, count(*) AS bets, round(sum(pnl), {FINE}) AS total_pnl,
  round(avg(bet_win), 6) AS win_rate FROM bt GROUP BY GROUPING SETS ((model, used_default), (model, tier), (model, used_default, tier))""",
)
def quality_crosstab(s):
    out = diagnostics.quality_crosstab(bets(s), "used_default", "tier")
    return out.select("model", "used_default", "tier", "level", "bets", *fine("total_pnl"), r6("win_rate").alias("win_rate"))


@query(
    "error_breakdown", "A-12",
    f"""WITH {MODEL_BETS}, e AS (SELECT *, home_margin - pred_ensemble AS er, CASE WHEN abs(spread_signed) < 2 THEN '0-2' WHEN abs(spread_signed) < 5 THEN '2-5' ELSE '5+' END AS sb FROM mb),
l AS (SELECT model, er, unnest([{{'k': 'overall', 'v': 'all'}}, {{'k': 'spread_bucket', 'v': sb}}, {{'k': 'home', 'v': CAST(home AS VARCHAR)}}, {{'k': 'away', 'v': CAST(away AS VARCHAR)}}, {{'k': 'outcome', 'v': covered}}]) AS g FROM e)
SELECT model, g.k AS group_type, g.v AS group_value, round(sqrt(avg(er * er)), 6) AS rmse, round(avg(abs(er)), 8) AS mae, count(*) AS n FROM l GROUP BY ALL""",
)
def error_breakdown(s):
    bucket = market.band(F.abs("spread_signed"), [2, 5], ["0-2", "2-5", "5+"], right_closed=False)
    out = diagnostics.error_breakdown(s.model_bets, F.col("home_margin") - F.col("pred_ensemble"), bucket, F.col("covered"))
    return out.select("model", "group_type", "group_value", r6("rmse").alias("rmse"), F.round("mae", 8).alias("mae"), "n")


FACTORS = {"bet_side": "bet_type", "bet_type": "bet_type", "spread_bucket": "bet_type", "season": "time", "month": "time", "day_of_week": "time", "tier": "data_quality", "used_default": "data_quality"}
SLICES = BETS + f""",
fl AS (SELECT model, pnl, bet_win, edge, kelly, selected_ev, unnest([{{'n': 'bet_side', 'g': 'bet_type', 'l': bet_side}}, {{'n': 'bet_type', 'g': 'bet_type', 'l': CASE WHEN fav = 'PICKEM' THEN 'pickem' WHEN bet_side = fav THEN 'favorite' ELSE 'underdog' END}},
  {{'n': 'spread_bucket', 'g': 'bet_type', 'l': CASE WHEN sa <= 2 THEN '0-2' WHEN sa <= 5 THEN '2-5' WHEN sa <= 8 THEN '5-8' ELSE '8+' END}}, {{'n': 'season', 'g': 'time', 'l': CAST(season AS VARCHAR)}}, {{'n': 'month', 'g': 'time', 'l': month}},
  {{'n': 'day_of_week', 'g': 'time', 'l': day_of_week}}, {{'n': 'tier', 'g': 'data_quality', 'l': tier}}, {{'n': 'used_default', 'g': 'data_quality', 'l': CAST(used_default AS VARCHAR)}}]) AS f FROM bt),
sl AS (SELECT model, f.g AS factor_group, f.n AS factor_name, f.l AS factor_level, count(*) AS bets, sum(pnl) AS total_pnl, avg(pnl) AS roi_per_bet, avg(bet_win) AS win_rate, avg(edge) AS avg_edge FROM fl GROUP BY 1, 2, 3, 4 HAVING count(*) >= 150)"""


@query(
    "factor_slices", "A-14 D-02",
    f"""WITH {SLICES} SELECT model, factor_group, factor_name, factor_level, bets, round(total_pnl, {FINE}) AS total_pnl, round(win_rate, 6) AS win_rate, round(avg_edge, 6) AS avg_edge FROM sl""",
)
def factor_slices(s):
    out = diagnostics.factor_slices(bets(s), FACTORS, 150)
    return out.select("model", "factor_group", "factor_name", "factor_level", "bets", *fine("total_pnl"), r6("win_rate").alias("win_rate"), r6("avg_edge").alias("avg_edge"))


@query(
    "top_factor_levels", "T-03 A-14",
    f"""WITH {SLICES}, r AS (SELECT *, row_number() OVER (PARTITION BY model, factor_group, factor_name ORDER BY bets DESC, total_pnl DESC, factor_level) AS k FROM sl)
SELECT model, factor_name, factor_level, bets FROM r WHERE k <= 3""",
)
def top_factor_levels(s):
    return diagnostics.top_levels(diagnostics.factor_slices(bets(s), FACTORS, 150), 3).select("model", "factor_name", "factor_level", "bets")


@query(
    "factor_impact", "A-31",
    f"""WITH {SLICES}, i AS (SELECT model, factor_group, factor_name, arg_max(factor_level, (roi_per_bet, factor_level)) AS top_level, max(roi_per_bet) AS hi, arg_min(factor_level, (roi_per_bet, factor_level)) AS bottom_level, min(roi_per_bet) AS lo,
  count(*) AS level_count, CAST(sum(bets) AS BIGINT) AS total_bets FROM sl GROUP BY 1, 2, 3 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(hi - lo) DESC, factor_name) AS k FROM i)
SELECT model, factor_name, top_level, bottom_level, level_count, total_bets, round(hi - lo, {FINE}) AS impact_spread FROM r WHERE k <= 4""",
)
def factor_impact(s):
    out = diagnostics.impact_spread(diagnostics.factor_slices(bets(s), FACTORS, 150), 150, 4)
    return out.select("model", "factor_name", "top_level", "bottom_level", "level_count", "total_bets", *fine("impact_spread"))


PERIODS = BETS + """,
mo AS (SELECT model, month, count(*) AS bets, sum(pnl) AS total_pnl, avg(bet_win) AS win_rate FROM bt GROUP BY 1, 2), se AS (SELECT model, season, count(*) AS bets, sum(pnl) AS total_pnl, avg(bet_win) AS win_rate FROM bt GROUP BY 1, 2)"""


@query(
    "period_summary", "A-15",
    f"""WITH {PERIODS} SELECT model, 'month' AS period_kind, month AS period, bets, round(total_pnl, {FINE}) AS total_pnl, round(win_rate, 6) AS win_rate FROM mo
UNION ALL SELECT model, 'season', CAST(season AS VARCHAR), bets, round(total_pnl, {FINE}), round(win_rate, 6) FROM se""",
)
def period_summary(s):
    out = diagnostics.period_summary(bets(s).drop("month"))
    return out.select("model", "period_kind", "period", "bets", *fine("total_pnl"), r6("win_rate").alias("win_rate"))


@query(
    "period_reconciliation", "A-16",
    f"""WITH {PERIODS}, m AS (SELECT model, sum(bets) AS b, sum(total_pnl) AS p FROM mo GROUP BY 1), z AS (SELECT model, sum(bets) AS b, sum(total_pnl) AS p FROM se GROUP BY 1),
j AS (SELECT max(abs(m.b - z.b)) AS b, max(abs(m.p - z.p)) AS p FROM m FULL OUTER JOIN z ON m.model = z.model)
SELECT 'monthly_bets_reconcile' AS "check", CASE WHEN b <= 0 THEN 'pass' ELSE 'warn' END AS status FROM j UNION ALL SELECT 'monthly_pnl_reconcile', CASE WHEN p <= 1e-9 THEN 'pass' ELSE 'warn' END FROM j""",
)
def period_reconciliation(s):
    p = diagnostics.period_summary(bets(s).drop("month"))
    return diagnostics.reconcile(p.where("period_kind = 'month'"), p.where("period_kind = 'season'")).select("check", "status")


@query(
    "reliability", "A-17",
    f"""WITH {MODEL_BETS} SELECT model, CAST(greatest(ceil(win_prob * 10), 1) AS INTEGER) AS bin, round(avg(win_prob), 6) AS mean_pred, round(avg(CASE WHEN covered = 'HOME' THEN 1 ELSE 0 END), 6) AS actual, count(*) AS n FROM mb GROUP BY 1, 2""",
)
def reliability(s):
    b = s.model_bets.withColumn("y", (F.col("covered") == "HOME").cast("int"))
    out = diagnostics.reliability(b, "win_prob", "y", 10, ["model"])
    return out.select("model", "bin", r6("mean_pred").alias("mean_pred"), r6("actual").alias("actual"), "n")


@query(
    "run_comparison", "A-25",
    f"""WITH {BETS} SELECT model AS run_id, count(*) AS run_bets, count(*) FILTER (tier = 'matched') AS tier_bets, round(avg(bet_win) FILTER (tier = 'matched'), 6) AS tier_win_rate,
  round(sum(pnl) FILTER (tier = 'matched') / sum(kelly) FILTER (tier = 'matched'), 8) AS tier_roi, round(count(*) FILTER (tier = 'matched') / (SELECT count(*) FROM mb m WHERE m.model = bt.model AND tier = 'matched'), 6) AS tier_coverage,
  round((SELECT avg(CASE WHEN tier = 'matched' THEN 1 ELSE 0 END) FROM mb m WHERE m.model = bt.model), 6) AS matched_odds_share FROM bt GROUP BY model""",
)
def run_comparison(s):
    from lagwise.sources.runs import comparison

    b = bets(s).withColumn("run_id", F.col("model"))
    audit = s.model_bets.select(F.col("model").alias("run_id"), "tier")
    out = comparison(b, audit, ["matched"])
    return out.select("run_id", "run_bets", "tier_bets", r6("tier_win_rate").alias("tier_win_rate"), F.round("tier_roi", 8).alias("tier_roi"), r6("tier_coverage").alias("tier_coverage"), r6("matched_odds_share").alias("matched_odds_share"))


@query(
    "kpi_report", "A-28",
    f"""WITH {BETS}, m AS (SELECT model, sum(pnl) AS p FROM bt GROUP BY 1), mo AS (SELECT month, sum(pnl) AS p FROM bt GROUP BY 1), ti AS (SELECT tier, avg(pnl) AS a FROM bt GROUP BY 1)
SELECT 'outcomes' AS category, 'model_count' AS metric, CAST(count(*) AS VARCHAR) AS value FROM m UNION ALL SELECT 'outcomes', 'positive_pnl_models', CAST(count(*) FILTER (p > 0) AS VARCHAR) FROM m
UNION ALL SELECT 'time', 'positive_months', CAST(count(*) FILTER (p > 0) AS VARCHAR) FROM mo UNION ALL SELECT 'time', 'negative_months', CAST(count(*) FILTER (p < 0) AS VARCHAR) FROM mo
UNION ALL SELECT 'market', 'best_market_bucket', arg_max(tier, a) FROM ti UNION ALL SELECT 'market', 'worst_market_bucket', arg_min(tier, a) FROM ti""",
)
def kpi_report(s):
    b = bets(s)
    m = b.groupBy("model").agg(F.sum("pnl").alias("p"))
    mo = b.groupBy("month").agg(F.sum("pnl").alias("p"))
    ti = b.groupBy("tier").agg(F.avg("pnl").alias("a"))
    return diagnostics.long_report([
        diagnostics.metric_rows(m, "outcomes", {"model_count": F.count("model"), "positive_pnl_models": F.count(F.when(F.col("p") > 0, 1))}),
        diagnostics.metric_rows(mo, "time", {"positive_months": F.count(F.when(F.col("p") > 0, 1)), "negative_months": F.count(F.when(F.col("p") < 0, 1))}),
        diagnostics.metric_rows(ti, "market", {"best_market_bucket": F.max_by("tier", "a"), "worst_market_bucket": F.min_by("tier", "a")}),
    ])


NEEDED = ("model", "game_id", "pnl", "edge", "kelly")


def bets_once(s):
    """The model bets of ``s``, worked out once and stored: a report reads them for each of its parts."""
    return SimpleNamespace(model_bets=stored(s.model_bets.drop("home", "away", "season", "fold", "win_prob", "sigma_ensemble")))


def metric_table(s):
    """All figures of a run, in long form: portfolio, outcomes, market, time, regime, calibration, quality, features."""
    b, m = bets(s), model_summary(s)
    tiers = b.groupBy("tier").agg(F.avg("pnl").alias("a"))
    months = b.groupBy("month").agg(F.sum("pnl").alias("p"))
    days = daily_regimes(s).groupBy("vol_bucket").agg(F.avg("daily_pnl").alias("a"))
    best = m.agg(F.max_by("model", F.struct("roi", "model")).alias("model"))
    own = ranking.equal_count_bins(b.select("model", "game_id", "edge", "pnl").join(F.broadcast(best), "model"), ["model"], F.round(F.abs("edge"), 9), ["game_id"], 10, "edge_decile", "D")  # one row
    deciles = own.groupBy("edge_decile").agg(F.avg("pnl").alias("a"))
    of = lambda bucket: F.max(F.when(F.col("vol_bucket") == bucket, F.col("a")))
    low, high = (lambda name, v: (F.min(v), F.min_by(name, F.struct(v, name)))), (lambda name, v: (F.max(v), F.max_by(name, F.struct(v, name))))
    report, manifest = schema.schema_report(b, NEEDED, ()), schema.feature_manifest(b, list(NEEDED))
    return diagnostics.long_report([
        diagnostics.measured(m, "portfolio", {
            "best_model_roi": high("model", "roi"), "worst_model_roi": low("model", "roi"), "median_model_roi": F.percentile("roi", 0.5),
            "total_model_bets": F.sum("num_bets"), "avg_model_win_rate": F.avg("win_rate"),
        }),
        diagnostics.measured(b.groupBy("model").agg(F.sum("pnl").alias("p")), "outcomes", {
            "total_pnl_all_models": F.sum("p"), "positive_pnl_models": F.count(F.when(F.col("p") > 0, 1)), "model_count": F.count(F.lit(1)),
        }),
        diagnostics.measured(tiers, "market", {"best_market_pnl": high("tier", "a"), "worst_market_pnl": low("tier", "a")}),
        diagnostics.measured(months, "time", {
            "positive_months": F.count(F.when(F.col("p") > 0, 1)), "negative_months": F.count(F.when(F.col("p") < 0, 1)),
            "negative_month_share": F.avg((F.col("p") < 0).cast("int")),
        }),
        diagnostics.measured(days, "regime", {"best_vol_pnl": high("vol_bucket", "a"), "worst_vol_pnl": low("vol_bucket", "a"), "vol_high_minus_low": of("high_vol") - of("low_vol")}),
        diagnostics.measured(deciles, "calibration", {"best_decile_roi": high("edge_decile", "a"), "worst_decile_roi": low("edge_decile", "a")}),
        diagnostics.measured(report, "quality", {"missing_hard_required_columns": F.count(F.when(F.col("is_hard_required") & ~F.col("present"), 1))}),
        diagnostics.measured(b, "quality", {"feature_match_rate": F.avg((F.col("tier") != "unmatched").cast("int"))}),
        diagnostics.measured(manifest, "features", {
            "factor_slice_features": F.count(F.when(F.col("include_for_factor_slicing"), 1)), "flagged_leaky_features": F.count(F.when(F.col("is_leaky"), 1)),
        }),
    ])


def rule_findings(s):
    return diagnostics.rule_findings(metric_table(s))


METRIC_SQL = BETS + SUMMARY[len(MODEL_BETS):] + DAILY[DAILY.index(",\ndy AS"):] + """,
mr AS (SELECT *, (ending - start) / start AS roi FROM sm), pm AS (SELECT model, sum(pnl) AS p FROM bt GROUP BY 1), ti AS (SELECT tier, avg(pnl) AS a FROM bt GROUP BY 1), mo AS (SELECT month, sum(pnl) AS p FROM bt GROUP BY 1),
vo AS (SELECT vol_bucket, avg(daily_pnl) AS a FROM vb GROUP BY 1), rk AS (SELECT bt.*, row_number() OVER (ORDER BY round(abs(edge), 9), game_id) AS r, count(*) OVER () AS n FROM bt WHERE model = (SELECT arg_max(model, (roi, model)) FROM mr)),
de AS (SELECT 'D' || CAST(greatest(1, ((r - 1) * 10 + n - 2) // (n - 1)) AS VARCHAR) AS edge_decile, avg(pnl) AS a FROM rk GROUP BY 1),
mt AS (SELECT 'portfolio' AS category, 'best_model_roi' AS metric, max(roi) AS value, arg_max(model, (roi, model)) AS label FROM mr UNION ALL SELECT 'portfolio', 'worst_model_roi', min(roi), arg_min(model, (roi, model)) FROM mr
UNION ALL SELECT 'portfolio', 'median_model_roi', quantile_cont(roi, 0.5), NULL FROM mr UNION ALL SELECT 'portfolio', 'total_model_bets', sum(num_bets), NULL FROM mr UNION ALL SELECT 'portfolio', 'avg_model_win_rate', avg(win_rate), NULL FROM mr
UNION ALL SELECT 'outcomes', 'total_pnl_all_models', sum(p), NULL FROM pm UNION ALL SELECT 'outcomes', 'positive_pnl_models', count(*) FILTER (p > 0), NULL FROM pm UNION ALL SELECT 'outcomes', 'model_count', count(*), NULL FROM pm
UNION ALL SELECT 'market', 'best_market_pnl', max(a), arg_max(tier, (a, tier)) FROM ti UNION ALL SELECT 'market', 'worst_market_pnl', min(a), arg_min(tier, (a, tier)) FROM ti
UNION ALL SELECT 'time', 'positive_months', count(*) FILTER (p > 0), NULL FROM mo UNION ALL SELECT 'time', 'negative_months', count(*) FILTER (p < 0), NULL FROM mo UNION ALL SELECT 'time', 'negative_month_share', avg(CASE WHEN p < 0 THEN 1 ELSE 0 END), NULL FROM mo
UNION ALL SELECT 'regime', 'best_vol_pnl', max(a), arg_max(vol_bucket, (a, vol_bucket)) FROM vo UNION ALL SELECT 'regime', 'worst_vol_pnl', min(a), arg_min(vol_bucket, (a, vol_bucket)) FROM vo
UNION ALL SELECT 'regime', 'vol_high_minus_low', max(a) FILTER (vol_bucket = 'high_vol') - max(a) FILTER (vol_bucket = 'low_vol'), NULL FROM vo
UNION ALL SELECT 'calibration', 'best_decile_roi', max(a), arg_max(edge_decile, (a, edge_decile)) FROM de UNION ALL SELECT 'calibration', 'worst_decile_roi', min(a), arg_min(edge_decile, (a, edge_decile)) FROM de
UNION ALL SELECT 'quality', 'missing_hard_required_columns', 0, NULL UNION ALL SELECT 'quality', 'feature_match_rate', avg(CASE WHEN tier <> 'unmatched' THEN 1 ELSE 0 END), NULL FROM bt
UNION ALL SELECT 'features', 'factor_slice_features', 4, NULL UNION ALL SELECT 'features', 'flagged_leaky_features', 0, NULL)"""
FOUND = METRIC_SQL + ",\nfd AS (" + " UNION ALL ".join(
    f"SELECT '{area}' AS area, '{finding}' AS finding, metric, value, label, "
    + (f"CASE WHEN value {test} {bound} THEN '{yes}' ELSE '{no}' END" if test else f"'{yes}'") + f" AS severity FROM mt WHERE metric = '{metric}' AND value IS NOT NULL"
    for area, finding, metric, test, bound, yes, no in diagnostics.RULES
) + ")"


@query("metric_table", "A-28", f"WITH {METRIC_SQL} SELECT category, metric, round(value, 7) AS value, label FROM mt")
def metric_table_query(s):
    return metric_table(bets_once(s)).withColumn("value", F.round("value", 7))


@query("rule_findings", "A-29", f"WITH {FOUND} SELECT area, finding, metric, round(value, 7) AS value, label, severity FROM fd")
def rule_findings_query(s):
    return rule_findings(bets_once(s)).withColumn("value", F.round("value", 7))


@query(
    "iteration_score", "A-32",
    f"""WITH {FOUND}, c AS (SELECT count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (severity = 'medium') AS medium_count FROM fd), a AS (SELECT avg((ending - start) / start) AS r FROM sm)
SELECT high_count, medium_count, round(r, 7) AS avg_roi, round(100 * r - 10 * high_count - 3 * medium_count, 5) AS score FROM c, a""",
)
def iteration_score(s):
    s = bets_once(s)
    out = diagnostics.iteration_score(rule_findings(s), model_summary(s))
    return out.select("high_count", "medium_count", F.round("avg_roi", 7).alias("avg_roi"), F.round("score", 5).alias("score"))


@query(
    "model_statistics", "A-30 A-21",
    f"""WITH {BETS + SUMMARY[len(MODEL_BETS):] + DAILY[DAILY.index(",\ndy AS"):]}, ga AS (SELECT model, avg(pnl) FILTER (bet_side = 'HOME') - avg(pnl) FILTER (bet_side = 'AWAY') AS gap FROM bt GROUP BY 1),
rm AS (SELECT model, sqrt(avg(pow(home_margin - pred_ensemble, 2))) AS rmse FROM mb GROUP BY 1), vl AS (SELECT model, avg(daily_pnl) FILTER (vol_bucket = 'high_vol') - avg(daily_pnl) FILTER (vol_bucket = 'low_vol') AS v FROM vb GROUP BY 1),
ti AS (SELECT model, avg(pnl) FILTER (tier = 'mirrored') - avg(pnl) FILTER (tier = 'default') AS t FROM bt GROUP BY 1)
SELECT sm.model, num_bets, round((ending - start) / start, 7) AS roi, round(gap, {FINE}) AS home_away_pnl_gap, round(rmse, 6) AS rmse_mean, round(v, 9) AS vol_high_minus_low, round(t, {FINE}) AS tier_gap
FROM sm LEFT JOIN ga ON ga.model = sm.model LEFT JOIN rm ON rm.model = sm.model LEFT JOIN vl ON vl.model = sm.model LEFT JOIN ti ON ti.model = sm.model""",
)
def model_statistics(s):
    s = bets_once(s)
    summary = model_summary(s).select("model", "num_bets", "roi")
    out = diagnostics.model_statistics(summary, bets(s), s.model_bets, daily_regimes(s))
    return out.select("model", "num_bets", F.round("roi", 7).alias("roi"), *fine("home_away_pnl_gap", "tier_gap"), r6("rmse_mean").alias("rmse_mean"), F.round("vol_high_minus_low", 9).alias("vol_high_minus_low"))


@query(
    "slot_intervals", "J-19 ST-06",
    """WITH g AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, o_orderdate + to_minutes(CAST(18 * 60 + (o_orderkey % 4) * 30 AS BIGINT)) AS tip FROM orders), t AS (SELECT DISTINCT day, tip FROM g),
a AS (SELECT o_orderkey, day, count(*) FILTER (outcome = 'bad') AS fails, count(*) FILTER (outcome = 'ok') AS oks FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN l_returnflag = 'R' THEN 'bad' WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 'ok' ELSE 'other' END AS outcome FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1, 2),
l AS (SELECT t.day, t.tip, sum(fails) AS fails, sum(oks) AS oks FROM t JOIN g ON g.day = t.day AND g.tip = t.tip LEFT JOIN a ON a.o_orderkey = g.o_orderkey GROUP BY 1, 2)
SELECT strftime(day, '%Y-%m-%d') AS slate_date, strftime(tip, '%H%M') AS slot, CASE WHEN coalesce(oks, 0) > 0 THEN 'done' WHEN TIMESTAMP '1998-06-15 18:45:00' >= tip - INTERVAL 3 MINUTE THEN 'missed'
  WHEN TIMESTAMP '1998-06-15 18:45:00' >= tip - INTERVAL 20 MINUTE AND coalesce(fails, 0) < 3 THEN 'due' WHEN TIMESTAMP '1998-06-15 18:45:00' >= tip - INTERVAL 20 MINUTE THEN 'failed' ELSE 'waiting' END AS state FROM l""",
)
def slot_intervals(s):
    from lagwise.streaming.slots import slot_states

    o = s.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (18 * 60 + F.col("o_orderkey") % 4 * 30) * 60_000_000).alias("us"))
    g = o.withColumn("tip", F.timestamp_micros("us"))
    slots = g.select("day", "tip").distinct().select(
        F.lit("p").alias("provider"), F.date_format("day", "yyyy-MM-dd").alias("slate_date"), F.date_format("tip", "HHmm").alias("slot"),
        (F.col("tip") - F.expr("INTERVAL 20 MINUTES")).alias("opens"), (F.col("tip") - F.expr("INTERVAL 3 MINUTES")).alias("closes"), F.lit(False).alias("capped"),
    )
    outcome = F.when(F.col("l_returnflag") == "R", "error").when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40), "ok").otherwise("other")
    log = s.table("lineitem").join(g, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("p").alias("provider"), F.date_format("day", "yyyy-MM-dd").alias("slate_date"), F.date_format("tip", "HHmm").alias("slot"), outcome.alias("outcome")
    )
    now = F.lit("1998-06-15 18:45:00").cast("timestamp")
    return slot_states(slots, log, now).select("slate_date", "slot", "state")


@query(
    "anchored_groups", "ST-05 T-06",
    """WITH RECURSIVE t AS (SELECT CAST(ts AS DATE) AS day, epoch_us(date_trunc('minute', ts)) AS us FROM events), r AS (SELECT day, us, row_number() OVER (PARTITION BY day ORDER BY us) AS n FROM t),
w AS (SELECT day, n, us, us AS anchor FROM r WHERE n = 1 UNION ALL SELECT r.day, r.n, r.us, CASE WHEN r.us - w.anchor <= 7200000000 THEN w.anchor ELSE r.us END FROM w JOIN r ON r.day = w.day AND r.n = w.n + 1)
SELECT strftime(day, '%Y-%m-%d') AS day, anchor AS first_us, count(*) AS size FROM w GROUP BY 1, 2""",
)
def anchored_groups(s):
    from lagwise.streaming.slots import anchored_groups as groups

    e = s.table("events").select(F.to_date("ts").alias("day"), F.unix_micros(F.date_trunc("minute", F.col("ts").cast("timestamp"))).alias("us"))
    out = groups(e, ["day"], "us", 7_200_000_000)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "first_us", "size")
