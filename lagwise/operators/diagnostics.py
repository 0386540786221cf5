"""Grouped diagnostics over bet rows: summaries, cross-tabs, slices, findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.ranking import top_n


def outcome_summary(bets: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Counts, sums, means, population deviation and win rates, overall and by side."""
    home, away = F.col("bet_side") == "HOME", F.col("bet_side") == "AWAY"
    won = (F.col("bet_win") == 1).cast("int")

    def total(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("pnl"))), F.lit(0.0))

    return bets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_bets"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("avg_pnl_per_bet"),
        F.stddev_pop("pnl").alias("std_pnl_per_bet"),
        F.count(F.when(home, 1)).alias("home_bets"),
        total(home).alias("home_pnl"),
        F.avg(F.when(home, F.col("pnl"))).alias("home_avg_pnl"),
        F.count(F.when(away, 1)).alias("away_bets"),
        total(away).alias("away_pnl"),
        F.avg(F.when(away, F.col("pnl"))).alias("away_avg_pnl"),
        F.avg(won).alias("win_rate"),
        F.avg(F.when(home, won)).alias("home_win_rate"),
        F.avg(F.when(away, won)).alias("away_win_rate"),
        F.sum(F.when(home, won)).alias("home_wins"),
        F.sum(F.when(away, won)).alias("away_wins"),
    )


def quality_crosstab(bets: DataFrame, flag: str, tier: str) -> DataFrame:
    """By flag, by tier and by both in one pass; ``level`` names the grouping, null groups are kept."""
    m, f, t = F.col("model"), F.col(flag), F.col(tier)
    out = bets.groupingSets([[m, f], [m, t], [m, f, t]], m, f, t).agg(
        F.grouping_id().alias("__g"),
        F.count(F.lit(1)).alias("bets"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("avg_pnl_per_bet"),
        F.avg("bet_win").alias("win_rate"),
    )
    level = F.when(F.col("__g") == 1, "flag").when(F.col("__g") == 2, "tier").otherwise("flag_tier")
    return out.withColumn("level", level).drop("__g")


def error_breakdown(rows: DataFrame, error: Column, bucket: Column, won: Column) -> DataFrame:
    """RMSE, MAE and count per model overall, by spread bucket, by home team, away team and outcome."""
    base = rows.select("model", error.alias("__e"), bucket.alias("spread_bucket"), "home", "away", won.alias("outcome"))
    m = F.col("model")
    cuts = ["spread_bucket", "home", "away", "outcome"]
    sets = [[m]] + [[m, F.col(c)] for c in cuts]
    out = base.groupingSets(sets, m, *[F.col(c) for c in cuts]).agg(
        F.grouping_id().alias("__g"),
        F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"),
        F.avg(F.abs("__e")).alias("mae"),
        F.count("__e").alias("n"),
    )
    kind = (
        F.when(F.col("__g") == 15, "overall").when(F.col("__g") == 7, "spread_bucket").when(F.col("__g") == 11, "home")
        .when(F.col("__g") == 13, "away").otherwise("outcome")
    )
    label = F.coalesce(*[F.col(c).cast("string") for c in cuts], F.lit("all"))
    return out.select("model", kind.alias("group_type"), label.alias("group_value"), "rmse", "mae", "n")


def fold_metrics(rows: DataFrame, error: Column, keys: Sequence[str] = ("fold",), date: str = "game_date") -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min(date).alias("test_start"), F.max(date).alias("test_end"), F.count(F.lit(1)).alias("rows"),
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
    )


def factor_slices(bets: DataFrame, factors: dict[str, str], min_bets: int) -> DataFrame:
    """Every factor level per model in one aggregation. ``factors``: column -> factor group."""
    cells = F.array(*[
        F.struct(F.lit(group).alias("factor_group"), F.lit(c).alias("factor_name"), F.col(c).cast("string").alias("factor_level"))
        for c, group in factors.items()
    ])
    long = bets.select("model", "pnl", "bet_win", "edge", "kelly", "selected_ev", F.explode(cells).alias("f")).where("f.factor_level IS NOT NULL")
    out = long.groupBy("model", "f.factor_group", "f.factor_name", "f.factor_level").agg(
        F.count(F.lit(1)).alias("bets"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("roi_per_bet"),
        F.avg("bet_win").alias("win_rate"),
        F.avg("edge").alias("avg_edge"),
        F.avg("kelly").alias("avg_kelly"),
        F.avg("selected_ev").alias("avg_selected_ev"),
    )
    return out.where(F.col("bets") >= min_bets)


def top_levels(slices: DataFrame, n: int) -> DataFrame:
    """The n levels with most bets of each factor, ties by total P&L."""
    order = [F.col("bets").desc(), F.col("total_pnl").desc(), F.col("factor_level").asc()]
    return top_n(slices, ["model", "factor_group", "factor_name"], order, n)


def impact_spread(slices: DataFrame, min_bets: int, n: int) -> DataFrame:
    """Best minus worst level of each factor; the n widest factors per model."""
    known = slices.where((F.col("bets") >= min_bets) & F.col("roi_per_bet").isNotNull())
    best = F.max_by("factor_level", F.struct("roi_per_bet", "factor_level"))
    worst = F.min_by("factor_level", F.struct("roi_per_bet", "factor_level"))
    out = known.groupBy("model", "factor_group", "factor_name").agg(
        best.alias("top_level"), F.max("roi_per_bet").alias("top_roi_per_bet"),
        worst.alias("bottom_level"), F.min("roi_per_bet").alias("bottom_roi_per_bet"),
        F.count(F.lit(1)).alias("level_count"), F.sum("bets").alias("total_bets"),
    ).where("level_count >= 2")
    out = out.withColumn("impact_spread", F.col("top_roi_per_bet") - F.col("bottom_roi_per_bet"))
    return top_n(out, ["model"], [F.abs("impact_spread").desc(), F.col("factor_name").asc()], n)


def period_summary(bets: DataFrame, date: str = "game_date", season: str = "season") -> DataFrame:
    """Month rows and season rows per model in one pass."""
    rows = bets.withColumn("month", F.date_format(date, "yyyy-MM"))
    m, mo, se = F.col("model"), F.col("month"), F.col(season)
    out = rows.groupingSets([[m, mo], [m, se]], m, mo, se).agg(
        F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("bets"), F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("avg_pnl_per_bet"), F.avg("bet_win").alias("win_rate"),
    )
    return out.select(
        "model", F.when(F.col("__g") == 1, "month").otherwise("season").alias("period_kind"),
        F.coalesce("month", F.col(season).cast("string")).alias("period"),
        "bets", "total_pnl", "avg_pnl_per_bet", "win_rate",
    )


def reconcile(months: DataFrame, seasons: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Do month totals and season totals of each model agree? One status row per check."""
    a = months.groupBy("model").agg(F.sum("bets").alias("mb"), F.sum("total_pnl").alias("mp"))
    b = seasons.groupBy("model").agg(F.sum("bets").alias("sb"), F.sum("total_pnl").alias("sp"))
    j = a.join(b, "model", "full_outer").fillna(0)
    worst = j.agg(F.max(F.abs(F.col("mb") - F.col("sb"))).alias("b"), F.max(F.abs(F.col("mp") - F.col("sp"))).alias("p"))

    def row(check: str, diff: Column, limit: float) -> Column:
        return F.struct(
            F.lit(check).alias("check"), F.when(diff <= limit, "pass").otherwise("warn").alias("status"), diff.cast("double").alias("max_diff")
        )

    checks = F.array(row("monthly_bets_reconcile", F.col("b"), 0.0), row("monthly_pnl_reconcile", F.col("p"), tolerance))
    return worst.select(F.explode(checks).alias("r")).select("r.*")


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width right-closed probability bins on [0, 1], the lowest edge included."""
    number = F.greatest(F.ceil(F.col(p) * bins), F.lit(1)).cast("int")
    inside = rows.where(F.col(p).between(0, 1))
    return inside.groupBy(*keys, number.alias("bin")).agg(
        F.avg(p).alias("mean_pred"), F.avg(y).alias("actual"), F.count(F.lit(1)).alias("n")
    )


def side_ledger_summary(ledger: DataFrame, start: float) -> DataFrame:
    """Per model: start, end, ROI, totals, win rate, mean edge and chosen-side EV, maximum drawdown.

    ``ledger`` is a compounded bet table with game_date and game_id.
    """
    placed = F.col("bet_side") != "NONE"
    chosen = F.when(F.col("bet_side") == "HOME", F.col("ev_home")).when(F.col("bet_side") == "AWAY", F.col("ev_away"))
    return ledger.groupBy("model").agg(
        F.lit(start).alias("starting_bankroll"),
        F.max_by("bankroll", F.struct("game_date", "game_id")).alias("ending_bankroll"),
        F.sum("pnl").alias("total_pnl"),
        F.count(F.when(placed, 1)).alias("num_bets"),
        F.avg(F.when(placed, F.col("bet_win"))).alias("win_rate"),
        F.avg(F.when(placed, F.col("edge"))).alias("avg_edge"),
        F.avg(F.when(placed, chosen)).alias("avg_ev_selected_side"),
        F.min("drawdown").alias("max_drawdown"),
    ).withColumn("roi", (F.col("ending_bankroll") - start) / start)


def strategy_summary(matrix: DataFrame) -> DataFrame:
    """Per strategy: mean and median ROI over its models, mean drawdown, all bets, and the best model (ties: the greatest name)."""
    best = F.struct("roi", "model")
    return matrix.groupBy("strategy_id").agg(
        F.avg("roi").alias("avg_roi"), F.percentile("roi", F.lit(0.5)).alias("median_roi"), F.avg("max_drawdown").alias("avg_max_drawdown"),
        F.sum("bets_placed").alias("total_bets"), F.max_by("model", best).alias("best_model"), F.max("roi").alias("best_roi"),
    )


def model_statistics(summary: DataFrame, bets: DataFrame, predictions: DataFrame, regimes: DataFrame) -> DataFrame:
    """Figures of each model of ``summary`` side by side: gaps of mean P&L between sides and between price tiers, RMSE, and
    mean daily P&L of volatile minus calm days. A figure is null where the model has no row of one kind."""

    def gap(kind: str, high: str, low: str, value: str) -> Column:
        return F.avg(F.when(F.col(kind) == high, F.col(value))) - F.avg(F.when(F.col(kind) == low, F.col(value)))

    error = F.col("home_margin") - F.col("pred_ensemble")
    parts = [
        bets.groupBy("model").agg(gap("bet_side", "HOME", "AWAY", "pnl").alias("home_away_pnl_gap"), gap("tier", "mirrored", "default", "pnl").alias("tier_gap")),
        predictions.groupBy("model").agg(F.sqrt(F.avg(error * error)).alias("rmse_mean")),
        regimes.groupBy("model").agg(gap("vol_bucket", "high_vol", "low_vol", "daily_pnl").alias("vol_high_minus_low")),
    ]
    return reduce(lambda out, part: out.join(part, "model", "left"), parts, summary)


def profit_rank(summary: DataFrame) -> DataFrame:
    """Models by growth, then ROI, then drawdown. One row per model reaches the ordering."""
    out = summary.withColumn("bankroll_growth", F.col("ending_bankroll") / F.col("starting_bankroll"))
    out = out.withColumn("profitable_flag", F.col("ending_bankroll") > F.col("starting_bankroll"))
    w = Window.orderBy(F.col("bankroll_growth").desc(), F.col("roi").desc(), F.col("max_drawdown").desc(), F.col("model").asc())
    return out.withColumn("profit_rank", F.row_number().over(w))


def long_report(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of (category, metric, value) rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def metric_rows(df: DataFrame, category: str, metrics: dict[str, Column]) -> DataFrame:
    """One-row aggregate to (category, metric, value) rows."""
    one = df.agg(*[c.cast("string").alias(n) for n, c in metrics.items()])
    rows = F.array(*[F.struct(F.lit(category).alias("category"), F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])
    return one.select(F.explode(rows).alias("r")).select("r.*")


# Order of finding severities.
SEVERITY_ORDER = {"high": 0, "medium": 1, "positive": 2}


def severity_rank(severity: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in SEVERITY_ORDER.items() for v in pair])
    return F.try_element_at(table, severity)


def findings(rules: Sequence[tuple[DataFrame, str, str, str, Column, Column]]) -> DataFrame:
    """Rule rows (area, finding, metric, value, severity), most severe first.

    A rule is (one-row frame, area, finding, metric, value, severity).
    """
    rows = [
        df.select(
            F.lit(area).alias("area"), F.lit(text).alias("finding"), F.lit(metric).alias("metric"),
            value.cast("double").alias("value"), severity.alias("severity"),
        )
        for df, area, text, metric, value, severity in rules
    ]
    return long_report(rows).orderBy(severity_rank(F.col("severity")), "area", "finding")


METRICS = "category string, metric string, value double, label string"


def measured(df: DataFrame, category: str, metrics: dict[str, Column | tuple[Column, Column]]) -> DataFrame:
    """Aggregates of ``df`` as rows ``category, metric, value, label``; a pair is a figure and the name it belongs to."""
    pairs = {n: c if isinstance(c, tuple) else (c, F.max(F.lit(None))) for n, c in metrics.items()}
    one = df.agg(*[x for n, (v, name) in pairs.items() for x in (v.cast("double").alias(f"v_{n}"), name.cast("string").alias(f"l_{n}"))])
    rows = F.array(*[F.struct(F.lit(category).alias("category"), F.lit(n).alias("metric"), F.col(f"v_{n}").alias("value"), F.col(f"l_{n}").alias("label")) for n in pairs])
    return one.select(F.explode(rows).alias("r")).select("r.*")


# Which figure each rule reads, its test, the severity if the test holds and if not. No test: always the first.
RULES = (
    # area, finding, metric, test, bound, severity, otherwise
    ("models", "highest return of a model", "best_model_roi", None, None, "positive", None),
    ("models", "lowest return of a model", "worst_model_roi", None, None, "high", None),
    ("models", "mean share of bets won", "avg_model_win_rate", "<", 0.5, "medium", "positive"),
    ("price tiers", "highest mean result of a tier", "best_market_pnl", ">", 0.0, "positive", "medium"),
    ("price tiers", "lowest mean result of a tier", "worst_market_pnl", "<", 0.0, "high", "medium"),
    ("time", "share of losing months", "negative_month_share", ">", 0.6, "high", "medium"),
    ("regimes", "volatile less calm days", "vol_high_minus_low", ">", 0.0, "positive", "medium"),
    ("calibration", "highest return of an edge decile", "best_decile_roi", ">", 0.0, "positive", "medium"),
    ("calibration", "lowest return of an edge decile", "worst_decile_roi", "<", 0.0, "high", "medium"),
    ("data quality", "required columns that are missing", "missing_hard_required_columns", ">", 0.0, "high", "positive"),
    ("data quality", "share of rows with features", "feature_match_rate", ">=", 0.99, "positive", "medium"),
)
RULE_KIND = "area string, finding string, metric string, test string, bound double, severity string, otherwise string"


def rule_findings(metrics: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """``area, finding, metric, value, label, severity``: rules are rows, joined to the long metric table by name.

    A rule whose metric is absent or null gives no finding; a new rule needs a row and no code. Most severe first.
    """
    table = metrics.sparkSession.createDataFrame(list(rules), RULE_KIND)
    j = table.join(metrics.where("value IS NOT NULL").select("metric", "value", "label"), "metric")
    v, b = F.col("value"), F.col("bound")
    holds = (
        F.when(F.col("test").isNull(), True).when(F.col("test") == "<", v < b).when(F.col("test") == "<=", v <= b)
        .when(F.col("test") == ">", v > b).when(F.col("test") == ">=", v >= b)
    )
    found = j.select("area", "finding", "metric", "value", "label", F.when(holds, F.col("severity")).otherwise(F.col("otherwise")).alias("severity"))
    return found.orderBy(severity_rank(F.col("severity")), "area", "finding")


def iteration_score(found: DataFrame, roi: DataFrame) -> DataFrame:
    """100 x mean ROI - 10 x high - 3 x medium."""
    counts = found.agg(
        F.count(F.when(F.col("severity") == "high", 1)).alias("high_count"),
        F.count(F.when(F.col("severity") == "medium", 1)).alias("medium_count"),
    ).withColumn("__one", F.lit(1))
    mean = roi.agg(F.coalesce(F.avg("roi"), F.lit(0.0)).alias("avg_roi")).withColumn("__one", F.lit(1))
    j = counts.join(F.broadcast(mean), "__one").drop("__one")  # one row each
    return j.withColumn("score", 100 * F.col("avg_roi") - 10 * F.col("high_count") - 3 * F.col("medium_count"))
