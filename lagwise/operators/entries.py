"""Does a forecast know more than the price at some time of entry? Entries are rows, so one set of sums serves them all."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions.numeric import clip
from lagwise.operators.joins import asof
from lagwise.session import cut_lineage


def without_margin(home: Column, away: Column) -> tuple[Column, Column]:
    """Home probability and overround of decimal prices, the margin taken off in proportion."""
    h, a = 1 / home, 1 / away
    return h / (h + a), h + a


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def grouped_ols(rows: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], cluster: str) -> DataFrame:
    """``keys, term, coef, se, p, n``: least squares with intercept and cluster-robust errors, for every group at once.

    Two aggregates over the rows, whatever the number of groups; the driver gets one k x k system a group. A group with
    too few rows or collinear columns has null coefficients. Groups are few (reports, not entities).
    """
    k = len(xs) + 1
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    clean = rows.dropna(subset=[y, *xs])
    clean = clean.select(*keys, F.col(cluster).alias("__g"), F.col(y).cast("double").alias("__y"), *[c.alias(f"__x{i}") for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"a{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"__x{i}") * F.col("__y")).alias(f"b{i}") for i in range(k)],
    ).collect()

    def symmetric(row) -> np.ndarray:
        m = np.zeros((k, k))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"a{i}_{j}"]
        return m

    solved = {}
    for r in first:
        m = symmetric(r)
        if r["n"] > k and np.linalg.cond(m) < 1e14:
            inverse = np.linalg.inv(m)
            solved[tuple(r[c] for c in keys)] = (inverse, inverse @ np.array([r[f"b{i}"] for i in range(k)]))
    out, spark, kinds = [], rows.sparkSession, dict(clean.dtypes)
    if solved:
        betas = spark.createDataFrame([(*g, *map(float, b)) for g, (_, b) in solved.items()], ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [f"__b{i} double" for i in range(k)]))
        fitted = sum((F.col(f"__x{i}") * F.col(f"__b{i}") for i in range(1, k)), F.col("__b0"))
        same = [clean[c].eqNullSafe(betas[c]) for c in keys]
        on = same[0]
        for s in same[1:]:
            on = on & s
        scored = clean.join(F.broadcast(betas), on).select(*[clean[c] for c in keys], "__g", *[(F.col(f"__x{i}") * (F.col("__y") - fitted)).alias(f"__s{i}") for i in range(k)])  # one row a group
        per_cluster = scored.groupBy(*keys, "__g").agg(*[F.sum(f"__s{i}").alias(f"__s{i}") for i in range(k)])
        meat = per_cluster.groupBy(*keys).agg(*[F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")).alias(f"a{i}_{j}") for i, j in pairs])
        for r in meat.collect():
            g = tuple(r[c] for c in keys)
            inverse, beta = solved[g]
            solved[g] = (np.sqrt(np.diag(inverse @ symmetric(r) @ inverse)), beta)
    for r in first:
        g = tuple(r[c] for c in keys)
        se, beta = solved.get(g, (None, None))
        for i, term in enumerate(["intercept", *xs]):
            fit = (None, None, None) if se is None else (float(beta[i]), float(se[i]), math.erfc(abs(beta[i] / se[i]) / math.sqrt(2)) if se[i] > 0 else None)
            out.append((*g, term, *fit, int(r["n"])))
    return spark.createDataFrame(out, ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["term string, coef double, se double, p double, n bigint"]))


def entry_prices(games: DataFrame, quotes: DataFrame, key: str, start: str, at: str, hours: dict[str, float], most: float = 1.08) -> DataFrame:
    """``games`` by entry: decimal prices, home probability and that of the close, one row per (game, entry).

    ``hours`` gives for each entry how long before ``start`` its last quote counts; ``close`` must be one of them.
    ``quotes`` needs the key, ``at``, decimal_home, decimal_away. Games with a broken quote (overround outside 1 to
    ``most``) or without one at some entry are left out, so all entries compare the same games.
    """
    cuts = F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(float(h)).alias("h")) for e, h in hours.items()])
    wanted = games.withColumn("__e", F.explode(cuts)).select(*games.columns, "__e.entry", (F.unix_micros(start) - F.col("__e.h") * 3.6e9).cast("bigint").alias("__cut"))
    wanted = wanted.withColumn("__cut", F.timestamp_micros("__cut"))
    found = asof(wanted, quotes, [key], "__cut", at, ["decimal_home", "decimal_away"], prefix="__q_")
    p, over = without_margin(F.col("__q_decimal_home"), F.col("__q_decimal_away"))
    rows = found.select(*games.columns, "entry", F.col("__q_decimal_home").alias("decimal_home"), F.col("__q_decimal_away").alias("decimal_away"), p.alias("p_entry"), over.alias("__over"))
    whole = rows.groupBy(key).agg(
        F.count(F.when(F.col("__over").between(1.0, most), 1)).alias("__good"), F.max(F.when(F.col("entry") == "close", F.col("p_entry"))).alias("p_close"),
    ).where(F.col("__good") == len(hours))
    return rows.join(whole.drop("__good"), key).drop("__over")


def entry_report(rows: DataFrame, forecasts: dict[str, str], won: str, cluster: str, least_ev: float = 0.03) -> DataFrame:
    """``forecast, entry, n, clv_slope, clv_se, bets, mean_clv, mean_clv_se, roi, roi_se, close_slope, close_se, log_loss``.

    ``rows`` are those of ``entry_prices``; ``forecasts`` maps names to columns of home probabilities. Per forecast and
    entry: the slope of the price's later move (in log odds) on the forecast's gap to the entry price; bets with an
    expected value above ``least_ev`` on their better side, their mean gain against the close and return. Per forecast:
    the slope of the outcome less the close on the forecast less the close, 0 if the close knows all.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("forecast"), F.col(c).alias("p")) for n, c in forecasts.items()]))
    long = rows.select("*", each.alias("__f")).select("*", "__f.forecast", "__f.p").where("p IS NOT NULL")
    p = clip(F.col("p"), 0.01, 0.99)
    home_ev, away_ev = p * F.col("decimal_home") - 1, (1 - p) * F.col("decimal_away") - 1
    on_home = (home_ev > least_ev) & (home_ev >= away_ev)
    price = F.when(on_home, F.col("decimal_home")).otherwise(F.col("decimal_away"))
    fair = F.when(on_home, F.col("p_close")).otherwise(1 - F.col("p_close"))
    hit = F.when(on_home, F.col(won) == 1).otherwise(F.col(won) == 0)
    bet = on_home | (away_ev > least_ev)
    q = clip(F.col("p"), 0.01, 0.99)
    long = cut_lineage(long.select(
        "forecast", "entry", F.col(cluster).alias("__cluster"), (logit(F.col("p_close")) - logit(F.col("p_entry"))).alias("move"), (logit(p) - logit(F.col("p_entry"))).alias("gap"),
        (F.col(won) - F.col("p_close")).alias("surprise"), (p - F.col("p_close")).alias("over_close"),
        F.when(bet, fair * price - 1).alias("clv"), F.when(bet, F.when(hit, price - 1).otherwise(-1.0)).alias("ret"),
        (-F.when(F.col(won) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("loss"),
    ))
    error = lambda c: F.stddev_samp(c) / F.sqrt(F.count(c))
    means = long.groupBy("forecast", "entry").agg(
        F.count(F.lit(1)).alias("n"), F.count("clv").alias("bets"), F.avg("clv").alias("mean_clv"), error("clv").alias("mean_clv_se"),
        F.avg("ret").alias("roi"), error("ret").alias("roi_se"), F.avg("loss").alias("log_loss"),
    )
    moves = grouped_ols(long.where("entry <> 'close'"), ["forecast", "entry"], "move", ["gap"], "__cluster").where("term = 'gap'")
    knows = grouped_ols(long.where("entry = 'close'"), ["forecast"], "surprise", ["over_close"], "__cluster").where("term = 'over_close'")
    return means.join(moves.select("forecast", "entry", F.col("coef").alias("clv_slope"), F.col("se").alias("clv_se")), ["forecast", "entry"], "left").join(
        knows.select("forecast", F.col("coef").alias("close_slope"), F.col("se").alias("close_se")), "forecast", "left"
    ).select("forecast", "entry", "n", "clv_slope", "clv_se", "bets", "mean_clv", "mean_clv_se", "roi", "roi_se", "close_slope", "close_se", "log_loss")


def spread_report(rows: DataFrame, margin: str, line: str, forecasts: Sequence[str], cluster: str, top: float = 0.2) -> DataFrame:
    """``forecast, slice, n, line_rmse, model_rmse, slope, se, p`` for all rows and for the ``top`` share by size of edge.

    ``line`` is the home handicap; the slope is that of the market's error on the forecast's edge over the market.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("forecast"), F.col(c).cast("double").alias("pred")) for c in forecasts]))
    long = rows.where(F.col(margin).isNotNull() & F.col(line).isNotNull()).select(margin, line, cluster, each.alias("f")).where("f.pred IS NOT NULL")
    long = cut_lineage(long.select("f.forecast", F.col(cluster).alias("__cluster"), (F.col(margin) + F.col(line)).cast("double").alias("error"), (F.col("f.pred") + F.col(line)).cast("double").alias("edge")))
    cut = long.groupBy("forecast").agg(F.percentile(F.abs("edge"), 1 - top).alias("__cut"))
    slices = F.explode(F.when(F.abs("edge") >= F.col("__cut"), F.array(F.lit("all"), F.lit("top"))).otherwise(F.array(F.lit("all"))))
    both = long.join(F.broadcast(cut), "forecast").withColumn("slice", slices)  # one row a forecast
    rmse = lambda c: F.sqrt(F.avg(c * c))
    means = both.groupBy("forecast", "slice").agg(F.count(F.lit(1)).alias("n"), rmse(F.col("error")).alias("line_rmse"), rmse(F.col("error") - F.col("edge")).alias("model_rmse"))
    fits = grouped_ols(both, ["forecast", "slice"], "error", ["edge"], "__cluster").where("term = 'edge'")
    return means.join(fits.select("forecast", "slice", F.col("coef").alias("slope"), "se", "p"), ["forecast", "slice"], "left")
