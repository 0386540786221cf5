"""Queries over join operators and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.operators import aggregates, joins, sets
from lagwise.plans.adapters import GAMES, MODEL_BETS, PREDICTIONS, PRICES, QUOTES, TEAM_GAMES
from lagwise.plans.catalog.common import TEAM_LINE, r6, text_date
from lagwise.plans.registry import query


@query(
    "side_attach", "J-01 J-02",
    f"""WITH {TEAM_GAMES}, f AS (SELECT game_id, team, lag(pts) OVER (PARTITION BY team ORDER BY d, game_id) AS prev FROM tg)
SELECT g.game_id, h.prev AS home_prev, a.prev AS away_prev FROM games g LEFT JOIN f h ON h.game_id = g.game_id AND h.team = g.home
LEFT JOIN f a ON a.game_id = g.game_id AND a.team = g.away WHERE g.home_handicap IS NOT NULL""",
)
def side_attach(s):
    from lagwise.operators.timeline import framed

    f = framed(s.team_games, TEAM_LINE, lambda w: {"prev": F.lag("pts").over(w)}, 1)
    out = joins.attach_side(s.games.where("home_handicap IS NOT NULL"), f, "home", "game_id", "team", ["prev"])
    return joins.attach_side(out, f, "away", "game_id", "team", ["prev"]).select("game_id", "home_prev", "away_prev")


@query(
    "sides_to_wide", "J-03",
    f"WITH {GAMES} SELECT game_id, home AS home_team, away AS away_team, score_home AS home_pts, score_away AS away_pts FROM games",
)
def sides_to_wide(s):
    return joins.sides_to_wide(s.team_games, "game_id", F.col("is_home") == 1, ["team", "pts"])


@query(
    "opponent_rows", "J-04 J-05 C-32",
    f"""WITH {TEAM_GAMES} SELECT game_id, team, opp AS opp_team, pts, opp_pts AS pts_opp, pts - opp_pts AS net_pts FROM tg""",
)
def opponent_rows(s):
    t = s.team_games.select("game_id", "team", "pts")
    return joins.opponent_rows(t, "game_id", "team", ["pts"]).withColumn("net_pts", F.col("pts") - F.col("pts_opp"))


@query(
    "contract_join", "J-05 Q-07",
    f"WITH {PRICES} SELECT g.game_id, g.season, p.home_american FROM games g LEFT JOIN prices p ON g.game_id = p.game_id",
)
def contract_join(s):
    return joins.contract_join(s.games.select("game_id", "season"), s.prices.select("game_id", "home_american"), ["game_id"], "left", "1:1")


TWO_PHASE = PRICES + """,
src AS (SELECT CASE WHEN game_id % 3 = 0 THEN NULL ELSE game_id END AS game_id, game_date, home, away, home_american, away_american FROM prices),
p1 AS (SELECT game_id, max(home_american) AS ph, max(away_american) AS pa FROM src WHERE game_id IS NOT NULL GROUP BY game_id),
j AS (SELECT g.game_id, g.game_date, p1.ph, p1.pa, s.home_american AS fh, s.away_american AS fa FROM games g LEFT JOIN p1 ON g.game_id = p1.game_id
  LEFT JOIN src s ON s.game_date = g.game_date AND s.home = g.home AND s.away = g.away),
m AS (SELECT game_id, CASE WHEN ph IS NOT NULL OR pa IS NOT NULL THEN 'primary' WHEN fh IS NOT NULL OR fa IS NOT NULL THEN 'fallback' ELSE 'none' END AS match, ph, pa, fh, fa FROM j),
tp AS (SELECT game_id, match, CASE WHEN match = 'primary' THEN ph ELSE fh END AS home_american, CASE WHEN match = 'primary' THEN pa ELSE fa END AS away_american FROM m)"""


def two_phase(s):
    src = s.prices.withColumn("game_id", F.when(F.col("game_id") % 3 != 0, F.col("game_id"))).drop("book_spread")
    left = s.games.select("game_id", "game_date", "home", "away")
    return joins.two_phase_match(
        left, src, ["game_id"], ["game_date", "home", "away"], ["home_american", "away_american"],
        ["home_american", "away_american"],
    )


@query("two_phase_match", "J-06", f"WITH {TWO_PHASE} SELECT * FROM tp")
def two_phase_match(s):
    return two_phase(s).select("game_id", "match", "home_american", "away_american")


@query(
    "join_audit", "J-17 A-35",
    f"""WITH {TWO_PHASE} SELECT count(*) AS feature_rows, count(*) FILTER (match = 'primary') AS primary_match_count,
  count(*) FILTER (match = 'fallback') AS fallback_match_count, count(*) FILTER (home_american IS NULL AND away_american IS NOT NULL) AS mirror_home_count,
  count(*) FILTER (away_american IS NULL AND home_american IS NOT NULL) AS mirror_away_count,
  count(*) FILTER (home_american IS NULL AND away_american IS NULL) AS default_count,
  round(avg(CASE WHEN home_american IS NOT NULL OR away_american IS NOT NULL THEN 1 ELSE 0 END), 6) AS match_rate FROM tp""",
)
def join_audit(s):
    h, a = F.col("home_american").isNull(), F.col("away_american").isNull()

    def n(cond, name):
        return F.count(F.when(cond, 1)).alias(name)

    return two_phase(s).agg(
        F.count(F.lit(1)).alias("feature_rows"), n(F.col("match") == "primary", "primary_match_count"),
        n(F.col("match") == "fallback", "fallback_match_count"), n(h & ~a, "mirror_home_count"), n(a & ~h, "mirror_away_count"),
        n(h & a, "default_count"), r6(F.avg((~(h & a)).cast("int"))).alias("match_rate"),
    )


@query(
    "merge_families", "J-07 A-02",
    """WITH a AS (SELECT l_orderkey, l_partkey, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
b AS (SELECT l_orderkey, l_partkey, avg(l_tax) AS t FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_partkey, b.l_partkey) AS l_partkey, round(q, 6) AS adv_l_quantity, round(t, 6) AS ff_l_tax
FROM a FULL OUTER JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey""",
)
def merge_families(s):
    li = s.table("lineitem")
    out = joins.merge_families(
        {"adv": li.where("l_returnflag = 'A'").select("l_orderkey", "l_partkey", "l_quantity"),
         "ff": li.where("l_linestatus = 'F'").select("l_orderkey", "l_partkey", "l_tax")},
        ["l_orderkey", "l_partkey"],
    )
    return out.select("l_orderkey", "l_partkey", r6("adv_l_quantity").alias("adv_l_quantity"), r6("ff_l_tax").alias("ff_l_tax"))


@query(
    "semi_and_anti", "J-08 J-09 S-10 ST-03",
    """SELECT o_orderkey, 'with_children' AS kind FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def semi_and_anti(s):
    o, li = s.table("orders").select("o_orderkey"), s.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    o, li = sets.dealt_alike(o, li, ["o_orderkey"])
    return o.join(li, "o_orderkey", "left_semi").withColumn("kind", F.lit("with_children")).unionByName(
        o.join(li, "o_orderkey", "left_anti").withColumn("kind", F.lit("missing"))
    )


@query(
    "missing_work_index", "S-10",
    """WITH fam AS (SELECT unnest(['A', 'N', 'R']) AS family), have AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem)
SELECT o_orderkey, family FROM orders, fam WHERE NOT EXISTS (SELECT 1 FROM have WHERE l_orderkey = o_orderkey AND l_returnflag = family)""",
)
def missing_work_index(s):
    from lagwise.sources.tables import missing_work

    stored = s.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("family"))
    return missing_work(s.table("orders").select("o_orderkey"), stored, ["o_orderkey"], "family", ["A", "N", "R"])


@query(
    "asof_snapshot", "J-10",
    f"""WITH {QUOTES}, e AS (SELECT quote_id, entity, ts + INTERVAL 10 HOUR AS cutoff FROM quotes WHERE market = 'purchase'),
q AS (SELECT * FROM quotes WHERE market IN ('view', 'click'))
SELECT e.quote_id, e.entity, arg_max(q.price, (q.ts, q.quote_id)) AS asof_price, max(q.quote_id) FILTER (q.ts = m.mts) AS asof_quote_id
FROM e LEFT JOIN q ON q.entity = e.entity AND q.ts <= e.cutoff
LEFT JOIN (SELECT e.quote_id, max(q.ts) AS mts FROM e JOIN q ON q.entity = e.entity AND q.ts <= e.cutoff GROUP BY 1) m ON m.quote_id = e.quote_id
GROUP BY e.quote_id, e.entity""",
)
def asof_snapshot(s):
    e = s.quotes.where("market = 'purchase'").select("quote_id", "entity", (F.col("ts") + F.expr("INTERVAL 10 HOURS")).alias("cutoff"))
    q = s.quotes.where("market IN ('view', 'click')")
    out = joins.asof(e, q, ["entity"], "cutoff", "ts", ["price", "quote_id"], ["quote_id"])
    return out.select("quote_id", "entity", "asof_price", "asof_quote_id")


@query(
    "asof_horizons", "J-11",
    f"""WITH {QUOTES}, e AS (SELECT quote_id, entity, ts FROM quotes WHERE market = 'purchase'), h AS (SELECT unnest([24, 12, 6, 3]) AS h),
c AS (SELECT e.quote_id, e.entity, h.h, e.ts - h.h * INTERVAL 1 HOUR AS cutoff FROM e, h),
q AS (SELECT entity, quote_id, ts, price AS bid, price + (quote_id % 20) / 100.0 AS ask FROM quotes WHERE market <> 'purchase' AND quote_id % 5 <> 0),
l AS (SELECT c.quote_id, c.h, c.cutoff, arg_max({{'ts': q.ts, 'bid': q.bid, 'ask': q.ask}}, (q.ts, q.quote_id)) AS b FROM c JOIN q ON q.entity = c.entity AND q.ts <= c.cutoff
  GROUP BY c.quote_id, c.h, c.cutoff)
SELECT quote_id, h, b.bid AS asof_bid, round(b.ask, 6) AS asof_ask FROM l WHERE epoch_us(cutoff) - epoch_us(b.ts) <= 72 * 3600000000 AND b.ask - b.bid <= 0.10""",
)
def asof_horizons(s):
    e = s.quotes.where("market = 'purchase'").select("quote_id", "entity", "ts")
    q = s.quotes.where("market <> 'purchase'").select(
        "entity", "quote_id", "ts", F.when(F.col("quote_id") % 5 != 0, F.col("price")).alias("bid"),
        (F.col("price") + F.col("quote_id") % 20 / 100.0).alias("ask"),
    )
    out = joins.asof_at_horizons(e, q, ["entity"], "ts", "ts", "bid", "ask", ["quote_id"], [24, 12, 6, 3], 72, 0.10)
    return out.select("quote_id", "h", "asof_bid", r6("asof_ask").alias("asof_ask"))


@query(
    "small_dimension_join", "J-13",
    """SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def small_dimension_join(s):
    n = s.table("nation").join(s.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return s.table("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query(
    "period_attribute", "J-14",
    f"""WITH {TEAM_GAMES}, st AS (SELECT season, date_trunc('month', game_date) AS month, team, CAST(1 + sum(pts) % 4 AS INTEGER) AS style_id FROM tg WHERE team % 7 <> 0 GROUP BY 1, 2, 3)
SELECT game_id, coalesce(h.style_id, 0) AS home_style_id, coalesce(a.style_id, 0) AS away_style_id, coalesce(h.style_id, 0) * 10 + coalesce(a.style_id, 0) AS style_pair
FROM games g LEFT JOIN st h ON h.season = g.season AND h.month = date_trunc('month', g.game_date) AND h.team = g.home
LEFT JOIN st a ON a.season = g.season AND a.month = date_trunc('month', g.game_date) AND a.team = g.away""",
)
def period_attribute(s):
    t = s.team_games.where("team % 7 <> 0").withColumn("month", F.trunc("game_date", "month"))
    st = t.groupBy("season", "month", "team").agg((1 + F.sum("pts") % 4).cast("int").alias("style_id"))
    g = s.games.withColumn("month", F.trunc("game_date", "month"))
    out = joins.period_attribute(g, st, ["season", "month"], "team", "style_id")
    return out.select("game_id", "home_style_id", "away_style_id", (F.col("home_style_id") * 10 + F.col("away_style_id")).alias("style_pair"))


@query(
    "unique_name_ids", "J-15",
    """WITH k AS (SELECT c_acctbal AS name, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY 1)
SELECT s_suppkey, coalesce(CASE WHEN lo = hi THEN lo END, s_suppkey + 100000000) AS entity_id FROM supplier LEFT JOIN k ON name = floor(s_acctbal / 10) * 10 + 0.5
UNION ALL SELECT c_custkey + 1000000, coalesce(CASE WHEN lo = hi THEN lo END, c_custkey + 1000000 + 100000000) FROM customer LEFT JOIN k ON name = c_acctbal""",
)
def unique_name_ids(s):
    known = s.table("customer").select(F.col("c_acctbal").alias("name"), "c_custkey")
    new = s.table("supplier").select("s_suppkey", (F.floor(F.col("s_acctbal") / 10) * 10 + 0.5).alias("name")).unionByName(
        s.table("customer").select((F.col("c_custkey") + 1000000).alias("s_suppkey"), F.col("c_acctbal").alias("name"))
    )
    return joins.match_unique_names(new, known, "name", "c_custkey", "s_suppkey", 100_000_000).select("s_suppkey", "entity_id")


@query(
    "group_set_match", "J-16",
    """WITH f AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS codes FROM lineitem GROUP BY 1)
SELECT l_orderkey, o_orderpriority FROM f JOIN orders ON o_orderkey = l_orderkey
WHERE codes = CASE WHEN o_orderkey % 2 = 0 THEN ['A', 'N'] ELSE ['N', 'R'] END""",
)
def group_set_match(s):
    want = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("N"), F.lit("A"))).otherwise(F.array(F.lit("R"), F.lit("N")))
    expected = s.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", want.alias("pair"))
    return joins.groups_with_set(s.table("lineitem"), ["l_orderkey"], "l_returnflag", expected, "pair")


@query(
    "feature_attach", "J-18",
    f"""WITH {PREDICTIONS}, f AS (SELECT l_orderkey AS game_id, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem)
SELECT p.game_id, fold, l_partkey, l_quantity FROM predictions p LEFT JOIN f ON f.game_id = p.game_id AND r = 1""",
)
def feature_attach(s):
    feats = s.table("lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("fold"), "l_partkey", "l_quantity", "l_suppkey", "l_linenumber")
    out, _ = joins.attach_features(s.predictions, feats, "game_id", ["l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("game_id", "fold", "l_partkey", "l_quantity")


@query(
    "feature_match_report", "J-18",
    f"""WITH {PREDICTIONS} SELECT count(*) AS model_rows, count(game_id) AS rows_with_join_key,
  count(*) FILTER (game_id IN (SELECT l_orderkey FROM lineitem)) AS rows_with_any_feature_match,
  round(avg(CASE WHEN game_id IN (SELECT l_orderkey FROM lineitem) THEN 1 ELSE 0 END), 6) AS feature_match_rate FROM predictions""",
)
def feature_match_report(s):
    feats = s.table("lineitem").select(F.col("l_orderkey").alias("game_id"), "l_partkey", "l_suppkey", "l_linenumber")
    _, report = joins.attach_features(s.predictions, feats, "game_id", ["l_linenumber", "l_partkey", "l_suppkey"])
    return report.withColumn("feature_match_rate", r6("feature_match_rate"))


STRATEGIES = [
    {"strategy_id": "R0", "kelly_scale": 0.1, "kelly_cap": 0.01, "top_n": 2, "exposure": 0.015, "penalised": False, "weight": 0.0, "skip_default": False, "tiers": None, "max_daily_loss": None, "min_edge": 0.0},
    {"strategy_id": "R1", "kelly_scale": 0.05, "kelly_cap": 0.005, "top_n": 3, "exposure": 0.01, "penalised": True, "weight": 0.5, "skip_default": True, "tiers": None, "max_daily_loss": None, "min_edge": 1.0},
    {"strategy_id": "R2", "kelly_scale": 0.05, "kelly_cap": 0.005, "top_n": 5, "exposure": 0.008, "penalised": True, "weight": 1.0, "skip_default": False, "tiers": ["matched", "mirrored"], "max_daily_loss": -0.003, "min_edge": 0.0},
]


@query(
    "parameter_rows", "J-20 R-20",
    f"""WITH {MODEL_BETS}, s AS (SELECT * FROM (VALUES ('R0', 0.1, 0.01, 2), ('R1', 0.05, 0.005, 3), ('R2', 0.05, 0.005, 5)) v(strategy_id, kelly_scale, kelly_cap, top_n))
SELECT strategy_id, model, count(*) AS rows, round(sum(least(kelly * kelly_scale, CAST(kelly_cap AS DOUBLE))), 6) AS staked FROM mb, s GROUP BY 1, 2""",
)
def parameter_rows(s):
    j = joins.with_parameters(s.model_bets, STRATEGIES)
    return j.groupBy("p.strategy_id", "model").agg(
        F.count(F.lit(1)).alias("rows"), r6(F.sum(F.least(F.col("kelly") * F.col("p.kelly_scale"), F.col("p.kelly_cap")))).alias("staked")
    )


@query(
    "union_missing_columns", "U-02 U-03",
    """SELECT DISTINCT k, kind, amount FROM (SELECT o_custkey AS k, 'order' AS kind, CAST(NULL AS DOUBLE) AS amount FROM orders
UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer)""",
)
def union_missing_columns(s):
    a = s.table("orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("kind"))
    b = s.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("amount"))
    return sets.distinct_keys(sets.union_by_name(a, b), ["k", "kind", "amount"])


@query(
    "key_overlap", "U-04",
    """WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 10), b AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_totalprice > 100000)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS status
FROM a FULL OUTER JOIN b ON a.k = b.k""",
)
def key_overlap(s):
    a = s.table("lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("k"))
    b = s.table("orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("k"))
    return sets.key_overlap(a, b, ["k"])


@query(
    "merge_newer", "U-05 A-03",
    """WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS newer FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY newer DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS k FROM n)
SELECT l_orderkey, l_linenumber, l_quantity FROM r WHERE k = 1""",
)
def merge_newer(s):
    li = s.table("lineitem")
    old, new = li.where("l_returnflag <> 'R'"), li.where("l_returnflag = 'R'")
    return sets.merge_newer(old, new, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "model_rows", "U-06",
    f"""WITH {PREDICTIONS} SELECT game_id, 'm1' AS model, pred_m1 AS pred, home_margin - pred_m1 AS error FROM predictions UNION ALL SELECT game_id, 'm2', pred_m2, NULL FROM predictions""",
)
def model_rows(s):
    p = s.predictions.withColumn("error_m1", F.col("home_margin") - F.col("pred_m1"))
    return sets.model_rows(p, ["game_id"], ["pred", "error"])


WIDE_BETS = MODEL_BETS + """,
wb AS (SELECT game_id, max(bet_side) FILTER (model = 'm1') AS bet_side_m1, max(pnl) FILTER (model = 'm1') AS pnl_kelly_m1, max(pnl) FILTER (model = 'm2') AS pnl_kelly_m2 FROM mb GROUP BY game_id)"""


@query(
    "any_model_bet_log", "U-07",
    f"""WITH {WIDE_BETS} SELECT game_id, bet_side_m1, round(pnl_kelly_m1, 6) AS pnl_kelly_m1, round(pnl_kelly_m2, 6) AS pnl_kelly_m2 FROM wb
WHERE bet_side_m1 = 'HOME' OR pnl_kelly_m2 <> 0""",
)
def any_model_bet_log(s):
    def of(model, c):
        return F.max(F.when(F.col("model") == model, F.col(c)))

    wide = s.model_bets.groupBy("game_id").agg(
        of("m1", "bet_side").alias("side"), of("m1", "pnl").alias("pnl_kelly_m1"), of("m2", "pnl").alias("pnl_kelly_m2")
    )
    wide = wide.withColumn("bet_side_m1", F.when(F.col("side") == "HOME", "HOME"))
    return sets.any_model_filter(wide).select(
        "game_id", F.col("side").alias("bet_side_m1"), r6("pnl_kelly_m1").alias("pnl_kelly_m1"), r6("pnl_kelly_m2").alias("pnl_kelly_m2")
    )


@query(
    "pivot_open_close", "A-21",
    f"""WITH {QUOTES}, q AS (SELECT entity, CAST(ts AS DATE) AS day, ts, quote_id, CASE WHEN market = 'view' THEN 'open' WHEN market = 'click' THEN 'close' END AS kind, price FROM quotes)
SELECT entity, strftime(day, '%Y-%m-%d') AS day, arg_max(price, (ts, quote_id)) FILTER (kind = 'open') AS price_open, arg_max(price, (ts, quote_id)) FILTER (kind = 'close') AS price_close
FROM q GROUP BY entity, day""",
)
def pivot_open_close(s):
    q = s.quotes.withColumn("day", F.to_date("ts")).withColumn("kind", F.when(F.col("market") == "view", "open").when(F.col("market") == "click", "close"))
    out = aggregates.pivot_last(q, ["entity", "day"], "kind", ["open", "close"], ["price"], F.struct("ts", "quote_id"))
    return out.select("entity", text_date("day").alias("day"), "price_open", "price_close")
