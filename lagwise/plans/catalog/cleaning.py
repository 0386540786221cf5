"""Queries over identifiers, codes, prices, bands and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.functions import dates, market, numeric, text
from lagwise.operators import ranking, schema
from lagwise.plans.adapters import GAMES, MODEL_BETS, PLAYER_BOX, PREDICTIONS, PRICES, TEAM_GAMES
from lagwise.plans.catalog.common import r6, text_date
from lagwise.plans.registry import query

# The same text is valid in Spark and in DuckDB.
MESSY_ID = """CASE o_orderkey % 7 WHEN 0 THEN '00' || CAST(o_orderkey AS STRING) || '.0' WHEN 1 THEN ' 0' || CAST(o_orderkey AS STRING) || ' '
  WHEN 2 THEN 'nan' WHEN 3 THEN '0000' WHEN 4 THEN CAST(o_orderkey AS STRING) || '.0.0'
  WHEN 5 THEN '12345678' || CAST(o_orderkey AS STRING) ELSE '' END"""


@query(
    "canonical_ids", "C-01 C-02 C-03 G-01",
    f"""WITH m AS (SELECT o_orderkey, {MESSY_ID} AS raw FROM orders),
s AS (SELECT *, trim(regexp_replace(raw, '\\.0$', '')) AS t, replace(raw, '.0', '') AS p FROM m)
SELECT o_orderkey, CASE WHEN t IN ('nan', 'None', '') THEN NULL ELSE ltrim(t, '0') END AS short_id,
  CASE WHEN t IN ('nan', 'None', '') THEN NULL WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END AS short_id_zero,
  CASE WHEN length(p) < 10 THEN lpad(p, 10, '0') ELSE p END AS padded_id,
  try_cast(trim(raw) AS BIGINT) AS integer_id FROM s""".replace("try_cast(trim(raw) AS BIGINT)", "CASE WHEN regexp_matches(trim(raw), '^[0-9]+$') THEN CAST(trim(raw) AS BIGINT) END"),
)
def canonical_ids(s):
    m = s.table("orders").select("o_orderkey", F.expr(MESSY_ID).alias("raw"))
    whole = F.when(F.col("raw").rlike(r"^\s*[0-9]+\s*$"), F.col("raw"))
    return m.select(
        "o_orderkey", text.short_id(F.col("raw")).alias("short_id"), text.short_id(F.col("raw"), True).alias("short_id_zero"),
        text.padded_id(F.col("raw")).alias("padded_id"), text.integer_id(whole).alias("integer_id"),
    )


@query(
    "alias_and_family_columns", "C-04 C-05 C-09",
    """SELECT o_orderkey AS game_id, o_totalprice AS points, o_totalprice AS adv_o_totalprice, o_custkey AS adv_o_custkey,
  CAST(NULL AS DOUBLE) AS missing_metric FROM orders""",
)
def alias_and_family_columns(s):
    o = schema.resolve_aliases(s.table("orders"), {"game_id": ["gameId", "o_orderkey"], "points": ["PTS", "o_totalprice"]})
    fam = schema.family_columns(s.table("orders"), ["o_orderkey"], "adv")
    fam = fam.select(F.col("o_orderkey").alias("game_id"), "adv_o_totalprice", "adv_o_custkey")
    return o.select("game_id", "points", schema.column_or_null(o, "absent").alias("missing_metric")).join(fam, "game_id")


CODES = {"1-URGENT": "URG", "2-HIGH": "HIG", "3-MEDIUM": "MED"}


@query(
    "code_map", "C-06 C-07",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'URG' WHEN '2-HIGH' THEN 'HIG' WHEN '3-MEDIUM' THEN 'MED' END AS code,
  CASE o_orderstatus WHEN 'F' THEN 'FIN' WHEN 'O' THEN 'OPN' WHEN 'P' THEN 'PRT' END AS strict_code FROM orders""",
)
def code_map(s):
    return s.table("orders").select(
        "o_orderkey", text.map_code(F.col("o_orderpriority"), CODES).alias("code"),
        text.map_code(F.col("o_orderstatus"), {"F": "FIN", "O": "OPN", "P": "PRT"}, strict=True).alias("strict_code"),
    )


@query(
    "numeric_coercion", "C-08",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END, 0.0) AS filled FROM events""",
)
def numeric_coercion(s):
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return s.table("events").select(
        "event_id", text.number(F.get_json_object("props", "$.k")).alias("k"), text.number(raw, 0.0).alias("filled")
    )


@query(
    "minutes_and_status", "C-10 C-11 C-12 C-13",
    f"""WITH {PLAYER_BOX}, x AS (SELECT game_id, player_id, line, supp,
  CAST(split_part(minutes, ':', 1) AS DOUBLE) + CAST(split_part(minutes, ':', 2) AS DOUBLE) / 60 AS mp,
  coalesce(trim(replace(replace(upper(comment), '_', ' '), '-', ' ')), '') AS status FROM player_box)
SELECT game_id, player_id, line, supp, round(mp, 6) AS minutes_played, round(mp, 6) AS minutes_strict, status,
  mp <= 0 AND status <> '' AND NOT contains(status, 'COACH') AS pregame_out,
  CAST(floor(round(mp * 60) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(round(mp * 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS minutes_text FROM x""",
)
def minutes_and_status(s):
    b = s.player_box.withColumn("mp", text.minutes_lenient(F.col("minutes"))).withColumn("status", text.status_text(F.col("comment")))
    return b.select(
        "game_id", "player_id", "line", "supp", r6("mp").alias("minutes_played"),
        r6(text.minutes_strict(F.col("minutes"))).alias("minutes_strict"), "status",
        text.known_absence(F.col("mp"), F.col("status")).alias("pregame_out"), text.minutes_text(F.col("mp")).alias("minutes_text"),
    )


@query(
    "name_keys", "C-14",
    """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))) AS key_hash
FROM documents""",
)
def name_keys(s):
    return s.table("documents").select("doc_id", F.md5(text.name_key(F.col("text"))).alias("key_hash"))


@query(
    "row_filters", "C-15",
    f"""WITH {GAMES} SELECT game_id, season, home, away FROM games WHERE season BETWEEN 1996 AND 1999 AND home_handicap IS NOT NULL
  AND home % 100 IN (1, 2, 3, 5, 8)""",
)
def row_filters(s):
    g = s.games
    return g.where(
        F.col("season").between(1996, 1999) & F.col("home_handicap").isNotNull() & (F.col("home") % 100).isin(1, 2, 3, 5, 8)
    ).select("game_id", "season", "home", "away")


@query(
    "signed_handicap", "C-16",
    f"""WITH {GAMES}, x AS (SELECT game_id, CASE WHEN home_handicap <= 0 THEN 'home' WHEN home_handicap > 0 THEN 'away' END AS fav,
  abs(home_handicap) AS spread FROM games) SELECT game_id, CASE WHEN coalesce(fav = 'home', FALSE) THEN -spread ELSE spread END AS spread_signed FROM x""",
)
def signed_handicap(s):
    fav = F.when(F.col("home_handicap") <= 0, "home").when(F.col("home_handicap") > 0, "away")
    return s.games.select("game_id", market.signed_handicap(fav, F.abs("home_handicap")).alias("spread_signed"))


@query(
    "line_and_price_repair", "C-17 C-18 C-19 C-21",
    f"""WITH {PRICES}, j AS (SELECT g.game_id, g.home_handicap AS kaggle, p.game_id IS NOT NULL AS in_join, p.book_spread, p.home_american AS ha, p.away_american AS aa
  FROM games g LEFT JOIN prices p ON g.game_id = p.game_id),
k AS (SELECT *, coalesce(-book_spread, kaggle) AS settle, coalesce(ha, aa, -110.0) AS h, coalesce(aa, ha, -110.0) AS a FROM j)
SELECT game_id, settle AS settle_signed, CASE WHEN book_spread IS NOT NULL THEN (kaggle + settle) / 2 ELSE kaggle END AS spread_signed,
  round(CASE WHEN h < 0 THEN 100.0 / abs(h) WHEN h > 0 THEN h / 100.0 ELSE 100.0 / 110.0 END, 6) AS payout_home,
  round(CASE WHEN a < 0 THEN 100.0 / abs(a) WHEN a > 0 THEN a / 100.0 ELSE 100.0 / 110.0 END, 6) AS payout_away,
  CASE WHEN NOT in_join THEN 'unmatched' WHEN ha IS NOT NULL AND aa IS NOT NULL THEN 'matched'
    WHEN ha IS NOT NULL OR aa IS NOT NULL THEN 'mirrored' ELSE 'default' END AS odds_tier FROM k""",
)
def line_and_price_repair(s):
    raw = s.prices.select("game_id", "home_american", "away_american", "book_spread", F.lit(True).alias("in_join"))
    j = s.games.join(raw, "game_id", "left")
    lines = market.blended_line(F.col("home_handicap"), F.col("book_spread"))
    home, away = market.repaired_prices(F.col("home_american"), F.col("away_american"))
    return j.select(
        "game_id", *[c.alias(n) for n, c in lines.items()],
        r6(market.valid_payout(home)).alias("payout_home"), r6(market.valid_payout(away)).alias("payout_away"),
        market.odds_tier(F.col("in_join"), F.col("home_american"), F.col("away_american")).alias("odds_tier"),
    )


@query(
    "price_provenance", "C-20 C-22 G-02",
    f"""WITH {PRICES}, a AS (SELECT game_id, CASE WHEN game_id % 3 = 0 THEN NULL ELSE home_american END AS spread_home_odds,
  CASE WHEN game_id % 4 = 0 THEN NULL ELSE away_american END AS spread_away_odds,
  CASE WHEN game_id % 6 = 0 THEN NULL ELSE home_american END AS moneyline_home, CASE WHEN game_id % 8 = 0 THEN NULL ELSE away_american END AS moneyline_away FROM prices),
b AS (SELECT *, coalesce(spread_home_odds, moneyline_home) AS hp, coalesce(spread_away_odds, moneyline_away) AS ap,
  CASE WHEN spread_home_odds IS NOT NULL THEN 'spread_home_odds' WHEN moneyline_home IS NOT NULL THEN 'moneyline_home' END AS hs,
  CASE WHEN spread_away_odds IS NOT NULL THEN 'spread_away_odds' WHEN moneyline_away IS NOT NULL THEN 'moneyline_away' END AS aws FROM a),
c AS (SELECT *, coalesce(hp, ap, -110.0) AS h, coalesce(ap, hp, -110.0) AS w, hp IS NULL AND ap IS NULL AS dflt FROM b),
e AS (SELECT *, dflt OR h = 0 OR w = 0 AS used_default,
  CASE WHEN hs IS NULL THEN CASE WHEN h = -110 THEN 'default_-110' ELSE 'mirrored' END WHEN starts_with(hs, 'moneyline') THEN 'moneyline' ELSE 'spread_or_market' END AS ht,
  CASE WHEN aws IS NULL THEN CASE WHEN w = -110 THEN 'default_-110' ELSE 'mirrored' END WHEN starts_with(aws, 'moneyline') THEN 'moneyline' ELSE 'spread_or_market' END AS wt FROM c),
f AS (SELECT *, 'home:' || ht || '|away:' || wt AS payout_source FROM e),
t AS (SELECT *, CASE WHEN used_default THEN 'tier_d_default' WHEN contains(payout_source, 'mirrored') THEN 'tier_c_mirrored'
  WHEN contains(payout_source, 'moneyline') THEN 'tier_b_moneyline' WHEN contains(payout_source, 'spread_or_market') THEN 'tier_a_market' ELSE 'tier_e_unknown' END AS tier FROM f)
SELECT game_id, hs AS home_src, aws AS away_src, payout_source, tier,
  CAST(CASE tier WHEN 'tier_a_market' THEN 1.0 WHEN 'tier_b_moneyline' THEN 0.92 WHEN 'tier_c_mirrored' THEN 0.8 WHEN 'tier_d_default' THEN 0.65 ELSE 0.75 END AS DOUBLE) AS weight FROM t""",
)
def price_provenance(s):
    gid = F.col("game_id")
    a = s.prices.select(
        "game_id", F.when(gid % 3 != 0, F.col("home_american")).alias("spread_home_odds"),
        F.when(gid % 4 != 0, F.col("away_american")).alias("spread_away_odds"),
        F.when(gid % 6 != 0, F.col("home_american")).alias("moneyline_home"),
        F.when(gid % 8 != 0, F.col("away_american")).alias("moneyline_away"),
    )
    hp, hs = market.first_with_source(["spread_home_odds", "moneyline_home"])
    ap, aws = market.first_with_source(["spread_away_odds", "moneyline_away"])
    b = a.withColumns({"hp": hp, "home_src": hs, "ap": ap, "away_src": aws})
    h, w = market.repaired_prices(F.col("hp"), F.col("ap"))
    b = b.withColumns({"h": h, "w": w})
    used = (F.col("hp").isNull() & F.col("ap").isNull()) | (F.col("h") == 0) | (F.col("w") == 0)
    label = text.source_label({"home": market.price_tag(F.col("home_src"), F.col("h")), "away": market.price_tag(F.col("away_src"), F.col("w"))})
    b = b.withColumn("payout_source", label).withColumn("tier", market.match_tier(F.col("payout_source"), used))
    return b.select("game_id", "home_src", "away_src", "payout_source", "tier", market.match_weight(F.col("tier")).alias("weight"))


@query(
    "devig", "C-23",
    f"""WITH {MODEL_BETS}, x AS (SELECT game_id, 1 + payout_home AS dh, 1 + payout_away AS da FROM mb WHERE model = 'm1'),
y AS (SELECT game_id, (1 / dh) / (1 / dh + 1 / da) AS p, 1 / dh + 1 / da AS o FROM x)
SELECT game_id, round(p, 6) AS p_home, round(o, 6) AS overround FROM y WHERE o BETWEEN 1.0 AND 1.08""",
)
def devig(s):
    b = s.model_bets.where("model = 'm1'")
    p, over = market.devig(1 + F.col("payout_home"), 1 + F.col("payout_away"))
    return b.withColumn("p", p).withColumn("o", over).where(F.col("o").between(1.0, 1.08)).select(
        "game_id", r6("p").alias("p_home"), r6("o").alias("overround")
    )


@query(
    "column_selection", "C-24 C-25",
    f"""WITH {PREDICTIONS} SELECT d, fold, game_id, season FROM predictions""",
)
def column_selection(s):
    p = s.predictions.withColumn("pnl_kelly_m1", F.lit(0.0))
    allowed = schema.feature_names(
        p.columns, allow=["d", "fold", "season", "pred_m1", "absent"], include=["pnl_kelly_m1", "home_margin"], deny=["home_margin"]
    )
    kept = schema.keep_and_match(p.columns, ["game_id"], ["fol", "pred"], ["d"])
    return p.select(*dict.fromkeys([*allowed, *kept]))


@query(
    "feature_manifest", "C-26",
    f"""WITH {PREDICTIONS} SELECT 'home_margin' AS "column", TRUE AS is_numeric, TRUE AS is_leaky, FALSE AS include_for_factor_slicing, count(home_margin) AS non_null_rows, 'excluded_leakage' AS reason FROM predictions
UNION ALL SELECT 'spread_signed', TRUE, FALSE, TRUE, count(spread_signed), 'ok' FROM predictions
UNION ALL SELECT 'game_date', FALSE, FALSE, FALSE, count(game_date), 'excluded_non_numeric' FROM predictions""",
)
def feature_manifest(s):
    return schema.feature_manifest(s.predictions, ["home_margin", "spread_signed", "game_date"])


BANDS_SQL = """CASE WHEN x IS NULL THEN NULL WHEN x <= 2 THEN '0-2' WHEN x <= 5 THEN '2-5' WHEN x <= 8 THEN '5-8' ELSE '8+' END"""


@query(
    "fixed_bands_and_bet_type", "C-28 C-31 F-04",
    f"""WITH {MODEL_BETS}, b AS (SELECT *, abs(spread_signed) AS x, CASE WHEN spread_signed < 0 THEN 'HOME' WHEN spread_signed > 0 THEN 'AWAY' ELSE 'PICKEM' END AS fav FROM mb WHERE bet_side <> 'NONE')
SELECT model, game_id, {BANDS_SQL} AS spread_bucket, CASE WHEN x < 2 THEN '0-2' WHEN x < 5 THEN '2-5' ELSE '5+' END AS left_closed,
  fav AS favorite_side, CASE WHEN fav = 'PICKEM' THEN 'pickem' WHEN bet_side = fav THEN 'favorite' ELSE 'underdog' END AS bet_type FROM b""",
)
def fixed_bands_and_bet_type(s):
    b = s.model_bets.where("bet_side <> 'NONE'").withColumn("x", F.abs("spread_signed"))
    fav = market.favourite_side(F.col("spread_signed"))
    return b.select(
        "model", "game_id", market.band(F.col("x"), [2, 5, 8], ["0-2", "2-5", "5-8", "8+"]).alias("spread_bucket"),
        market.band(F.col("x"), [2, 5], ["0-2", "2-5", "5+"], right_closed=False).alias("left_closed"),
        fav.alias("favorite_side"), market.bet_type(F.col("bet_side"), fav).alias("bet_type"),
    )


@query(
    "equal_count_deciles", "C-29",
    f"""WITH {MODEL_BETS}, r AS (SELECT model, game_id, row_number() OVER (PARTITION BY model ORDER BY round(abs(edge), 9), game_id) AS r, count(*) OVER (PARTITION BY model) AS n FROM mb)
SELECT model, game_id, 'D' || CAST(greatest(1, ((r - 1) * 10 + n - 2) // (n - 1)) AS VARCHAR) AS edge_decile FROM r""",
)
def equal_count_deciles(s):
    out = ranking.equal_count_bins(s.model_bets, ["model"], F.round(F.abs("edge"), 9), ["game_id"], 10, "edge_decile", "D")
    return out.select("model", "game_id", "edge_decile")


@query(
    "value_quantile_bins", "C-30",
    f"""WITH {TEAM_GAMES}, e AS (SELECT list_sort(list_distinct(q)) AS edges FROM (SELECT quantile_cont(pts, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS q FROM tg))
SELECT game_id, team, greatest(1, len(list_filter(edges, lambda v: v < pts))) AS bin FROM tg, e""",
)
def value_quantile_bins(s):
    t = s.team_games
    edges = ranking.quantile_edges(t, [], F.col("pts"), 10)
    j = ranking.attach(t, edges, [])
    return j.select("game_id", "team", ranking.edge_bin(F.col("pts").cast("double"), F.col("edges")).alias("bin"))


@query(
    "four_factors_and_expectation", "C-33 C-34 M-03",
    f"""WITH {GAMES}, x AS (SELECT *, score_home - score_away AS m, greatest(CAST(score_home AS DOUBLE), 1.0) AS o, greatest(CAST(score_away AS DOUBLE), 1.0) AS a FROM games)
SELECT game_id, CAST(sign(m) * m * m AS DOUBLE) AS signed_square, round(1 / (1 + exp(-m / 100.0)), 6) AS logistic_margin,
  round(pow(o, 13.91) / (pow(o, 13.91) + pow(a, 13.91)), 6) AS pyth_home,
  CAST(0.4 * m - 0.25 * (score_home % 7 - score_away % 7) + 0.2 * (score_home % 5 - score_away % 5) + 0.15 * (score_home % 3 - score_away % 3) AS DOUBLE) AS composite FROM x""",
)
def four_factors_and_expectation(s):
    h, a = F.col("score_home"), F.col("score_away")
    m = h - a
    return s.games.select(
        "game_id", r6(numeric.signed_square(m.cast("double"))).alias("signed_square"), r6(numeric.logistic(m / 100.0)).alias("logistic_margin"),
        r6(numeric.pythagorean(h.cast("double"), a.cast("double"), 13.91)).alias("pyth_home"),
        r6(numeric.weighted_difference([(0.4, h, a), (-0.25, h % 7, a % 7), (0.2, h % 5, a % 5), (0.15, h % 3, a % 3)])).alias("composite"),
    )


@query(
    "fill_by_source", "C-36",
    f"""WITH {GAMES} SELECT game_id, CASE WHEN game_id % 3 <> 0 AND NOT game_id % 10 > 7 THEN coalesce(home_handicap, 0) ELSE home_handicap END AS metric FROM games""",
)
def fill_by_source(s):
    trusted = (F.col("game_id") % 3 != 0) & ~(F.col("game_id") % 10 > 7)
    return schema.fill_trusted(s.games, ["home_handicap"], trusted).select("game_id", F.col("home_handicap").alias("metric"))


@query(
    "matchup_home", "C-37",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'u' || user_id END AS home FROM events""",
)
def matchup_home(s):
    e = s.table("events")
    a, b = F.col("event_type"), F.concat(F.lit("u"), F.col("user_id"))
    matchup = F.when(F.col("event_id") % 3 == 0, F.concat(a, F.lit(" vs. "), b)).when(F.col("event_id") % 3 == 1, F.concat(a, F.lit(" @ "), b)).otherwise(a)
    return e.select("event_id", text.home_from_matchup(matchup).alias("home"))


@query(
    "surrogate_ids", "C-38",
    f"""WITH {GAMES}, known AS (SELECT season, max(20000000 + (season - 2001) * 100000 + 90000 + 1 + game_id % 50) AS last FROM games WHERE season <> 1999 GROUP BY season),
n AS (SELECT game_id AS source_id, season, row_number() OVER (PARTITION BY season ORDER BY d, game_id) AS r FROM games WHERE game_id % 4 = 1)
SELECT n.source_id, n.season, coalesce(last, 20000000 + (n.season - 2001) * 100000 + 90000) + r AS game_id FROM n LEFT JOIN known ON n.season = known.season""",
)
def surrogate_ids(s):
    base = 20_000_000 + (F.col("season") - 2001) * 100_000 + 90_000
    known = s.games.where("season <> 1999").select((base + 1 + F.col("game_id") % 50).cast("bigint").alias("known_id"))
    of_id = F.when(F.col("known_id") % 100_000 > 90_000, (F.floor((F.col("known_id") - 20_000_000) / 100_000) + 2001).cast("int"))
    new = s.games.where("game_id % 4 = 1").select(F.col("game_id").alias("source_id"), "season", "d")
    out = schema.assign_ids(new, known, "season", ["d", "source_id"], "known_id", base, of_id)
    return out.select("source_id", "season", F.col("game_id").cast("bigint").alias("game_id"))


@query(
    "normal_cdf", "M-02",
    f"""WITH {PREDICTIONS}, z AS (SELECT game_id, (pred_m1 + spread_signed) / 6.0 AS z FROM predictions WHERE spread_signed IS NOT NULL)
SELECT game_id, round({numeric.normal_cdf_sql('z')}, 9) AS p, round(1 - {numeric.normal_cdf_sql('z')}, 9) AS q FROM z""",
)
def normal_cdf(s):
    z = (F.col("pred_m1") + F.col("spread_signed")) / 6.0
    p = s.predictions.where("spread_signed IS NOT NULL").withColumn("z", z)
    return p.select("game_id", F.round(numeric.normal_cdf(F.col("z")), 9).alias("p"), F.round(numeric.normal_sf(F.col("z")), 9).alias("q"))


@query(
    "half_even_rounding", "M-08 M-10",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(l_quantity / 2.0, 0) AS half, l_linenumber * 10 + l_suppkey % 10 AS pair_code FROM lineitem""",
)
def half_even_rounding(s):
    return s.table("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", numeric.half_even(F.col("l_quantity") / 2.0, 0).alias("half"),
        (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("pair_code"),
    )


@query(
    "date_parts", "D-01 D-02",
    """SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(o_orderdate, '%A') AS weekday,
  CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 9 THEN 1 ELSE 0 END AS INTEGER) AS season,
  strftime(o_orderdate, '%Y-%m-%d') AS parsed, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day_number FROM orders""",
)
def date_parts(s):
    d = F.col("o_orderdate")
    return s.table("orders").select(
        "o_orderkey", text_date(dates.month_start(d)).alias("month"), dates.weekday_name(d).alias("weekday"),
        dates.season_of(d).alias("season"), text_date(dates.parse_day(F.date_format(d, "M/d/yyyy"))).alias("parsed"),
        F.datediff(d, F.lit("1995-01-01").cast("date")).alias("day_number"),
    )


@query(
    "local_time", "D-03 D-04",
    """SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago', '%Y-%m-%d') AS local_day,
  'close@' || strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago', '%H%M') AS label FROM events""",
)
def local_time(s):
    return s.table("events").select(
        "event_id", text_date(dates.local_day(F.col("ts"))).alias("local_day"), dates.close_label(F.col("ts")).alias("label")
    )


@query(
    "digests", "K-01",
    """SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents""",
)
def digests(s):
    return s.table("documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


@query(
    "objective_score", "M-09",
    f"""WITH {MODEL_BETS}, x AS (SELECT *, abs(pred_ensemble) AS risk, CASE WHEN bet_side = 'HOME' THEN ev_home WHEN bet_side = 'AWAY' THEN ev_away END AS ev FROM mb),
md AS (SELECT model, quantile_cont(risk, 0.5) AS med FROM x GROUP BY model)
SELECT x.model, game_id, round((CASE WHEN coalesce(ev, 0) = 0 THEN abs(edge) ELSE ev END)
  / (1 + 0.5 * least(greatest(risk / CASE WHEN med > 0 THEN med ELSE 1.0 END, 0.5), 3.0) + 0.5 * kelly), 6) AS score
FROM x JOIN md ON x.model = md.model""",
)
def objective_score(s):
    b = s.model_bets.withColumn("risk", F.abs("pred_ensemble"))
    med = ranking.quantiles(b, ["model"], F.col("risk"), {"med": 0.5})
    ev = F.when(F.col("bet_side") == "HOME", F.col("ev_home")).when(F.col("bet_side") == "AWAY", F.col("ev_away"))
    score = market.objective_score(F.col("edge"), ev, F.col("risk"), F.col("med"), F.col("kelly"), F.lit(True), F.lit(0.5))
    return ranking.attach(b, med, ["model"]).select("model", "game_id", r6(score).alias("score"))
