"""Nested documents to rows: quotes, candles, box scores, scoreboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.dates import event_from_expiry, minutes_between
from lagwise.functions.text import number

BOOK_A = """struct<odds:string, spread:string, overUnder:string, available:boolean, lastUpdatedAt:string, openOdds:string,
 openSpread:string, openOverUnder:string, closeOdds:string, closeSpread:string, closeOverUnder:string>"""
EVENT_A = f"""struct<eventID:string, status:struct<startsAt:string>,
 teams:struct<home:struct<names:struct<long:string>>, away:struct<names:struct<long:string>>>,
 odds:map<string, struct<byBookmaker:map<string, {BOOK_A}>>>>"""
PAYLOAD_A = f"array<struct<data:array<{EVENT_A}>>>"
PAYLOAD_B = """array<struct<id:string, commence_time:string, home_team:string, away_team:string,
 bookmakers:array<struct<key:string, last_update:string,
  markets:array<struct<key:string, last_update:string, outcomes:array<struct<name:string, price:string, point:string>>>>>>>>"""
ENVELOPE = ("request_id", "slot", "captured_at_utc")


def envelope_schema(payload: str) -> str:
    return f"request_id string, provider string, slot string, slate_date string, captured_at_utc string, payload {payload}"


def parse_odd_id(odd_id: Column) -> dict[str, Column]:
    """``stat-entity-period-bet-side``: three parts from the right, then the first ``-`` of the head.

    Fewer than four parts give nulls everywhere.
    """
    part = F.split(odd_id, "-")
    n = F.size(part)
    good = odd_id.isNotNull() & (n >= 4)
    head = F.array_join(F.slice(part, F.lit(1), F.greatest(n - 3, F.lit(1))), "-")

    def at(i: int) -> Column:
        return F.when(good, F.try_element_at(part, F.lit(i)))

    entity = F.when(F.contains(head, F.lit("-")), F.substring(head, F.locate("-", head) + 1, F.length(head)))
    return {
        "stat_id": F.when(good, F.substring_index(head, "-", 1)),
        "stat_entity_id": F.when(good, F.nullif(entity, F.lit(""))),
        "period_id": at(-3),
        "bet_type_id": at(-2),
        "side_id": at(-1),
    }


def quote_rows_a(envelopes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """pages -> events -> map of odds -> map of books, one row per book. Missing levels give no rows."""
    meta = (*ENVELOPE, *extra)
    ev = envelopes.select(*meta, F.explode("payload").alias("page")).select(*meta, F.explode("page.data").alias("ev"))
    start = F.col("ev.status.startsAt")
    # flat event columns first: the two explodes below then carry no nested event
    flat = ev.select(
        *meta,
        minutes_between(start, F.col("captured_at_utc")).alias("minutes_to_tip"),
        F.col("ev.eventID").alias("event_id"),
        start.alias("starts_at_utc"),
        F.col("ev.teams.home.names.long").alias("home_team"),
        F.col("ev.teams.away.names.long").alias("away_team"),
        F.col("ev.odds").alias("odds"),
    )
    event = [c for c in flat.columns if c != "odds"]
    odds = flat.select(*event, F.explode("odds").alias("odd_id", "odd"))
    book = odds.select(*event, "odd_id", F.explode("odd.byBookmaker").alias("bookmaker_id", "b"))

    def first(*names: str) -> Column:
        return number(F.coalesce(*[F.col(f"b.{n}") for n in names]))

    return book.select(
        *event,
        "odd_id",
        *[c.alias(n) for n, c in parse_odd_id(F.col("odd_id")).items()],
        "bookmaker_id",
        number(F.col("b.odds")).alias("odds_american"),
        first("spread", "overUnder").alias("line"),
        F.col("b.available").alias("available"),
        F.col("b.lastUpdatedAt").alias("last_updated_at"),
        number(F.col("b.openOdds")).alias("open_odds"),
        first("openSpread", "openOverUnder").alias("open_line"),
        number(F.col("b.closeOdds")).alias("close_odds"),
        first("closeSpread", "closeOverUnder").alias("close_line"),
    )


def quote_rows_b(envelopes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """events -> bookmakers -> markets -> outcomes, one row per outcome."""
    meta = (*ENVELOPE, *extra)
    ev = envelopes.select(*meta, F.explode("payload").alias("ev"))
    bk = ev.select(*meta, "ev", F.explode("ev.bookmakers").alias("bk"))
    mk = bk.select(*meta, "ev", "bk", F.explode("bk.markets").alias("m"))
    out = mk.select(*meta, "ev", "bk", "m", F.explode("m.outcomes").alias("o"))
    start = F.col("ev.commence_time")
    return out.select(
        *meta,
        minutes_between(start, F.col("captured_at_utc")).alias("minutes_to_tip"),
        F.col("ev.id").alias("event_id"), start.alias("commence_time_utc"),
        F.col("ev.home_team").alias("home_team"), F.col("ev.away_team").alias("away_team"),
        F.col("bk.key").alias("bookmaker_key"), F.col("bk.last_update").alias("bookmaker_last_update"),
        F.col("m.key").alias("market_key"), F.col("m.last_update").alias("market_last_update"),
        F.col("o.name").alias("outcome_name"), number(F.col("o.point")).alias("point"), number(F.col("o.price")).alias("price_american"),
    )


def candle_rows(markets: DataFrame, hours_before_expiry: int = 3) -> DataFrame:
    """One row per candle; a market without candles gets one marker row with nulls.

    Needs ticker, expiry (timestamp) and candlesticks (array of structs).
    """
    tip = F.unix_seconds(event_from_expiry(F.col("expiry"), hours_before_expiry))
    c = markets.select("ticker", tip.alias("tip_ts"), F.explode_outer("candlesticks").alias("c"))
    return c.select(
        "ticker", "tip_ts", F.col("c.end_period_ts").alias("end_period_ts"), F.col("c.yes_bid.close").alias("bid"),
        F.col("c.yes_ask.close").alias("ask"), F.col("c.price.close").alias("price"), F.col("c.volume").alias("volume"),
    )


# Box-score keys and the column each becomes.
STAT_COLUMNS = {
    "points": "points", "rebounds": "reboundsTotal", "assists": "assists", "turnovers": "turnovers", "steals": "steals",
    "blocks": "blocks", "offensiveRebounds": "reboundsOffensive", "defensiveRebounds": "reboundsDefensive",
    "fouls": "foulsPersonal", "plusMinus": "plusMinusPoints",
}
PAIR_COLUMNS = {
    "fieldGoalsMade-fieldGoalsAttempted": ("fieldGoalsMade", "fieldGoalsAttempted"),
    "threePointFieldGoalsMade-threePointFieldGoalsAttempted": ("threePointersMade", "threePointersAttempted"),
    "freeThrowsMade-freeThrowsAttempted": ("freeThrowsMade", "freeThrowsAttempted"),
}
# Linear fits from box-score estimates to published possessions and rebound rates.
POSSESSION_FIT = (5.6798, 0.9330)
REBOUND_FIT = (0.0628, 0.9068)

BOX_SCHEMA = """struct<players:array<struct<team:struct<abbreviation:string>, statistics:array<struct<keys:array<string>,
 athletes:array<struct<athlete:struct<id:string, displayName:string, shortName:string>, starter:boolean, didNotPlay:boolean,
  reason:string, stats:array<string>>>>>>>,
 teams:array<struct<team:struct<abbreviation:string>, statistics:array<struct<name:string, displayValue:string>>>>>"""


def box_rows(documents: DataFrame, box: str = "boxscore", key: str = "game_id") -> DataFrame:
    """Player rows of a box-score document: keys zipped with values, pairs split, absences explained.

    Entries without an id, and entries without minutes or a reason, are skipped.
    """
    # of a bare column Spark would infer filters, and parse the document once more for each of them
    players = F.coalesce(F.col(f"{box}.players"), F.array())
    t = documents.select(key, F.explode(players).alias("t"))
    st = t.select(key, F.col("t.team.abbreviation").alias("team"), F.col("t.statistics")[0].alias("st"))
    a = st.select(key, "team", F.col("st.keys").alias("keys"), F.explode("st.athletes").alias("a")).where("a.athlete.id IS NOT NULL")
    values = F.coalesce(F.col("a.stats"), F.array().cast("array<string>"))
    shared = F.least(F.size("keys"), F.size(values))
    stats = F.map_from_arrays(F.slice("keys", F.lit(1), shared), F.slice(values, F.lit(1), shared))
    a = a.select(key, "team", "a", F.explode(F.array(stats)).alias("s"))  # one map an entry, for the filter as for the columns
    a = a.withColumn("absent", F.coalesce(F.col("a.didNotPlay"), F.lit(False)) | (F.size("s") == 0))
    minutes = F.try_element_at("s", F.lit("minutes"))
    a = a.where(F.col("absent") | F.coalesce(minutes.rlike("^[0-9]+$"), F.lit(False)))
    reason = F.trim(F.coalesce(F.col("a.reason"), F.lit("")))
    coach = (reason == "") | F.contains(F.upper(reason), F.lit("COACH"))
    comment = F.when(F.col("absent"), F.when(coach, "DNP - Coach's Decision").otherwise(F.concat(F.lit("DNP - "), F.initcap(reason))))
    name = F.col("a.athlete.displayName")

    def single(k: str) -> Column:
        raw = F.coalesce(F.try_element_at("s", F.lit(k)), F.lit("0"))
        return F.when(F.col("absent"), F.lit(0.0)).otherwise(number(F.ltrim(raw, F.lit("+"))))

    def pair(k: str, i: int) -> Column:
        raw = F.split(F.coalesce(F.try_element_at("s", F.lit(k)), F.lit("0-0")), "-")
        return F.when(F.col("absent"), F.lit(0.0)).otherwise(F.coalesce(number(F.try_element_at(raw, F.lit(i))), F.lit(0.0)))

    return a.select(
        key, "team", F.col("a.athlete.id").cast("bigint").alias("source_player_id"),
        F.substring_index(name, " ", 1).alias("firstName"),
        F.when(F.contains(name, F.lit(" ")), F.substring(name, F.locate(" ", name) + 1, F.length(name))).otherwise("").alias("familyName"),
        F.col("a.athlete.shortName").alias("nameI"),
        comment.alias("comment"),
        F.when(~F.col("absent"), F.concat(minutes.cast("int").cast("string"), F.lit(":00"))).alias("minutes"),
        *[single(k).alias(c) for k, c in STAT_COLUMNS.items()],
        *[pair(k, i + 1).alias(c) for k, cs in PAIR_COLUMNS.items() for i, c in enumerate(cs)],
    )


def team_total_rows(documents: DataFrame, box: str = "boxscore", key: str = "game_id") -> DataFrame:
    """Team metrics from published team totals, with fitted possessions, rounded as published."""
    t = documents.select(key, F.explode(f"{box}.teams").alias("t"))
    entries = F.transform("t.statistics", lambda x: F.struct(x["name"], x["displayValue"]))
    t = t.select(key, F.col("t.team.abbreviation").alias("team"), F.map_from_entries(entries).alias("s"))

    def plain(k: str) -> Column:
        return number(F.try_element_at("s", F.lit(k)))

    pairs = {c: number(F.split(F.try_element_at("s", F.lit(k)), "-")[i]) for k, cs in PAIR_COLUMNS.items() for i, c in enumerate(cs)}
    t = t.select(key, "team", *[c.alias(n) for n, c in pairs.items()], *[plain(k).alias(k) for k in ("offensiveRebounds", "defensiveRebounds", "turnovers", "totalTurnovers")])
    t = t.withColumn("pts", 2 * F.col("fieldGoalsMade") + F.col("threePointersMade") + F.col("freeThrowsMade"))
    t = t.withColumn("est", F.col("fieldGoalsAttempted") + 0.44 * F.col("freeThrowsAttempted") - F.col("offensiveRebounds") + F.col("turnovers"))
    both = Window.partitionBy(key)  # two rows per game

    def other(c: str) -> Column:
        return F.sum(c).over(both) - F.col(c)

    t = t.withColumns({
        "poss": POSSESSION_FIT[0] + POSSESSION_FIT[1] * F.avg("est").over(both),
        "opp_pts": other("pts"), "opp_dreb": other("defensiveRebounds"),
    })
    ortg, drtg = 100 * F.col("pts") / F.col("poss"), 100 * F.col("opp_pts") / F.col("poss")
    return t.select(
        key, "team",
        F.bround((F.col("fieldGoalsMade") + 0.5 * F.col("threePointersMade")) / F.col("fieldGoalsAttempted"), 3).alias("ff_effective_fg_pct"),
        F.bround(F.col("freeThrowsAttempted") / F.col("fieldGoalsAttempted"), 3).alias("ff_free_throw_rate"),
        F.bround(F.col("totalTurnovers") / F.col("poss"), 3).alias("ff_turnover_pct"),
        F.bround(REBOUND_FIT[0] + REBOUND_FIT[1] * F.col("offensiveRebounds") / (F.col("offensiveRebounds") + F.col("opp_dreb")), 3).alias("ff_off_reb_pct"),
        F.bround(ortg, 1).alias("adv_off_rating"), F.bround(drtg, 1).alias("adv_def_rating"),
        F.bround(ortg - drtg, 1).alias("adv_net_rating"), F.bround(F.col("poss"), 0).alias("adv_possessions"),
    )


SCOREBOARD_SCHEMA = """array<struct<id:string, season:struct<year:int, type:int>, competitions:array<struct<type:struct<abbreviation:string>,
 venue:struct<fullName:string>, status:struct<type:struct<name:string>>,
 competitors:array<struct<homeAway:string, score:string, team:struct<abbreviation:string>>>>>>>"""


def scoreboard_rows(documents: DataFrame, events: str = "events", day: str = "day", final_only: bool = True) -> DataFrame:
    """Standard regular-season games of a scoreboard document."""
    e = documents.select(day, F.explode(events).alias("e")).withColumn("c", F.col("e.competitions")[0])
    kind = F.coalesce(F.col("c.type.abbreviation"), F.lit("STD"))
    e = e.where((F.col("e.season.type") == 2) & (kind == "STD"))

    def side(which: str) -> Column:
        return F.try_element_at(F.filter("c.competitors", lambda x: x["homeAway"] == which), F.lit(1))

    e = e.withColumn("h", side("home")).withColumn("a", side("away"))
    out = e.select(
        F.col("e.id").alias("source_id"), F.col(day).alias("date"), F.col("e.season.year").alias("season"),
        F.col("h.team.abbreviation").alias("home"), F.col("a.team.abbreviation").alias("away"),
        number(F.col("h.score")).alias("score_home"), number(F.col("a.score")).alias("score_away"),
        F.col("c.venue.fullName").alias("arena"), (F.col("c.status.type.name") == "STATUS_FINAL").alias("final"),
    )
    return out.where("final") if final_only else out


def first_priced_line(items: Column, default_priority: int = 99) -> Column:
    """Spread of the item with the smallest provider priority among those that have one.

    ``items`` is an array of structs with ``provider.priority`` and ``spread``.
    """
    priced = F.filter(items, lambda x: x["spread"].isNotNull())
    keyed = F.transform(
        priced,
        lambda x, i: F.struct(F.coalesce(x["provider"]["priority"], F.lit(default_priority)).alias("p"), i.alias("i"), x["spread"].alias("spread")),
    )
    return F.try_element_at(F.array_sort(keyed), F.lit(1))["spread"]


