"""Capture slots: local windows, close groups, and their state against the request log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lagwise.functions.dates import close_label, local_day, local_time_utc
from lagwise.operators.ranking import largest_groups

# Fixed values of the slot calendar.
ZONE = "America/Chicago"
CLOSE_OPENS_MIN, CLOSE_ENDS_MIN, TIP_PAD_MIN, GROUP_SPAN_MIN = 20, 3, 15, 30
MAX_CLOSES, MAX_FAILURES = 3, 3
DONE = ("ok", "missed")
FAILED = ("error", "empty", "skipped_quota")


def anchored_groups(df: DataFrame, keys: Sequence[str], time: str, span: int) -> DataFrame:
    """Groups anchored at their first time: a time later than anchor + span opens a new group.

    Not a session gap. Equal times are counted first; start times lie on a minute
    grid, so a date has at most 1,440 entries to fold, however many games it has.
    """
    counts = df.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.count(F.lit(1)).alias("__n"))
    folded = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col("__n").alias("n")))).alias("ts"))

    def step(groups: Column, x: Column) -> Column:
        last = F.element_at(groups, -1)
        joined = F.array_append(F.slice(groups, F.lit(1), F.size(groups) - 1), F.struct(last["t"].alias("t"), (last["n"] + x["n"]).alias("n")))
        fresh = (F.size(groups) == 0) | (x["t"] - last["t"] > span)
        return F.when(fresh, F.array_append(groups, x)).otherwise(joined)

    kind = folded.schema["ts"].dataType.simpleString()
    groups = F.aggregate("ts", F.array().cast(kind), step)
    return folded.select(*keys, F.explode(groups).alias("g")).select(*keys, F.col("g.t").alias(f"first_{time}"), F.col("g.n").alias("size"))


def slate_tips(events: DataFrame, time: str = "commence_time") -> DataFrame:
    """One row per readable, zone-aware start time with its local slate date."""
    aware = F.col(time).rlike(r"(Z|[+-]\d\d:?\d\d)$")
    tip = F.when(aware, F.try_to_timestamp(F.col(time)))
    return events.withColumn("tip", tip).where("tip IS NOT NULL").withColumn("slate_date", local_day(F.col("tip"), ZONE)).select("slate_date", "tip")


def slot_calendar(tips: DataFrame) -> DataFrame:
    """Every capture slot of each slate date.

    open and settle windows are fixed local hours; props only when a game starts
    after 15:00; close windows run from 20 to 3 minutes before a start. The second
    provider's closes are one per anchored group, of which the largest three are kept.
    """
    day = F.col("slate_date")

    def minutes(n: int) -> Column:
        return F.expr(f"INTERVAL {n} MINUTES")

    def slot(provider: str, name, opens, closes, lo, hi, finalized=False, capped=None) -> Column:
        return F.struct(
            F.lit(provider).alias("provider"), (F.lit(name) if isinstance(name, str) else name).alias("slot"),
            opens.alias("opens"), closes.alias("closes"), lo.alias("starts_after"), hi.alias("starts_before"),
            F.lit(finalized).alias("finalized"), (F.lit(False) if capped is None else capped).alias("capped"),
        )

    lo, hi = local_time_utc(day, 0, ZONE), local_time_utc(day, 0, ZONE, 1)
    days = tips.groupBy("slate_date").agg(F.max("tip").alias("last_tip"))
    fixed = F.array(
        slot("sgo", "open", local_time_utc(day, 10, ZONE), local_time_utc(day, 12, ZONE), lo, hi),
        slot("oddsapi", "open", local_time_utc(day, 10, ZONE), local_time_utc(day, 12, ZONE), lo, hi),
        slot("sgo", "settle", local_time_utc(day, 10, ZONE, 1), local_time_utc(day, 12, ZONE, 1), lo, hi, finalized=True),
        slot("sgo", "props", local_time_utc(day, 15, ZONE), local_time_utc(day, 17, ZONE), lo, hi),
    )
    out = days.select("slate_date", "last_tip", F.explode(fixed).alias("s"))
    out = out.where((F.col("s.slot") != "props") | (F.col("last_tip") > local_time_utc(day, 15, ZONE))).select("slate_date", "s.*")

    tip = F.col("tip")
    closes = tips.distinct().select(
        "slate_date",
        slot("sgo", close_label(tip, ZONE), tip - minutes(CLOSE_OPENS_MIN), tip - minutes(CLOSE_ENDS_MIN), tip - minutes(TIP_PAD_MIN), tip + minutes(TIP_PAD_MIN)).alias("s"),
    ).select("slate_date", "s.*")

    grouped = anchored_groups(tips.select("slate_date", F.unix_micros("tip").alias("us")), ["slate_date"], "us", GROUP_SPAN_MIN * 60_000_000)
    ranked = largest_groups(grouped, ["slate_date"], "size", "first_us", MAX_CLOSES).withColumn("tip", F.timestamp_micros("first_us"))
    grouped_closes = ranked.select(
        "slate_date",
        slot("oddsapi", close_label(tip, ZONE), tip - minutes(CLOSE_OPENS_MIN), tip - minutes(CLOSE_ENDS_MIN), lo, hi, capped=~F.col("kept")).alias("s"),
    ).select("slate_date", "s.*")
    return out.unionByName(closes).unionByName(grouped_closes)


def slot_states(slots: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """done, missed, due, failed or waiting for each slot at ``now``.

    The log is reduced to one row per slot before the join.
    """
    key = ["provider", "slate_date", "slot"]
    seen = log.groupBy(*key).agg(
        F.count(F.when(F.col("outcome").isin(*DONE), 1)).alias("__done"), F.count(F.when(F.col("outcome").isin(*FAILED), 1)).alias("__failed")
    )
    j = slots.join(seen, key, "left").fillna(0, ["__done", "__failed"])
    state = (
        F.when(F.col("__done") > 0, "done")
        .when(now >= F.col("closes"), "missed")
        .when((now < F.col("opens")) | F.col("capped"), "waiting")
        .when(F.col("__failed") >= MAX_FAILURES, "failed")
        .otherwise("due")
    )
    return j.withColumn("state", state).drop("__done", "__failed")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERDICT = "provider string, slate_date string, slot string, state string, closes timestamp"
KEEP_DAYS = 2
#: Groups of slots of one provider and date; each is one value in the state.
GROUPS = 256


class _Watch(StatefulProcessor):
    """State of one group of slots: when each closes, was first done and goes, and whether its verdict is out. Times are milliseconds.

    A value holds a whole group, because every access to state or timers is a round trip between Python and the executor.
    """

    def __init__(self, keep_ms: int):
        self._keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("slots", "slot array<string>, closes array<long>, done_at array<long>, goes array<long>, judged array<boolean>")

    def _load(self) -> dict:
        found = self._state.get()
        return {slot: fields for slot, *fields in zip(*found)} if found else {}

    def _store(self, slots: dict) -> None:
        if slots:
            self._state.update(tuple(map(list, zip(*((slot, *fields) for slot, fields in slots.items())))))
        else:
            self._state.clear()

    def handleInputRows(self, key, rows, timerValues):
        slots, seen, timers = self._load(), set(), set()
        for r in rows:
            slot, at_ms, closes_ms, done_ms = r.slot, r.at_ms, r.closes_ms, r.done_ms
            closes, done_at, goes, judged = slots.get(slot) or (None, None, None, False)
            if done_ms is not None:
                done_at = done_ms if done_at is None else min(done_at, done_ms)
            if closes_ms is not None and closes is None and at_ms < closes_ms + self._keep:
                closes, goes = closes_ms, closes_ms + self._keep
                timers |= {closes, goes}
            slots[slot] = [closes, done_at, goes, judged]
            seen.add(slot)
        now = timerValues.getCurrentWatermarkInMs()
        for slot in seen if now > 0 else ():
            if slots[slot][0] is None and slots[slot][2] is None:
                slots[slot][2] = now + self._keep  # an outcome without a slot does not stay for ever
                timers.add(now + self._keep)
        for t in timers:
            self._handle.registerTimer(t)
        self._store(slots)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        slots, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        for slot, fields in slots.items():
            closes, done_at, _, judged = fields
            if closes is not None and closes <= now and not judged:
                state = "done" if done_at is not None and done_at < closes else "missed"
                yield Row(provider=key[0], slate_date=key[1], slot=slot, state=state, closes_ms=closes)
                fields[3] = True
        self._store({slot: fields for slot, fields in slots.items() if fields[2] is None or fields[2] > now})

    def close(self) -> None:
        pass


def watch_slots(rows: DataFrame, delay: str = "10 minutes", keep_days: int = KEEP_DAYS) -> DataFrame:
    """Stream of verdicts ``VERDICT``: each slot is reported once, when its window has closed, as done or missed.

    ``rows`` is a stream of ``provider, slate_date, slot, at, closes, outcome``: announcements of slots (``closes`` set;
    repeats do no harm) and entries of the request log (``outcome`` set), or both in one row. A timer at ``closes`` asks
    the slot's state, so a slot that nobody asked for is reported as well, and a restart repeats nothing. A slot is done
    if an entry before ``closes`` says so, as ``slot_states`` finds at that time. Entries may come ``delay`` late. A slot
    leaves the state ``keep_days`` after ``closes``; an announcement that comes later is ignored. The slots of a provider
    and date are dealt out by hash to ``GROUPS`` values of the state, so round trips do not grow with the slots.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # timers need this store
    done = F.when(F.col("outcome").isin("ok"), F.unix_millis("at"))
    narrow = rows.withWatermark("at", delay).select(
        "provider", F.col("slate_date").cast("string").alias("slate_date"), "slot", "at", F.unix_millis("at").alias("at_ms"),
        F.unix_millis("closes").alias("closes_ms"), done.alias("done_ms"), F.pmod(F.xxhash64("slot"), F.lit(GROUPS)).alias("dealt"),
    )
    kind = VERDICT.replace("closes timestamp", "closes_ms long")
    out = narrow.groupBy("provider", "slate_date", "dealt").transformWithState(_Watch(keep_days * 86_400_000), kind, "Append", "EventTime")
    return out.select("provider", "slate_date", "slot", "state", F.timestamp_millis("closes_ms").alias("closes"))
