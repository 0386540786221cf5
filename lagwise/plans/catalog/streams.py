"""Queries that run a stream over a given table to completion and read its result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.plans.registry import query
from lagwise.sources import snapshots
from lagwise.streaming import quotes, slots


def event_stream(s):
    schema = s.table("events").schema
    return s.spark.readStream.schema(schema).parquet(f"{s.folder}/events.parquet*")


@query(
    "stream_deduplicate", "ST-02",
    """SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events""",
)
def stream_deduplicate(s):
    folder = quotes.job_folder(s.spark, "dedupe")
    e = event_stream(s).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    quotes.run_available(e, f"{folder}/state", quotes.merge_days(f"{folder}/out", ["user_id", "event_type", "day"], "day", span_days=0))
    return snapshots.read(s.spark, f"{folder}/out")


@query(
    "stream_moved_rows", "ST-02",
    """WITH u AS (SELECT event_id AS game_id, ts AS seen, strftime(ts, '%Y-%m-%d') AS day, 1 AS n FROM events
UNION ALL SELECT event_id, ts, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d'), 2 FROM events WHERE event_id % 10 = 0)
SELECT game_id, day FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY n DESC) AS r FROM u) WHERE r = 1""",
)
def stream_moved_rows(s):
    """Games in two runs of one stream: the newest half first, then the older half and those moved by three days."""
    folder = quotes.job_folder(s.spark, "moved")
    e = s.table("events").select(F.col("event_id").alias("game_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(1).alias("n"))
    moved = e.where("game_id % 10 = 0").withColumn("day", F.date_format(F.date_add("day", 3), "yyyy-MM-dd")).withColumn("n", F.lit(2))
    late = F.col("day") < "2024-01-16"
    for part in (e.where(~late), e.where(late).unionByName(moved)):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = s.spark.readStream.schema(e.schema).parquet(f"{folder}/in")
        quotes.run_available(stream, f"{folder}/state", quotes.merge_days(f"{folder}/out", ["game_id"], "day", ["n"]))
    return snapshots.read(s.spark, f"{folder}/out").select("game_id", "day")


@query(
    "stream_usage", "ST-07 A-34",
    """SELECT event_type AS provider, strftime(ts, '%Y-%m') AS month, CAST(sum(floor(value)) AS BIGINT) AS objects FROM events GROUP BY 1, 2""",
)
def stream_usage(s):
    folder = quotes.job_folder(s.spark, "usage")
    log = event_stream(s).select(
        F.col("event_type").alias("provider"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("attempted_at_utc"), F.floor("value").cast("string").alias("objects")
    )
    quotes.run_available(quotes.usage_stream(log), f"{folder}/state", quotes.replace_table(f"{folder}/out"), "complete")
    return snapshots.read(s.spark, f"{folder}/out")


@query(
    "incremental_children", "ST-03 J-09",
    """SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders""",
)
def incremental_children(s):
    folder = quotes.job_folder(s.spark, "children")
    o = s.table("orders").select("o_orderkey", "o_custkey")
    quotes.refill_children(o.where("o_orderkey % 3 = 0"), f"{folder}/out", ["o_orderkey"], lambda p: p)
    quotes.refill_children(o, f"{folder}/out", ["o_orderkey"], lambda p: p)
    return s.spark.read.parquet(f"{folder}/out")


@query(
    "slot_watch", "ST-06 ST-04",
    """WITH s AS (SELECT user_id, date_trunc('day', ts) + INTERVAL 12 HOUR AS closes, min(CASE WHEN event_type = 'purchase' THEN ts END) AS ok FROM events GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) AS slot, strftime(closes, '%Y-%m-%d') AS slate_date, CASE WHEN ok < closes THEN 'done' ELSE 'missed' END AS state
FROM s WHERE closes < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def slot_watch(s):
    """Each user's daily slot closes at noon and is done by a purchase; two runs of one stream, each verdict once."""
    folder = quotes.job_folder(s.spark, "watch")
    e = s.table("events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    for part in (e.where(half), e.where(~half)):
        part.write.mode("append").parquet(f"{folder}/in")
        rows = s.spark.readStream.schema(e.schema).parquet(f"{folder}/in")
        key = [F.lit("p").alias("provider"), F.date_format("ts", "yyyy-MM-dd").alias("slate_date"), F.col("user_id").cast("string").alias("slot"), F.col("ts").alias("at")]
        noon = F.date_trunc("day", "ts") + F.expr("INTERVAL 12 HOURS")
        outcome = F.when(F.col("event_type") == "purchase", "ok").otherwise("error")
        verdicts = slots.watch_slots(rows.select(*key, noon.alias("closes"), outcome.alias("outcome")))
        verdicts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return s.spark.read.parquet(f"{folder}/out").select("slot", "slate_date", "state")
