"""Structured Streaming jobs over landed quote documents and event rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.operators.nested import envelope_schema
from lagwise.operators.sets import latest
from lagwise.session import shared_folder
from lagwise.sources import snapshots
from lagwise.sources.documents import FLATTEN, flatten_envelopes
from lagwise.sources.tables import table_exists


def job_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a job's state and output in the shared folder of the cluster."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def flatten_new_documents(spark: SparkSession, raw: str, out: str, checkpoint: str, provider: str, per_file: bool = True) -> None:
    """Flatten every document that arrived since the last run exactly once, then stop."""
    payload, _ = FLATTEN[provider]
    docs = (
        spark.readStream.schema(envelope_schema(payload)).option("multiLine", per_file).option("recursiveFileLookup", True).json(raw)
    )
    query = (
        flatten_envelopes(docs, provider).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).partitionBy("provider", "date").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def deduplicate(stream: DataFrame, keys: Sequence[str], time: str, delay: str = "7 days") -> DataFrame:
    """Drop repeats of a natural key that arrive within the delay; state older than it is released."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def append_once(path: str, keys: Sequence[str], order: Sequence[str] = (), partition: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that appends only rows whose key is not stored yet.

    A replayed batch adds nothing, so the sink is idempotent. With ``partition``, a
    key column such as the date, the table is stored by it and only the partitions
    that the batch touches are read again.
    """
    if partition and partition not in keys:
        raise ValueError("the partition must be one of the keys")

    def write(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch, keys, list(order) or list(keys), keep="first")
        if table_exists(spark, path):
            stored = spark.read.parquet(path).select(*keys)
            if partition:
                touched = [r[0] for r in fresh.select(partition).distinct().collect()]  # a batch's few dates
                stored = stored.where(F.col(partition).isin(touched))
            fresh = fresh.join(stored, list(keys), "left_anti")
        fresh.write.mode("append").partitionBy(*([partition] if partition else [])).parquet(path)

    return write


def refill_children(parents: DataFrame, children_path: str, keys: Sequence[str], build: Callable[[DataFrame], DataFrame]) -> None:
    """Build and append the children of every parent that has none (heals an interrupted run)."""
    spark = parents.sparkSession
    todo = parents
    if table_exists(spark, children_path):
        todo = parents.join(spark.read.parquet(children_path).select(*keys), list(keys), "left_anti")
    build(todo).write.mode("append").parquet(children_path)


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that is available and stop."""
    (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
        .trigger(availableNow=True).start().awaitTermination()
    )


def usage_stream(log: DataFrame) -> DataFrame:
    """Running objects per provider and month of a request-log stream."""
    return log.groupBy("provider", F.substring("attempted_at_utc", 1, 7).alias("month")).agg(
        F.sum(F.coalesce(F.col("objects").try_cast("double"), F.lit(0.0))).cast("bigint").alias("objects")
    )


def replace_table(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for a complete-mode aggregate: each batch is the next snapshot of the table."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        snapshots.replace(batch, path)

    return write


def merge_days(path: str, keys: Sequence[str], day: str, order: Sequence[str] = (), span_days: int = 7) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that upserts by key into a table stored by day, however late a row comes.

    The days within ``span_days`` of a batch's rows are read again, so a row that moved to another day (a postponed
    game) replaces its old one; no watermark drops anything, and a replayed batch changes nothing.
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        snapshots.merge(batch, path, keys, day, order, span_days)

    return write


def over_quota(used: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Providers whose monthly use has reached their stop limit."""
    table = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])
    return used.where(F.col("objects") >= F.try_element_at(table, F.col("provider")))
