"""Tables that are never half visible: versioned folders and a log that names them, written last.

A commit writes its rows to a new folder ``data/__version=n`` and then appends one small file to ``log``, which lists
for every partition the version that holds it now. A reader takes the newest complete entry of the log, so it sees the
table before or after a commit and nothing in between; a writer that dies leaves an unnamed folder that no reader opens.
Files are never replaced in place. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lagwise.operators.sets import latest
from lagwise.sources.tables import table_exists

VERSION = "__version"
_LOG = f"{VERSION} int, partition string, part string, holder int, schema string"


def _log(spark: SparkSession, path: str, version: int | None = None) -> list:
    """Entries of a version (the newest by default); none if there is no table yet. One row per partition."""
    if not table_exists(spark, f"{path}/log"):
        return []
    log = spark.read.schema(_LOG).parquet(f"{path}/log")
    if version is None:
        version = log.agg(F.max(VERSION)).first()[0]
    return log.where(F.col(VERSION) == version).collect()


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_log(spark, path))


def latest_version(spark: SparkSession, path: str) -> int | None:
    entries = _log(spark, path)
    return entries[0][VERSION] if entries else None


def _part(partition: str):
    return F.coalesce(F.col(partition).cast("string"), F.lit(""))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of the newest (or a given) version; only the folders that hold it are read."""
    entries = _log(spark, path, version)
    if not entries:
        raise ValueError(f"no snapshot {'' if version is None else version} at {path}")
    schema, partition = StructType.fromJson(json.loads(entries[0]["schema"])), entries[0]["partition"]
    data = spark.read.schema(StructType([*schema.fields, StructField(VERSION, IntegerType())])).parquet(f"{path}/data")
    if partition is None:
        return data.where(F.col(VERSION) == entries[0]["holder"]).select(*schema.names)
    held = [f"{e['holder']}/{e['part']}" for e in entries if e["part"] is not None]
    place = F.concat_ws("/", F.col(VERSION).cast("string"), _part(partition))  # partition columns only: Spark prunes folders
    return data.where(place.isin(held)).select(*schema.names)


def _commit(df: DataFrame, path: str, version: int, partition: str | None, kept: Sequence[tuple[str, int]] = ()) -> None:
    spark = df.sparkSession
    folder = f"{path}/data/{VERSION}={version}"
    df.write.mode("overwrite").partitionBy(*([partition] if partition else [])).parquet(folder)  # a leftover of a failed commit
    schema = df.schema.json()
    if partition is None:
        rows = [(version, None, None, version, schema)]
    else:
        new = [r[0] for r in spark.read.schema(df.schema).parquet(folder).select(_part(partition)).distinct().collect()]  # one row per partition
        rows = [(version, partition, p, h, schema) for p, h in [*kept, *((p, version) for p in new)]] or [(version, partition, None, version, schema)]
    spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def replace(df: DataFrame, path: str, partition: str | None = None) -> int:
    """Make ``df`` the whole table; returns the version."""
    version = (latest_version(df.sparkSession, path) or 0) + 1
    _commit(df, path, version, partition)
    return version


def merge(new: DataFrame, path: str, keys: Sequence[str], partition: str, order: Sequence[str] = (), span_days: int = 0) -> int | None:
    """Upsert rows by key into a table stored by ``partition``; only touched partitions are read and written again.

    A new row replaces the stored row of its key. ``order`` decides between new rows of one key (the last one stays).
    With ``span_days``, for a date partition, partitions up to so many days from the new rows' are touched too, so a row
    whose date has moved by that much replaces the old one instead of standing beside it. Merging the same rows again
    changes nothing. No new rows, no commit (None).
    """
    spark = new.sparkSession
    fresh = latest(new, keys, list(order) or sorted(set(new.columns) - set(keys)) or list(keys))
    day = F.col(partition)
    near = F.sequence(F.date_sub(day.cast("date"), span_days), F.date_add(day.cast("date"), span_days)) if span_days else F.array(day)
    places = fresh.select(F.explode(F.when(day.isNull(), F.array(day)).otherwise(near.cast(f"array<{dict(new.dtypes)[partition]}>"))).alias(partition))
    touched = {r[0] for r in places.select(_part(partition)).distinct().collect()}  # a batch's partitions
    if not touched:
        return None
    entries = _log(spark, path)
    version = (entries[0][VERSION] if entries else 0) + 1
    if entries:
        stored = read(spark, path).where(_part(partition).isin(list(touched)))
        both = stored.select(new.columns).withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
        fresh = latest(both, keys, ["__new"]).drop("__new")
    _commit(fresh, path, version, partition, [(e["part"], e["holder"]) for e in entries if e["part"] is not None and e["part"] not in touched])
    return version
