"""Table scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] | None = None, dates: dict[str, str] | None = None, **options) -> DataFrame:
    """CSV scan with an explicit schema, a column subset and date patterns for text columns."""
    df = spark.read.options(header=True, **options).schema(schema).csv(path)
    if dates:
        df = df.withColumns({c: F.try_to_date(F.col(c), p) for c, p in dates.items()})
    return df.select(*columns) if columns else df


def read_or_build(spark: SparkSession, path: str, build, read_on_hit: bool = True, write_outputs: bool = True, enabled: bool = True) -> DataFrame:
    """Stored table if there is one, else build it, store it as a snapshot and read it back.

    Reading back cuts the lineage, so later steps do not repeat this one. A reader never sees a table half written.
    """
    from lagwise.sources import snapshots

    if enabled and read_on_hit and snapshots.exists(spark, path):
        return snapshots.read(spark, path)
    df = build()
    if not (enabled and write_outputs):
        return df
    snapshots.replace(df, path)
    return snapshots.read(spark, path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at the path; any other trouble with it is an error, not an absent table."""
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing there, or an empty folder
            return False
        raise


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The target's columns, order and types; missing ones null, extra ones dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def append_rows(df: DataFrame, path: str, schema: StructType, partition_by: Sequence[str] = ()) -> None:
    conform(df, schema).write.mode("append").partitionBy(*partition_by).parquet(path)


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Append-only log; empty with the right schema when nothing was written yet."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def missing_work(keys: DataFrame, stored: DataFrame, on: Sequence[str], family: str, families: Sequence[str]) -> DataFrame:
    """(key, family) pairs that are expected but not stored."""
    wanted = keys.distinct().withColumn(family, F.explode(F.array(*[F.lit(f) for f in families])))
    return wanted.join(stored, [*on, family], "left_anti")
