"""Raw documents in, partitioned quote tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.operators.nested import PAYLOAD_A, PAYLOAD_B, envelope_schema, quote_rows_a, quote_rows_b

FLATTEN = {"sgo": (PAYLOAD_A, quote_rows_a), "oddsapi": (PAYLOAD_B, quote_rows_b)}


def read_envelopes(spark: SparkSession, path: str, provider: str, per_file: bool = True) -> DataFrame:
    """Envelopes, one JSON document per file or per line; gzip is recognised by its suffix and Hive folders are read."""
    payload, _ = FLATTEN[provider]
    return (
        spark.read.option("multiLine", per_file).option("recursiveFileLookup", True)
        .schema(envelope_schema(payload)).json(path)
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def flatten_envelopes(envelopes: DataFrame, provider: str) -> DataFrame:
    """Flattened quote rows with their partition columns."""
    _, rows = FLATTEN[provider]
    return rows(envelopes, ("slate_date",)).withColumnRenamed("slate_date", "date").withColumn("provider", F.lit(provider))


def write_quotes(rows: DataFrame, path: str) -> None:
    """Hive-partitioned store; only the partitions present in ``rows`` are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "date").parquet(path)


def append_quotes(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("provider", "date").parquet(path)


def rebuild_quotes(spark: SparkSession, raw: str, path: str, provider: str, per_file: bool = True) -> None:
    """Rebuild the flattened store from the raw documents; running it twice changes nothing."""
    write_quotes(flatten_envelopes(read_envelopes(spark, raw, provider, per_file), provider), path)


def read_quotes(spark: SparkSession, path: str, provider: str, dates: tuple[str, str] | None = None) -> DataFrame:
    """Quote store of one provider; the date range prunes partitions."""
    df = spark.read.parquet(path).where(F.col("provider") == provider)
    return df.where(F.col("date").between(*dates)) if dates else df


def read_family_files(spark: SparkSession, pattern: str, schema: str, name_pattern: str, fields: dict[str, int]) -> DataFrame:
    """Many CSV files whose key and family are part of the file name."""
    df = spark.read.option("header", True).schema(schema).csv(pattern)
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(path, name_pattern, g).alias(n) for n, g in fields.items()])


def write_slate_document(forecast: DataFrame, path: str) -> None:
    """One JSON document per slate date: header fields and an array of games."""
    slate_document(forecast).write.mode("overwrite").json(path)


def slate_document(forecast: DataFrame, keys: tuple[str, ...] = ("slate_date",)) -> DataFrame:
    """Header fields and an array of games per key; a slate is the games of one league and day."""
    header = [c for c in ("model_version", "data_through") if c in forecast.columns]
    games = [c for c in forecast.columns if c not in (*keys, *header)]
    return forecast.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in header],
        F.array_sort(F.collect_list(F.struct(*games))).alias("games"),
    )
