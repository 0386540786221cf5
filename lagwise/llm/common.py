"""Shared folder, written intermediate tables, document identity and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of ``[^\x20\x09-\x0D]``-words' separators, as a character class.
SPACES = " \t\n\x0b\x0c\r"
#: For words of letters, digits and everything outside ASCII: other ASCII bytes become blanks, A-Z become a-z.
PLAIN_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder serves a local session; any other session is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lagwise-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and still there if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(df: DataFrame) -> DataFrame:
    """``doc_id, text`` with one row per document.

    A doc_id that repeats is one document, with the least of its texts (null comes last); rows without a doc_id name
    no document and are left out. Other columns are ignored. Without such rows this costs one count of the ids.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1")
    if odd.isEmpty():
        return docs
    return docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))


def by_row(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` on ``docs``, whose operators join by doc_id, with every row as a document of its own.

    Where a doc_id repeats or is missing, rows get keys in a written table, which the stage sees as doc_id: in order of
    doc_id (null last), then of a digest of the text, then of place in the input. Other tables cost one count of the ids.
    """
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return stage(docs)
    order = [F.col("doc_id").asc_nulls_last(), F.sha2(F.col("text").cast("binary"), 256).asc_nulls_last(), "__at"]
    ordered = docs.withColumn("__at", F.monotonically_increasing_id()).orderBy(*order).drop("__at")
    keyed = written(ordered.withColumnRenamed("doc_id", "__doc_id").withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    return stage(keyed).drop("doc_id").withColumnRenamed("__doc_id", "doc_id").select(*docs.columns)


def crc_of_id() -> Column:
    """crc32 of the doc_id's decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
