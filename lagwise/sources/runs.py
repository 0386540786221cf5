"""Captured runs: tables stored under one run id, their manifest, checks and comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.operators.audits import fingerprint
from lagwise.operators.joins import require_unique
from lagwise.operators.windows import overlapping_folds
from lagwise.sources.tables import table_exists

# The tables of a run and the columns each must have.
RUN_TABLES: dict[str, tuple[str, ...]] = {
    "predictions": ("game_id", "game_date", "fold", "p_home", "home_win"),
    "bets": ("game_id", "game_date", "bet_side", "odds_tier", "prob", "edge", "kelly_fraction", "win", "pnl", "bankroll"),
    "fold_metrics": ("fold", "test_start", "test_end", "rows", "rmse", "mae"),
    "odds_audit": ("game_id", "game_date", "odds_tier"),
    "metrics": (),
}
SCHEMA_VERSION = 1
MANIFEST = "run_id string, table_name string, rows bigint, fingerprint string, columns array<string>, created_at timestamp, status string, warnings array<string>, schema_version int"


def capture_run(tables: dict[str, DataFrame], run_id: str, root: str, warnings: Sequence[str] = ()) -> DataFrame:
    """Store the run's tables partitioned by run id and append its manifest rows.

    A run id that exists already, or a repeated bet key, is refused. The manifest comes last: a run that stops before
    is listed as failed.
    """
    spark = next(iter(tables.values())).sparkSession
    if table_exists(spark, f"{root}/manifest") and spark.read.parquet(f"{root}/manifest").where(F.col("run_id") == run_id).limit(1).count():
        raise ValueError(f"run {run_id} exists already")
    if "bets" in tables:
        require_unique(tables["bets"], ["game_id", "bet_side"], "bets")
    manifest = None
    for name, df in tables.items():
        path = f"{root}/{name}/run_id={run_id}"
        df.write.mode("errorifexists").parquet(path)
        row = fingerprint(spark.read.parquet(path)).select(
            F.lit(run_id).alias("run_id"), F.lit(name).alias("table_name"), "rows", "fingerprint",
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"), F.current_timestamp().alias("created_at"),
            F.lit("complete").alias("status"), F.array(*[F.lit(w) for w in warnings]).cast("array<string>").alias("warnings"),
            F.lit(SCHEMA_VERSION).alias("schema_version"),
        )
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("append").parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest").where(F.col("run_id") == run_id)


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """Rows of all runs of a table, with run_id as text; runs may differ in columns."""
    if not table_exists(spark, f"{root}/{name}"):
        return None
    return spark.read.option("mergeSchema", True).parquet(f"{root}/{name}").withColumn("run_id", F.col("run_id").cast("string"))


def catalogue(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """``run_id, status, created_at, tables, rows, problems`` of every run (or one), newest first.

    One aggregate per table kind over all runs together gives counts, fingerprints and fold overlaps; they are joined
    to the manifest, whatever the number of runs. ``failed``: tables without a manifest, or with one of another schema
    version; ``partial``: a table is missing, not captured, changed or lacks a column, test windows overlap, or the
    manifest warns; else ``complete``. A table's required columns are those the manifest saw, since a table that has
    other columns now has another fingerprint.
    """
    only = F.lit(True) if run_id is None else F.col("run_id") == run_id
    sums, overlaps = None, None
    for name, required in RUN_TABLES.items():
        df = _stored(spark, root, name)
        if df is None:
            continue
        df = df.where(only)
        part = fingerprint(df, ["run_id"]).withColumn("table_name", F.lit(name))
        sums = part if sums is None else sums.unionByName(part)
        if name == "fold_metrics" and set(required) <= set(df.columns):
            overlaps = overlapping_folds(df, ["run_id"]).select("run_id").distinct().withColumn("__overlap", F.lit(True))
    now = spark.createDataFrame([], "run_id string, rows bigint, fingerprint string, table_name string") if sums is None else sums
    m = spark.createDataFrame([], MANIFEST)
    if table_exists(spark, f"{root}/manifest"):
        m = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    m = m.where(only)
    readable = F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))
    heads = m.groupBy("run_id").agg(
        F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("tables"), F.bool_and(F.col("status") == "complete").alias("__done"),
        F.array_distinct(F.flatten(F.collect_list("warnings"))).alias("__warnings"), F.bool_and(readable).alias("__readable"), F.max("schema_version").alias("__version"),
    )  # a run has a row per table kind
    needs = F.create_map(*[x for t, cols in RUN_TABLES.items() for x in (F.lit(t), F.array(*[F.lit(c) for c in cols]).cast("array<string>"))])
    runs = m.select("run_id").unionByName(now.select("run_id")).distinct()
    expected = runs.withColumn("table_name", F.explode(F.array(*[F.lit(t) for t in RUN_TABLES])))
    was = m.select("run_id", "table_name", F.col("rows").alias("__rows"), F.col("fingerprint").alias("__print"), F.col("columns").alias("__columns"))
    j = expected.join(was, ["run_id", "table_name"], "left").join(now, ["run_id", "table_name"], "left")
    t, lacking = F.col("table_name"), F.array_except(needs[F.col("table_name")], F.col("__columns"))
    found = F.array_compact(F.array(
        F.when(F.col("__rows").isNull(), F.concat(t, F.lit(": not captured")))
        .when(F.col("rows").isNull() & (F.col("__rows") > 0), F.concat(t, F.lit(": table missing")))
        .when(F.coalesce("rows", F.lit(0)) != F.col("__rows"), F.concat(t, F.lit(": row count "), F.col("rows").cast("string"), F.lit(" != manifest "), F.col("__rows").cast("string")))
        .when(F.col("fingerprint") != F.col("__print"), F.concat(t, F.lit(": content changed since capture"))),
        F.when(F.size(lacking) > 0, F.concat(t, F.lit(": missing columns "), F.array_join(lacking, ", "))),
    ))
    per_run = j.groupBy("run_id").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.array_sort(F.flatten(F.collect_list(found))).alias("__problems"))
    out = per_run.join(heads, "run_id", "left")
    out = out.withColumn("__overlap", F.lit(None).cast("boolean")) if overlaps is None else out.join(overlaps, "run_id", "left")
    failed = F.coalesce(~F.col("__readable"), F.lit(True))
    reason = F.when(F.col("__readable").isNull(), F.lit("manifest missing")).otherwise(F.concat(F.lit("unsupported schema_version "), F.coalesce(F.col("__version").cast("string"), F.lit("none"))))
    overlap = F.when(F.col("__overlap"), F.array(F.lit("fold_metrics: test windows overlap or are out of order"))).otherwise(F.array().cast("array<string>"))
    problems = F.when(failed, F.array(reason)).otherwise(F.concat(F.coalesce("__warnings", F.array().cast("array<string>")), F.col("__problems"), overlap))
    status = F.when(failed, "failed").when(F.col("__done") & (F.size("problems") == 0), "complete").otherwise("partial")
    return out.withColumn("problems", problems).select(
        "run_id", status.alias("status"), "created_at", F.coalesce("tables", F.lit(0)).alias("tables"), "rows", "problems"
    ).orderBy(F.col("created_at").desc_nulls_last(), "run_id")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs with their status, newest first: complete, partial or failed."""
    return catalogue(spark, root)


def check_run(spark: SparkSession, root: str, run_id: str) -> list[str]:
    """Problems of a stored run; only its own partitions are read."""
    row = catalogue(spark, root, run_id).first()
    return ["not found"] if row is None else list(row["problems"])


def read_run_table(spark: SparkSession, root: str, name: str, run_id: str) -> DataFrame:
    """A table of a complete run; any other run is refused."""
    row = catalogue(spark, root, run_id).first()
    if row is None or row["status"] != "complete":
        raise ValueError(f"run {run_id} is {'absent' if row is None else row['status']}; refusing to load {name}")
    return spark.read.parquet(f"{root}/{name}/run_id={run_id}")


def comparison(bets: DataFrame, audit: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """One row per run: all bets, the selected tiers' bets, coverage and the matched share.

    ``bets`` needs run_id, tier, bet_win, pnl, kelly; ``audit`` needs run_id, tier.
    """
    inside = F.col("tier").isin(*tiers)
    b = bets.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("run_bets"),
        F.count(F.when(inside, 1)).alias("tier_bets"),
        F.avg(F.when(inside, F.col("bet_win"))).alias("tier_win_rate"),
        (F.sum(F.when(inside, F.col("pnl"))) / F.nullif(F.sum(F.when(inside, F.col("kelly"))), F.lit(0.0))).alias("tier_roi"),
    )
    a = audit.groupBy("run_id").agg(
        F.count(F.when(inside, 1)).alias("__audited"), F.avg((F.col("tier") == "matched").cast("int")).alias("matched_odds_share")
    )
    out = b.join(a, "run_id", "left")
    return out.withColumn("tier_coverage", F.col("tier_bets") / F.nullif(F.col("__audited"), F.lit(0))).drop("__audited")


# Columns of the experiment log that come from its JSON parameters.
LOG_PARAMS = "train_size int, test_size int, models array<string>, n_features int"


def read_experiment_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated experiment log with its JSON ``params`` widened; unreadable JSON counts as empty."""
    df = spark.read.options(header=True, sep="\t", quote="", escape="").schema(schema).csv(path)
    p = F.from_json("params", LOG_PARAMS)
    return df.withColumn("p", p).select(
        *[c for c in df.columns if c != "params"], "p.train_size", "p.test_size", "p.n_features", F.array_join("p.models", ", ").alias("models")
    )


def append_experiment_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").options(header=True, sep="\t", quote="", escape="").csv(path)
