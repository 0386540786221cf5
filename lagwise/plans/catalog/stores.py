"""Queries that write a table in one of the stored forms and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.operators import audits, schema
from lagwise.plans.adapters import MODEL_BETS
from lagwise.plans.catalog.common import text_date
from lagwise.plans.catalog.documents import envelopes_a
from lagwise.plans.registry import query
from lagwise.sources import documents, runs, tables
from lagwise.streaming.quotes import flatten_new_documents, job_folder, refill_children

STORED_QUOTES = """WITH e AS (SELECT event_id, event_type, value, strftime(ts, '%Y-%m-%d') AS date FROM events), b AS (SELECT *, unnest([('b1'), (event_type)]) AS bookmaker_id FROM e)
SELECT 'r' || event_id AS request_id, date, bookmaker_id, CASE WHEN event_id % 3 = 0 THEN 112.5 ELSE value END AS line FROM b"""


@query(
    "csv_round_trip", "S-01 D-01",
    "SELECT CAST(o_orderkey AS VARCHAR) AS game_id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS points FROM orders",
)
def csv_round_trip(s):
    path = f"{job_folder(s.spark, 'csv')}/orders"
    o = s.table("orders").select(F.col("o_orderkey").alias("game_id"), F.date_format("o_orderdate", "M/d/yyyy").alias("date"), F.col("o_totalprice").alias("points"), "o_orderpriority")
    o.write.option("header", True).csv(path)
    df = tables.read_csv(s.spark, path, "game_id string, date string, points double, o_orderpriority string", ["game_id", "date", "points"], {"date": "M/d/yyyy"})
    return df.withColumn("date", text_date("date"))


@query(
    "family_files", "S-09",
    "SELECT l_orderkey, l_quantity, l_returnflag AS family FROM lineitem",
)
def family_files(s):
    path = f"{job_folder(s.spark, 'families')}/box"
    s.table("lineitem").select("l_orderkey", "l_quantity", F.col("l_returnflag").alias("family")).write.partitionBy("family").option("header", True).csv(path)
    df = documents.read_family_files(s.spark, f"{path}/*", "l_orderkey bigint, l_quantity double", r"family=([A-Z]+)/", {"family": 1})
    return df.select("l_orderkey", "l_quantity", "family")


@query("quote_store", "S-05 S-06 S-07", STORED_QUOTES)
def quote_store(s):
    folder = job_folder(s.spark, "quotes")
    envelopes_a(s).write.json(f"{folder}/raw")
    documents.rebuild_quotes(s.spark, f"{folder}/raw", f"{folder}/store", "sgo", per_file=False)
    return documents.read_quotes(s.spark, f"{folder}/store", "sgo").select("request_id", F.col("date").cast("string").alias("date"), "bookmaker_id", "line")


@query("stream_documents", "ST-01 F-05", STORED_QUOTES)
def stream_documents(s):
    folder = job_folder(s.spark, "documents")
    envelopes_a(s).write.json(f"{folder}/raw")
    flatten_new_documents(s.spark, f"{folder}/raw", f"{folder}/store", f"{folder}/state", "sgo", per_file=False)
    return s.spark.read.parquet(f"{folder}/store").select("request_id", F.col("date").cast("string").alias("date"), "bookmaker_id", "line")


@query(
    "experiment_log", "S-04",
    """SELECT CAST(o_orderkey AS VARCHAR) AS run, o_totalprice AS score, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS INTEGER) END AS train_size, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'a, b' END AS models FROM orders""",
)
def experiment_log(s):
    path = f"{job_folder(s.spark, 'log')}/experiments"
    params = F.when(F.col("o_orderkey") % 5 == 0, "{bad json").otherwise(F.concat(F.lit('{"train_size": '), F.col("o_custkey"), F.lit(', "models": ["a", "b"]}')))
    runs.append_experiment_log(s.table("orders").select(F.col("o_orderkey").cast("string").alias("run"), F.col("o_totalprice").alias("score"), params.alias("params")), path)
    return runs.read_experiment_log(s.spark, path, "run string, score double, params string").select("run", "score", "train_size", "models")


@query(
    "captured_runs", "S-12 S-13 Q-06",
    f"""WITH {MODEL_BETS}, b AS (SELECT fold, count(*) AS n FROM mb WHERE model = 'm1' AND bet_side <> 'NONE' GROUP BY 1), p AS (SELECT fold, count(*) AS n FROM predictions GROUP BY 1), o AS (SELECT count(*) AS n FROM prices),
t AS (SELECT 'whole' AS run_id, 'complete' AS status, 5 AS tables, (SELECT sum(n) FROM p) + (SELECT sum(n) FROM b) + (SELECT count(*) FROM p) + n + 1 AS rows, 0 AS problems FROM o
UNION ALL SELECT 'short', 'partial', 4, (SELECT sum(n) FROM p WHERE fold = 1) + (SELECT coalesce(sum(n), 0) FROM b WHERE fold = 1) + 1 + n, 1 FROM o
UNION ALL SELECT 'changed', 'partial', 2, (SELECT sum(n) FROM p WHERE fold = 2) + 1, 4 FROM o
UNION ALL SELECT 'overlap', 'partial', 1, (SELECT count(*) FROM p), 5 FROM o
UNION ALL SELECT 'stopped', 'failed', 0, (SELECT sum(n) FROM p WHERE fold = 3), 1 FROM o)
SELECT run_id, status, tables, CAST(rows AS BIGINT) AS rows, problems FROM t""",
)
def captured_runs(s):
    """Runs of every kind: whole, without metrics, changed after capture, with overlapping folds, stopped before the manifest."""
    root = job_folder(s.spark, "runs")
    predictions = s.predictions.select("game_id", "game_date", "fold", F.lit(0.5).alias("p_home"), (F.col("home_margin") > 0).cast("int").alias("home_win"))
    bets = s.model_bets.where("model = 'm1' AND bet_side <> 'NONE'").select(
        "game_id", "game_date", "fold", "bet_side", F.col("tier").alias("odds_tier"), F.col("win_prob").alias("prob"), "edge",
        F.col("kelly").alias("kelly_fraction"), (F.col("covered") == F.col("bet_side")).cast("int").alias("win"), "pnl", F.lit(1.0).alias("bankroll"),
    )
    error = F.col("home_margin") - F.col("pred_m1")
    folds = s.predictions.groupBy("fold").agg(
        F.min("game_date").alias("test_start"), F.max("game_date").alias("test_end"), F.count(F.lit(1)).alias("rows"),
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
    )
    audit = s.prices.select("game_id", "game_date", F.lit("matched").alias("odds_tier"))
    metrics = s.games.agg(F.avg("score_home").alias("score"))
    runs.capture_run({"predictions": predictions, "bets": bets, "fold_metrics": folds, "odds_audit": audit, "metrics": metrics}, "whole", root)
    first = {"predictions": predictions.where("fold = 1"), "bets": bets.where("fold = 1"), "fold_metrics": folds.where("fold = 1"), "odds_audit": audit}
    runs.capture_run(first, "short", root)
    runs.capture_run({"predictions": predictions.where("fold = 2"), "metrics": metrics}, "changed", root)
    predictions.where("fold = 2").withColumn("p_home", F.lit(0.6)).write.mode("overwrite").parquet(f"{root}/predictions/run_id=changed")
    runs.capture_run({"fold_metrics": folds.withColumn("test_end", F.date_add("test_end", 9))}, "overlap", root)
    predictions.where("fold = 3").write.parquet(f"{root}/predictions/run_id=stopped")
    return runs.catalogue(s.spark, root).select("run_id", "status", F.col("tables").cast("int").alias("tables"), "rows", F.size("problems").alias("problems"))


@query("json_lines", "S-08", "SELECT event_id AS market_id, event_type AS series, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS price FROM events")
def json_lines(s):
    """A market list in JSON lines, some without a price."""
    path = f"{job_folder(s.spark, 'markets')}/list"
    e = s.table("events").select(F.col("event_id").alias("market_id"), F.col("event_type").alias("series"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("price"))
    e.write.json(path)
    return documents.read_json_lines(s.spark, path, "market_id bigint, series string, price double")


@query(
    "append_log", "S-03 S-15",
    """SELECT event_id AS request_id, event_type AS provider, CASE WHEN event_id % 2 = 0 THEN value END AS objects FROM events""",
)
def append_log(s):
    """A log that is empty at first and then takes rows with a missing column, and rows with one too many in another order."""
    path = f"{job_folder(s.spark, 'log')}/requests"
    e = s.table("events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("provider"), F.col("value").alias("objects"), "props")
    kind = e.drop("props").schema
    rows = tables.read_log(s.spark, path, kind)
    for part in (e.where("request_id % 2 = 1").select("request_id", "provider"), e.where("request_id % 2 = 0").select("props", "objects", "provider", "request_id")):
        tables.append_rows(part, path, kind)
    return rows.unionByName(tables.read_log(s.spark, path, kind))


@query("complete_children", "Q-08 ST-03", "SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def complete_children(s):
    """Line counts of orders: those with lines are stored, the others refilled, and the gate lets the table through."""
    path = f"{job_folder(s.spark, 'children')}/counts"
    orders, lines = s.table("orders"), s.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines")).write.parquet(path)
    refill_children(orders, path, ["o_orderkey"], lambda todo: todo.select("o_orderkey", F.lit(0).cast("long").alias("lines")))
    children = s.spark.read.parquet(path)
    audits.require_children(orders, children, ["o_orderkey"])
    return children


@query(
    "schema_report", "C-27",
    """SELECT * FROM (VALUES ('game_id', TRUE, TRUE, 'error'), ('home_margin', TRUE, TRUE, 'error'), ('stake', TRUE, FALSE, 'error'), ('pred_*', FALSE, TRUE, 'warning'), ('odds_*', FALSE, FALSE, 'warning')) t("column", is_hard_required, present, severity)""",
)
def schema_report(s):
    return schema.schema_report(s.predictions, ["game_id", "home_margin", "stake"], ["pred_*", "odds_*"])
