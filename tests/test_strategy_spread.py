"""The strategy sweep deals its rows out to tasks, whatever the models are."""

from pyspark.sql import functions as F

from lagwise.plans.strategies import _spread


def test_rows_are_dealt_out_to_more_tasks_when_there_are_many(spark):
    bets = spark.range(0, 900, numPartitions=2).select(F.col("id").alias("game_id"), F.lit("m1").alias("model"))
    per_task = _spread(bets, 3, rows=300).groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert sum(r["count"] for r in per_task) == 900 and max(r["count"] for r in per_task) <= 200  # about 100 each
    assert _spread(bets, 3, rows=10_000) is bets
    assert _spread(bets.limit(0), 3).count() == 0


def test_median_of_a_model_is_no_shuffle_by_model(spark, monkeypatch):
    from lagwise.plans import strategies

    seen = {}
    monkeypatch.setattr(strategies, "with_parameters", lambda df, rows: seen.setdefault("base", df) and (_ for _ in ()).throw(StopIteration))
    bets = spark.range(100).select(F.col("id").alias("game_id"), (F.col("id") % 2).alias("model"), F.col("id").cast("double").alias("pred_ensemble"))
    try:
        strategies.strategy_selection(bets, [{"top_n": 2}])
    except StopIteration:
        pass
    assert "BroadcastHashJoin" in seen["base"]._jdf.queryExecution().executedPlan().toString()
