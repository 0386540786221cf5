"""Snapshots, merging of late and moved rows, and slots watched by a stateful stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lagwise.sources import snapshots, tables
from lagwise.streaming import quotes, slots

KIND = "k string, day date, v int"
D = [dt.date(2024, 1, n) for n in range(1, 32)]


def rows_of(spark, path, version=None):
    return sorted(((r.k, r.day, r.v) for r in snapshots.read(spark, path, version).collect()), key=str)


def test_reader_between_the_two_writes_sees_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    old, new = [("a", D[0], 1), ("b", None, 2)], [("a", D[0], 5), ("c", D[1], 6)]
    assert not snapshots.exists(spark, path)
    with pytest.raises(ValueError):
        snapshots.read(spark, path)
    assert snapshots.replace(spark.createDataFrame(old, KIND), path) == 1
    seen = []
    create = spark.createDataFrame

    def log_is_next(data, schema=None, **more):
        if schema == snapshots._LOG:
            seen.append(rows_of(spark, path))  # the rows are written, the log is not
        return create(data, schema, **more)

    after = create(new, KIND)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, **more: log_is_next(data, schema, **more))
    snapshots.replace(after, path)
    assert [set(x) for x in seen] == [set(old)]
    monkeypatch.undo()
    assert rows_of(spark, path) == sorted(new) and len(snapshots.read(spark, path, 1).collect()) == 2


def test_writer_that_dies_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.replace(spark.createDataFrame([("a", D[0], 1)], KIND), path)
    spark.createDataFrame([("x", D[0], 9)], KIND).write.parquet(f"{path}/data/__version=2")  # no log entry followed
    assert rows_of(spark, path) == [("a", D[0], 1)]
    assert snapshots.replace(spark.createDataFrame([("b", D[0], 2)], KIND), path) == 2
    assert rows_of(spark, path) == [("b", D[0], 2)]


def test_stored_table_and_sink_use_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    write = quotes.replace_table(path)
    for v in (1, 2):
        write(spark.createDataFrame([("a", D[0], v)], KIND), v)
    assert rows_of(spark, path) == [("a", D[0], 2)] and rows_of(spark, path, 1) == [("a", D[0], 1)]
    assert tables.read_or_build(spark, path, lambda: 1 / 0).count() == 1


def merge(spark, path, rows, span=0):
    return snapshots.merge(spark.createDataFrame(rows, KIND), path, ["k"], "day", ["v"], span)


def test_merge_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, [("a", D[0], 1), ("b", D[4], 2), ("n", None, 3)])
    merge(spark, path, [("c", D[4], 4), ("c", D[4], 3)])
    assert {(r.k, r.day, r.v) for r in snapshots.read(spark, path).collect()} == {("a", D[0], 1), ("b", D[4], 2), ("c", D[4], 4), ("n", None, 3)}
    held = {e["part"]: e["holder"] for e in snapshots._log(spark, path)}
    assert held == {"2024-01-01": 1, "2024-01-05": 2, "": 1}
    assert merge(spark, path, []) is None
    before = snapshots.read(spark, path).collect()
    merge(spark, path, [("c", D[4], 4)])  # replayed
    assert sorted(map(str, snapshots.read(spark, path).collect())) == sorted(map(str, before))


def test_postponed_row_replaces_its_old_day(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, [("a", D[9], 1), ("b", D[9], 1), ("z", D[30], 1)], 7)
    merge(spark, path, [("a", D[12], 2)], 7)
    assert rows_of(spark, path) == [("a", D[12], 2), ("b", D[9], 1), ("z", D[30], 1)]
    merge(spark, path, [("b", D[12], 2)], 7)  # leaves its day empty
    assert rows_of(spark, path) == [("a", D[12], 2), ("b", D[12], 2), ("z", D[30], 1)]
    assert "2024-01-10" not in {e["part"] for e in snapshots._log(spark, path)}


def test_stream_in_reverse_time_order_equals_distinct(spark, tmp_path):
    kind = "k string, day string"
    batches = [[("a", "2024-03-01"), ("b", "2024-03-02"), ("a", "2024-03-01")], [("a", "2023-12-01"), ("b", "2024-03-02"), ("c", "2023-12-01")]]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], kind).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        quotes.run_available(stream, str(tmp_path / "state"), quotes.merge_days(str(tmp_path / "out"), ["k", "day"], "day"))
    got = sorted((r.k, r.day) for r in snapshots.read(spark, str(tmp_path / "out")).collect())
    assert got == sorted({x for rows in batches for x in rows})


def test_watched_slots_are_reported_once_across_restarts(spark, tmp_path):
    t = lambda day, hour, minute=0: dt.datetime(2024, 1, day, hour, minute)
    kind = "provider string, slate_date string, slot string, at timestamp, closes timestamp, outcome string"
    first = [("p", "d1", "kept", t(1, 8), t(1, 12), None), ("p", "d1", "kept", t(1, 11), None, "ok"),
             ("p", "d1", "late", t(1, 8), t(1, 12), None), ("p", "d1", "never", t(1, 8), t(1, 12), None), ("p", "d1", "never", t(1, 9), None, "error"),
             ("p", "d2", "open", t(1, 8), t(2, 12), None), ("p", "d1", "no slot", t(1, 9), None, "ok"), ("p", "d1", "tick", t(1, 11, 30), None, None)]
    second = [("p", "d1", "late", t(1, 13), None, "ok"), ("p", "d1", "never", t(1, 13), t(1, 12), None), ("p", "d2", "open", t(2, 10), None, "ok"), ("p", "d1", "tick", t(3, 0), None, None)]
    third = [("p", "d1", "never", t(3, 2), t(1, 12), None), ("p", "d1", "tick", t(9, 0), None, None)]
    schema = spark.createDataFrame([], kind).schema

    def run(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        watched = slots.watch_slots(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        watched.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.slot, r.state) for r in spark.read.schema(slots.VERDICT).parquet(str(tmp_path / "out")).collect())

    assert run(first) == []
    want = [("kept", "done"), ("late", "missed"), ("never", "missed"), ("open", "done")]
    assert run(second) == want and run(third) == want
    table = spark.createDataFrame(first + second, kind).where("closes IS NOT NULL").groupBy("provider", "slate_date", "slot").agg(F.max("closes").alias("closes")).withColumns({"opens": F.lit(t(1, 0)), "capped": F.lit(False)})
    log = spark.createDataFrame(first + second, kind).where("outcome IS NOT NULL")
    batch = set()
    for closes in (t(1, 12), t(2, 12)):  # what the batch operator says at each closing time
        known = slots.slot_states(table.where(F.col("closes") == F.lit(closes)), log.where(F.col("at") < F.lit(closes)), F.lit(closes))
        batch |= {(r.slot, r.state) for r in known.collect()}
    assert batch == set(want)
