"""Chunked and bucketed computations against plain Python on one hot entity."""

import random

import pytest
from pyspark.sql import functions as F

from lagwise.operators import ranking
from lagwise.operators import windows as W
from lagwise.operators.ranking import group_rank
from lagwise.operators.timeline import RANGE, Timeline, by_day, cum_count, cum_max, cum_min, cum_product, cum_sum, framed, in_ranges, positions, running

random.seed(3)
# entity "a" holds most rows; days repeat; values have nulls
ROWS = [("a" if random.random() < 0.8 else "b", random.randint(0, 12), i, None if random.random() < 0.2 else random.randint(-4, 6)) for i in range(240)]
LINE = Timeline("k", ("day", "id"))


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k string, day int, id int, v int").repartition(5).cache()


def history(key):
    return sorted([r for r in ROWS if r[0] == key], key=lambda r: (r[1], r[2]))


def by_id(rows, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in rows}


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("bounded", [False, True])
def test_running(df, inclusive, bounded):
    out = running(
        df, LINE,
        {"s": cum_sum(F.col("v")), "n": cum_count(F.col("v")), "lo": cum_min(F.col("v")), "hi": cum_max(F.col("v")), "p": cum_product(1 + F.col("v") / 100)},
        inclusive, {"total": cum_count()}, bounded,
    )
    got = by_id(out.collect(), "s", "n", "lo", "hi", "p", "total")
    for key in "ab":
        rows = history(key)
        for i, r in enumerate(rows):
            seen = [x[3] for x in rows[: i + inclusive] if x[3] is not None]
            s, n, lo, hi, p, total = got[r[2]]
            assert (s, n, lo, hi, total) == (sum(seen) if seen else None, len(seen), min(seen, default=None), max(seen, default=None), len(rows))
            want = 1.0
            for x in seen:
                want *= 1 + x / 100
            assert (p is None and not seen) or abs(p - want) < 1e-12


@pytest.mark.parametrize("chunk", [5, 7, 1000])
def test_frames_cross_chunks(df, chunk):
    out = framed(
        df, LINE,
        lambda w: {"m": W.last_mean(w, F.col("v"), 5, 2), "full": W.last_mean(w, F.col("v"), 3), "w": W.last_decayed(w, F.col("v"), 3, 0.5), "l": F.lag("id", 4).over(w)},
        5, chunk,
    )
    rows = out.collect()
    assert len(rows) == len(ROWS)
    got = by_id(rows, "m", "full", "w", "l")
    for key in "ab":
        h = history(key)
        for i, r in enumerate(h):
            m, full, w, lag = got[r[2]]
            last = [x[3] for x in h[max(0, i - 5): i] if x[3] is not None]
            assert (m is None) == (len(last) < 2) and (m is None or abs(m - sum(last) / len(last)) < 1e-12)
            three = [x[3] for x in h[max(0, i - 3): i]]
            whole = len(three) == 3 and None not in three
            assert (full is None) == (not whole) and (w is None) == (not whole)
            if whole:
                assert abs(w - (three[2] + 0.5 * three[1] + 0.25 * three[0]) / 1.75) < 1e-12
            assert lag == (h[i - 4][2] if i >= 4 else None)


def test_chunk_must_cover_reach(df):
    with pytest.raises(ValueError):
        framed(df, LINE, lambda w: {}, 5, 4)


def test_positions_and_streaks(df):
    got = by_id(positions(df, LINE).collect(), "pos")
    streak = by_id(W.streaks(df, LINE, F.col("v") > 0).collect(), "win_streak", "loss_streak", "streak_length")
    for key in "ab":
        win = loss = 0
        for i, r in enumerate(history(key)):
            assert got[r[2]] == (i,)
            assert streak[r[2]] == (win, loss, win - loss)
            if r[3] is not None and r[3] > 0:
                win, loss = win + 1, 0
            else:
                win, loss = 0, loss + 1


def test_calendar_windows(df):
    out = by_day(df, ["k"], "day", {"n": F.count(F.lit(1))}, lambda w: {"near": F.coalesce(F.sum("n").over(w.rangeBetween(-3, -1)), F.lit(0))})
    load = by_id(W.inverse_gap_load(df, ["k"], "day").collect(), "rest_weighted_load")
    for r in out.collect():
        rows = [x for x in ROWS if x[0] == r["k"]]
        assert r["near"] == sum(1 for x in rows if r["day"] - 3 <= x[1] < r["day"])
        want = sum(1 / (r["day"] - x[1]) for x in rows if 0 < r["day"] - x[1] <= 7)
        assert abs(load[r["id"]][0] - want) < 1e-9


def test_zscore_of_constant_history_is_zero(spark):
    rows = [("t", i, 0.1 + 0.2) for i in range(9)] + [("t", 9, 5.0)]
    d = spark.createDataFrame(rows, "k string, day int, v double")
    out = W.prior_zscores(d.withColumn("z", F.col("v")), Timeline("k", "day"), {"z": F.col("v")})
    assert {r["z"] for r in out.collect()} == {0.0}


def test_exact_quantiles_rank_and_bins(df):
    q = {r["k"]: (r["lo"], r["mid"]) for r in ranking.quantiles(df, ["k"], F.col("v"), {"lo": 0.1, "mid": 0.5}).collect()}
    rank = by_id(ranking.group_rank(df, ["k"], F.col("v"), ["id"], "r").collect(), "r")
    bins = by_id(ranking.equal_count_bins(df, ["k"], F.col("v"), ["id"], 4, "b", "Q").collect(), "b")
    for key in "ab":
        vals = sorted(r[3] for r in ROWS if r[0] == key and r[3] is not None)

        def at(p):
            h = (len(vals) - 1) * p
            i = int(h)
            return vals[i] + (vals[min(i + 1, len(vals) - 1)] - vals[i]) * (h - i)

        assert abs(q[key][0] - at(0.1)) < 1e-9 and abs(q[key][1] - at(0.5)) < 1e-9
        order = sorted([r for r in ROWS if r[0] == key], key=lambda r: (r[3] is None, -(r[3] or 0), r[2]))
        assert [rank[r[2]][0] for r in order] == list(range(1, len(order) + 1))
        up = sorted([r for r in ROWS if r[0] == key and r[3] is not None], key=lambda r: (r[3], r[2]))
        n = len(up)
        for i, r in enumerate(up):
            assert bins[r[2]][0] == f"Q{max(1, -(-i * 4 // (n - 1)))}"
    assert all(bins[r[2]][0] is None for r in ROWS if r[3] is None)


@pytest.mark.parametrize("metric", ["1.5", "1000 + id / 1e9", "if(id % 10 = 0, id, null)"])
def test_no_range_holds_many_rows(spark, metric):
    """A constant, a narrow and a mostly missing metric: ranks are right, and no task gets more than a few per cent."""
    df = spark.range(20_000).selectExpr("id", f"cast({metric} as double) m")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = (F.col("m").desc_nulls_last(), "id")
        sizes = [r["count"] for r in in_ranges(df, (), order).groupBy(RANGE).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 1_200
        got = {r["id"]: r["r"] for r in group_rank(df, [], F.col("m"), ["id"], "r").collect()}
        rows = sorted(df.collect(), key=lambda r: (r.m is None, -(r.m or 0), r.id))
        assert got == {r.id: i + 1 for i, r in enumerate(rows)}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
