"""Line deduplication against dictionaries of whole lines."""

import random
from collections import defaultdict

import numpy as np
import pytest
from brute import UPPER, corpus, prose

from lagwise.llm import line_dedup as L

ENDS = " \t\n\x0b\x0c\r"


def plain_dedup(docs, least_docs=5, least_chars=40):
    holders = defaultdict(set)
    key = lambda x: x.strip(ENDS).translate(UPPER)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                holders[key(x)].add(i)
    out = {}
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if len(holders[key(x)]) < least_docs or max(holders[key(x)]) == i]
        out[i] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out


def lined(seed, n=80):
    rng = random.Random(seed)
    shared = [prose(rng, k) for k in (8, 9, 12, 15, 40, 6, 7)] + ["ä" * 39, "ä" * 40, "x" * 39, "x" * 40, "É" * 30 + "Q" * 10]
    docs = list(corpus(seed, 40))
    for i in range(100, 100 + n):
        rows = [prose(rng, rng.randint(1, 14)) for _ in range(rng.randint(0, 6))]
        for x in rng.sample(shared, rng.randint(0, 6)):
            x = x.upper() if rng.random() < 0.3 and x.isascii() else x
            rows.insert(rng.randint(0, len(rows)), rng.choice(["", " ", "\t ", "\xa0"]) + x + rng.choice(["", "\r", " "]))
        docs.append((i, "\n".join(rows * rng.choice([1, 1, 2]))))
    return docs


@pytest.mark.parametrize("seed, shard, hot", [(1, 1 << 14, 1024), (2, 8, 1024), (3, 8, 1), (4, 50, 10)])
def test_lines_equal_plain_version(spark, monkeypatch, seed, shard, hot):
    monkeypatch.setattr(L, "HOT", hot)
    docs = lined(seed)
    got = L.deduplicate_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_lines=shard)
    want = plain_dedup(docs)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()} == want
    assert sum(w[1] for w in want.values()) > 50


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64)
    a[: n // 10] = 7  # equal halves
    counts, keepers = rng.integers(5, 300, n), rng.integers(-50, 1 << 40, n)
    made = L.Shard.read(*L.Shard.of(a, b, counts, keepers).row())
    assert sorted(made.index(a, b).tolist()) == list(range(n))
    got = made.probe(a, b)
    assert got[0].tolist() == counts.tolist() and (got[1] == keepers).all()
    other = rng.integers(0, 1 << 63, 5000, np.uint64)
    assert not made.probe(other, other)[0].any()
    if n >= 1000:
        assert made.counts.itemsize == 2 and sum(map(len, made.levels)) < 5 * n


def test_awkward_rows(spark):
    line = "a line of forty characters, as it must be, and more"
    rows = [(i, f"{line}\nx", "k", i) for i in range(5)] + [(0, line, "z", 1), (None, line, "z", 1), (7, None, None, None), (8, "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, n long")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in L.deduplicate_lines(df).collect()}
    assert got == {0: (1, 1, ""), 1: (2, 1, "x"), 2: (2, 1, "x"), 3: (2, 1, "x"), 4: (2, 0, f"{line}\nx"), 7: (1, 0, ""), 8: (1, 0, "")}
    assert L.deduplicate_lines(df.limit(0)).collect() == []
