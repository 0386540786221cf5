"""Periodic runs against a table of all pairs of words."""

import random
import zlib

import numpy as np
import pytest
from brute import corpus, sha, split

from lagwise.llm import periodic_runs as R
from lagwise.llm.queries import QUERIES


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            lo = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - lo >= q and i - lo + q >= 12:
                found.setdefault((lo - q, i), q)  # periods rise, so the first one is the least
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain(doc_id, text, plant):
    w = split(text)
    if plant and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def values(words):
    return np.array([hash(w) for w in words], np.int64).view(np.uint64)


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_the_full_table(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abc" if seed % 3 == 1 else "abcdefghijklmnop"
    words = [rng.choice(letters) for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 4)):
        p = rng.randint(1, 40)
        root = [rng.choice(letters) for _ in range(p)]
        words += (root * 9)[: rng.randint(1, 9 * p)] + [rng.choice(letters) for _ in range(rng.randint(0, 9))]
    assert R.runs(values(words)).tolist() == [list(r) for r in plain_runs(words)]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_strings_full_of_runs():
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(512))
    for text in (fibonacci(600), thue, "a" * 300, "ab" * 150 + "a", "a" * 149 + "b" + "a" * 149 + "b", "aab" * 99 + "aabaab"):
        assert R.runs(values(text)).tolist() == [list(r) for r in plain_runs(text)]


def test_cost_does_not_depend_on_the_words():
    one = R.runs(np.zeros(200_000, np.uint64))
    assert one.tolist() == [[0, 200_000, 1]]


def test_documents(spark):
    docs = [(i, t) for i, t in corpus(9) if len(split(t)) < 1500]
    docs += [(100 + i, "x y z " * i) for i in range(12)] + [(200, "a b c d e f " * 2), (201, "a b c d e f " * 2 + "a"), (-5, "q " * 11), (-6, "q " * 12)]
    got = R.periodic_runs(spark.createDataFrame(docs, "doc_id long, text string"), R.planted).collect()
    assert {r.doc_id: tuple(r)[1:8] for r in got} == {i: plain(i, t, True) for i, t in docs}
    assert sum(r.n_runs > 0 for r in got) > 10
    bare = R.periodic_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:8] for r in bare} == {i: plain(i, t, False) for i, t in docs}


def test_documents_do_not_touch(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f g")]
    assert [r.n_runs for r in R.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0, 0, 0]


def test_awkward_rows(spark):
    rows = [(1, "a " * 30, "x", 5), (1, "a " * 30, "y", 6), (None, "a " * 30, None, 1), (2, None, None, 1), (3, " \n", "z", None)]
    got = R.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, start string, n_runs int")).collect()
    assert [(r.doc_id, r.n_runs, r.start, r.period, r.exponent_milli) for r in got] == [(1, 1, 0, 1, 30000), (1, 1, 0, 1, 30000), (None, 1, 0, 1, 30000), (2, 0, None, None, None), (3, 0, None, None, None)]
    assert got[3].collapsed_sha256 == got[3].runs_sha256 == sha("")
    assert R.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, start string, n_runs int").limit(0)).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:8] for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert set(got) == {i for i, _ in docs}
    short = [(i, t) for i, t in docs if len(split(t)) < 600]
    assert len(short) > 100 and all(got[i] == plain(i, t, True) for i, t in short)
