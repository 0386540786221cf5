"""Ranked search against scores of every document."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from brute import corpus, plain

from lagwise.llm import lexical_search as S


def plain_search(docs, items, top=10):
    words = {i: plain(t) for i, t in docs}
    some = {i: w for i, w in words.items() if w}
    n, total = len(some), sum(map(len, some.values()))
    df = Counter(t for w in some.values() for t in set(w))
    out = set()
    for item, text in items:
        scored = []
        for d, w in some.items():
            m = 100 - 90 + (90 * len(w) * n) // total
            tf = Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(plain(text)) if tf[t])
            if s > 0:
                scored.append((-s, d))
        out |= {(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])}
    return out


def frames(spark, docs, items, parts=3):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 7), (3, 1)])
def test_ranks_equal_all_scores(spark, monkeypatch, seed, block):
    monkeypatch.setattr(S, "BLOCK_DOCS", block)
    rng = random.Random(seed)
    docs = corpus(seed, 90)
    items = [(i, " ".join(rng.sample((rng.choice(docs)[1] or "x").split() or ["x"], 1) * 2 + ["The", "of"]) + f" über {t or ''}"[:200]) for i, (_, t) in enumerate(docs[:25])]
    items += [(100, None), (101, "nowhere"), (102, "one")]
    d, q = frames(spark, docs, items)
    assert {tuple(r) for r in S.search(d, q).collect()} == plain_search(docs, items)


def test_ties_are_ranked_by_id(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(50, "other text")] * 1
    items = [(1, "words"), (2, "text same")]
    d, q = frames(spark, docs, items)
    got = {tuple(r) for r in S.search(d, q).collect()}
    assert got == plain_search(docs, items)
    assert {r[2] for r in got if r[0] == 1} == set(range(1, 11))


def test_passes_change_nothing(spark):
    docs = corpus(4, 50)
    items = [(i, t) for i, t in docs[:20]]
    d, q = frames(spark, docs, items)
    assert {tuple(r) for r in S.search(d, q, pass_terms=15).collect()} == plain_search(docs, items)


def lists_of(rng, n_docs, n_terms):
    of, term = [], []
    n = np.array([rng.randint(5, 60) for _ in range(n_docs)])
    for d in range(n_docs):
        for _ in range(n[d]):
            of.append(d)
            term.append(min(int(rng.expovariate(0.15)), n_terms - 1))
    return S.Impacts(n, np.array(of), np.array(term), n_docs, int(n.sum()))


def test_best_positions_stop_no_later_than_last_read():
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    fewer = 0
    for seed in range(40):
        rng = random.Random(seed)
        lists = lists_of(rng, 800, 40)
        ids, terms = np.arange(800), np.array(rng.sample(range(30), 3))
        weights = np.array([rng.randint(1, 5000) for _ in terms])
        a = S.best_positions(lists, ids, terms, weights, 5, none)
        b = S.best_positions(lists, ids, terms, weights, 5, none, last_read=True)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
        assert a[2] <= b[2]
        fewer += a[2] < 800
    assert fewer > 20


def test_awkward_rows(spark):
    d = spark.createDataFrame([(1, "b word", 7, "k"), (1, "a word", 8, "k"), (None, "a word", 9, None), (2, None, 1, None), (3, "", 1, "x")], "doc_id long, text string, rank int, item_id string")
    q = spark.createDataFrame([(5, "word a b", 1), (5, "a", 2), (None, "word", 3), (6, None, 4)], "item_id long, text string, score int")
    got = S.search(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and [(r.item_id, r.rank, r.doc_id) for r in got.collect()] == [(5, 1, 1)]
    assert S.search(d.limit(0), q).collect() == [] and S.search(d, q.limit(0)).collect() == []
