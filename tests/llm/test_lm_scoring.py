import math
import zlib
from collections import Counter

import pytest
from brute import corpus, lowered, split

from lagwise.llm import lm_scoring

KIND = "doc_id long, text string"


def plain(docs, folds, k):
    """The same model with dictionaries, one token at a time."""
    seqs = [(i, split(lowered(t)) + [None]) for i, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % folds == 2 for i, _ in seqs]
    train = [s for (_, s), h in zip(seqs, held) if not h]
    uni = Counter(w for s in train for w in s)
    bi = Counter(p for s in train for p in zip(["<s>"] + s, s))
    n, v = sum(uni.values()), len(uni)
    once, twice = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.1
    root = lambda w: (uni[w] - d if uni[w] else d * v) / n if n else 1.0
    out = []
    for (i, s), h in zip(seqs, held):
        total, state = 0.0, "<s>"
        for w in s:
            c = len(train) if state == "<s>" else uni[state]
            total += math.log10((bi[state, w] + k * root(w)) / (c + k))
            state = w
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in s)
        out.append((i, h, len(s), sum(uni[w] > 0 for w in s), n, base, total))
    return out


@pytest.mark.parametrize("batch, part", [(1 << 25, 1 << 24), (3000, 2000)])
def test_same_as_dictionaries(spark, monkeypatch, batch, part):
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", batch)
    monkeypatch.setattr(lm_scoring, "PART_BYTES", part)
    docs = corpus(12, 90) + [(None, "no id"), (4, "again"), (4, "again"), (5000, "wholly unknown zzz")]
    df = spark.createDataFrame([(*d, 1.0, "x") for d in docs], KIND + ", score double, batch string").repartition(3)
    got = sorted((tuple(r) for r in lm_scoring.score(df).collect()), key=str)
    want = sorted(plain(docs, 7, lm_scoring.CONCENTRATION), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


def test_weights_of_a_state_sum_to_one():
    import numpy as np

    uses = np.array([5, 3, 1, 1, 0])  # the last is "unknown"
    model = lm_scoring.Automaton(10, 4, 0.5, 7.0)
    assert math.isclose(model.root(uses).sum(), 1)
    pair = np.array([2, 1, 0, 0, 0])
    assert math.isclose((10 ** model.run(uses, np.full(5, 3), pair)).sum(), 1)
    assert math.isclose((10 ** model.run(uses, np.zeros(5), np.zeros(5))).sum(), 1)


def test_no_training_rows_and_empty_table(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = lm_scoring.score(spark.createDataFrame([(i, "a b") for i in ids], KIND)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(3, 0, 0, 0.0, 0.0)] * 3
    assert lm_scoring.score(spark.createDataFrame([], KIND)).collect() == []
