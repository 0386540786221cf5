import math
import random
import zlib

import numpy as np
import pytest
from brute import prose

from lagwise.llm import quality_classifier


def table(spark, n=1200):
    rng = random.Random(6)
    rows, labels, truth = [], [], {}
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(20, 90))
        if not good:
            text = rng.choice([text.upper() + "!!", text.replace(" ", " | "), (prose(rng, 4) + " ") * 12, text.replace(" ", "$$$ ")])
        rows.append((i, text, "en", 0.5, 1))
        truth[i] = int(good)
        if rng.random() < 0.5:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, x string, score double, positive int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_accuracy(spark):
    docs, labels, truth = table(spark)
    rows = quality_classifier.classify(docs, labels).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in truth}
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    pos, neg = ([r.score for r in held if truth[r.doc_id] == k] for k in (1, 0))
    assert np.mean([[a > b for b in neg] for a in pos]) > 0.98
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def plain_risk(x, pos, prior, w):
    """The risk, its part for the negatives and its slope, one row at a time."""
    lift, all_minus, pos_minus, slope = 0.0, 0.0, 0.0, np.zeros(len(w))
    for row, positive in zip(x, pos):
        z = float(row @ w)
        plus, minus, s = math.log1p(math.exp(-z)), math.log1p(math.exp(z)), 1 / (1 + math.exp(-z))
        all_minus += minus / len(x)
        slope += s * row / len(x)
        if positive:
            lift += plus / pos.sum()
            pos_minus += minus / pos.sum()
            slope += prior * (s - 1 - s) * row / pos.sum()
    negative = all_minus - prior * pos_minus
    penalty = quality_classifier.RIDGE
    return prior * lift + max(0.0, negative) + penalty * float(w @ w), negative, slope + 2 * penalty * w


def test_fit_against_the_plain_risk(spark):
    """The fit ends at a minimum or where the negatives' part reaches zero; there it is not the minimum (README)."""
    docs, labels, truth = table(spark, 600)
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    rows = [(r.doc_id, [float(v) for v in quality_classifier.features(r.text.encode())]) for r in docs.collect()]
    train = [(x, known.get(i, 0) == 1) for i, x in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    prior = np.mean(list(known.values()))
    centre, spread, w = quality_classifier.fit(spark.createDataFrame(train, "x array<double>, positive boolean").repartition(5), float(prior))
    raw, pos = np.array([x for x, _ in train]), np.array([p for _, p in train])
    assert np.allclose(centre, raw.mean(axis=0)) and np.allclose(spread, np.sqrt(np.maximum(raw.var(axis=0), 1e-12)), atol=1e-6)

    def columns(raw):
        z = np.tanh((raw - centre) / spread / 3)
        return np.hstack([np.ones((len(raw), 1)), z, z * z])

    x = columns(raw)
    risk, negative, slope = plain_risk(x, pos, prior, w)
    start, _, first_slope = plain_risk(x, pos, prior, np.zeros(len(w)))
    assert start == pytest.approx(prior * math.log(2) + (1 - prior) * math.log(2)) and np.abs(first_slope).max() > 0.01
    assert 0 < negative and risk < start / 2
    assert negative < 0.01 * start or np.abs(slope).max() < 1e-3
    want = dict(zip((i for i, _ in rows), 1 / (1 + np.exp(-columns(np.array([f for _, f in rows])) @ w))))
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in got) < 1e-4


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = table(spark, 300)
    kept = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    one, two = ({r.doc_id: r.score for r in quality_classifier.classify(docs, x).collect()} for x in (labels, kept))
    assert all(abs(one[i] - two[i]) < 1e-9 for i in one)


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    none = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 5
    assert quality_classifier.classify(docs.limit(0), labels).collect() == []
