"""A quality classifier from trusted positives and unlabelled text: non-negative positive-unlabelled learning."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import crc_of_id, written

_ALL = bytes(range(256))
_UPPER, _LOWER, _DIGIT, _POINT, _SYMBOL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:!?", b"#*$%&|<>@^~_=+\\/{}[]"
_SENTENCE = re.compile(rb"[.!?](?:\s|$)")
#: Steps of the fit at most; it ends earlier when a step no longer lowers the risk.
STEPS = 40
#: Weight of the squared coefficients in the risk, so that it has one minimum.
RIDGE = 1e-4


def features(text: bytes | None) -> list[float]:
    """Measures of one whole text; null and empty texts have zeros and a mark of their own."""
    words = (text or b"").split()
    if not words:
        return [1.0] + [0.0] * 11
    n, chars = len(words), sum(map(len, words))
    count = lambda kind: len(text) - len(text.translate(None, kind))
    upper, lower = count(_UPPER), count(_LOWER)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        0.0, np.log1p(n), chars / n, count(_SYMBOL) / n, count(_POINT) / n, count(_DIGIT) / chars, upper / max(1, upper + lower),
        len(set(words)) / n, len(set(zip(words, words[1:]))) / n, 1 - len(set(lines)) / len(lines), len(_SENTENCE.findall(text)) / n, max(map(len, words)) / 10,
    ]


def _columns(raw: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """A constant, each measure bounded, and its square: a text far out in one measure cannot outweigh all others."""
    z = np.tanh((raw - centre) / spread / 3)
    return np.hstack([np.ones((len(raw), 1)), z, z * z])


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with its ``text`` replaced by ``x``, its features."""
    others = [c for c in docs.columns if c != "text"]
    docs = docs.select("text", *others)

    def of(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.list_(pa.float64()))], [*others, "x"])

    return docs.mapInArrow(of, ", ".join(f"{n} {t}" for n, t in docs.dtypes[1:]) + ", x array<double>")


def _sums(rows: DataFrame, of_block) -> dict[int, float]:
    """``of_block`` turns a block (matrix x, positive or not) into a vector; their sum over all rows, by place.

    Tasks sum their own rows, Spark adds up the tasks; the driver gets one number per place.
    """

    def of(batches):
        total = 0.0
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                total = total + of_block(x, b.column(1).to_numpy(zero_copy_only=False).astype(bool))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    return {r.i: r.v for r in rows.select("x", "positive").mapInArrow(of, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}


def _vector(sums: dict[int, float], n: int) -> np.ndarray:
    return np.array([sums.get(i, 0.0) for i in range(n)])


def fit(rows: DataFrame, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Centre, spread and weights of the classifier from ``rows(x, positive)``; null without positives or others.

    Positives are a sample of the good texts, all rows one of the web. With the logistic loss l the risk is
    prior * E_pos[l(+)] + max(0, E_all[l(-)] - prior * E_pos[l(-)]): the unbiased estimate, with the part that stands
    for the negatives kept from falling below zero. Where that part is positive, l(+) - l(-) = -z makes the risk convex
    and each step is Newton's, over all rows; a step is halved until the risk falls, and the fit ends at the minimum or
    where the negatives' part reaches zero.
    """
    probe = rows.select("x").first()
    if probe is None:
        return None
    width = len(probe.x)
    first = _vector(_sums(rows, lambda x, pos: np.concatenate([[len(x), pos.sum()], x.sum(axis=0), (x * x).sum(axis=0)])), 2 + 2 * width)
    n, n_pos = first[:2]
    if not n_pos:
        return None
    centre = first[2 : 2 + width] / n
    spread = np.sqrt(np.maximum(first[2 + width :] / n - centre**2, 1e-12))
    k = 2 * width + 1

    def terms(weights: list[np.ndarray]):
        """For each vector of weights: E_pos[l(+)], E_pos[l(-)], E_all[l(-)]; for the first also sums for its step."""

        def of_block(raw, pos):
            x = _columns(raw, centre, spread)
            out = []
            for w in weights:
                z = x @ w
                minus = np.logaddexp(0, z)
                out += [(minus - z)[pos].sum() / n_pos, minus[pos].sum() / n_pos, minus.sum() / n]
            s = 1 / (1 + np.exp(-(x @ weights[0])))
            return np.concatenate([out, x[pos].sum(axis=0) / n_pos, x.T @ s / n, ((x * (s * (1 - s))[:, None]).T @ x / n).ravel()])

        got = _vector(_sums(rows, of_block), 3 * len(weights) + 2 * k + k * k)
        head = got[: 3 * len(weights)].reshape(-1, 3)
        negative = head[:, 2] - prior * head[:, 1]
        risk = prior * head[:, 0] + np.maximum(0, negative) + np.array([RIDGE * w @ w for w in weights])
        rest = got[3 * len(weights) :]
        return risk, negative, rest[:k], rest[k : 2 * k], rest[2 * k :].reshape(k, k)

    w = np.zeros(k)
    for _ in range(STEPS):
        _, _, pos, every, curve = terms([w])
        step = np.linalg.solve(curve + 2 * RIDGE * np.eye(k), prior * pos - every - 2 * RIDGE * w)
        tries = [w] + [w + step / 2**i for i in range(7)]
        risk, negative, *_ = terms(tries)
        best = int(np.argmin(np.where(negative > 0, risk, np.inf)))
        if best == 0 or risk[0] - risk[best] < 1e-7:
            break
        w = tries[best]
    return centre, spread, w


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Labels are only taken of rows whose fold, crc32 of the doc_id's text modulo ``folds``, is not ``held_out``. Among
    these, rows with a label 1 are the trusted positives, all rows are the unlabelled web text, and the class prior is
    estimated as the share of 1 among the labelled rows, kept between 0.01 and 0.99. Only the text is used for a score.

    Several labels of a document count as their greatest; null labels and labels without a doc_id do nothing. Null and
    empty texts are scored by a feature of their own. Rows that repeat a doc_id or have none are rows of their own.
    Without any positive label every score is the prior (0.5 without labels). An empty table gives an empty result;
    other columns are ignored. The fit's rounds read a written table of features; tasks sum, the driver holds sums.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_of_id() % folds == held_out).alias("held_out"))
    rows = written(measured(base), "features")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    training = rows.filter("NOT held_out").join(known, "doc_id", "left").select("x", "quality", (F.coalesce("quality", F.lit(0)) == 1).alias("positive"))
    training = written(training, "training")
    found = training.agg(F.avg(F.when(F.col("quality").isNotNull(), F.col("positive").cast("double"))).alias("p")).first()
    prior = 0.5 if found.p is None else min(0.99, max(0.01, found.p))
    model = fit(training, prior)

    def of(batches):
        for b in batches:
            score = np.full(b.num_rows, prior)
            if model and b.num_rows:
                x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                score = 1 / (1 + np.exp(-(_columns(x, model[0], model[1]) @ model[2])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "x").mapInArrow(of, "doc_id long, held_out boolean, score double, predicted int")
