"""Ranked lexical search: impact lists of a block of documents, read by the Best Position Algorithm."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import documents, written
from lagwise.llm.words import plain_words, slices

#: Text and documents of which impact lists are made at once.
BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 4096
#: Terms of the items that are searched in one pass over the documents; more items take more passes.
PASS_TERMS = 200_000
FIRST_STEP = 8


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1, BLOCK_BYTES):
        for at in range(0, b.num_rows, BLOCK_DOCS):
            yield b.slice(at, BLOCK_DOCS)


def _terms(texts: pa.Array, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text; text and number of every use of a known term."""
    lengths, known = [], []
    for t in texts.cast(pa.binary()).to_pylist():
        words = plain_words(t or b"")
        lengths.append(len(words))
        known.append(np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words)))
    n = np.array(lengths, np.int64)
    term = np.concatenate(known) if known else np.empty(0, np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return n, of[term >= 0], term[term >= 0]


class Impacts:
    """The impact lists of some documents: of each known term, its documents by falling impact (then rising number).

    ``base`` is an impact without its term's weight, which is the same for the whole list. Sorted access reads a list
    from its head; direct access goes from a document to its places in all lists.
    """

    def __init__(self, n: np.ndarray, of: np.ndarray, term: np.ndarray, docs: int, terms: int):
        d = len(n)
        key, tf = np.unique(term * d + of, return_counts=True)
        term, doc = np.divmod(key, max(d, 1))
        m = 10 + (90 * n * docs) // terms
        base = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, -base, term))
        self.doc, self.base, self.term = doc[order], base[order], term[order]
        new = np.ones(len(key), np.bool_)
        new[1:] = self.term[1:] != self.term[:-1]
        first = np.flatnonzero(new)
        self.listed = dict(zip(self.term[first].tolist(), zip(first.tolist(), np.diff(np.append(first, len(key))).tolist())))
        self.by_doc = np.argsort(self.doc, kind="stable")
        self.doc_first = np.searchsorted(self.doc[self.by_doc], np.arange(d + 1))

    def of_documents(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct access: all places of ``docs`` in the lists, and for each the index into ``docs``."""
        begin = self.doc_first[docs]
        count = self.doc_first[docs + 1] - begin
        which = np.repeat(np.arange(len(docs)), count)
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(which))
        return self.by_doc[at], which


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` highest scores above 0, equal ones by rising id."""
    order = np.lexsort((ids, -scores))[:top]
    order = order[scores[order] > 0]
    return scores[order], ids[order]


def best_positions(
    lists: Impacts, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, top: int, found: tuple[np.ndarray, np.ndarray], last_read: bool = False,
) -> tuple[np.ndarray, np.ndarray, int]:
    """``found`` (scores, ids) with the documents of ``lists`` that belong to the ``top``; and how many were looked at.

    All lists are read side by side. A document that shows up is looked up in all lists, which gives its score and marks
    its places there as seen. A list's best position is the end of the stretch of seen places at its head, which can
    be far beyond the last place read. No document that was not looked at can score more than the sum of impacts right
    after the best positions; reading stops when that sum is strictly below the lowest score of a full ``found``, so
    equal scores are all looked at. ``last_read`` takes the last places read instead, for comparison.
    """
    here = [(*lists.listed[t], w) for t, w in zip(terms.tolist(), weights.tolist()) if w > 0 and t in lists.listed]
    if not here:
        return *found, 0
    first, size, weight = (np.array(c, np.int64) for c in zip(*here))
    begin = np.cumsum(size) - size  # the lists one after the other
    seen = np.zeros(int(size.sum()), np.bool_)
    slot = np.full(int(lists.term[-1]) + 1, -1, np.int64)
    slot[lists.term[first]] = np.arange(len(first))
    known = np.zeros(len(ids), np.bool_)
    at, step, looked = 0, FIRST_STEP, 0
    position = np.zeros(len(first), np.int64)
    while True:
        rest = np.minimum(position, size - 1)
        bound = int((weight * lists.base[first + rest])[position < size].sum())
        if bound < (int(found[0][-1]) if len(found[0]) == top else 1):
            return *found, looked
        depth = np.arange(at, at + step)
        row, col = np.nonzero(depth[None, :] < size[:, None])
        docs = np.unique(lists.doc[first[row] + depth[col]])
        docs = docs[~known[docs]]
        known[docs] = True
        looked += len(docs)
        place, which = lists.of_documents(docs)
        s = slot[lists.term[place]]
        place, which, s = place[s >= 0], which[s >= 0], s[s >= 0]
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, which, weight[s] * lists.base[place])
        seen[begin[s] + place - first[s]] = True
        found = best(np.concatenate([found[0], scores]), np.concatenate([found[1], ids[docs]]), top)
        at += step
        step *= 2
        if last_read:
            position = np.minimum(at, size)
        else:
            unseen = np.append(np.flatnonzero(~seen), len(seen))
            position = np.minimum(unseen[np.searchsorted(unseen, begin)] - begin, size)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term`` of ``items(item_id, text)``: the distinct terms of each item.

    An item_id that repeats is one item, with the least of its texts; rows without one name no item.
    """

    def of(batches):
        for b in slices(batches):
            rows = [(i, w.decode()) for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()) for w in set(plain_words(t or b""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["item_id", "term"])

    ids = items.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return documents(ids).mapInArrow(of, "item_id long, term string")


def _statistics(docs: DataFrame, number: dict[bytes, int]) -> tuple[np.ndarray, int, int]:
    """Documents that hold each known term; documents with a term; all terms. One row per known term and task is added up."""

    def of(batches):
        held = np.zeros(len(number) + 2, np.int64)
        for b in _blocks(batches):
            n, of_text, term = _terms(b.column(1), number)
            pairs = np.unique(of_text * max(len(number), 1) + term)
            held[: len(number)] += np.bincount(pairs % max(len(number), 1), minlength=len(number))[: len(number)]
            held[-2:] += [np.count_nonzero(n), n.sum()]
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at])], ["at", "n"])

    total = np.zeros(len(number) + 2, np.int64)
    for r in docs.mapInArrow(of, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    return total[:-2], int(total[-2]), int(total[-1])


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def _search(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """The best documents of each task for the items with the terms ``rows``."""
    words = sorted({r["term"] for r in rows})
    number = {w.encode(): i for i, w in enumerate(words)}
    holding, n_docs, n_terms = _statistics(docs, number)
    weights = np.array([weight(n_docs, h) for h in holding.tolist()], np.int64)
    items: dict[int, list[int]] = {}
    for r in rows:
        items.setdefault(r["item_id"], []).append(number[r["term"].encode()])
    queries = {i: (np.array(t), weights[t]) for i, t in items.items()}

    def of(batches):
        nothing = (np.empty(0, np.int64), np.empty(0, np.int64))
        found = dict.fromkeys(queries, nothing)
        for b in _blocks(batches):
            n, of_text, term = _terms(b.column(1), number)
            if not len(term):
                continue
            lists, ids = Impacts(n, of_text, term, n_docs, n_terms), b.column(0).to_numpy()
            for i, (t, w) in queries.items():
                found[i] = best_positions(lists, ids, t, w, top, found[i])[:2]
        for i, (scores, ids) in found.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(ids), pa.int64()), pa.array(ids), pa.array(scores)], ["item_id", "doc_id", "score"])

    return docs.mapInArrow(of, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 10, pass_terms: int = PASS_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with the highest score above 0 for each item.

    Scores are integers (term weights from document counts, term counts damped by relative length); equal scores are
    ranked by rising doc_id. Documents stay where they are: each task makes impact lists of a block of them at a time
    and carries every item's best documents, and with them the threshold, from block to block; the at most ``top`` per
    item and task are ranked at the end. Items are taken in passes of about ``pass_terms`` terms, so what is sent to a
    task is bounded; each pass reads the documents twice, for the counts and for the search.

    Null texts have no terms: such a document is never found and such an item finds nothing. Repeated doc_ids or
    item_ids are one each, with the least of the texts, and rows without one are left out; empty tables give an empty
    result; other columns are ignored.
    """
    docs = documents(docs)
    terms = written(item_terms(items), "terms")
    passes = max(1, -(-terms.count() // pass_terms))
    found = None
    for p in range(passes):
        rows = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()
        if rows:
            part = _search(docs, rows, top)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
