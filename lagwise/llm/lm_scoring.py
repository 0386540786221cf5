"""Language-model scores by a weighted backoff automaton over word pairs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import crc_of_id, written
from lagwise.llm.words import CHUNK_BYTES, mixed, word_hashes

#: Text that one task turns into one batch, and text per part of the hash range that one task counts.
BATCH_BYTES = 8 << 20
PART_BYTES = 16 << 20
#: Weight of the failure arc: a state trusts its own counts as much as the root after this many uses.
CONCENTRATION = 100.0
END = np.uint64(0x5DEECE66D1234567)
START = np.uint64(0x2C1B3C6DF00DCAFE)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pack(values: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed: planes of high bytes are nearly empty."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds in sorted ``keys`` of equal parts of the range of hashes."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)


@dataclass
class Tokens:
    """A batch's documents as token hashes, each document's words and one end."""

    ids: list
    trained: np.ndarray
    first: np.ndarray
    token: np.ndarray
    before: np.ndarray

    def pairs(self) -> np.ndarray:
        return mixed(self.before * _STEP + self.token)


def _tokens(row: dict) -> Tokens:
    data = zstandard.ZstdDecompressor().decompress(row["texts"])
    found, first, at, words, sizes = [], [0], 0, [], 0
    ends = []
    for n in row["sizes"]:
        own = data[at : at + n].split()
        at += n
        sizes += n
        words += own
        ends.append(len(own))
        if sizes >= CHUNK_BYTES:
            found.append(word_hashes(words))
            words, sizes = [], 0
    found.append(word_hashes(words))
    lengths = np.array(ends, np.int64) + 1
    first = np.concatenate([[0], np.cumsum(lengths)])
    token = np.full(first[-1], END, np.uint64)
    is_word = np.ones(first[-1], np.bool_)
    is_word[first[1:] - 1] = False
    token[is_word] = np.concatenate(found)
    before = np.roll(token, 1)
    before[first[:-1]] = START
    return Tokens(row["ids"], np.array(row["trained"], np.bool_), first, token, before)


def batches(docs: DataFrame) -> DataFrame:
    """``batch, ids, trained, sizes, texts``: whole documents, up to about ``BATCH_BYTES`` a row, A-Z lower-cased.

    Written once, so that counting and scoring see the same batches whatever happens to executors in between.
    """
    names = ["batch", "ids", "trained", "sizes", "texts"]
    kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]

    def row(ids, trained, texts):
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        values = [[uuid.uuid4().hex], [ids], [trained], [[len(t) for t in texts]], [packed]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    def of(arriving):
        ids, trained, texts, size = [], [], [], 0
        for b in arriving:
            for i, t, k in zip(b.column(0), b.column(1).cast(pa.binary()), b.column(2)):
                text = (t.as_py() or b"").lower()
                ids.append(i.as_py())
                trained.append(k.as_py())
                texts.append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield row(ids, trained, texts)
                    ids, trained, texts, size = [], [], [], 0
        if ids:
            yield row(ids, trained, texts)

    return written(docs.select("doc_id", "text", "trained").mapInArrow(of, "batch string, ids array<long>, trained array<boolean>, sizes array<int>, texts binary"), "batches")


def _requests(table: DataFrame, parts: int) -> DataFrame:
    """For each batch, order and part of the hash range: the distinct tokens or pairs, and their uses in training."""
    names = ["part", "batch", "n", "keys", "uses"]

    def of(arriving):
        for b in arriving:
            for r in b.to_pylist():
                t = _tokens(r)
                weight = np.repeat(t.trained, np.diff(t.first))
                for n, values in ((1, t.token), (2, t.pairs())):
                    order = np.argsort(values, kind="stable")
                    values = values[order]
                    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
                    keys, uses = values[start], np.add.reduceat(weight[order].astype(np.uint32), start, dtype=np.uint32)
                    cuts = _parts(keys, parts)
                    filled = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                    spans = [slice(cuts[p], cuts[p + 1]) for p in filled]
                    steps = [_pack(np.diff(keys[s], prepend=np.uint64(0))) for s in spans]
                    columns = [pa.array(filled, pa.int32()), pa.array([r["batch"]] * len(filled), pa.string()), pa.array([n] * len(filled), pa.int32()), pa.array(steps, pa.binary()), pa.array([_pack(uses[s]) for s in spans], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return table.mapInArrow(of, "part int, batch string, n int, keys binary, uses binary")


_REPLY = "batch string, n int, part int, totals binary, tokens long, types long, once long, twice long"


def _count(group: pa.Table) -> pa.Table:
    """All batches' keys in one part of the range: total uses, back in each batch's order, and sums over the part."""
    rows = group.to_pylist()
    out = []
    for n in (1, 2):
        own = [r for r in rows if r["n"] == n]
        if not own:
            continue
        keys = [np.cumsum(_unpack(r["keys"], np.uint64), dtype=np.uint64) for r in own]
        every, uses = np.concatenate(keys), np.concatenate([_unpack(r["uses"], np.uint32) for r in own])
        order = np.argsort(every, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
        totals = np.add.reduceat(uses[order].astype(np.int64), start)
        back = np.empty(len(every), np.int64)
        back[order] = np.repeat(totals, np.diff(np.append(start, len(every))))
        at = 0
        for r, k in zip(own, keys):
            part = back[at : at + len(k)]
            at += len(k)
            out.append((r["batch"], n, r["part"], _pack(part.astype(np.int64)), None, None, None, None))
        if n == 1:
            out.append((None, 1, own[0]["part"], None, int(totals.sum()), int((totals > 0).sum()), int((totals == 1).sum()), int((totals == 2).sum())))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary()] + [pa.int64()] * 4
    names = ["batch", "n", "part", "totals", "tokens", "types", "once", "twice"]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


@dataclass(frozen=True)
class Automaton:
    """The model: a root state, and a state for each token seen in training as a history.

    From the state of history h, the arc of a pair (h, w) seen c(hw) times weighs (c(hw) + k * root(w)) / (c(h) + k). Any
    other token takes the failure arc, weight k / (c(h) + k), to the root, whose arcs weigh root(w): the discounted share
    of w, and for unknown tokens together what discounting has freed. Each state's weights sum to one over the known
    tokens and "unknown". After w the state is that of w, or the root if w never was a history. k is ``concentration``.
    """

    tokens: int
    types: int
    discount: float
    concentration: float

    def root(self, uses: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(uses))
        return np.where(uses > 0, uses - self.discount, self.discount * self.types) / self.tokens

    def run(self, uses: np.ndarray, history: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 of the weights along the path of tokens with these counts: of themselves, of the states, of the arcs."""
        root = self.root(uses)
        arc = (pair + self.concentration * root) / (history + self.concentration)
        failure = self.concentration / (history + self.concentration)
        return np.log10(np.where(pair > 0, arc, failure * root))


def _score(model: Automaton):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def of(key, texts: pa.Table, replies: pa.Table) -> pa.Table:
        found = sorted(replies.to_pylist(), key=lambda r: (r["n"], r["part"]))
        totals = {n: np.concatenate([_unpack(r["totals"], np.int64) for r in found if r["n"] == n] or [np.empty(0, np.int64)]) for n in (1, 2)}
        out = []
        for r in texts.to_pylist():
            t = _tokens(r)
            keys, place = np.unique(t.token, return_inverse=True)
            uses = totals[1][place]
            start = totals[1][np.searchsorted(keys, END)]  # each training document starts once and ends once
            history = np.where(t.before == START, start, np.roll(uses, 1))
            pair = totals[2][np.unique(t.pairs(), return_inverse=True)[1]]
            logs = model.run(uses, history, pair)
            base = np.log10((uses + 1) / (model.tokens + model.types + 1))
            sums = [np.add.reduceat(v, t.first[:-1]) for v in (uses > 0, base, logs)] if len(t.ids) else [[], [], []]
            columns = [t.ids, ~t.trained, np.diff(t.first), sums[0], [model.tokens] * len(t.ids), sums[1], sums[2]]
            out.append(pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], k) for k in kinds], names)

    return of


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, concentration: float = CONCENTRATION) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``.

    Tokens are the words of the whole text, A-Z lower-cased, and one end. Rows whose fold, crc32 of the doc_id's text
    modulo ``folds``, is not ``held_out`` train the model (``Automaton``). ``base_score`` sums log10((c + 1) / (N + V +
    1)) over the tokens, ``score`` the log10 weights of the automaton's arcs on one pass from left to right.

    The model grows with the corpus and is never gathered. Documents lie in written batches; each sends its distinct
    tokens and pairs, with its counts, to the task of their part of the hash range, which adds up all batches' counts and
    answers each batch for just these keys. A batch then holds every state and arc that its own texts can reach. Words
    and pairs are told apart by 64-bit hashes.

    Null texts are empty (only the end). Rows that repeat a doc_id or have none are rows of their own. Without training
    rows both scores are those of a model with no counts: 0. An empty table gives an empty result; other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_of_id() % folds != held_out).alias("trained"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    table = batches(rows)
    parts = max(1, -(-size // PART_BYTES))
    replies = written(_requests(table, parts).groupBy("part").applyInArrow(_count, _REPLY), "replies")
    s = replies.filter("batch IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "once", "twice")]).first()
    discount = min(0.9, max(0.1, s.once / (s.once + 2 * s.twice))) if s.once else 0.1
    model = Automaton(s.tokens, s.types, discount, concentration)
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = replies.filter("batch IS NOT NULL").select("batch", "n", "part", "totals")
    return table.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(model), kind)
