"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import written
from lagwise.llm.words import chunks

#: Chunks of text between white space whose ids a worker remembers: about 300 MB at most.
REMEMBERED = 1_500_000
#: Pieces that one task ranks at most if all have the same length.
RANKED = 20_000


class ChunkTokenizer:
    """Ids of white-space-free chunks of text as little-endian 32-bit strings, remembered within bounds.

    For tokenizers whose pieces never span ASCII white space and which drop it: a text's ids are then those of its
    chunks in order. New chunks are encoded together, with a special token in between to tell them apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self._tokenizer.get_added_tokens_decoder().items() if t.special]
        self._id, self._between = special[-1]
        self._marks = tuple({t[:2].encode() for _, t in special})
        self._known: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of ``words``, among others."""
        if len(self._known) + len(words) > REMEMBERED:
            self._known = {}
        new = [w for w in words if w not in self._known]
        plain = [w for w in new if not any(m in w for m in self._marks)]
        for at in range(0, len(plain), 500):
            part = plain[at : at + 500]
            ids = self._encode(self._between.join(w.decode() for w in part))
            cuts = np.flatnonzero(ids == self._id)
            if len(cuts) != len(part) - 1:
                raise ValueError("this tokenizer cannot encode chunks side by side")
            for w, a, b in zip(part, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                self._known[w] = ids[a:b].tobytes()
        for w in set(new).difference(plain):
            self._known[w] = self._encode(w.decode()).tobytes()
        return self._known


@cache
def _tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``: each text's ids and ``end``, cut at ``capacity``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    last = np.array([end], "<u4").tobytes()

    def of(batches):
        tok = _tokenizer(tokenizer)
        for c in chunks(batches):
            known = tok.learn(set(c.words))
            rows = []
            for i, doc in enumerate(c.ids.to_pylist()):
                ids = b"".join(map(known.__getitem__, c.words[c.first[i] : c.first[i + 1]])) + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, kind)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many bins hold just these) for ``counts`` pieces of each length.

    A bin takes the longest piece left, then again and again the longest that fits. Then its shortest piece makes way
    for two unpacked ones if some two fill the expanded gap more tightly, until no two do. The same bin is used as long
    as pieces of its lengths last, so the work depends on the number of lengths, not on the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    steps = np.arange(capacity + 1)
    bins = []
    while left.any():
        now, held, gap = left.copy(), [], capacity
        while gap:
            fits = np.flatnonzero(now[: gap + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            n = int(min(now[length], gap // length))
            held += [length] * n
            now[length] -= n
            gap -= n * length
        while gap and held:
            room = gap + held[-1]
            below = np.maximum.accumulate(np.where(now > 0, steps, 0))
            a = np.flatnonzero(now[:room])
            most = np.minimum(a, room - a)
            b = below[most]
            b = np.where((b == a) & (now[a] < 2), below[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if not len(a) or total.max() <= held[-1]:
                break
            k = int(total.argmax())
            now[held.pop()] += 1
            for x in (int(a[k]), int(b[k])):
                held.append(x)
                now[x] -= 1
            held.sort(reverse=True)
            gap = capacity - sum(held)
        lengths, n = np.unique(held, return_counts=True)
        times = int((left[lengths] // n).min())
        left[lengths] -= n * times
        bins.append((held, times))
    return bins


def _segments(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Per bin pattern and length: length, rank of its first piece, pieces a bin, first bin, offset in the bin."""
    rank: dict[int, int] = {}
    rows, first_bin = [], 0
    for held, times in bins:
        at = 0
        for length in sorted(set(held), reverse=True):
            n = held.count(length)
            rows.append((length, rank.get(length, 0), n, first_bin, at))
            rank[length] = rank.get(length, 0) + n * times
            at += n * length
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _ranked(cut: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0; a frequent length is dealt to many tasks."""
    parts = max(1, -(-cut.count() // RANKED))
    salted = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # rows: parts
    base = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("inside", inside).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("inside") - 1).drop("part", "base", "inside")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]``: a place in a sequence for every piece.

    The bins are planned on the number of pieces of each length, ``capacity`` numbers whatever the corpus's size, and
    pieces take the planned places by their rank among those of their length. Only documents longer than a sequence are
    cut. A null or empty text is its end token alone. Every row is a document, also rows that repeat a doc_id or have
    none; equal lengths are told apart by doc_id, piece and content. An empty table gives an empty result, and other
    columns are ignored.
    """
    cut = written(pieces(docs, tokenizer, capacity, end, with_ids), "pieces")
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = cut.sparkSession.sparkContext.broadcast(_segments(best_two_fit(counts, capacity)))
    ranked = _ranked(cut)
    names = ranked.columns

    def of(batches):
        seg = table.value
        shift = 44  # a rank has 44 bits, a length the rest
        keys = (seg[:, 0] << shift) + seg[:, 1]
        for b in batches:
            column = lambda name: b.column(names.index(name)).to_numpy()
            length, rank = column("length"), column("rank")
            s = seg[np.searchsorted(keys, (length << shift) + rank, side="right") - 1] if len(seg) else np.zeros((0, 5), np.int64)
            k = rank - s[:, 1]
            bin_, offset = s[:, 3] + k // s[:, 2], s[:, 4] + k % s[:, 2] * length
            kept = [b.column(i) for i, n in enumerate(names) if n != "rank"]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(bin_), pa.array(offset)], [n for n in names if n != "rank"] + ["sequence_id", "offset"])

    kind = ", ".join(f"{n} {t}" for n, t in ranked.drop("rank").dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(of, kind).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
