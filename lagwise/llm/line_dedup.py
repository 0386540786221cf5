"""Line deduplication by probing the arrays of a sharded minimal perfect hash of the lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import SPACES, documents, written
from lagwise.llm.words import mixed, slices

# Shorter keys and keys in fewer documents stay.
LEAST_CHARS = 40
LEAST_DOCS = 5
#: Lines (one per document and key) that are looked up in one shard; a shard has at most a ``LEAST_DOCS``-th as many keys.
SHARD_LINES = 1 << 14
#: A key with more than this share of all lines is answered at once; there are at most ``HOT`` such keys.
HOT = 1024
_MULTIPLIER = 0x9E3779B97F4A7C15
_SHARD = "shard int, levels array<int>, bits binary, marks binary, counts binary, keepers binary"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES.encode()).lower()  # of bytes: A-Z only


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _digest(key: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(key), "<i8").tolist())


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, a, b``: the digest of each distinct key of at least ``least_chars`` code points of each whole text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = {k for k in map(line_key, (t or b"").split(b"\n")) if _long_enough(k, least_chars)}
                ids += [i] * len(own)
                keys += own
            ab = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["doc_id", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, a long, b long")


# --- one shard


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(mixed(a + np.uint64((level + 1) * _MULTIPLIER % (1 << 64))) ^ b) % np.uint64(size)).astype(np.int64)


@dataclass
class Shard:
    """A minimal perfect hash of keys (pairs of 64-bit values) and the arrays it indexes.

    A level is a bit table twice as large as the number of keys that reach it; a key that is alone at its place there
    owns the bit, and the others go on to the next level. A key's index is the number of bits before its own. A key of
    another set may end at some index too: ``marks`` holds each owner's ``b``, so this is noticed but for one in 2^64.
    ``counts`` takes the fewest bytes that hold its largest value.
    """

    levels: list[np.ndarray]
    marks: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        levels, owners, rest = [], [], np.arange(len(a))
        while len(rest):
            size = max(64, -(-2 * len(rest) // 64) * 64)
            at = _places(a[rest], b[rest], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            mine = alone[at]
            owners.append(rest[mine][np.argsort(at[mine])])
            levels.append(alone)
            rest = rest[~mine]
        order = np.concatenate(owners) if owners else rest
        small = np.min_scalar_type(int(counts.max())) if len(counts) else np.uint8
        return cls(levels, b[order], counts[order].astype(small), keepers[order])

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for a key that no level holds."""
        out, rest, before = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, bits in enumerate(self.levels):
            at = _places(a[rest], b[rest], level, len(bits))
            rank = np.cumsum(bits)
            mine = bits[at]
            out[rest[mine]] = before + rank[at[mine]] - 1
            before += int(rank[-1])
            rest = rest[~mine]
        return out

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and keeper of each key; count 0 for keys that are not in the set."""
        at = self.index(a, b)
        if not len(self.marks):
            return np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        held = (at >= 0) & (self.marks[at] == b)
        return np.where(held, self.counts[at].astype(np.int64), 0), self.keepers[at]

    def row(self) -> list:
        bits = np.packbits(np.concatenate(self.levels)) if self.levels else np.empty(0, np.uint8)
        arrays = (self.marks.astype("<u8"), self.counts.astype(self.counts.dtype.newbyteorder("<")), self.keepers.astype("<i8"))
        return [[len(x) for x in self.levels], bits.tobytes(), *[x.tobytes() for x in arrays]]

    @classmethod
    def read(cls, levels: list[int], bits: bytes, marks: bytes, counts: bytes, keepers: bytes) -> Shard:
        keys = len(marks) // 8
        kind = f"<u{len(counts) // keys}" if keys else "<u1"
        all_bits = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(np.bool_)
        return cls(
            np.split(all_bits, np.cumsum(levels)[:-1]) if levels else [],
            np.frombuffer(marks, "<u8"), np.frombuffer(counts, kind), np.frombuffer(keepers, "<i8"),
        )


# --- all shards


def _shard_of(shards: int):
    return F.pmod(F.col("a"), F.lit(shards)).cast("int").alias("shard")


def build_index(frequent: DataFrame, shards: int) -> DataFrame:
    """One row per shard that has keys, from ``frequent(a, b, n, keeper)``."""

    def of(t: pa.Table) -> pa.Table:
        a, b, n, keeper = (t.column(c).to_numpy() for c in ("a", "b", "n", "keeper"))
        made = Shard.of(a.view(np.uint64), b.view(np.uint64), n, keeper)
        values = [t.column("shard")[0].as_py(), *made.row()]
        kinds = [pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in _SHARD.split(", ")])

    return frequent.select(_shard_of(shards), "a", "b", "n", "keeper").groupBy("shard").applyInArrow(of, _SHARD)


def probed(keys: DataFrame, index: DataFrame, shards: int, least: int) -> DataFrame:
    """``doc_id, a, b`` of the lines of ``keys`` that the arrays of ``index`` tell to drop.

    A shard's row comes first, its lines stream past it: a task holds one shard and one batch of lines.
    """
    empty = {c.split()[0]: c.split()[1] for c in _SHARD.split(", ")[1:]}
    lines = keys.select(_shard_of(shards), F.lit(1).alias("kind"), "doc_id", "a", "b", *[F.lit(None).cast(k).alias(c) for c, k in empty.items()])
    heads = index.select("shard", F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("doc_id", "a", "b")], *empty)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = None, None
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if kind[lo] == 0:
                    number, now = shard[lo], Shard.read(*[batch.column(c)[lo].as_py() for c in range(5, 10)])
                elif number == shard[lo]:
                    part = batch.slice(lo, hi - lo)
                    doc, a, b = (part.column(c).to_numpy() for c in (2, 3, 4))
                    n, keeper = now.probe(a.view(np.uint64), b.view(np.uint64))
                    gone = (n >= least) & (keeper != doc)
                    yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (doc, a, b)], ["doc_id", "a", "b"])

    together = heads.select(lines.columns).unionByName(lines).repartition("shard").sortWithinPartitions("shard", "kind")
    return together.mapInArrow(of, "doc_id long, a long, b long")


def deduplicate_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, shard_lines: int = SHARD_LINES) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: every document without the lines that many documents share.

    A line's key is the line without white space at its ends and with A-Z in lower case. A key of ``least_chars`` code
    points or more that ``least_docs`` documents or more hold loses all its lines but those of the largest such doc_id.
    The other lines stay as they are. Keys are 128-bit digests: counted with map-side sums, those of enough documents
    become a sharded minimal perfect hash whose arrays hold mark, count and keeper; every document's keys are sent to
    their shards and looked up there. A key with more than a ``HOT``-th of all lines is answered from a table of at most
    ``HOT`` rows instead, so that it does not crowd one shard.

    A null or empty text is one empty line. A repeated doc_id is one document and a row without one is left out
    (``documents``); an empty table gives an empty result; other columns are ignored.
    """
    docs = documents(docs)
    keys = written(line_keys(docs, least_chars), "line-keys")
    lines = keys.count()
    counted = keys.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    frequent = written(counted.filter(F.col("n") >= least_docs), "frequent-lines")
    common = F.col("n") * HOT > lines
    hot = F.broadcast(frequent.filter(common).select("a", "b", "keeper"))  # at most HOT rows: their counts sum up to no more than all lines
    shards = -(-lines // shard_lines) or 1
    index = written(build_index(frequent.filter(~common), shards), "line-index")
    at_once = keys.join(hot, ["a", "b"]).filter("doc_id <> keeper").select("doc_id", "a", "b")
    gone = at_once.unionByName(probed(keys.join(hot, ["a", "b"], "left_anti"), index, shards, least_docs))
    per_doc = gone.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("gone"))  # no more than the document's own lines

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t, drop in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                every = (t or b"").split(b"\n")
                kept = every
                if drop:
                    digests = {(d["a"], d["b"]) for d in drop}
                    kept = [x for x in every if not (_long_enough(k := line_key(x), least_chars) and _digest(k) in digests)]
                rows.append((len(every), len(every) - len(kept), b"\n".join(kept)))
            n, dropped, text = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())],
                ["doc_id", "n_lines", "n_dropped", "text"],
            )

    return docs.join(per_doc, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(of, "doc_id long, n_lines long, n_dropped long, text string")
