"""Substring deduplication by compacting the de Bruijn graph of the corpus's word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import documents, written
from lagwise.llm.words import Chunk, chunks, mixed, shingle_hashes, slices, word_hashes

_BASES = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_SALT = np.uint64(0xA0761D6478BD642F)


def anchor_size(size: int) -> int:
    """Words of an anchor. A window holds at most 63 anchors, so that its places fit the bits of a long."""
    return max(1, size // 5, size - 62)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Digests:
    """Two 64-bit digests of any run of consecutive words, by prefix sums of polynomial hashes."""

    def __init__(self, x: np.ndarray):
        n = len(x) + 1
        self._sums, self._back = [], []
        for base, inverse, words in zip(_BASES, _INVERSES, (x, mixed(x ^ _SALT))):
            sums = np.zeros(n, np.uint64)
            np.cumsum(words * _powers(base, n)[:-1], out=sums[1:])
            self._sums.append(sums)
            self._back.append(_powers(inverse, n))

    def of(self, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        out = []
        for sums, back, base in zip(self._sums, self._back, _BASES):
            h = (sums[start + length] - sums[start]) * back[start] + length.astype(np.uint64) * base
            out.append(mixed(h).view(np.int64))
        return out


def _first_least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least value in each run of ``width`` values."""
    value, index, have = h, np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[:-step]
        value, index = np.where(right, value[step:], value[:-step]), np.where(right, index[step:], index[:-step])
        have += step
    return index


def _stretches(c: Chunk, size: int) -> tuple[np.ndarray, ...] | None:
    """Runs of windows with a common anchor: first window, number of windows, anchor hash, document."""
    k = anchor_size(size)
    x, of = c.hashes(), c.document_of()
    inside = c.whole(of, size)
    starts = np.flatnonzero(inside)
    if not len(starts):
        return None
    h = shingle_hashes(x, k)
    anchor = _first_least(h, size - k + 1)[: len(inside)][starts]
    new = np.ones(len(starts), np.bool_)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    begin = np.flatnonzero(new)
    lo = starts[begin]
    n = np.diff(np.append(begin, len(starts)))
    d1, d2 = _Digests(x).of(lo, n + size - 1)
    return lo, n, h[anchor[begin]].view(np.int64), d1, d2, of[lo]


def stretches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, lo, n, anchor, d1, d2``: the edges of the graph, already compacted within their documents.

    An edge of the graph is a window of ``size`` words. Its anchor is the first of its least-hashed word k-mers, a
    property of the window alone, so equal windows have equal anchors. Consecutive windows of a document with the same
    anchor are one row: ``n`` windows from word ``lo`` on, with a 128-bit digest of all their words.
    """

    def of(batches: Iterator[pa.RecordBatch]):
        for c in chunks(batches):
            if found := _stretches(c, size):
                lo, n, anchor, d1, d2, doc = found
                columns = [c.ids.take(pa.array(doc)), pa.array((lo - c.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(d1), pa.array(d2)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lo", "n", "anchor", "d1", "d2"])

    return docs.mapInArrow(of, "doc_id long, lo int, n int, anchor long, d1 long, d2 long")


def _span_digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _read_sources(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """From the source texts: a digest of each path's words, and each window of contested stretches.

    ``wanted``: doc_id and, gathered per document, the stretches (path: 1, contested: 0) that have their source there.
    """
    names = ["d1", "d2", "digest", "j", "w1", "w2", "source"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def of(batches):
        for b in slices(batches):
            for doc, text, asked in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2)):
                words = (text.as_py() or b"").split()
                digests = _Digests(word_hashes(words))
                paths, parts = [], []
                for r in asked.as_py():
                    if r["path"]:
                        paths.append((r["d1"], r["d2"], _span_digest(words[r["lo"] : r["lo"] + r["n"] + size - 1])))
                    else:
                        parts.append((r["d1"], r["d2"], r["lo"], r["n"]))
                if paths:
                    d1, d2, digest = zip(*paths)
                    none = [pa.nulls(len(d1), k) for k in kinds[3:]]
                    yield pa.RecordBatch.from_arrays([pa.array(d1, kinds[0]), pa.array(d2, kinds[1]), pa.array(digest, kinds[2]), *none], names)
                if parts:
                    d1, d2, lo, n = (np.array(x, np.int64) for x in zip(*parts))
                    j = np.concatenate([np.arange(k) for k in n])
                    w1, w2 = digests.of(np.repeat(lo, n) + j, np.full(len(j), size))
                    columns = [pa.array(np.repeat(d1, n)), pa.array(np.repeat(d2, n)), pa.nulls(len(j), kinds[2]), pa.array(j.astype(np.int32)), pa.array(w1), pa.array(w2), pa.array(np.full(len(j), doc))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    asked = docs.join(wanted, "doc_id").select("doc_id", "text", "asked")
    return asked.mapInArrow(of, "d1 long, d2 long, digest binary, j int, w1 long, w2 long, source long")


def repeated_spans(docs: DataFrame, size: int = 50) -> DataFrame:
    """``doc_id, lo, n, places, digest``: windows to remove, from word ``lo`` on, in ``docs`` with unique doc_ids.

    Either all ``n`` windows (``places`` null; ``digest`` is that of the source's words, to be verified), or those
    whose bit is set in ``places``.

    1. Stretches whose anchor is in one document only repeat nothing and go. Equal stretches are one node, with its
       source, the least (doc_id, place) where it stands.
    2. Neighbouring nodes that always stand next to each other (the exclusive or of all their places agrees) and
       share a source lie on a nonbranching path. Paths keep their first node; a Spark join of first nodes with the
       stretches finds every place of a whole path.
    3. Where one anchor has different nodes, texts branch. Only these nodes' windows are compared one by one.
    """
    found = written(stretches(docs, size), "stretches")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    found = written(found.join(written(shared, "anchors"), "anchor"), "shared-stretches")  # a plain join: Spark can split a hot anchor

    place = F.xxhash64("doc_id", "lo")
    behind = F.xxhash64("doc_id", F.col("lo") + F.col("n"))
    nodes = written(
        found.groupBy("anchor", "d1", "d2", "n")
        .agg(F.min(F.struct("doc_id", "lo")).alias("s"), F.max("doc_id").alias("last"), F.bit_xor(place).alias("at"), F.bit_xor(behind).alias("then"))
        .select("anchor", "d1", "d2", "n", F.col("s.doc_id").alias("source"), "s.lo", "last", "at", "then"),
        "nodes",
    )
    along = Window.partitionBy("source").orderBy("lo")  # nodes that have their source in one document
    joined = (F.lag("then").over(along) == F.col("at")) & (F.lag(F.col("lo") + F.col("n")).over(along) == F.col("lo"))
    headed = nodes.filter("source < last").withColumn("head", F.when(joined, None).otherwise(F.col("lo")))
    headed = headed.withColumn("head", F.last("head", ignorenulls=True).over(along))
    first = F.min(F.struct("lo", "d1", "d2")).alias("f")
    paths = headed.groupBy("source", "head").agg(F.sum("n").cast("int").alias("n"), first).select("source", F.col("head").alias("lo"), "n", "f.d1", "f.d2")
    branching = nodes.groupBy("anchor").count().filter("count > 1").select("anchor")
    contested = nodes.join(branching, "anchor").select("source", "lo", "n", "d1", "d2")
    asked = paths.withColumn("path", F.lit(1)).unionByName(contested.withColumn("path", F.lit(0)))
    wanted = asked.groupBy(F.col("source").alias("doc_id")).agg(F.collect_list(F.struct("path", "lo", "n", "d1", "d2")).alias("asked"))
    read = written(_read_sources(docs, wanted, size), "sources")

    windows = read.filter("w1 IS NOT NULL")
    least = windows.groupBy("w1", "w2").agg(F.min("source").alias("least"))
    earlier = windows.join(least, ["w1", "w2"]).filter("least < source")
    places = earlier.groupBy("d1", "d2").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("places"))
    whole = paths.select("d1", "d2", "source", F.col("n").alias("windows")).join(read.filter("digest IS NOT NULL").select("d1", "d2", "digest"), ["d1", "d2"])
    marks = whole.select("d1", "d2", "source", "windows", "digest", F.lit(None).cast("long").alias("places")).unionByName(
        places.join(nodes.select("d1", "d2", "source"), ["d1", "d2"]).select("d1", "d2", "source", F.lit(None).cast("int").alias("windows"), F.lit(None).cast("binary").alias("digest"), "places")
    )
    at = found.select("doc_id", "lo", "d1", "d2", F.col("n").alias("own")).join(marks, ["d1", "d2"])
    at = at.filter(F.when(F.col("places").isNull(), F.col("doc_id") > F.col("source")).otherwise(F.col("doc_id") == F.col("source")))
    return at.select("doc_id", "lo", F.coalesce("windows", "own").alias("n"), "places", "digest")


def _gone(words: list[bytes], spans: list[dict], size: int) -> np.ndarray:
    """For each word, whether a span covers it; a whole span only counts if its words are those of its source."""
    edges = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        if s["places"] is not None:
            at = [s["lo"] + j for j in range(s["n"]) if s["places"] >> j & 1]
            np.add.at(edges, at, 1)
            np.add.at(edges, [a + size for a in at], -1)
        elif _span_digest(words[s["lo"] : s["lo"] + s["n"] + size - 1]) == s["digest"]:
            edges[s["lo"]] += 1
            edges[s["lo"] + s["n"] + size - 1] -= 1
    return np.cumsum(edges[:-1]) > 0


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that are gone; each goes with the white space behind it."""
    out, at, bounds = [], 0, []
    for w in text.split():
        at = text.index(w, at)
        bounds.append(at)
        at += len(w)
    bounds.append(len(text))
    out.append(text[: bounds[0]])
    out += [text[a:b] for a, b, g in zip(bounds, bounds[1:], gone.tolist()) if not g]
    return b"".join(out)


def deduplicate(docs: DataFrame, size: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for every document.

    A word goes if a window of ``size`` consecutive words covers it whose words also start, in that order, in a
    document with a smaller doc_id; all windows are judged on the input. ``kept_sha256`` is that of the kept words
    joined by blanks; ``kept_text`` is the text with the words cut out where they stand, null only for null.

    Words are split at ASCII white space and compared byte by byte. Null and empty texts, and texts of fewer than
    ``size`` words, lose nothing, and a window that only repeats inside its own document stays. A repeated doc_id is
    one document, a row without one is left out (``documents``); empty tables and further columns do no harm.
    """
    docs = documents(docs)
    spans = repeated_spans(docs, size).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n", "places", "digest")).alias("spans"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def of(batches):
        for b in slices(batches):
            rows = []
            for doc, text, cut in zip(b.column(0), b.column(1).cast(pa.binary()), b.column(2)):
                text, cut = text.as_py(), cut.as_py()
                words = (text or b"").split()
                kept, left = words, text
                if cut:
                    gone = _gone(words, cut, size)
                    kept, left = [w for w, g in zip(words, gone.tolist()) if not g], _without(text, gone)
                sha = hashlib.sha256(b" ".join(kept)).hexdigest()
                rows.append((doc.as_py(), len(words), len(words) - len(kept), sha, None if left is None else left.decode()))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(of, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def cut_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text`` (and ``n_chars``, if there, counted anew).

    A document of which nothing is left goes; one that had no words before stays. A repeated doc_id is one document
    here too: all its rows get that document's kept text. Rows without a doc_id stay as they are.
    """
    kept = deduplicate(docs, size).filter("n_removed > 0").select("doc_id", F.col("kept_text").alias("__kept"), (F.col("n_removed") == F.col("n_words")).alias("__all"))
    out = docs.join(kept, "doc_id", "left").filter("__all IS NULL OR NOT __all")
    text = F.coalesce("__kept", "text")
    columns = {"text": text} | ({"n_chars": F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("__kept"))} if "n_chars" in docs.columns else {})
    return out.withColumns(columns).select(*docs.columns)
