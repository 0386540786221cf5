"""Benchmark decontamination as a prefix-filtered set join over item-sized windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import documents, written
from lagwise.llm.words import chunks, plain_words, shingle_hashes, word_hashes

SHINGLE = 5
#: Bits of the filter that tasks hold: 512 kB whatever the benchmark's size.
FILTER_BITS = 22


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """``item_id, window`` (words joined by blanks) of ``items(item_id, text)``, repeats included.

    A window is ``size`` consecutive words; an item of fewer words, but not none, is one window.
    """

    def of(batches):
        for b in batches:
            ids, found = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = plain_words(text or b"")
                for at in range(max(1, len(words) - size + 1) if words else 0):
                    ids.append(i)
                    found.append(b" ".join(words[at : at + size]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], ["item_id", "window"])

    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).filter("item_id IS NOT NULL").mapInArrow(of, "item_id string, window string")


def _window_shingles(windows: DataFrame) -> DataFrame:
    """``window, n, size, offset, hash``: the shingles of each window, of five words or all of a shorter window."""

    def of(batches):
        for b in batches:
            rows = []
            for window in b.column(0).to_pylist():
                words = window.encode().split(b" ")
                size = min(SHINGLE, len(words))
                for offset, h in enumerate(shingle_hashes(word_hashes(words), size).view(np.int64).tolist()):
                    rows.append((window, len(words), size, offset, h))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["window", "n", "size", "offset", "hash"])

    return windows.mapInArrow(of, "window string, n int, size int, offset int, hash long")


def _filter(hashes: DataFrame) -> tuple[list[int], np.ndarray]:
    """Shingle sizes and a bit table of fixed size that says which hashes may be wanted."""
    sizes = [r[0] for r in hashes.select("size").distinct().collect()]  # at most SHINGLE numbers
    bits = np.zeros(1 << FILTER_BITS, np.bool_)
    slots = hashes.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).cast("int").alias("s")).distinct()
    for s in slots.toLocalIterator():  # at most one number per bit
        bits[s[0]] = True
    return sorted(sizes), np.packbits(bits)


def _hits(chunk, sizes, table, x, of):
    """Of each shingle size: positions of the chunk whose shingle passes the filter, and their hashes."""
    bits = np.unpackbits(table).view(np.bool_)
    for size in sizes:
        h = shingle_hashes(x, size)
        at = np.flatnonzero(bits[(h >> np.uint64(64 - FILTER_BITS)).view(np.int64)] & chunk.whole(of, size))
        yield size, at, h[at].view(np.int64)


def _counts(docs: DataFrame, wanted) -> DataFrame:
    """How often shingles that pass the filter occur in all documents, summed in each task first."""

    def of(batches):
        for c in chunks(batches, plain_words):
            found = [h for _, _, h in _hits(c, wanted.value[0], wanted.value[1], c.hashes(), c.document_of())]
            hashes, n = np.unique(np.concatenate(found or [np.empty(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n, pa.int64())], ["hash", "n"])

    return docs.mapInArrow(of, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("seen"))


def _candidates(docs: DataFrame, wanted, size: int) -> DataFrame:
    """A row per document (``n_words``), and one per position whose shingle may be a prefix token, with words around."""
    names = ["doc_id", "n_words", "pos", "hash", "around", "around_at"]

    def of(batches):
        for c in chunks(batches, plain_words):
            n_words = np.diff(c.first)
            yield pa.RecordBatch.from_arrays(
                [c.ids, pa.array(n_words, pa.int64())] + [pa.nulls(len(c.ids), k) for k in (pa.int64(), pa.int64(), pa.string(), pa.int64())], names
            )
            doc = c.document_of()
            for _, at, h in _hits(c, wanted.value[0], wanted.value[1], c.hashes(), doc):
                for k in range(0, len(at), 20_000):
                    part = at[k : k + 20_000]
                    first, last = c.first[doc[part]], c.first[doc[part] + 1]
                    lo, hi = np.maximum(first, part - size), np.minimum(last, part + size)
                    around = [b" ".join(c.words[a:b]).decode() for a, b in zip(lo.tolist(), hi.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [c.ids.take(pa.array(doc[part])), pa.array(n_words[doc[part]], pa.int64()), pa.array(part - first, pa.int64()), pa.array(h[k : k + 20_000]), pa.array(around, pa.string()), pa.array(lo - first, pa.int64())], names
                    )

    return docs.mapInArrow(of, "doc_id long, n_words long, pos long, hash long, around string, around_at long")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document.

    A window is ``size`` consecutive words of an item (a shorter item is one window); a word of a document inside any
    occurrence of a window is hit. All words of a window must stand there in order, so its necessary prefix is one
    token: its rarest five-word shingle, by counts over all documents. Documents are joined on that token alone. Then
    come the positional and length bounds (the window must start at the token's place less its offset, and end inside
    the document) and the comparison of all its words.

    Tasks hold a bit table of fixed size, whatever the benchmark's size; more items only let more rows through to the
    join. Null or empty texts have no words (an item without words has no window, a document without words no hit);
    items without an id are left out; repeated items are one; a repeated doc_id is one document and a row without one
    is left out (``documents``); empty tables and further columns do no harm.
    """
    spark = docs.sparkSession
    docs = documents(docs)
    windows = written(item_windows(items, size).distinct(), "windows")
    tokens = written(_window_shingles(windows.select("window").distinct()), "tokens")
    seen = written(_counts(docs, spark.sparkContext.broadcast(_filter(tokens))), "seen")
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "hash", "size")).alias("t")
    prefix = written(tokens.join(seen, "hash", "left").groupBy("window", "n").agg(rarest).select("window", "n", "t.offset", "t.hash", "t.size"), "prefix")
    found = written(_candidates(docs, spark.sparkContext.broadcast(_filter(prefix)), size), "candidates")

    start = F.col("pos") - F.col("offset")
    words = F.slice(F.split("around", " "), (start - F.col("around_at") + 1).cast("int"), F.col("n"))
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    at_windows = found.filter("pos IS NOT NULL").join(prefix, "hash").filter(inside)
    occurrences = written(at_windows.filter(F.array_join(words, " ") == F.col("window")).select("doc_id", "window", "n", start.alias("start")), "occurrences")

    in_order = Window.partitionBy("doc_id").orderBy("start", "n")  # one document's own positions
    before = F.max(F.col("start") + F.col("n")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, F.lit(0))))
    hit = occurrences.select("doc_id", "start", "n").distinct().withColumn("fresh", fresh).groupBy("doc_id").agg(F.sum("fresh").alias("n_hit"))
    named = occurrences.select("doc_id", "window").distinct().join(windows, "window").groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    return (
        found.filter("pos IS NULL").select("doc_id", "n_words").join(hit, "doc_id", "left").join(named, "doc_id", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` (all its columns) in whose text no window of an item occurs; rows without a doc_id stay."""
    return docs.join(contamination(docs, items, size).filter("contaminated").select("doc_id"), "doc_id", "left_anti")
