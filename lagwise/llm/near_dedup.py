"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import documents, written
from lagwise.llm.components import connected_components

SEED = 42
BYTES = 8
#: A posting list up to this length is joined with itself; a longer one is linked through midpoints.
LONG_LIST = 1024


def _fingerprint(text: bytes, size: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(size, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), "<u8", len(starts))
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, BYTES)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """``doc_id, fingerprint`` (long, the 64 bits) of the ``size``-word shingles of each whole text.

    A text of fewer words is one shingle; no words, or null, gives zero.
    """

    def of(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            found = [_fingerprint(t.as_py() or b"", size) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, fingerprint long")


def position_sets(shared: int) -> list[tuple[int, ...]]:
    """Sets of ``shared - 1`` byte positions such that any ``shared`` of the eight positions contain one of the sets.

    For four shared bytes this is Turan's construction over three groups of positions: 20 sets of three. Otherwise all
    sets of that size.
    """
    if shared != 4:
        return list(combinations(range(BYTES), max(1, shared - 1)))
    groups = [range(0, 3), range(3, 6), range(6, 8)]
    sets = {c for g in groups for c in combinations(g, 3)}
    for g, h in zip(groups, groups[1:] + groups[:1]):
        sets |= {tuple(sorted((*two, one))) for two in combinations(g, 2) for one in h}
    return sorted(sets)


def _mask(positions) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def _shared_bytes(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share: the tally of their common posting lists."""
    same = [F.when((a.bitwiseXOR(b)).bitwiseAND(F.lit(_mask([p]))) == 0, 1).otherwise(0) for p in range(BYTES)]
    return sum(same[1:], same[0])


def links(prints: DataFrame, distance: int = 4, long_list: int = LONG_LIST) -> DataFrame:
    """Links between distinct fingerprints ``fp`` at ``distance`` or fewer differing bits, as ``(a, b)``.

    At most ``distance`` of the eight bytes differ, so linked fingerprints share at least ``8 - distance`` positional
    bytes. One byte's posting list holds 1/256 of all rows, so lists are those of several positions at once: any pair
    with the guaranteed number of matches meets in one of ``position_sets``. Pairs that meet are tallied over all eight
    positions, kept from the guaranteed minimum on, at the first list they share, and verified bit by bit. In a list
    longer than ``long_list`` no pairs are formed: members link to the least member within half the distance of a common
    midpoint, which reaches every pair of the list within ``distance`` through at most one other member, so components
    are the same; its rows grow with the list, not with its square.
    """
    spark = prints.sparkSession
    least = BYTES - distance
    sets = position_sets(least)
    entries = F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("k")) for i, c in enumerate(sets)])
    index = prints.select("fp", F.explode(entries).alias("e")).select("fp", "e.s", "e.k")
    long_lists = written(index.groupBy("s", "k").count().filter(F.col("count") > long_list).select("s", "k"), "long-lists")
    crowded = not long_lists.isEmpty()
    short = index.join(long_lists, ["s", "k"], "left_anti") if crowded else index
    a, b = short.alias("a"), short.alias("b")
    x, y = F.col("a.fp"), F.col("b.fp")
    differ = x.bitwiseXOR(y)
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(_mask(c))) == 0, F.lit(i)) for i, c in enumerate(sets)])
    pairs = a.join(
        b,
        (F.col("a.s") == F.col("b.s")) & (F.col("a.k") == F.col("b.k")) & (x < y)
        & (_shared_bytes(x, y) >= least) & (F.bit_count(differ) <= distance) & ((first == F.col("a.s")) | F.lit(crowded)),
    ).select(x.alias("a"), y.alias("b"))
    if not crowded:
        return pairs
    half = distance // 2
    rows = []
    for i, c in enumerate(sets):
        free = [p for p in range(64) if p // 8 not in c]
        for n in range(half + distance % 2 + 1):
            rows += [(i, n, sum(1 << p for p in ones)) for ones in combinations(free, n)]
    table = spark.createDataFrame([(i, n, m - (1 << 64) if m >= 1 << 63 else m) for i, n, m in rows], "s int, n int, mask long")
    # the left half of an odd distance is one bit longer: both halves are tried from either end
    around = index.join(long_lists, ["s", "k"]).join(F.broadcast(table), "s").select("s", "k", "fp", "n", F.col("fp").bitwiseXOR(F.col("mask")).alias("mid"))
    near = around.filter(F.col("n") <= half)
    centre = near.groupBy("s", "k", "mid").agg(F.min("fp").alias("a"))
    reached = around.join(centre, ["s", "k", "mid"]).filter((F.col("a") != F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance))
    return pairs.unionByName(reached.select("a", F.col("fp").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, size: int = 4, long_list: int = LONG_LIST) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document of ``docs(doc_id, text)``.

    component_id is the least doc_id reachable over links, the document itself included. Documents with the same
    fingerprint are one node, so copies are never expanded into pairs. Null and empty texts have fingerprint zero and
    link like any other; a repeated doc_id is one document and a row without one is left out (``documents``); an empty
    table gives an empty result; other columns are ignored.
    """
    prints = written(fingerprints(documents(docs), size), "fingerprints")
    nodes = written(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("rep")), "nodes")
    found = written(links(nodes, distance, long_list), "pairs")
    by_a = nodes.select(F.col("fp").alias("a"), F.col("rep").alias("u"))
    by_b = nodes.select(F.col("fp").alias("b"), F.col("rep").alias("v"))
    groups = connected_components(found.join(by_a, "a").join(by_b, "b").select("u", "v"))
    of_print = nodes.join(groups, nodes.rep == groups.node, "left").select(
        F.col("fp").alias("fingerprint"), F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(of_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one_per_group(docs: DataFrame, distance: int = 4, size: int = 4) -> DataFrame:
    """The rows of ``docs`` (all its columns) whose doc_id is the least of its near-duplicate group.

    Rows that repeat a kept doc_id stay as they are, and so do rows without a doc_id: nothing shows them to be copies.
    """
    dropped = near_duplicates(docs, distance, size).filter("doc_id <> component_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti")
