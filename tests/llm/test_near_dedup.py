import random
from itertools import combinations

import pytest
from brute import corpus, fingerprint, near_groups

from lagwise.llm import near_dedup
from lagwise.llm.components import connected_components

KIND = "doc_id long, text string"


def test_same_as_brute_force(spark):
    docs = corpus(3)
    got = {r.doc_id: (r.fingerprint % (1 << 64), r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, KIND)).collect()}
    prints = {i: fingerprint(t) for i, t in docs}
    groups = near_groups(prints)
    assert got == {i: (prints[i], groups[i]) for i in prints}


@pytest.mark.parametrize("long_list", [1024, 3])
@pytest.mark.parametrize("distance", [3, 4])
def test_links_of_crowded_fingerprints(spark, long_list, distance):
    """Dense balls around a few centres and chains; short and long posting lists give the same components."""
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        prints |= {c} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))) for _ in range(25)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    found = near_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance, long_list)
    at = {p: i for i, p in enumerate(signed)}
    pairs = [(at[r.a], at[r.b]) for r in found.collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= distance for a, b in pairs)
    if long_list > 100:
        want = {(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= distance}
        assert {tuple(sorted(p)) for p in pairs} == want and len(pairs) == len(want)
    rows = connected_components(spark.createDataFrame(pairs or [(0, 0)], "u long, v long")).collect()
    got = {i: i for i in range(len(prints))} | {r.node: r.component for r in rows}
    assert got == near_groups(dict(enumerate(prints)), distance)


def test_every_four_positions_hold_a_set():
    sets = near_dedup.position_sets(4)
    assert len(sets) == 20
    assert all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 200)]
    random.Random(1).shuffle(links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_repeated_null_and_further_columns(spark):
    rows = [(5, "same text here now", "x", 1), (5, "same text here now", "y", 2), (None, "lost", "z", 3), (2, "same text here now", None, None), (7, None, "q", 1), (8, "", "q", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, count long")
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(2, 2), (5, 2), (7, 7), (8, 7)]
    kept = near_dedup.keep_one_per_group(df)
    assert sorted(kept.columns) == sorted(df.columns)
    assert sorted(r.text or "-" for r in kept.collect()) == ["-", "lost", "same text here now"]


def test_empty_table(spark):
    df = spark.createDataFrame([], KIND)
    assert near_dedup.near_duplicates(df).collect() == []
    assert near_dedup.keep_one_per_group(df).collect() == []


def test_chunks_cut_batches_into_whole_rows():
    import pyarrow as pa

    from lagwise.llm.words import chunks

    texts = ["a b", None, "", "c " * 50, "d", "e f g", "h" * 300, "i"]
    b = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts), pa.array(list("pqrstuvw"))], ["doc_id", "text", "k"])
    for limit in (1, 5, 120, 10_000):
        parts = list(chunks([b.slice(0, 3), b.slice(3)], limit=limit))
        assert [i for c in parts for i in c.ids.to_pylist()] == list(range(8))
        assert [k for c in parts for k in c.rest[0].to_pylist()] == list("pqrstuvw")
        assert [c.words[x:y] for c in parts for x, y in zip(c.first, c.first[1:])] == [(t or "").encode().split() for t in texts]
