import random

import pytest
from brute import corpus, prose, repeated_windows, sha, split

from lagwise.llm import substring_dedup

KIND = "doc_id long, text string"


def expected(docs, size):
    out = {}
    for i, gone in repeated_windows(docs, size).items():
        w = split(dict(docs)[i])
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("size, seed", [(50, 1), (7, 2)])
def test_same_as_brute_force(spark, size, seed):
    docs = corpus(seed, 120)
    got = result(substring_dedup.deduplicate(spark.createDataFrame(docs, KIND).repartition(5), size))
    want = expected(docs, size)
    assert got == want
    assert sum(v[1] for v in want.values()) > 1000


def test_many_variants_of_one_passage(spark):
    """Near copies, pieces and different continuations of one text: branching paths of every kind."""
    rng = random.Random(8)
    base = prose(rng, 400).split()
    docs = []
    for i in range(80):
        a, b = sorted(rng.sample(range(len(base)), 2))
        words = base[a:b] + (base[: rng.randint(0, 120)] if i % 3 else [])
        for _ in range(i % 4):
            if words:
                words[rng.randrange(len(words))] = f"new{i}"
        docs.append((i * 7 % 80, " ".join(words)))
    docs += [(200, "x " * 500), (201, "x " * 300), (202, "x y " * 200)]
    for size in (50, 12):
        assert result(substring_dedup.deduplicate(spark.createDataFrame(docs, KIND).repartition(3), size)) == expected(docs, size)


def test_stage_cuts_text_and_keeps_the_rest(spark):
    rng = random.Random(2)
    passage, own = prose(rng, 60), [prose(rng, 30) for _ in range(4)]
    rows = [(1, f"{own[0]}\n{passage}", "a", 3), (2, f"{own[1]}\n {passage}\t{own[2]}", "b", 3), (3, passage, "c", 3), (4, None, "d", 0), (5, "", "e", 0), (None, passage, "f", 1), (6, own[3], None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    got = {r.doc_id: r for r in substring_dedup.cut_repeats(df).collect()}
    assert set(got) == {1, 2, 4, 5, 6, None} and list(df.columns) == list(got[1].__fields__)
    assert got[2].text == f"{own[1]}\n {own[2]}" and got[2].n_chars == len(got[2].text)
    assert got[1].text == rows[0][1] and got[4].text is None and got[5].text == "" and got[None].text == passage


def test_repeated_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 1), (1, text, 2), (2, text, 3)], "doc_id long, text string, n int")
    assert result(substring_dedup.deduplicate(df)) == expected([(1, text), (2, text)], 50)
    assert result(substring_dedup.deduplicate(df.limit(0))) == {}
