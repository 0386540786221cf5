import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import corpus
from tokenizers import Tokenizer

from lagwise.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> a<|startoftext|>b <| x", "don't I'LL 's É é ́x ǅ İ Σας ΣΑΣ", "a b c\x1cd\x85e", "x​　y 12³ ½ ﬁ <|endoftext|><|endoftext|>", "\U0001f600‍漢字 ⅷ_a_b"]


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_every_token_has_one_place(spark, capacity):
    docs = corpus(6) + [(500 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, length string, rank int").repartition(4)
    rows = packing.pack(df, PATH, capacity, with_ids=True).collect()
    got = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= capacity and zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id].append((r.piece, r.start, ids))
    want = defaultdict(list)
    for i, t in docs:
        ids = ids_of(t)
        want[i] += [(k, at, ids[at : at + capacity]) for k, at in enumerate(range(0, len(ids), capacity))]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // capacity) * 1.1 + 1


def test_plan_is_tight_and_uses_all():
    rng = random.Random(4)
    for capacity, lengths in ((100, [rng.randint(1, 100) for _ in range(3000)]), (50, [26] * 40 + [24] * 40 + [13] * 7), (10, [6, 5, 5, 4] * 9), (7, [7]), (9, [])):
        bins = packing.best_two_fit(Counter(lengths), capacity)
        used = Counter()
        for held, times in bins:
            assert sum(held) <= capacity and times > 0
            for x in held:
                used[x] += times
        assert used == Counter(lengths)
        assert sum(t for _, t in bins) <= -(-sum(lengths) // capacity) * 1.03 + 1


def test_two_pieces_replace_the_shortest():
    # greedy: 60 + 30 leaves a gap of 10; 25 + 15 instead of 30 fill it
    assert packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0] == ([60, 25, 15], 1)


def test_one_frequent_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    df = spark.range(500).selectExpr("id doc_id", "'a b c' text")
    rows = packing.pack(df, PATH, 16).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 500 and len({r.sequence_id for r in rows}) == 125


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
