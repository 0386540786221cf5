import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from brute import contamination, corpus, fingerprint, near_groups, prose, repeated_windows, split
from tokenizers import Tokenizer

from lagwise.llm import quality_rules, substring_dedup

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def base_failed(text):
    w = split(text)
    tri = defaultdict(int)
    for t in zip(w, w[1:], w[2:]):
        tri[t] += 1
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w) < quality_rules.LEAST_WORDS or 100 * len(hit) > quality_rules.MOST_REPEATED * len(w)


def test_all_stages_like_plain_versions(spark, tmp_path):
    rng = random.Random(21)
    docs = corpus(21, 150)
    items = [(i, prose(rng, 25)) for i in range(5)]
    docs += [(400 + i, f"{prose(rng, 90)} {items[i % 5][1]} {prose(rng, 20)}") for i in range(8)]
    docs += [(500 + i, docs[3][1] + " " + docs[9][1]) for i in range(2)] + [(500 + 2, docs[3][1])]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], KIND).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in docs[::3]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    left = [(i, t) for i, t in docs if not base_failed(t)]
    groups = near_groups({i: fingerprint(t) for i, t in left})
    left = [(i, t) for i, t in left if groups[i] == i]
    gone = repeated_windows(left)
    assert any(any(g) for g in gone.values())
    left = [(i, substring_dedup._without(t.encode(), np.array(gone[i])).decode()) for i, t in left if not gone[i] or not all(gone[i])]
    hit = contamination(left, items)
    assert sum(v[4] for v in hit.values()) >= 5
    left = [(i, t) for i, t in left if not hit[i][4]]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in left:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want += [(i, at // 2048, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for at in range(0, len(ids), 2048)]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_take_awkward_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    long = " ".join(f"w{i}x" for i in range(70))
    rows = [(None, long, None, None, None, 1), (1, None, "en", "s", 0, 2), (2, "", None, None, 0, 3), (3, long, "en", "s", 9, 4), (3, long, "en", "s", 9, 5), (4, long + " more", "en", "s", 9, 6)]
    df = spark.createDataFrame(rows, KIND + ", spans int")
    spark.createDataFrame([(1, 1), (None, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "w1x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for source in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, source, folder)
            got = out.collect()
            assert name == "best_fit_packing" or out.columns == df.columns
            assert len(got) <= len(rows) and bool(got) == bool(source.count())


def test_every_row_of_a_repeated_or_missing_id_counts(spark, tmp_path):
    rng, folder = random.Random(8), str(tmp_path)
    a, b, c, d, copy, item = (prose(rng, 80) for _ in range(6))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    def left(stage, *rows):
        df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], KIND).repartition(3)
        out = dict(corpus_pipeline.STAGES)[stage](spark, df, folder)
        assert out.dtypes == df.dtypes
        return sorted(((r.doc_id, r.text.strip()) for r in out.collect()), key=str)

    def rows(*want):
        return sorted(want, key=str)

    for x, y in ((a, b), (b, a)):  # either may have the lesser text or digest
        assert left("benchmark_decontamination", (1, x), (1, f"{y} {item}"), (None, f"{c} {item}"), (None, d)) == rows((1, x), (None, d))
        assert left("simhash_near_dedup", (0, copy), (1, x), (1, copy), (1, y), (None, copy), (None, d)) == rows((0, copy), (1, x), (1, y), (None, d))
        assert left("substring_dedup", (0, copy), (1, f"{x} {copy}"), (1, f"{y} {copy}"), (None, f"{c} {copy}"), (None, copy), (None, d)) == rows(
            (0, copy), (1, x), (1, y), (None, c), (None, d)
        )
    assert left("simhash_near_dedup", (1, a), (1, a), (None, b), (None, b)) == rows((1, a), (None, b))
