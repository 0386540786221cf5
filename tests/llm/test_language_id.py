import math
import random

import numpy as np
import public_tokenizers
import pytest

from lagwise.llm import language_id

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(word, number, p, unknown):
    """Probability and piece uses by trying every cut."""
    if not word:
        return 1.0, {}
    total, uses = 0.0, {}
    for n in range(1, min(len(word), language_id.LONGEST) + 1):
        i = number.get(word[:n])
        here = p[i] if i is not None else 0.0
        if n == 1:
            here = max(here, unknown)
        if not here:
            continue
        rest, inner = all_segmentations(word[n:], number, p, unknown)
        total += here * rest
        for k, v in inner.items():
            uses[k] = uses.get(k, 0) + here * v
        uses[i] = uses.get(i, 0) + here * rest
    return total, uses


@pytest.fixture(scope="module")
def pieces():
    return language_id.Pieces(VOCABULARY)


WORDS = ["▁the", "▁thering", "▁über", "▁", "▁\U0001f600x", "▁ñandú", "▁a", "▁hippopotamus", "▁aaaaaaa"]


def test_forward_sum_over_all_segmentations(pieces):
    rng = np.random.default_rng(1)
    n = len(pieces.pieces)
    p = np.vstack([rng.random((n, 2)) / n, np.zeros((1, 2))])
    number = {x: i for i, x in enumerate(pieces.pieces)}
    got = language_id.word_scores(pieces, WORDS, p)
    for w, row in zip(WORDS, got):
        for lang in range(2):
            assert math.isclose(row[lang], math.log(all_segmentations(w, number, p[:, lang], language_id.UNKNOWN)[0]), rel_tol=1e-9)


def test_expected_uses(pieces):
    rng = np.random.default_rng(2)
    n = len(pieces.pieces)
    prior = np.append(rng.random(n) / n, 0)
    number = {x: i for i, x in enumerate(pieces.pieces)}
    weights = rng.integers(0, 4, (len(WORDS), 2)).astype(float)
    want = np.zeros((n + 1, 2))
    for w, ws in zip(WORDS, weights):
        total, uses = all_segmentations(w, number, prior, language_id.UNKNOWN)
        for i, v in uses.items():
            want[n if i is None else i] += ws * v / total
    assert np.allclose(language_id.expected_counts(pieces, WORDS, weights, prior), want, rtol=1e-6, atol=1e-12)


def test_no_piece_of_the_vocabulary_is_left_out(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    left_out = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    whole = {model.id_to_piece(i) for i in range(model.vocab_size()) if not any(f(i) for f in left_out)}
    assert set(pieces.pieces) == whole and {"▁government", "▁different", "▁University"} <= whole
    rng = np.random.default_rng(3)
    p = np.append(rng.random(len(whole)), 0)
    p /= p.sum()
    chance = dict(zip(pieces.pieces, p))
    words = ["▁government", "▁differently", "▁functions", max(whole, key=len) + "s"]

    def sums(word):
        out = [1.0]
        for end in range(1, len(word) + 1):
            out.append(sum(out[at] * max(chance.get(word[at:end], 0), language_id.UNKNOWN * (end - at == 1)) for at in range(end)))
        return out

    got = language_id.word_scores(pieces, words, p[:, None])[:, 0]
    uses = language_id.expected_counts(pieces, words, np.eye(len(words)), p)
    for k, w in enumerate(words):
        ahead, behind = sums(w), [1.0] * (len(w) + 1)
        for at in range(len(w) - 1, -1, -1):
            behind[at] = sum(max(chance.get(w[at:end], 0), language_id.UNKNOWN * (end - at == 1)) * behind[end] for end in range(at + 1, len(w) + 1))
        assert math.isclose(got[k], math.log(ahead[-1]), rel_tol=1e-9)
        spans = [(w[at:end], ahead[at] * chance[w[at:end]] * behind[end] / ahead[-1]) for at in range(len(w)) for end in range(at + 1, len(w) + 1) if w[at:end] in chance]
        for piece in {x for x, _ in spans}:
            assert math.isclose(uses[pieces.pieces.index(piece), k], sum(v for x, v in spans if x == piece), rel_tol=1e-6, abs_tol=1e-12)
        assert any(len(x) > 8 for x, _ in spans)


def test_very_long_word(pieces):
    p = np.full((len(pieces.pieces) + 1, 1), 1 / len(pieces.pieces))
    p[-1] = 0
    one, two = language_id.word_scores(pieces, ["▁" + "the" * 2000, "▁" + "the" * 4000], p)[:, 0]
    assert np.isfinite([one, two]).all() and 1.9 < two / one < 2.1
    uses = language_id.expected_counts(pieces, ["▁" + "the" * 400], np.ones((1, 1)), p[:, 0])[:, 0]
    assert np.isclose((uses[:-1] * [len(x) for x in pieces.pieces]).sum() + uses[-1], 1201)


def test_held_out_accuracy_and_awkward_rows(spark):
    rng = random.Random(4)
    make = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ung", "ein", "tz"], "zz": ["ção", "ñe", "lla", "que"]}
    rows = [(i, " ".join("".join(rng.choices(make[g], k=rng.randint(1, 4))) for _ in range(12)), g, "s", 0.5) for i in range(400) for g in [rng.choice(list(make))]]
    rows += [(900, None, "xx", "s", 0.0), (901, "", "xx", "s", 0.0), (902, "123 !!", "yy", "s", 0.0), (903, "kalo", None, None, 0.0), (None, "schung ein", "yy", "s", 0.0), (903, "kalo", None, None, 0.0), (904, "x " * 3000 + "y" * 5000, "xx", "s", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    got = language_id.identify(df, VOCABULARY).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == g for i, _, g, *_ in rows[:400])
    assert [(by[i].lang_pred, by[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[903].lang_pred == "xx" and by[None].lang_pred == "yy" and 0 <= by[904].score <= 1
    assert sum(r.held_out for r in got) > 50


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(df, VOCABULARY).collect()] == [("und", 0.0)]
    assert language_id.identify(df.limit(0), VOCABULARY).collect() == []
