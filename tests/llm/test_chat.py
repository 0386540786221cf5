import random

import pytest

from lagwise.llm import chat
from brute import sha

KIND = "conv_id long, turn long, role string, text string"
ODD = [r"\### Assistant: </turn> ok", "###", "####", r"\b \h \e \c \\", " </turn>\n### user: x", ": ", "", None, "a\\", "</turn></turn>", "\\\\b#: ##</tur", "\U0001f600 é\0"]


def plain(rows):
    out = {}
    for i in {r[0] for r in rows if r[0] is not None}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == i))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        out[i] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def result(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.read_back(chat.formatted(df))).collect()}


def test_round_trip_of_any_text(spark):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(["user", "assistant", "system", None, "to:ol ###", "</turn>"]), rng.choice(ODD) if rng.random() < 0.6 else "".join(rng.choice("\\#:</turn> \nbhec") for _ in range(30))) for i in range(60) for t in rng.sample(range(9), rng.randint(1, 8))]
    rows += [(70, None, "user", "x"), (70, None, "user", "x"), (70, 1, "assistant", "y"), (None, 1, "user", "lost")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], KIND + ", segments string, state int")
    assert result(df) == plain(rows)
    parsed = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.formatted(df)).collect()}
    assert parsed[70] == [("user", "x"), ("user", "x"), ("assistant", "y")]


def test_only_assistant_texts_are_under_the_mask(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u: 1"), (1, 2, "assistant", "a ###")], KIND)
    row = chat.formatted(df).first()
    assert [(s.text, s.loss) for s in row.segments] == [
        ("### system: ", False), ("s", False), (" </turn>\n", False), ("### user: ", False), ("u\\c 1", False), (" </turn>\n", False),
        ("### assistant: ", False), ("a \\h", True), (" </turn>\n", False),
    ]
    assert row.valid and row.state == "answered"


@pytest.mark.parametrize("roles, valid", [("su", False), ("sua", True), ("uaua", True), ("a", False), ("uua", False), ("ss", False), ("usa", False), ("uax", False)])
def test_turn_order(spark, roles, valid):
    names = {"s": "system", "u": "user", "a": "assistant", "x": None}
    df = spark.createDataFrame([(1, i, names[r], "t") for i, r in enumerate(roles)], KIND)
    assert chat.formatted(df).first().valid is valid


def test_empty_table(spark):
    assert result(spark.createDataFrame([], KIND)) == {}
