import random

from brute import contamination, corpus, prose

from lagwise.llm import decontaminate

COLUMNS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def result(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_same_as_brute_force(spark):
    rng = random.Random(9)
    docs = corpus(4)
    items = [(1, prose(rng, 30)), (2, "The thing"), (10, prose(rng, 12)), (3, ""), (4, None), (5, "a " * 12), (6, "x9ing!! x9er"), (None, "the")]
    items += [(20, docs[3][1][:300]), (21, docs[3][1][100:400]), (22, docs[9][1]), (22, docs[9][1]), (23, docs[9][1].upper())]
    docs.append((900, "Before. " + prose(rng, 20) + " " + items[0][1].upper() + "\n" + items[2][1] + " after"))
    got = result(decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == contamination(docs, items)
    assert sum(v[4] for v in got.values()) > 5


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "q"), (1, "a b c", 5, "q"), (None, "a b c", 1, "q"), (2, None, 1, "q")], "doc_id long, text string, n_hit int, hash string")
    items = spark.createDataFrame([("i2", "B c", "w"), ("i10", "a B", "w")], "item_id string, text string, window string")
    assert result(decontaminate.contamination(docs, items)) == contamination([(1, "a b c"), (2, None)], [("i2", "b c"), ("i10", "a b")])
    assert sorted(str(r.doc_id) for r in decontaminate.without_contaminated(docs, items).collect()) == ["2", "None"]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert result(decontaminate.contamination(docs, items.limit(0))) == contamination([(1, "a b")], [])
    assert result(decontaminate.contamination(docs.limit(0), items)) == {}
