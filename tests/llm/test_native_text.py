"""License scans and quality rules against plain versions."""

import math
import random
from collections import Counter, defaultdict

import pytest
from brute import PLAIN, corpus, lowered, prose, split

from lagwise.llm import licenses, quality_rules


def base_of(text):
    w = PLAIN.findall(lowered(text))
    at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    first = [i for i, _ in at]
    return len(w), len(at), min(first, default=None), max(first, default=None), ",".join(sorted({x for _, x in at}))


def license_texts():
    rng = random.Random(7)
    docs = corpus(7, 30)
    lines = list(licenses.PHRASES) + ["MIT License MIT license", "CC-BY 4.0", "Apache\nLicense, gnu General  Public-License", "MIT Lİcense", "GNU GENERAL PUBLIC LICENSE".replace("K", "K"), "licenKe mit licenKe cc by", "gnu general public", "by cc"]
    docs += [(100 + i, f"{prose(rng, 30)} {x}. {prose(rng, 5)} {x}") for i, x in enumerate(lines)]
    return docs


def test_license_base_is_exact(spark):
    docs = license_texts()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: base_of(t) for i, t in docs}
    assert sum(v[1] for v in got.values()) > 10


def test_notice_with_changed_words(spark):
    notice = next(n for n, label in licenses.NOTICES.items() if label == "bsd").split()
    changed = notice[:6] + ["code"] + notice[6:12] + notice[13:]
    rows = [(1, " ".join(["x"] * 9 + changed + ["y"] * 9)), (2, " ".join(notice[:6])), (3, "All rights reserved."), (4, "Licensed under CC BY-NC 4.0"), (5, "none")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "bsd" and got[1].base_labels == "" and 0.8 < got[1].score < 1 and got[1].n_base == 0
    assert got[2].labels == "" and got[2].score == 0
    assert got[3].labels == "all-rights-reserved" and got[3].score == 1
    assert got[4].labels == "cc-by,cc-by-nc" and got[4].base_labels == "cc-by"
    assert (got[5].labels, got[5].score, got[5].first_word) == ("", 0, None)


def test_repeated_and_disordered_pairs_are_no_notice(spark):
    apache = next(n for n, label in licenses.NOTICES.items() if label == "apache")
    bsd = next(n for n, label in licenses.NOTICES.items() if label == "bsd").split()
    backwards = " ".join(" ".join(bsd[i : i + 2]) for i in range(len(bsd) - 2, -1, -1))
    grown = " ".join(bsd[:5] + ["a", "b", "c"] + bsd[5:11] + ["d", "e", "f"] + bsd[11:16] + ["g", "h"] + bsd[16:])
    junk = "the license " * 7
    texts = [junk, "free of charge " * 6, backwards, f"{junk}{apache} {junk}", grown, apache, "all rights reserved " * 3]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(7)] == ["", "", "", "apache", "bsd", "apache", "all-rights-reserved"]
    assert [got[i].score for i in (0, 1, 2, 3, 5, 6)] == [0, 0, 0, 1, 1, 1] and math.isclose(got[4].score, 1 - 3 / (len(bsd) - 1))
    long = " ".join(f"t{i}" for i in range(150))
    found = licenses.scan(spark.createDataFrame([(1, f"x {long} y"), (2, "t1 t2 " * 150)], "doc_id long, text string"), {}, {long: "long"})
    assert {r.doc_id: (r.labels, r.score) for r in found.collect()} == {1: ("long", 1.0), 2: ("", 0.0)}


def test_license_awkward_rows(spark):
    df = spark.createDataFrame([(1, "mit license", "a", 1), (1, "mit license", "b", 2), (None, "mit license", "c", 3)], "doc_id long, text string, label string, pair int")
    assert [(r.doc_id, r.n_base) for r in licenses.scan(df).collect()] == [(1, 1)]
    assert licenses.scan(df.limit(0)).collect() == []


def counts_of(text):
    text = text or ""
    w = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_are_exact(spark):
    rng = random.Random(3)
    docs = corpus(5) + [(300, "a b c a b c d a b"), (301, "# * <x>\n# * <x>\n \n \n|"), (302, "\na b\r\na b\n"), (303, " ".join(rng.choice("ab") for _ in range(3000)))]
    docs += [(304 + i, " ".join(rng.choice("abcdefgh") for _ in range(i))) for i in range(40)]
    got = {r.doc_id: tuple(r[c] for c in quality_rules.COUNTS[:5]) for r in quality_rules.counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: counts_of(t) for i, t in docs}


def tail(x, n, p):
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))


def labelled(spark, n=3000):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        good = i % 5 > 0
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(rng.randint(50, 90))]
        if not good:
            words = [w + "###" for w in words]
        elif i % 200 == 1:
            words[:10] = ["$$"] * 10
        rows.append((i, " ".join(words), "en" if i % 3 else None, "k", 1))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n int"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int")


def test_cutoffs_hold_the_exact_bound(spark):
    docs, labels = labelled(spark)
    rules = quality_rules.RULES
    counted = quality_rules.counts(quality_rules._keyed(docs))
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    rows = [r.asDict() for r in counted.collect() if r.doc_id in good and r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words]
    by = defaultdict(list)
    for r in rows:
        by[r["stratum"]].append(r)
    got = {r.stratum: r for r in quality_rules.learn(counted, labels, "stratum").collect()}
    assert set(got) == set(by) == {"en", None}
    share, level = 0.05 / len(rules), 0.05 / (2 * sum(len(r.cutoffs) for r in rules))
    for stratum, part in by.items():
        for rule in rules:
            value = [eval(rule.value, {}, r) for r in part]
            want = None
            for c in rule.cutoffs:
                x = sum(v > c if rule.above else v < c for v in value)
                if x < len(part) * share and tail(x, len(part), share) <= level:
                    want = c
                    break
            assert got[stratum][f"cut_{rule.name}"] == want, rule.name
    result = {r.doc_id: r for r in quality_rules.quality(docs, labels).collect()}
    assert all(result[i].kept == (i % 3 == 0) for i in range(0, 3000, 5))  # too few good texts elsewhere
    assert sum(not result[i].kept for i in good if i is not None) <= 0.05 * len(good)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in result.items() if r.kept}
    assert got["en"].cut_symbols in (0.3, 0.5)


def test_rules_on_awkward_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", 5), (1, text, "en", 6), (None, text, None, 1), (2, None, None, 1), (3, "", "de", 1)], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in quality_rules.quality(docs, labels).collect())
    assert got == [("1", 60, False, True)] * 2 + [("2", 0, True, False), ("3", 0, True, False), ("None", 60, False, True)]
    assert sorted(str(r.doc_id) for r in quality_rules.keep_good(docs, labels).collect()) == ["1", "1", "None"]
    assert quality_rules.quality(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("x, n, p", [(0, 10, 0.1), (3, 400, 0.01), (40, 20_000, 0.004), (0, 1, 0.5)])
def test_binomial_tail(spark, x, n, p):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x, n)], "x long, n long")
    got = df.select(quality_rules._log_tail(F.col("x"), F.col("n"), p)).first()[0]
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(x + 1))
    assert math.isclose(got, math.log(want), rel_tol=1e-9, abs_tol=1e-9)
