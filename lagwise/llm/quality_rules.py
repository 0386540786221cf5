"""Quality rules whose cutoffs come with a guarantee on false rejections. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import SPACES, written

# The bounds of the base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words
#: Strata up to which the table of cutoffs is broadcast; more are joined like any table.
FEW_STRATA = 10_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")


@dataclass(frozen=True)
class Rule:
    """Reject a text whose ``value`` is above (or below) a cutoff; candidates run from the strictest on."""

    name: str
    value: str
    cutoffs: tuple[float, ...]
    above: bool = True

    def measured(self) -> Column:
        """The value; null for a text without words, whose ratios Spark might compute before the base rules decide."""
        return F.when(F.col("n_words") > 0, F.expr(self.value))


RULES = (
    Rule("symbols", "n_symbols / n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0)),
    Rule("repeats", "n_repeat_words / n_words", (0.1, 0.2, 0.3, 0.4, 0.5)),
    Rule("duplicate_lines", "n_dup_lines / n_words", (0.005, 0.01, 0.02, 0.03, 0.05, 0.1)),
    Rule("capitals", "n_upper / word_chars", (0.05, 0.1, 0.2, 0.3, 0.5, 0.7)),
    Rule("long_words", "word_chars / n_words", (6.0, 6.5, 7.0, 8.0, 10.0, 15.0)),
    Rule("short_words", "word_chars / n_words", (4.0, 3.5, 3.0, 2.5, 2.0), above=False),
)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the counts of its whole texts (null: none), by functions of one row, without a shuffle.

    Repeated three-word windows are found by sorting, per text, one long per window: its hash's upper bits, then its
    place. Neighbours with the same upper bits are candidates, and only these are compared word by word.
    """
    own = docs.columns
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.btrim(raw, F.lit(SPACES))
    none = F.array().cast("array<string>")
    words = F.when(trimmed == "", none).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
    lines = F.filter(F.split(raw, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    df = docs.select(*[F.col(f"`{c}`") for c in own], words.alias("__w"), lines.alias("__l"), F.regexp_count(raw, F.lit(r"[#*$%&|<>]")).alias("__s"), F.regexp_count(raw, F.lit(r"\p{Lu}")).alias("__u"))
    w, n = F.col("__w"), F.size("__w")
    df = df.select("*", F.expr("shiftleft(1L, length(bin(size(__w)))) - 1").alias("__m"))
    m = F.col("__m")
    windows = F.transform(F.slice(w, F.lit(1), n - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")))
    df = df.select("*", F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.sort_array(windows)).alias("__h"))
    h = F.col("__h")
    upper = lambda i: F.get(h, i).bitwiseOR(m)
    alike = F.filter(h, lambda x, i: (x.bitwiseOR(m) == upper(i + 1)) | (x.bitwiseOR(m) == upper(i - 1)))
    df = df.select("*", F.transform(alike, lambda x: x.bitwiseAND(m).cast("int")).alias("__c"))
    shown = F.transform(F.col("__c"), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")))
    df = df.select("*", F.sort_array(shown).alias("__t"))
    t = F.col("__t")
    twice = F.filter(t, lambda x, j: (x["t"] == F.get(t, j + 1)["t"]) | (x["t"] == F.get(t, j - 1)["t"]))
    df = df.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("__r"))
    covered = F.aggregate(
        F.col("__r"), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).cast("long").alias("n")), lambda a: a["n"],
    )
    found = F.struct(
        n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.col("__s").cast("long").alias("n_symbols"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), F.col("__u").cast("long").alias("n_upper"),
    )
    # generated columns: a filter on them is not moved below, where each use would count the text again
    return df.select(*[F.col(f"`{c}`") for c in own], F.inline(F.array(found)))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _log_tail(x: Column, n: Column, p: float) -> Column:
    """log P(Binomial(n, p) <= x), exactly: the terms are summed one after the other, in logarithms."""
    odds = math.log(p) - math.log1p(-p)

    def add(a, k):
        term = a["term"] + F.log((n - k + 1) / k) + F.lit(odds)
        top = F.greatest(term, a["sum"])
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(term, a["sum"]) - top))).alias("sum"))

    first = n.cast("double") * F.lit(math.log1p(-p))
    start = F.struct(first.alias("term"), first.alias("sum"))
    return F.aggregate(F.when(x > 0, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<bigint>")), start, add, lambda a: a["sum"])


def cutoffs(holdout: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES, most: float = 0.05, doubt: float = 0.05) -> DataFrame:
    """One row per ``stratum`` of good held-out texts (with ``counts``), with a column per rule: its cutoff or null.

    Each (stratum, rule, candidate) is a test of "the rule rejects more than ``most / rules`` of good texts". A
    candidate passes if so few of the stratum's good texts are rejected that this has a probability (the exact
    binomial tail, which is the Clopper-Pearson bound) of ``doubt / tests`` at most (Bonferroni). The strictest
    candidate that passes is taken; without one the rule does not apply there. With probability ``1 - doubt``, all
    rules together then reject at most ``most`` of the good texts of every stratum.
    """
    share = most / len(rules)
    each = [(i, j, r, c) for i, r in enumerate(rules) for j, c in enumerate(r.cutoffs)]
    hit = lambda r, c: r.measured() > c if r.above else r.measured() < c
    sums = holdout.groupBy(stratum).agg(
        F.count("*").alias("n"), *[F.sum(F.when(hit(r, c), 1).otherwise(0)).cast("long").alias(f"x{i}_{j}") for i, j, r, c in each]
    )
    strata = max(1, sums.count())
    allowed = math.log(doubt / (strata * len(each)))

    def chosen(i: int, r: Rule) -> Column:
        n = F.col("n")
        passes = lambda x: (x < n * share) & (_log_tail(x, n, share) <= allowed)
        return F.coalesce(*[F.when(passes(F.col(f"x{i}_{j}")), F.lit(c)) for j, c in enumerate(r.cutoffs)]).alias(f"cut_{r.name}")

    return sums.select(stratum, *[chosen(i, r) for i, r in enumerate(rules)])


def learn(counted: DataFrame, labels: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES, most: float = 0.05, doubt: float = 0.05) -> DataFrame:
    """Cutoffs from the labelled texts among ``counted(doc_id, stratum, counts)``; good: any label of it says 1.

    Texts that the base rules reject are no part of the test: the further rules never see them.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return written(cutoffs(counted.join(good, "doc_id", "left_semi").filter(~base_failed()), stratum, rules, most, doubt), "cutoffs")


def judged(counted: DataFrame, table: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``counted`` and ``base_failed``, ``kept``, with the cutoffs of ``table``; a stratum without cutoffs has the base rules only."""
    small = table.count() <= FEW_STRATA
    known = table.withColumnRenamed(stratum, "__stratum")
    df = counted.join(F.broadcast(known) if small else known, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    broken = F.lit(False)
    for r in rules:
        value, cut = r.measured(), F.col(f"cut_{r.name}")
        broken = broken | F.coalesce(value > cut if r.above else value < cut, F.lit(False))
    df = df.withColumn("base_failed", base_failed())
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(broken, F.lit(False))).drop("__stratum", *[f"cut_{r.name}" for r in rules])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), F.col("text").cast("string").alias("text"))


def quality(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, most: float = 0.05, doubt: float = 0.05) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for every row of ``docs(doc_id, text, lang)``.

    Strata are the languages; null is one. A null or empty text has no words, null ratios, and fails the base rules. Every row is judged for itself, also rows that repeat a doc_id or have none (these never have a
    label). Labels that are null or name no document do nothing; without labels only the base rules reject. An empty
    table gives an empty result; other columns are ignored.
    """
    counted = written(counts(_keyed(docs)).drop("text"), "counts")
    return judged(counted, learn(counted, labels, "stratum", rules, most, doubt), "stratum", rules).drop("stratum")


def keep_good(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, most: float = 0.05, doubt: float = 0.05) -> DataFrame:
    """The rows of ``docs`` (all its columns) that ``quality`` keeps; learning and judging read the texts in turn."""
    counted = written(counts(_keyed(docs)).drop("text"), "counts")
    table = learn(counted, labels, "stratum", rules, most, doubt)
    whole = docs.select(F.struct(*docs.columns).alias("__row"), F.col("lang").cast("string").alias("stratum"), F.col("text").cast("string").alias("text"))
    return judged(counts(whole), table, "stratum", rules).filter("kept").select("__row.*")
