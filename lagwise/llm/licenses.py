"""License scans by diagonal voting over word pairs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import documents

# The phrases of the contract with their labels, each found word by word.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening words of public licenses and notices, found also with some words changed.
NOTICES = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under the gnu general public license": "gpl",
    "released under the mit license": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this near belong to one place of a notice: a word put in or left out moves the diagonal by one.
NEAR = 3
#: Share of a notice's word pairs that its place must hold.
LEAST = 0.6


def plain_text(text: Column) -> Column:
    """A-Z in lower case; other letters may change too, but never into, from or with ASCII.

    Only two characters outside ASCII have ASCII in their lower case, the Kelvin sign and the dotted capital I. They
    become other letters first, so the words that are plain ASCII are just those of the contract.
    """
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))
    return F.lower(F.replace(text, F.lit("İ"), F.lit("ı")))


def _pairs(words: Column) -> Column:
    """Hashes of all pairs of neighbouring words, by place."""
    return F.when(F.size(words) < 2, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    )


def _placed_pairs(words: Column) -> Column:
    """Structs ``pos, pair, word, next`` of all pairs of neighbouring words."""
    each = lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w, F.get(words, i + 1)).alias("pair"), w.alias("word"), F.get(words, i + 1).alias("next"))
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), each)


def templates(spark, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """``template, label, exact, t_words, t_pos, pair`` for each word pair of each template: a table of fixed size."""
    rows = [(label, exact, text.split()) for group, exact in ((phrases, True), (notices, False)) for text, label in group.items()]
    if any(len(words) < 2 for *_, words in rows):
        raise ValueError("a phrase needs two words at least")
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template int, label string, exact boolean, t_words array<string>")
    return table.select("*", F.posexplode(_pairs(F.col("t_words"))).alias("t_pos", "pair"))


def votes(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``doc_id, template, label, exact, pairs, diagonal, pos, t_pos``: every place of a word pair of a template.

    All pairs of all texts are joined with the templates by hash, and both words compared. A pair carries its own two
    words only, so the work grows with the length of a text, not with its square.
    """
    words = docs.select("doc_id", F.regexp_extract_all(plain_text(F.col("text")), F.lit(WORD), F.lit(0)).alias("words"))
    placed = words.select("doc_id", F.inline(_placed_pairs(F.col("words"))))
    met = placed.join(F.broadcast(table), "pair")
    same = (F.col("word") == F.get("t_words", F.col("t_pos"))) & (F.col("next") == F.get("t_words", F.col("t_pos") + 1))
    return met.filter(same).select("doc_id", "template", "label", "exact", (F.size("t_words") - 1).alias("pairs"), (F.col("pos") - F.col("t_pos")).alias("diagonal"), "pos", "t_pos")


def _chain(votes: Column, near: int, pairs: Column) -> Column:
    """``n, first, last`` of the longest run of votes whose places rise in text and template alike.

    ``votes``: structs ``pos, t_pos``, sorted. From one vote to the next the diagonal moves by ``near`` at most, so a run
    has each of the template's pairs once, in order, and only votes within a template's length behind are remembered.
    """
    vote = "struct<pos:int,t_pos:int,n:int,first:int>"
    start = F.struct(F.array().cast(f"array<{vote}>").alias("open"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(0).alias("last")).alias("best"))

    def extended(state, v):
        fits = lambda x: (x.pos < v.pos) & (x.t_pos < v.t_pos) & (F.abs((v.pos - v.t_pos) - (x.pos - x.t_pos)) <= near)
        before = F.array_max(F.transform(F.filter(state.open, fits), lambda x: F.struct(x.n.alias("n"), x.first.alias("first"))))
        run = lambda b: F.struct(v.pos.alias("pos"), v.t_pos.alias("t_pos"), (F.coalesce(b.n, F.lit(0)) + 1).alias("n"), F.coalesce(b.first, v.pos).alias("first"))
        recent = F.filter(state.open, lambda x: x.pos >= v.pos - pairs - near)

        def step(r):
            best = F.when(r.n > state.best.n, F.struct(r.n.alias("n"), r.first.alias("first"), r.pos.alias("last"))).otherwise(state.best)
            return F.struct(F.concat(recent, F.array(r)).alias("open"), best.alias("best"))

        return F.get(F.transform(F.transform(F.array(before), run), step), F.lit(0))

    return F.aggregate(votes, start, extended, lambda state: state.best)


def places(cast_votes: DataFrame, near: int = NEAR, least: float = LEAST, longest: int = 64) -> DataFrame:
    """``doc_id, template, label, exact, first, last, share``: verified places of templates of up to ``longest`` pairs.

    Votes are counted by diagonal, the template's place in the text. A phrase stands where one diagonal has all its
    pairs. For a notice, diagonals up to ``near`` apart are one place. If it has ``least`` of the notice's pairs, each
    counted once, its words are compared with the notice's in order: ``share`` is that of the pairs in ``_chain``.
    """
    masks = [f"m{i}" for i in range(-(-longest // 64))]  # a diagonal's places in the template, one bit each
    by_diagonal = cast_votes.groupBy("doc_id", "template", "label", "exact", "pairs", "diagonal").agg(
        F.count("*").alias("n"), *[F.expr(f"bit_or(if(t_pos div 64 = {i}, shiftleft(1L, t_pos % 64), 0L))").alias(m) for i, m in enumerate(masks)]
    ).filter("NOT exact OR n = pairs")
    along = Window.partitionBy("doc_id", "template").orderBy("diagonal")  # places of one template in one text
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    start = F.when(F.col("exact") | gap.isNull() | (gap > near), 1).otherwise(0)
    merged = by_diagonal.withColumn("place", F.sum(start).over(along))
    inside = Window.partitionBy("doc_id", "template", "place")
    distinct = sum((F.bit_count(F.bit_or(m).over(inside)) for m in masks[1:]), F.bit_count(F.bit_or(masks[0]).over(inside)))
    enough = merged.withColumn("distinct", distinct).filter(F.col("exact") | (F.col("distinct") >= least * F.col("pairs")))
    found = enough.groupBy("doc_id", "template", "label", "exact", "pairs", "place").agg(F.collect_list(F.struct("diagonal", *masks)).alias("held"))

    def set_in(d, t):
        bit = lambda m: F.call_function("shiftrightunsigned", d[m], t % 64).bitwiseAND(F.lit(1)) == 1
        return F.coalesce(*[F.when(F.floor(t / 64) == i, bit(m)) for i, m in enumerate(masks)])

    steps = F.sequence(F.lit(0), (F.col("pairs") - 1).cast("int"))
    of_diagonal = lambda d: F.transform(F.filter(steps, lambda t: set_in(d, t)), lambda t: F.struct((d.diagonal + t).cast("int").alias("pos"), t.cast("int").alias("t_pos")))
    votes_there = F.array_sort(F.flatten(F.transform("held", of_diagonal)))
    chained = found.withColumn("run", _chain(votes_there, near, F.col("pairs"))).withColumn("share", F.col("run.n") / F.col("pairs"))
    return chained.filter(F.col("share") >= F.when(F.col("exact"), 1.0).otherwise(least)).select(
        "doc_id", "template", "label", "exact", F.col("run.first").cast("long").alias("first"), (F.col("run.last") + 1).cast("long").alias("last"), "share"
    )


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, near: int = NEAR, least: float = LEAST) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every document.

    Base: places where a phrase's words stand consecutively, with the least and greatest first word (null without one)
    and its labels; ``labels`` adds those of notices. ``score`` is the largest share of a template found at one place,
    0 without one. A place of a notice has its pairs in order, each once (``places``). Labels are distinct, sorted and joined by commas. A null text is empty, and such documents have
    zeros and empty labels. A repeated doc_id is one document and a row without one is left out (``documents``); an
    empty table gives an empty result; other columns are ignored.
    """
    docs = documents(docs)
    longest = max((len(t.split()) - 1 for t in (*phrases, *notices)), default=1)
    found = places(votes(docs, templates(docs.sparkSession, phrases, notices)), near, least, longest)
    base = F.when(F.col("exact"), F.col("first"))
    per_doc = found.groupBy("doc_id").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("base"), F.collect_set("label").alias("all"), F.max("share").alias("score"),
    )  # the sets hold no more than the templates' labels
    words = docs.select("doc_id", F.regexp_count(plain_text(F.col("text")), F.lit(WORD)).cast("long").alias("n_words"))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return words.join(per_doc, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
