"""License scans: phrase places, and an exact set-similarity join of text blocks with notice templates.

Everything is DataFrame functions. Texts are cut into words by one ``split``. A block is a line, or any run of ``span``
words in a row whatever line breaks and comment marks stand between them; ``span`` is the length of the template over
the threshold, so as many words may be put in as may be missing. A template is found in a block that has at least
``threshold`` of its distinct words.

The join orders tokens by how many documents have them, rarest first. A block that meets the threshold must
have one of the first ``size - need + 1`` tokens of the template (prefix filter), at least ``need`` template tokens
(length filter), and after the first common token enough tokens left on both sides (positional filter). Only
documents with a prefix token keep their text beyond the scan, and only their blocks are joined; what passes
the filters is verified by intersecting the sets. Templates are few and fixed, so their index is broadcast.
Runs are looked for around each prefix token of a document: all runs that hold it lie within ``span`` words of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.llm.store import stored

# Phrases that must be found wherever their words stand one after the other.
PHRASES = {
    "gpl": ("gnu", "general", "public", "license"),
    "apache": ("apache", "license"),
    "cc-by": ("cc", "by"),
    "mit": ("mit", "license"),
}

# Notices in common use, by the label they give.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
THRESHOLD = 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of ASCII digits, letters (A-Z lower-cased) and all characters outside ASCII; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS), "")


def phrase_places(words: Column, phrases: dict[str, tuple[str, ...]] = PHRASES) -> Column:
    """``array<struct<place, label>>`` of all places where a phrase begins.

    Words are only walked through where the last word of a phrase occurs.
    """
    def at(word: Column, i: Column) -> Column:
        found = [F.when((word == p[0]) & _all(F.get(words, i + k) == w for k, w in enumerate(p[1:], 1)),
                        F.struct(i.cast("bigint").alias("place"), F.lit(label).alias("label"))) for label, p in phrases.items()]
        return F.coalesce(*found)

    last = F.array(*[F.lit(p[-1]) for p in phrases.values()])
    kind = "array<struct<place:bigint,label:string>>"
    return F.when(F.arrays_overlap(words, last), F.filter(F.transform(words, at), lambda p: p.isNotNull())).otherwise(
        F.array().cast(kind))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def document_counts(docs: DataFrame, text: str, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many documents each word of a fixed vocabulary occurs; one row per word reaches the driver."""
    words = F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}


class TemplateIndex:
    """Templates as sets of token ranks in the global order."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float, counts: dict[str, int]) -> None:
        tokens = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(tokens)}
        self.rows = []
        for number, (label, template) in enumerate(templates):
            ranks = sorted({self.rank[w] for w in template.split()})
            need = -(-round(threshold * len(ranks) * 1000) // 1000)
            for place, r in enumerate(ranks[:len(ranks) - need + 1]):
                self.rows.append((r, number, label, place, len(ranks), need, ranks))
        self.words = tokens
        self.spans = [-(-round(len(t.split()) / threshold * 1000) // 1000) for _, t in templates]
        self.prefix_tokens = sorted({tokens[row[0]] for row in self.rows})

    def table(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.createDataFrame(
            self.rows, "token int, template int, label string, place int, size int, need int, ranks array<int>")

    def span_table(self, like: DataFrame) -> DataFrame:
        """For each prefix token, the templates as words and the length of their runs."""
        rows = [(self.words[r], number, label, need, self.spans[number], [self.words[x] for x in ranks])
                for r, number, label, _, _, need, ranks in self.rows]
        return like.sparkSession.createDataFrame(
            rows, "token string, template int, label string, need int, span int, held array<string>")

    def ranks_of(self, words: Column) -> Column:
        """Sorted ranks of the template tokens in a block."""
        order = F.create_map(*[F.lit(x) for pair in self.rank.items() for x in pair])
        known = F.array_intersect(words, F.array(*map(F.lit, self.rank)))
        return F.array_sort(F.transform(known, lambda w: F.element_at(order, w)))


def find_templates(texts: DataFrame, index: TemplateIndex, keys: Sequence[str]) -> DataFrame:
    """``keys, line, template, label, containment`` of all blocks of ``texts`` (``keys, text``) that meet the threshold."""
    lines = texts.select(*keys, F.posexplode(F.split("text", "\n")).alias("line", "block"))
    blocks = lines.select(*keys, "line", index.ranks_of(words_of(F.col("block"))).alias("found")).where(F.size("found") > 0)
    probes = blocks.select(*keys, "line", "found", F.size("found").alias("n"), F.posexplode("found").alias("at", "token"))
    left = F.least(F.col("size") - F.col("place"), F.col("n") - F.col("at"))
    joined = probes.join(F.broadcast(index.table(texts)), "token").where((F.col("n") >= F.col("need")) & (left >= F.col("need")))
    overlap = F.size(F.array_intersect("found", "ranks"))
    return joined.where(overlap >= F.col("need")).select(
        *keys, "line", "template", "label", (overlap / F.col("size")).alias("containment")).distinct()


def find_runs(texts: DataFrame, index: TemplateIndex, keys: Sequence[str]) -> DataFrame:
    """``keys, template, label, containment`` of the best run of words of ``texts`` (``keys, text``) that meets the threshold.

    Only texts of several lines are looked at: a run inside one line has no more of a template than the line.
    """
    words = texts.where(F.instr("text", "\n") > 0).select(*keys, words_of(F.col("text")).alias("words"))
    at = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("token"))),
                  lambda p: p["token"].isin(index.prefix_tokens))
    # What lies within the longest run of a prefix token; its own place in that is ``i``.
    far = max(index.spans, default=1) - 1
    probes = words.select(*keys, "words", F.explode(at).alias("p")).select(
        *keys, "p.token", F.least("p.i", F.lit(far)).alias("i"),
        F.slice("words", F.greatest(F.col("p.i") - far, F.lit(0)) + 1, F.lit(2 * far + 1)).alias("around"))
    near = probes.join(F.broadcast(index.span_table(texts)), "token")
    low = F.greatest(F.col("i") - F.col("span") + 1, F.lit(0))
    near = near.where(F.size(F.array_intersect("around", "held")) >= F.col("need"))
    # The runs that hold the token begin at ``low`` to ``i``.
    common = F.transform(F.sequence(low, F.col("i")), lambda s: F.size(F.array_intersect(F.slice("around", s + 1, F.col("span")), F.col("held"))))
    best = near.select(*keys, "template", "label", "need", F.size("held").alias("size"), F.array_max(common).alias("overlap"))
    return best.where("overlap >= need").select(*keys, "template", "label", (F.col("overlap") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, phrases: dict[str, tuple[str, ...]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts phrase places; ``first_word`` and ``last_word`` are the smallest and largest, or null.
    ``labels`` adds those of templates to those of phrases; ``score`` is 1 for a phrase, else the highest
    containment, else 0. Labels are sorted and joined by commas, empty if there are none. Null text is empty. Every row
    gives a row; rows with equal id and text get equal results. Only ``doc_id`` and ``text`` are read.
    """
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    index = TemplateIndex(templates, threshold, document_counts(docs, "text", vocabulary))
    cut = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", words_of(F.col("text")).alias("words"))
    placed = cut.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.size("words").cast("bigint").alias("n_words"),
        phrase_places(F.col("words"), phrases).alias("places"),
        F.when(F.arrays_overlap("words", F.array(*map(F.lit, index.prefix_tokens))), F.col("text")).alias("text"))
    placed = stored(placed, "license-candidates")
    candidates, keys = placed.where("text is not null"), ("doc_id", "text_hash")
    hits = find_templates(candidates, index, keys).drop("line").unionByName(find_runs(candidates, index, keys))
    found = hits.groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best")).withColumnsRenamed(
        {"doc_id": "_id", "text_hash": "_hash"})
    joined = placed.drop("text").join(
        found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("found", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.col("places.place")).alias("first_word"), F.array_max(F.col("places.place")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
