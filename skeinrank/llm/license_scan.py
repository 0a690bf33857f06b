"""License scans with Spark's own functions: phrases, and an exact containment join with templates.

A text's blocks
are all runs of words that no line without words parts (a notice may be wrapped over any number of lines)
and that are at most `SPREAD` times as long as the template. A block meets a template when it holds at
least `threshold` of the template's distinct words. Words are ordered by how many documents hold
them, rarest first; a block that meets a template of n words, of which it needs k, must hold
one of the template's first n - k + 1 words (prefix filter). So only the surroundings of such words are
looked at: they must have k words (length), enough of the order must be left on both sides
of the shared word (positions), and then every run around it is counted. Documents
without any such word drop out; the places of those left are
joined to the index of prefix words, which is as small as the templates are.

Edge cases: null and empty texts have no words, no labels and score 0; templates without
words never match; different texts under one id, and null ids, are judged each by itself; rows
that repeat an id and a text are alike; extra columns are ignored; texts of any length are read whole;
of blocks that hold as much the first one of a place is named; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices as their licenses give them.
TEMPLATES = {
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
THRESHOLD = 0.9
#: Words of a block for each word of the template: what stands between them may be half as many.
SPREAD = 1.5

WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: The end of a line that a line without words follows.
BREAK = r"\n[^0-9a-z\x{80}-\x{10FFFF}\n]*(?=\n)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _split(template: str) -> list[str]:
    """The template's words in order, repeats included."""
    return "".join(ch if not ch.isascii() or ch.isalnum() else " " for ch in template.translate(str.maketrans(_UPPER, _LOWER))).split(" ")


def _text(name: str) -> Column:
    """Lower-cased beyond A-Z too: that changes no word of the phrases and templates but for
    letters whose lower case is ASCII, which `_exact` rules out again."""
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def _exact(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _hash(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`")).alias("hash")


def base_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, n_words, n_base, first_word, last_word, base): the phrases' places, counted in words from 0."""
    heads = F.array(*(F.lit(w) for w in ("license", "cc")))
    step = docs.select(F.col(f"`{id_col}`").alias("id"), _hash(text_col), F.col(f"`{text_col}`").alias("text"), _words(_text(f"`{text_col}`")).alias("words"))
    step = step.select("id", "hash", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", heads), F.col("text")).alias("text"))
    # every word between two spaces of its own, so that neighbours of a phrase may be phrases
    padded = F.concat(F.lit(""), F.array_join(F.transform(_words(_exact(F.col("text"))), lambda w: F.concat(F.lit(" "), w, F.lit(" "))), ""))
    step = step.select("id", "hash", "n_words", F.when(F.col("text").isNotNull(), padded).otherwise(F.lit("")).alias("s"))
    seek = {p: "".join(f" {w} " for w in p.split()) for p in PHRASES}
    n_of = {p: ((F.length("s") - F.length(F.replace("s", F.lit(x)))) / len(x)).cast("long") for p, x in seek.items()}
    before = lambda upto: ((F.length(upto) - F.length(F.replace(upto, F.lit(" ")))) / 2).cast("long")
    first, last = [], []
    for x in seek.values():
        at = F.instr("s", x)
        first.append(F.when(at > 0, before(F.substring(F.col("s"), F.lit(1), at - 1))))
        back = F.instr(F.reverse("s"), x[::-1])
        last.append(F.when(back > 0, before(F.substring(F.col("s"), F.lit(1), F.length("s") - back - len(x) + 1))))
    base = F.array_compact(F.array(*(F.when(n_of[p] > 0, F.lit(label)) for p, label in PHRASES.items())))
    return step.select("id", "hash", "n_words", sum(n_of.values(), F.lit(0).cast("long")).alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), F.array_sort(F.array_distinct(base)).alias("base"))


def _around(words: Column, at: Column, room: Column | int) -> tuple[Column, Column]:
    """The words up to `room` - 1 places before and after place `at` (from 0), and `at` among them."""
    first = F.greatest(at - room + 1, F.lit(0))
    return F.slice(words, (first + 1).cast("int"), (at - first + room).cast("int")), (at - first).cast("int")


def license_blocks(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, block, label, template, containment): around each place of a rare word of a template that is met there, the best
    block; it is named by its first word's place among words and breaks."""
    spark = docs.sparkSession
    listed = [(label, t, [w for w in _split(t) if w]) for label, ts in (TEMPLATES if templates is None else templates).items() for t in ts]
    listed = [x for x in listed if x[2]]
    vocabulary = sorted({w for *_, ws in listed for w in ws})
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # how many documents hold each of the templates' words: at most as many rows as there are such words
    known = F.array(*(F.lit(w) for w in vocabulary))
    held = rows.select(F.explode(F.array_intersect(_words(_text("text")), known)).alias("word")).groupBy("word").count()
    times = {r.word: r["count"] for r in held.collect()} if vocabulary else {}
    order = sorted(vocabulary, key=lambda w: (times.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, most = [], 1
    for k, (label, text, ws) in enumerate(listed):
        room = math.ceil(SPREAD * len(ws))
        ws = sorted(set(ws), key=rank.__getitem__)
        need = math.ceil(threshold * len(ws) - 1e-9)
        index += [(ws[i], k, label, text, ws, need, i, room) for i in range(len(ws) - need + 1)]
        most = max(most, room)
    schema = "word string, t int, label string, template string, words array<string>, need int, place int, room int"
    prefix = F.broadcast(spark.createDataFrame(index, schema))  # as small as the templates
    marks = F.array(*(F.lit(w) for w in sorted({x[0] for x in index}, key=rank.__getitem__)), F.lit("\x00"))

    # each place of such a word, with what stands around it
    held = rows.where(F.arrays_overlap(_words(_text("text")), marks)).select("id", _hash("text"), F.regexp_extract_all(_exact(F.col("text")), F.lit(f"{WORD}|{BREAK}"), F.lit(0)).alias("all"))
    at = F.filter(F.transform("all", lambda w, i: F.when(F.array_contains(marks, w), i)), lambda i: i.isNotNull())
    near = held.select("id", "hash", F.explode(F.transform(at, lambda i: F.struct(i.alias("pos"), *(c.alias(n) for c, n in zip(_around(F.col("all"), i, most), ("near", "at")))))).alias("p"))
    met = near.select("id", "hash", "p.*", F.get("p.near", F.col("p.at")).alias("word")).join(prefix, "word")

    # no further than the template's room, nor beyond a line without words
    for c, n in zip(_around(F.col("near"), F.col("at"), F.col("room")), ("own", "mid")):
        met = met.withColumn(n, c)
    breaks = F.filter(F.transform("own", lambda w, i: F.when(F.startswith(w, F.lit("\n")), i)), lambda i: i.isNotNull())
    met = met.withColumn("breaks", breaks).withColumn("low", F.coalesce(F.array_max(F.filter("breaks", lambda b: b < F.col("mid"))) + 1, F.lit(0)))
    high = F.coalesce(F.array_min(F.filter("breaks", lambda b: b > F.col("mid"))), F.size("own"))
    met = met.withColumn("own", F.slice("own", F.col("low") + 1, high - F.col("low"))).withColumn("mid", F.col("mid") - F.col("low")).where(F.size("own") >= F.col("need"))
    # the words that templates know, in the common order: enough must be left beyond the shared one on both sides
    ranked = F.array(*(F.lit(w) for w in order), F.lit("\x00"))
    shared = F.array_intersect(ranked, F.col("own"))
    left = F.size("shared") - F.array_position("shared", F.col("word"))
    met = met.withColumn("shared", shared).where((1 + F.least(F.size("words") - F.col("place") - 1, left) >= F.col("need") - F.col("place")) & (F.size(F.array_intersect("shared", "words")) >= F.col("need")))
    # every run of that room around the word
    starts = F.sequence(F.greatest(F.col("mid") - F.col("room") + 1, F.lit(0)), F.col("mid"))
    met = met.withColumn("both", F.transform(starts, lambda s: F.size(F.array_intersect(F.slice("own", s + 1, F.col("room")), F.col("words")))))
    best = F.array_max("both")
    block = F.col("pos") - F.col("mid") + F.greatest(F.col("mid") - F.col("room") + 1, F.lit(0)) + F.array_position("both", best).cast("int") - 1
    met = met.where(best >= F.col("need")).select("id", "hash", block.alias("block"), "t", "label", "template", (best / F.size("words")).alias("containment"))
    return met.groupBy("id", "hash", "block", "t").agg(F.first("label").alias("label"), F.first("template").alias("template"), F.max("containment").alias("containment")).drop("t")


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """base_scan's columns, and labels (both kinds) and score: 1 where a phrase stands, else the best containment."""
    found = license_blocks(docs, templates, threshold, id_col, text_col).groupBy(F.col("id").alias("of"), F.col("hash").alias("text_hash")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = base_scan(docs, id_col, text_col)
    out = out.join(found, out["id"].eqNullSafe(found["of"]) & (out["hash"] == found["text_hash"]), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base", labels.alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
