"""License scans: diagonal voting over rolling word k-grams.

All hashes of k consecutive words of a text are joined to the positions of the same k-grams in license templates. A place of
the text less a place of the template is a diagonal; a stretch of a text that follows a template votes for one diagonal, or,
with words inserted or left out, for neighbouring ones. Votes are added up by diagonal, neighbours are merged, and so are
diagonals further apart whose stretches follow each other; a span that has enough votes is verified on the words themselves,
in their order. Besides, fixed phrases are counted where their words stand together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanlake.llm.common import small, stored, texts

#: Phrases and their labels (fixed values).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Openings of license texts and notices (fixed values), by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("copyright", "Copyright (c) by the authors. All rights reserved."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
)
#: Words of a k-gram, diagonals that are merged, share of a template's words that a verified span must have.
GRAM, NEAR, SHARE = 3, 3, 0.7
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, each with a blank of its own on both sides; empty without words."""
    line = F.trim(F.regexp_replace(F.translate(text, _A, _Z), _SEPARATORS, "  "))
    return F.when(line == "", F.lit("")).otherwise(F.concat(F.lit(" "), line, F.lit(" ")))


def _count(text: Column, part: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def phrases(line: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and the array of base labels, of a ``spaced`` column."""
    n_words = F.floor(_count(line, " ") / 2).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        words = phrase.split()
        part = " " + "  ".join(words) + " "
        found = F.contains(line, F.lit(part))
        counts.append(_count(line, part))
        firsts.append(F.when(found, F.floor(_count(F.substring_index(line, part, 1), " ") / 2)))
        lasts.append(F.when(found, n_words - len(words) - F.floor(_count(F.substring_index(line, part, -1), " ") / 2)))
        labels.append(F.when(found, F.lit(label)))
    return {"n_words": n_words, "n_base": sum(counts[1:], counts[0]), "first_word": F.least(*firsts).cast("long"), "last_word": F.greatest(*lasts).cast("long"), "base": F.array_compact(F.array(*labels))}


def _grams(words: Column, k: int) -> Column:
    """Hashes of all k consecutive words of an array."""
    hashed = F.transform(F.array(words), lambda w: F.when(F.size(w) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))))
    return hashed[0]


def templates(spark: SparkSession, given=TEMPLATES) -> DataFrame:
    """(template, label, template_words) from pairs of label and text, or from a table (label, body) at a path, numbered by
    its rows' order of label and body."""
    if isinstance(given, str):
        given = sorted((r["label"], r["body"]) for r in spark.read.parquet(given).select("label", "body").distinct().collect())
    rows = spark.createDataFrame([(k, label, text) for k, (label, text) in enumerate(given)], "template int, label string, body string")
    return rows.select("template", "label", F.split(F.trim(spaced(F.col("body"))), "  ").alias("template_words"))


def in_order(words: Column, own: Column) -> Column:
    """Length of the longest common subsequence of two arrays: a row of its table for each word of ``own``."""

    def row(above: Column, word: Column) -> Column:
        def cell(done: Column, i: Column) -> Column:
            up, left, corner = F.get(above, i + 1), F.element_at(done, -1), F.get(above, i)
            return F.concat(done, F.array(F.when(F.get(words, i) == word, corner + 1).otherwise(F.greatest(up, left))))

        return F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), F.array(F.lit(0)), cell)

    return F.aggregate(own, F.array_repeat(F.lit(0), F.size(words) + 1), row, lambda last: F.element_at(last, -1))


def _marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, mark, line): hashes of id, which may be null, and text stand for a row in joins."""
    return texts(docs, id_col, text_col).select("id", F.xxhash64("id").alias("key"), F.xxhash64("text").alias("mark"), spaced(F.col("text")).alias("line"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given=TEMPLATES) -> DataFrame:
    """(key, mark, id, template, label, start, length, score) of verified spans, of rows that share id and text once.

    ``start`` is a word's number from 0; ``score`` is the share of the template's words that the span has in their order.
    ``given``: pairs of label and text, or the path of a table (label, body).
    """
    rows = _marks(docs, id_col, text_col)
    fixed = stored(templates(docs.sparkSession, given), "templates")
    known = fixed.select("template", F.size("template_words").alias("size"), F.posexplode(_grams(F.col("template_words"), GRAM)).alias("at", "gram"))
    split = F.split(F.trim(F.col("line")), "  ")
    places = rows.where("line <> ''").select("key", "mark", F.posexplode(_grams(split, GRAM)).alias("place", "gram"))
    votes = places.join(small(known), "gram").groupBy("key", "mark", "template", "size", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"))
    # Neighbouring diagonals are one run, and so are two of which one's stretch begins behind the other's, within the template's length.
    ordered = Window.partitionBy("key", "mark", "template").orderBy("diagonal")
    before = lambda c: F.lag(c).over(ordered)
    most = F.col("size") + F.floor(F.col("size") * (1 - SHARE))
    behind = (F.col("low") > before("high")) & (F.col("high") + GRAM - before("low") <= most)
    follows = behind | ((F.col("high") < before("low")) & (before("high") + GRAM - F.col("low") <= most))
    together = (F.col("diagonal") - before("diagonal") <= NEAR) | follows
    merged = votes.withColumn("apart", F.coalesce(~together, F.lit(True)).cast("int")).withColumn("run", F.sum("apart").over(ordered)).groupBy("key", "mark", "template", "size", "run").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"))
    # Words left out or exchanged break up to GRAM votes each: what can't reach SHARE is not looked at again.
    enough = merged.where(F.col("votes") >= F.greatest(F.lit(1), F.floor(F.col("size") * (1 - GRAM * (1 - SHARE))) - GRAM + 1))
    asked = enough.groupBy("key", "mark").agg(F.collect_list(F.struct("template", "low", "high")).alias("asked"))
    asked = stored(asked, "spans")  # counted, then joined: the votes are cast once
    again = rows.join(small(asked), ["key", "mark"]).dropDuplicates(["key", "mark"]).select("key", "mark", "id", split.alias("words"), F.explode("asked").alias("a"))
    own = F.slice("words", F.col("a.low") + 1, F.col("a.high") - F.col("a.low") + GRAM)
    span = again.select("key", "mark", "id", "a.template", F.col("a.low").alias("start"), own.alias("own")).join(small(fixed), "template")
    verified = span.withColumn("score", in_order(F.col("template_words"), F.col("own")) / F.size("template_words")).where(F.col("score") >= SHARE)
    return verified.select("key", "mark", "id", "template", "label", "start", F.size("own").alias("length"), "score")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given=TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for every row of ``docs``.

    The score is 1 where a phrase stands, else the best verified span's, else 0. Labels are distinct, sorted, comma-joined;
    none give an empty string. A null or empty text has no words; repeated rows and those without an id count each; an empty
    table gives none.
    """
    found = spans(docs, id_col, text_col, given).groupBy("key", "mark").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    rows = _marks(docs, id_col, text_col)
    base = rows.select("id", "key", "mark", *(c.alias(k) for k, c in phrases(F.col("line")).items()))
    out = base.join(found, ["key", "mark"], "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
