"""License scan: exact phrases, and an exact set-similarity join with license templates.

Base: the places where the words of a few license phrases stand consecutively.

Method: a template is the set of a license notice's words. A text is cut into blocks of
2s consecutive words, a new one every s words, for each of a few sizes s; a template of up
to s words is looked for in the blocks of the smallest such s, so that any passage of its
length lies whole in a block. A block meets a template of n words if they share at least
t = ceil(containment * n) words. These pairs are found exactly by a set-similarity join:
words are ordered by their frequency in all documents, rarest first; a template's prefix
is its first n - t + 1 words, of which a matching block must hold one; blocks of fewer
than t template words are skipped (length filter); a shared word at positions i and j
leaves room for at most 1 + min(n - i - 1, m - j - 1) shared words, which must reach t
(positional filter); what remains is verified by intersecting the sets.

Only words of templates can count, so blocks keep only those, and all that is broadcast
(template words, prefixes) is as large as the templates, whatever the corpus. Texts are
not shuffled: the join's output is one small row for each document with a hit.

Defined cases: a null or empty text has no words, no labels and score 0; equal rows give
equal results; an empty table gives an empty result; other columns are ignored. Words are
lower-cased in A-Z only (U+212A, whose lower case is k, is kept apart).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import HASH, ID, TEXT, keyed, same_row

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Wordings of license notices and their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)

#: Block steps; the last must hold the longest template.
STEPS = (8, 16, 32, 64)


def words_of(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text lower-cased in A-Z."""
    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))
    spaced = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def phrase_starts(words: Column, phrase: str) -> Column:
    """Word positions, from 0, at which the phrase's words stand consecutively."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        at = F.get(words, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            at = at & (F.get(words, i + k) == w)
        return F.coalesce(at, F.lit(False))

    held = F.array_contains(words, parts[0])
    for w in parts[1:]:
        held = held & F.array_contains(words, w)
    return F.when(held, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each of these words stands in all documents. What comes back is as long as `vocabulary`."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    counted = docs.select(F.explode(words_of(F.col(TEXT))).alias("word")).join(F.broadcast(known), "word").groupBy("word").count()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in counted.collect()}


def template_matches(docs: DataFrame, templates=TEMPLATES, containment: float = 0.8) -> DataFrame:
    """From keyed documents: one row (key, start, block, template number, label, share) for each block that meets a template."""
    spark = docs.sparkSession
    sets = [(label, sorted(set(_words(text)))) for label, text in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    counts = word_frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counts[w], w))
    place = {w: k for k, w in enumerate(order)}
    rows = []
    for k, (label, s) in enumerate(sets):
        ranked, n = sorted(s, key=place.get), len(s)
        least = math.ceil(containment * n - 1e-9)
        step = next(x for x in STEPS if x >= len(_words(templates[k][1])))
        rows += [(w, step, i, k, label, n, least, ranked) for i, w in enumerate(ranked[: n - least + 1])]
    prefixes = spark.createDataFrame(rows, "token string, step int, i int, template int, label string, n int, least int, ranked array<string>")
    rare = F.array(*[F.lit(w) for w in sorted({r[0] for r in rows})])
    with_rare = docs.select(ID, HASH, words_of(F.col(TEXT)).alias("words")).filter(F.arrays_overlap("words", rare))
    steps = F.array(*[F.lit(s) for s in sorted({r[1] for r in rows})])
    starts = with_rare.select(ID, HASH, "words", F.explode(steps).alias("step"))
    starts = starts.select("*", F.explode(F.expr("sequence(0, size(words) - 1, step)")).alias("start"))
    block = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.expr("slice(words, start + 1, 2 * step)"))
    blocks = starts.select(ID, HASH, "step", "start", block.alias("block")).filter(F.size("block") > 0)
    tokens = blocks.select("*", F.posexplode("block").alias("j", "token"))
    m = F.size("block")
    pairs = tokens.join(F.broadcast(prefixes), ["token", "step"])
    pairs = pairs.filter((m >= F.col("least")) & (F.col("j") <= m - F.col("least")) & (1 + F.least(F.col("n") - F.col("i") - 1, m - F.col("j") - 1) >= F.col("least")))
    shared = F.size(F.array_intersect("block", "ranked"))
    return pairs.withColumn("shared", shared).filter(F.col("shared") >= F.col("least")).select(ID, HASH, "start", "block", "template", "label", (F.col("shared") / F.col("n")).alias("share"))


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of `docs`: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = keyed(docs, id_col, text_col)
    hits = template_matches(rows, templates, containment).groupBy(F.col(ID).alias("__mid"), F.col(HASH).alias("__mhash")).agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    words = rows.select(ID, HASH, F.explode(F.array(words_of(F.col(TEXT)))).alias("words"))
    places = [phrase_starts(F.col("words"), p) for p in PHRASES]
    base = words.select(ID, HASH, F.size("words").cast("long").alias("n_words"), *[p.alias(f"p{k}") for k, p in enumerate(places)])
    every = F.concat(*[F.col(f"p{k}") for k in range(len(places))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(x)) for k, x in enumerate(PHRASES.values())]))
    base = base.select(ID, HASH, "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))
    joined = base.join(hits, same_row(base, hits, "__mid", "__mhash"), "left")
    joined_labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return joined.select(F.col(ID).alias(id_col), "n_words", "n_base", "first_word", "last_word", joined_labels(F.col("base")).alias("base_labels"), joined_labels(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"), score.alias("score"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(containment: float = 0.8) -> str:
    """The query in DuckDB's SQL: every phrase and every template against every place and block."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    places, shares, labels = [], [], []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(parts) - 1}] = {quoted(parts)}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    for k, (label, text) in enumerate(TEMPLATES):
        words, step = sorted(set(_words(text))), next(x for x in STEPS if x >= len(_words(text)))
        shares.append(f"coalesce(list_max(list_transform(range(0, len(w), {step}), lambda i: len(list_intersect(w[i + 1:i + {2 * step}], {quoted(words)})))), 0) AS s{k}")
        labels.append((k, label, len(words), math.ceil(containment * len(words) - 1e-9)))
    found = ", ".join(f"CASE WHEN s{k} >= {least} THEN '{label}' END" for k, label, _, least in labels)
    score = ", ".join(f"CASE WHEN s{k} >= {least} THEN s{k} / CAST({n} AS DOUBLE) ELSE 0.0 END" for k, _, n, least in labels)
    joined = lambda x: f"coalesce(array_to_string(list_sort(list_distinct({x})), ','), '')"
    return f"""WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    hits AS (SELECT doc_id, len(w) AS n_words, list_concat({", ".join(places)}) AS p, {", ".join(shares)} FROM docs)
    SELECT doc_id, n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(list_transform(p, lambda x: x.at)) AS first_word, list_max(list_transform(p, lambda x: x.at)) AS last_word,
      {joined("list_transform(p, lambda x: x.label)")} AS base_labels, {joined(f"list_concat(list_transform(p, lambda x: x.label), list_filter([{found}], lambda x: x IS NOT NULL))")} AS labels,
      CAST(CASE WHEN len(p) > 0 THEN 1.0 ELSE greatest({score}) END AS DOUBLE) AS score FROM hits"""


SQL = _sql()
