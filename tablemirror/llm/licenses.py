"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A text's words are cut into overlapping blocks of ``2 * stride`` words, so that any run of up to ``stride`` words
lies whole in a block. A block matches a template if it contains at least ``threshold`` of the template's distinct
words (all of them for a base phrase). Words are ordered by how often they occur in the whole corpus, rarest first;
the join then needs

* the prefix filter: a block and a template with ``need`` words in common share one among the first
  ``size - need + 1`` words of each (counted among template words, as others cannot match);
* the length filter: a block with fewer than ``need`` template words is out;
* the positional filter: from the first common word on, enough words must be left on both sides;

and a pair is made once, at its first common word. What is left is verified on the full sets. Base phrases are
templates with threshold 1 whose words must also stand consecutively; each place counts once, in the block that
owns its first word. Only the template index (bounded by the templates given) is broadcast; texts are never
shuffled, only per-document sums are.

Defined cases: a null or empty text has 0 words, no places, empty label lists and score 0; null and repeated ids keep
one row per input row; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.llm.common import lower_ascii, only

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"       # the same before lower-casing
STRIDE = 128
THRESHOLD = 0.8

# The phrases of the contract.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

# Public license wording, shortened to the telling sentences.
TEMPLATES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the "
                 "license you may obtain a copy of the license at unless required by applicable law or agreed to in "
                 "writing software distributed under the license is distributed on an as is basis without warranties or "
                 "conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met redistributions of source code must retain the above copyright notice "
            "this list of conditions and the following disclaimer"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and "
            "related or neighboring rights to this work"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version of the license or at your "
            "option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify "
                  "publish use compile sell or distribute this software"),
)


def index_rows(words_of: Sequence[tuple[str, list[str], bool]], threshold: float, order: Mapping[str, int]) -> list[tuple]:
    """(word, position, label, is base, phrase, ordered set, need): one row per template and word of its prefix."""
    rows = []
    for label, words, base in words_of:
        ordered = sorted(set(words), key=order.__getitem__)
        need = len(ordered) if base else max(1, math.ceil(threshold * len(ordered) - 1e-9))
        for position, word in enumerate(ordered[:len(ordered) - need + 1]):
            rows.append((word, position, label, base, words if base else [], ordered, need))
    return rows


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES,
                  templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                  stride: int = STRIDE) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest containment found)."""
    spark = docs.sparkSession
    words_of = [(label, words.split(), True) for label, words in phrases.items()]
    words_of += [(label, words.split(), False) for label, words in templates]
    if max(len(words) for _, words, _ in words_of) > stride:
        raise ValueError("a template may have as many words as the stride, not more")
    vocabulary = sorted({w for _, words, _ in words_of for w in words})
    rows = only(docs, _key=key, _text=text).select("_key", F.coalesce("_text", F.lit("")).alias("_text"))

    # Global frequencies of the template words: a few hundred numbers.
    spoken = rows.select(F.explode(F.split(F.lower("_text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("w"))
    counts = dict(spoken.filter(F.col("w").isin(vocabulary)).groupBy("w").count().collect())
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    entries = index_rows(words_of, threshold, {w: i for i, w in enumerate(ordered)})
    index = spark.createDataFrame(entries, "_word string, _tpos int, _label string, _base boolean, _phrase array<string>, "
                                           "_template array<string>, _need int")

    starts = F.array(*[F.lit(w) for w in sorted({e[0] for e in entries})])
    raw = rows.select("_key", F.monotonically_increasing_id().alias("_row"), "_text",
                      F.regexp_extract_all("_text", F.lit(RAW_WORD), F.lit(0)).alias("_raw"))
    # Lower case as a whole finds no fewer candidates; the words that count are lower-cased by A-Z alone.
    hopeful = F.arrays_overlap(F.split(F.lower("_text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), starts)
    blocks_of = F.greatest(F.lit(1), F.ceil(F.size("_words") / F.lit(stride)) - 1).cast("int")
    blocks = (raw.select("_key", "_row", F.size("_raw").cast("long").alias("_n"),
                         F.when(hopeful, F.regexp_extract_all(lower_ascii(F.col("_text")), F.lit(WORD), F.lit(0))).alias("_words"))
              .select("_key", "_row", "_n", F.explode_outer(F.transform(
                  F.when(F.col("_words").isNotNull(), F.sequence(F.lit(0), blocks_of - 1)),
                  lambda b: F.struct(b.alias("no"), (b == blocks_of - 1).alias("last"),
                                     F.slice("_words", b * stride + 1, 2 * stride).alias("words")))).alias("_block")))
    own = F.array_intersect(F.array(*[F.lit(w) for w in ordered]), F.col("_block.words"))    # in global order
    tokens = (blocks.withColumn("_own", own)
              .select("*", F.posexplode_outer("_own").alias("_pos", "_word")))
    size, left = F.size("_own"), F.col("_need")
    possible = ((size >= left) & (F.col("_pos") <= size - left) & (F.col("_tpos") <= F.size("_template") - left)
                & (1 + F.least(size - F.col("_pos"), F.size("_template") - F.col("_tpos")) - 1 >= left)
                & (F.size(F.array_intersect(F.slice("_own", 1, F.col("_pos")),
                                            F.slice("_template", 1, F.col("_tpos")))) == 0))
    pairs = tokens.join(F.broadcast(index), "_word", "left")
    overlap = F.when(possible, F.size(F.array_intersect("_own", "_template")))
    starting = F.when(F.col("_block.last"), F.size("_block.words") - 1).otherwise(F.least(
        F.lit(stride - 1), F.size("_block.words") - 1))
    places = F.filter(F.sequence(F.lit(0), starting),
                      lambda i: F.slice("_block.words", i + 1, F.size("_phrase")) == F.col("_phrase"))
    verified = (pairs.withColumn("_overlap", overlap)
                .withColumn("_share", F.when(F.col("_overlap") >= left, F.col("_overlap") / F.size("_template")))
                .withColumn("_places", F.when(F.col("_share").isNotNull() & F.col("_base"), places)))
    found = F.size("_places") > 0
    place = lambda fn: F.when(found, fn("_places").cast("long") + F.col("_block.no").cast("long") * stride)     # noqa: E731
    hit = F.when(F.when(F.col("_base"), found).otherwise(F.col("_share").isNotNull()), F.col("_label"))
    per_row = verified.groupBy("_row", "_key", "_n").agg(
        F.coalesce(F.sum(F.when(found, F.size("_places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(place(F.array_min)).alias("first_word"), F.max(place(F.array_max)).alias("last_word"),
        F.collect_set(F.when(F.col("_base"), hit)).alias("_base_labels"), F.collect_set(hit).alias("_labels"),
        F.coalesce(F.max(F.when(hit.isNotNull(), F.col("_share"))), F.lit(0.0)).alias("score"))
    return per_row.select(
        F.col("_key").alias(key), F.col("_n").alias("n_words"), "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort("_labels"), ",").alias("labels"), "score")


def brute_force_sql(table: str = "documents", stride: int = STRIDE, threshold: float = THRESHOLD) -> str:
    """The same result in DuckDB SQL, by comparing every block with every template."""
    def listed(words: Sequence[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    rows = [(label, words.split(), True) for label, words in PHRASES.items()]
    rows += [(label, words.split(), False) for label, words in TEMPLATES]
    values = ", ".join(f"('{label}', {listed(words)}, {listed(sorted(set(words)))}, {str(base).lower()}, "
                       f"{len(set(words)) if base else math.ceil(threshold * len(set(words)) - 1e-9)})"
                       for label, words, base in rows)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
    WITH templates(label, phrase, words, base, need) AS (VALUES {values}),
    d AS (SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '{word}') AS w FROM {table}),
    b AS (SELECT r, no, no = greatest(1, ceil(len(w) / {stride}.0)::INT - 1) - 1 AS last, w[no * {stride} + 1 : (no + 2) * {stride}] AS bw
          FROM (SELECT r, w, unnest(range(greatest(1, ceil(len(w) / {stride}.0)::INT - 1))) AS no FROM d)),
    p AS (SELECT r, no, label, base, len(list_intersect(list_distinct(bw), words)) / len(words)::DOUBLE AS share,
                 CASE WHEN base THEN list_filter(range(CASE WHEN last THEN len(bw) ELSE least({stride}, len(bw)) END),
                                                 lambda i: bw[i + 1 : i + len(phrase)] = phrase) ELSE [] END AS places
          FROM b, templates WHERE len(list_intersect(list_distinct(bw), words)) >= need),
    h AS (SELECT r, label, base, share, len(places) AS n, list_min(places) + no * {stride} AS lo, list_max(places) + no * {stride} AS hi
          FROM p WHERE NOT base OR len(places) > 0),
    s AS (SELECT r, sum(n) AS n_base, min(lo) AS first_word, max(hi) AS last_word, max(share) AS score,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
           last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           coalesce(score, 0)::DOUBLE AS score
    FROM d LEFT JOIN s USING (r)"""
