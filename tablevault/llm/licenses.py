"""License scans by an exact set-similarity join.

Templates are token sets. A text block (a line, or two or three lines in a row, since notices wrap)
meets a template if it holds at least ``threshold`` of the template's tokens. Tokens are ordered by
their frequency over all documents, rarest first; a block that meets a template of n tokens with an
overlap of a or more must hold one of the template's n - a + 1 rarest tokens (prefix filter), must have a
tokens of the vocabulary at all (length filter), and a left from the shared token on, in the block and in
the template (positional filter). What passes is compared in full, so the join is exact.

Beside the join, three phrases are found word by word (``PHRASES``); their labels are the base labels.

Only DataFrame functions. The templates are a parameter, and their tokens travel as literals: their
number is checked against ``MOST_TOKENS``, and larger template sets are scanned in blocks.

Defined results: a null text is empty: no words, no places, score 0; rows equal in id and text get the
same result; other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevault.llm.common import row_key, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Opening sentences of public licences (fixed values).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
                   " http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            " documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
            " the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
            " Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
            " granted"),
)
THRESHOLD = 0.9
MOST_TOKENS = 2_000
LINES = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text in order; only A-Z are lower-cased."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS, -1), lambda w: w != "")


def template_tokens(text: str) -> list[str]:
    """The same words, for a template (ASCII text)."""
    lowered = "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in text)
    return sorted(set("".join(c if c.isdigit() or c in LOWER or ord(c) > 127 else " " for c in lowered).split()))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def token_order(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each token of the vocabulary by the number of documents that hold it, rarest first.

    Its result has a row per token of the vocabulary at most.
    """
    held = words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}


def _literal_rows(rows: list[tuple], names: list[str], df: DataFrame) -> DataFrame:
    """A small DataFrame of literals."""
    structs = F.array(*[F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(n)
                                   for n, v in zip(names, r, strict=True)]) for r in rows])
    return df.sparkSession.range(1).select(F.explode(structs).alias("r")).select("r.*")


def template_matches(docs: DataFrame, id_col: str, text_col: str, templates=TEMPLATES,
                     threshold: float = THRESHOLD) -> DataFrame:
    """Every (key, label) with a block that meets a template, and the best containment."""
    sets = [(label, template_tokens(text)) for label, text in templates]
    vocabulary = sorted({t for _, tokens in sets for t in tokens})
    few = docs.select(row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    order = token_order(few.select(words_of(F.col("text")).alias("words")), vocabulary)
    index, full = [], []
    for number, (_, tokens) in enumerate(sets):
        ranks = sorted(order[t] for t in tokens)
        least = math.ceil(threshold * len(ranks) - 1e-9)
        full.append(ranks)
        index += [(rank, number, at, least) for at, rank in enumerate(ranks[:len(ranks) - least + 1])]
    by_rank = sorted(order, key=order.get)
    prefix = sorted({by_rank[rank] for rank, *_ in index})
    # the cheap test first: only texts that hold a prefix token are cut into blocks at all
    lines = (few.filter(F.translate("text", UPPER, LOWER).rlike("|".join(prefix)))
             .select("key", F.split("text", "\n", -1).alias("lines")))
    ranked = F.transform("lines", lambda x: F.array_intersect(words_of(x), _strings(vocabulary)))
    lines = lines.select("key", ranked.alias("lines"))
    lines = lines.select("key", F.filter("lines", lambda x: F.size(x) > 0).alias("lines"))
    windows = F.flatten(F.transform(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.transform(
        F.sequence(F.lit(1), F.lit(LINES)), lambda k: F.array_distinct(F.flatten(F.slice(F.col("lines"), i + 1, k))))))
    blocks = (lines.withColumn("windows", F.when(F.size("lines") > 0, windows))
              .select("key", F.explode_outer("windows").alias("tokens"))
              .filter(F.arrays_overlap("tokens", _strings(prefix))))
    ranks = F.array_sort(F.transform("tokens", lambda t: F.array_position(_strings(by_rank), t) - 1))
    blocks = blocks.select("key", ranks.alias("ranks")).select("key", "ranks", F.posexplode("ranks").alias("at", "rank"))
    entries = F.broadcast(_literal_rows(index, ["rank", "template", "place", "least"], docs)
                          .select(F.col("rank").cast("long"), "template", "place", "least"))
    sizes = _literal_rows([(i, label, f, len(f)) for i, ((label, _), f) in enumerate(zip(sets, full, strict=True))],
                          ["template", "label", "all", "n"], docs)
    n_all = F.create_map(*[x for i, f in enumerate(full) for x in (F.lit(i), F.lit(len(f)))])
    passed = (blocks.join(entries, "rank")
              .filter((F.size("ranks") - F.col("at") >= F.col("least"))
                      & (n_all[F.col("template")] - F.col("place") >= F.col("least"))))
    checked = passed.join(F.broadcast(sizes), "template")
    overlap = F.size(F.array_intersect("ranks", F.col("all").cast("array<bigint>")))
    return (checked.withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("least"))
            .groupBy("key", "label").agg(F.max(F.col("overlap") / F.col("n")).alias("score")))


def _stands(parts: list[str]):
    """A test of a word's index: do the parts stand there?"""

    def test(i: Column) -> Column:
        hit = F.col("_words")[i] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit &= F.coalesce(F.get(F.col("_words"), i + k) == part, F.lit(False))
        return hit

    return test


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """Per row: its id, words, places of the phrases, base labels, all labels, and the best score."""
    blocks, block, held = [], [], set()
    for label, text in templates:
        tokens = template_tokens(text)
        if block and len(held.union(tokens)) > MOST_TOKENS:
            blocks.append(block)
            block, held = [], set()
        block.append((label, text))
        held.update(tokens)
    matches = None
    for part in [*blocks, block] if block else []:
        found = template_matches(docs, id_col, text_col, part, threshold)
        matches = found if matches is None else matches.unionByName(found)
    df = docs.select(row_key(id_col, text_col).alias("_key"), F.col(id_col).alias("doc_id"),
                     words_of(text_of(text_col)).alias("_words"))
    at, starts = F.sequence(F.lit(0), F.size("_words") - 1), []
    for phrase, label in PHRASES:
        parts = phrase.split()
        held = F.array_contains("_words", parts[0]) & F.array_contains("_words", parts[-1])
        df = df.withColumn(f"_{label}", F.when(held, F.filter(at, _stands(parts))).otherwise(F.array().cast("array<int>")))
        starts.append((f"_{label}", label))
    found = F.concat(*[F.col(n) for n, _ in starts])
    base = F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in starts]))
    df = df.select("_key", "doc_id", F.size("_words").cast("long").alias("n_words"),
                   F.size(found).cast("long").alias("n_base"), F.array_min(found).cast("long").alias("first_word"),
                   F.array_max(found).cast("long").alias("last_word"), F.array_sort(base).alias("_base"))
    if matches is None:
        df = df.withColumn("_labels", F.array().cast("array<string>")).withColumn("_score", F.lit(0.0))
    else:
        own = matches.groupBy("key").agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score"))
        df = df.join(own.withColumnRenamed("key", "_key"), "_key", "left")
    every = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_labels", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("_score", F.lit(0.0)), F.when(F.size("_base") > 0, 1.0).otherwise(0.0))
    return df.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
                     F.array_join(every, ",").alias("labels"), score.alias("score"))
