"""Licence scan by a positional index of rare template words, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Notices of common licences, the label of each, and the key phrases that a file with it must have.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Licensed under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ("permission is hereby granted", "without restriction")),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("compliance with the license", "www apache org licenses")),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Phrases that are labels wherever they stand.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Rarest words of a template that the index holds, words by which a key phrase may be moved, and bytes of templates that may be broadcast.
RARE, SLACK, TEMPLATE_BYTES = 6, 3, 8 << 20
#: Score of a base phrase without a verified template.
PHRASE_SCORE = 0.5

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of letters, digits and all beyond ASCII, A-Z in lower case; none for a null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def default_templates(spark: SparkSession) -> DataFrame:
    """TEMPLATES as rows (label, notice, phrases)."""
    rows = [F.struct(F.lit(label).alias("label"), F.lit(notice).alias("notice"), F.array(*map(F.lit, phrases)).alias("phrases")) for label, notice, phrases in TEMPLATES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rare_word_index(docs: DataFrame, templates: DataFrame, text: str = "text", rare: int = RARE) -> DataFrame:
    """One row: words, the indexed ones; postings by word, (template, pos); templates by number, with what a placement needs.

    A template's words of the highest inverse document frequency, counted over all of ``docs`` (ties:
    the lesser word), are indexed with every place they have in it. Words of a document are counted
    once each, and summed before the shuffle, so its size is that of the vocabulary.
    """
    numbered = templates.select("label", words_of(F.col("notice")).alias("notice"), F.transform("phrases", words_of).alias("phrases"))
    numbered = numbered.where(F.size("notice") > 0).withColumn("template", F.row_number().over(Window.orderBy("label", "notice", "phrases")) - 1)
    places = numbered.select("template", F.posexplode("notice").alias("pos", "word"))
    vocabulary = places.agg(F.collect_set("word").alias("vocabulary"))
    seen = docs.select(words_of(F.col(text)).alias("words")).crossJoin(F.broadcast(vocabulary)).select(F.explode(F.array_intersect("words", "vocabulary")).alias("word"))
    frequency = seen.groupBy("word").agg(F.count("*").alias("files"))
    ranked = places.groupBy("template", "word").agg(F.collect_list("pos").alias("at")).join(frequency, "word", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    best = ranked.withColumn("k", F.row_number().over(Window.partitionBy("template").orderBy("files", "word"))).where(F.col("k") <= rare)
    postings = best.select("word", F.explode("at").alias("pos"), "template").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("template", "pos"))).alias("postings"))
    needed = best.groupBy("template").agg(F.sum(F.size("at")).alias("indexed"))
    # A phrase stands in its template where its first word does, so that the rest follows.
    expected = F.transform("phrases", lambda p: F.struct(p.alias("words"), F.coalesce(F.get(_starts(F.col("notice"), p), F.lit(0)), F.lit(0)).alias("at")))
    facts = numbered.join(needed, "template").select(F.struct("template", "label", F.col("notice").alias("words"), expected.alias("phrases"), F.greatest(F.lit(2), F.ceil(F.col("indexed") / 2)).cast("int").alias("votes")).alias("fact"))
    return (
        postings.agg(F.array_sort(F.collect_list("word")).alias("index_words"), F.map_from_entries(F.collect_list(F.struct("word", "postings"))).alias("postings"))
        .crossJoin(F.broadcast(facts.agg(F.array_sort(F.collect_list("fact")).alias("templates"))))
    )


def _starts(words: Column, phrase: Column) -> Column:
    """Where the words of ``phrase`` stand one after another."""
    last = F.size(words) - F.size(phrase)
    at = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull() & (i <= last))
    return F.filter(at, lambda i: F.slice(words, i + 1, F.size(phrase)) == phrase)


def license_scan(docs: DataFrame, templates: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_words, places of base phrases, placements of templates, base_labels, labels and score.

    places: (at, label) of every base phrase, by place. placements: (template, label, at, share) of
    each template that half of its indexed words (two at least) put at the same place of a file with
    two indexed words or more, where all its key phrases stand within three words of where they belong; share is the part of the
    template's words that stand exactly in place. labels: those of base phrases and placements. score:
    the greatest share, 0.5 at least with a base phrase, else 0. Null and empty texts have no words
    and no labels. Rows are judged one by one once words are counted, so ties and repeated rows
    agree; columns of ``docs`` with these names are replaced. ``templates`` (label, notice, phrases)
    may take 8 MiB: the index is one broadcast row.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    size = templates.agg(F.sum(F.octet_length("notice") + F.octet_length(F.array_join("phrases", " ")))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes; at most {TEMPLATE_BYTES} are broadcast")
    index = rare_word_index(docs, templates, text)
    own = ("n_words", "places", "placements", "base_labels", "labels", "score")
    kept = [c for c in docs.columns if c not in own]
    phrases = [(p.split(), label) for p, label in BASE]
    named = F.array(*map(F.lit, sorted({w for p, _ in phrases for w in p})))

    read = docs.select(*kept, words_of(F.col(text)).alias("_words")).crossJoin(F.broadcast(index))
    read = read.select("*", F.array_intersect("_words", named).alias("_named"), F.array_intersect("_words", "index_words").alias("_rare"))

    def places(phrase: list[str], label: str) -> Column:
        whole = F.array(*map(F.lit, phrase))
        at = F.transform(_starts(F.col("_words"), whole), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))
        return F.when(F.size(F.array_intersect("_named", whole)) == len(phrase), at).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))

    hits = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: F.array_contains("_rare", h["word"]))
    vote = lambda h: F.transform(F.element_at("postings", h["word"]), lambda p: F.struct(p["template"].alias("template"), (h["at"] - p["pos"]).alias("at"), p["pos"].alias("pos")))
    votes = F.when(F.size("_rare") > 1, F.array_sort(F.flatten(F.transform(hits, vote))))
    found = read.select("*", F.array_sort(F.concat(*(places(p, label) for p, label in phrases))).alias("places"), votes.alias("_votes"))

    def alike(a: Column, b: Column) -> Column:
        return F.coalesce((a["template"] == b["template"]) & (a["at"] == b["at"]), F.lit(False))

    def enough(v: Column, i: Column) -> Column:
        need = F.get("templates", v["template"])["votes"]
        return alike(v, F.get("_votes", i + need - 1)) & ~alike(v, F.get("_votes", i - 1))

    def in_place(v: Column) -> Column:
        moved = lambda p: F.exists(F.sequence(F.lit(-SLACK), F.lit(SLACK)), lambda d: (v["at"] + p["at"] + d >= 0) & (F.slice("_words", F.greatest(v["at"] + p["at"] + d, F.lit(0)) + 1, F.size(p["words"])) == p["words"]))
        return F.forall(F.get("templates", v["template"])["phrases"], moved)

    def placement(v: Column) -> Column:
        words = F.get("templates", v["template"])["words"]
        same = F.size(F.filter(F.transform(words, lambda w, i: F.get("_words", v["at"] + i) == w), lambda x: x))
        return F.struct(v["template"].alias("template"), F.get("templates", v["template"])["label"].alias("label"), v["at"].cast("long").alias("at"), (same / F.size(words)).alias("share"))

    placed = F.coalesce(F.transform(F.filter(F.filter("_votes", enough), in_place), placement), F.array().cast("array<struct<template:int,label:string,at:bigint,share:double>>"))
    found = found.select("*", placed.alias("placements"), F.array_sort(F.array_distinct(F.col("places.label"))).alias("base_labels"))
    score = F.greatest(F.coalesce(F.array_max(F.col("placements.share")), F.lit(0.0)), F.when(F.size("places") > 0, PHRASE_SCORE).otherwise(0.0))
    return found.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        "places",
        "placements",
        "base_labels",
        F.array_sort(F.array_union("base_labels", F.col("placements.label"))).alias("labels"),
        score.alias("score"),
    )
