"""Licence scans by diagonal voting, in DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkatlas.llm.exact import ascii_lower
from linkatlas.session import durable

# All but ASCII letters, ASCII digits and characters beyond ASCII stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Label and words of the phrases that count wherever they stand in one run.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
# Label and words of public notices, found also where words were changed, added or lost.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-program", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]
GAP = 3
PERCENT = 70


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], exact: int) -> DataFrame:
    """One row per rolling run of three words of each template (two, where that is all it has): ``template``, ``label``, ``exact``, ``total`` (words),
    ``grams``, ``tpos``, and the words ``t0``, ``t1``, ``t2``. The first ``exact`` templates count only as whole runs. The list is the caller's own and short."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words = text.split()
        size = min(3, len(words))
        if size < 2 or not re.fullmatch("[a-z0-9 ]+", text):
            raise ValueError(f"a template has two words or more, of a-z and 0-9: {text!r}")
        grams = len(words) - size + 1
        rows += [(number, label, number < exact, len(words), grams, i, *(words[i:i + size] + [None])[:3]) for i in range(grams)]
    return spark.createDataFrame(rows, "template int, label string, exact boolean, total int, grams int, tpos int, t0 string, t1 string, t2 string")


def _diagonals(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Votes per diagonal: ``row``, ``doc_id``, ``n_words``, and where a template was met ``template``, its columns, ``diagonal`` (place in the text less
    place in the template) and ``at`` (the places in the template that voted). Each row of ``docs`` has one line at least.

    Every run of two words is looked up by its hash; a hit counts where the words themselves, and the third one, are the same. So all words of a vote are
    verified as it is cast, and the text need not be met again. The votes of a row are summed by its own task before they are shuffled.
    """
    words = F.filter(F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), BETWEEN), lambda w: w != "")
    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), words.alias("w")).withColumn("row", F.monotonically_increasing_id())
    n = F.size("w")
    runs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(n, F.lit(1))).alias("b"), F.slice("w", 3, F.greatest(n, F.lit(1))).alias("c"))
    each = slim.select("row", "doc_id", n.cast("bigint").alias("n_words"), F.posexplode_outer(runs).alias("pos", "run"))
    low: dict[str, Column] = {c: ascii_lower(F.col(f"run.{c}")) for c in "abc"}
    each = each.select("row", "doc_id", "n_words", "pos", low["a"].alias("a"), low["b"].alias("b"), F.col("run.c").alias("c"))
    keyed = grams.withColumn("hash", F.xxhash64("t0", "t1"))
    same = (F.xxhash64("a", "b") == F.col("hash")) & (F.col("a") == F.col("t0")) & (F.col("b") == F.col("t1")) & (
        F.col("t2").isNull() | (ascii_lower(F.col("c")) == F.col("t2")))
    met = each.join(F.broadcast(keyed), same, "left").filter(F.col("template").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    return met.groupBy("row", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("exact").alias("exact"),
        F.first("total").alias("total"), F.first("grams").alias("grams"), F.collect_set("tpos").alias("at"))


def license_spans(diagonals: DataFrame, gap: int = GAP) -> DataFrame:
    """One row per place: ``row``, ``label``, ``exact``, ``start``, ``stop`` (words from 0, ``stop`` behind the last), ``coverage`` (share of the template's words found).

    Whole phrases are diagonals that got every vote. Of the notices, diagonals at most ``gap`` apart are merged, since a word that was added or lost shifts
    what follows it by one; a template word counts once, however many of the merged diagonals hold it.
    """
    hit = diagonals.filter("template is not null")
    place = F.col("diagonal").cast("bigint")
    phrases = hit.filter(F.col("exact") & (F.size("at") == F.col("grams"))).select(
        "row", "label", "exact", place.alias("start"), (place + F.col("total")).alias("stop"), F.lit(1.0).alias("coverage"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(along) > gap
    merged = hit.filter(~F.col("exact")).withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("span", F.sum("far").over(along))
    votes = merged.select("*", F.explode("at").alias("tpos"))
    spans = votes.groupBy("row", "template", "span").agg(
        F.first("label").alias("label"), F.first("total").alias("total"), F.min(place + F.col("tpos")).alias("start"),
        (F.max(place + F.col("tpos")) + 3).alias("stop"), F.collect_set("tpos").alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.array(t, t + 1, t + 2)))))
    notices = spans.select("row", "label", F.lit(False).alias("exact"), "start", "stop", (covered / F.col("total")).alias("coverage"))
    return phrases.unionByName(notices)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES,
                 notices: list[tuple[str, str]] = NOTICES, percent: int = PERCENT, gap: int = GAP) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``n_base`` counts the places where a phrase stands word by word, ``first_word`` and ``last_word`` are the least and greatest start (null if none).
    ``labels`` adds the notices of which a merged span holds at least ``percent`` hundredths of the words, verified and in their order up to ``gap`` words.
    ``score`` is the greatest coverage of any place, 0 if none; a phrase has 1. Null or empty texts have no words and nothing else. Rows that repeat an id are
    rows of their own, and a null id is kept. An empty table gives no rows. The notices are broadcast: they come from the caller's list, not from the data.
    """
    grams = template_grams(docs.sparkSession, [*phrases, *notices], len(phrases))
    diagonals = durable(_diagonals(docs, grams, id_col, text_col))
    spans = license_spans(diagonals, gap)
    base, long_enough = F.col("exact"), F.col("coverage") * 100 >= percent
    rows = diagonals.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    found = spans.groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_set"), F.collect_set(F.when(long_enough, F.col("label"))).alias("label_set"),
        F.max("coverage").alias("score"))
    listed = lambda c: F.array_join(F.sort_array(F.coalesce(c, F.array().cast("array<string>"))), ",")
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        listed(F.col("base_set")).alias("base_labels"), listed(F.col("label_set")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
