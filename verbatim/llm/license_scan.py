"""License scans by diagonal voting, in DataFrame operations alone.

Every two consecutive words of every document are hashed and joined to the positions of the same two
words in license templates (a table written below, so its size is fixed). A hit at document word p
and template word q votes for the diagonal p - q, where the template's first word would stand. Votes
are gathered by diagonal, neighbouring diagonals (an inserted or lost word moves what follows) are
merged, and a span counts by the share of the template's word pairs that it really holds: the join
compares the words themselves besides their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Wordings by which the method adds labels of its own.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)
NEIGHBOURS = 2
LEAST_COVERED = 0.7
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def template_grams(spark, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row for each pair of consecutive words of each template (64 pairs at most)."""
    rows = []
    for t, (label, text) in enumerate([*phrases, *templates]):
        words = text.split()
        if not 2 <= len(words) <= 64:
            raise ValueError("a template has from 2 to 64 words")
        rows += [(t, label, t < len(phrases), len(words) - 1, q, a, b) for q, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    grams = spark.createDataFrame(rows, "t int, label string, base boolean, n_grams int, q int, a string, b string")
    return grams.withColumn("gram", F.xxhash64("a", "b"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, least_covered: float = LEAST_COVERED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each document.

    Words are as in WORD after lower-casing; null and empty texts have none, and with no span found
    n_base is 0, first_word and last_word are null, label lists are empty and the score is 0. Each
    row of ``docs`` gives one row, also where doc_id is null or repeated; more columns are left out.
    score is the largest covered share of a template, 1 where a base phrase stands.
    """
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORD), 0).alias("words"))
    sized = words.withColumn("n_words", F.size("words").cast("long"))
    pairs = sized.select("doc_id", "row", "n_words", F.posexplode_outer(F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.size("words")).alias("b"))).alias("p", "pair"))
    pairs = pairs.select("doc_id", "row", "n_words", "p", F.col("pair.a").alias("wa"), F.col("pair.b").alias("wb"))
    grams = F.broadcast(template_grams(docs.sparkSession, phrases, templates))
    on = (F.xxhash64("wa", "wb") == F.col("gram")) & (F.col("wa") == F.col("a")) & (F.col("wb") == F.col("b"))
    hits = pairs.join(grams, on, "left")
    of_row = ["row", "doc_id", "n_words"]
    of_template = ["t", "label", "base", "n_grams"]
    start = F.when(F.col("t").isNotNull(), F.col("p") - F.col("q")).alias("start")
    votes = hits.groupBy(*of_row, *of_template, start).agg(F.bit_or(F.expr("shiftleft(1L, q)")).alias("held"))
    near = Window.partitionBy("row", "t").orderBy("start").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    full = F.col("base") & (F.bit_count("held") == F.col("n_grams"))
    spans = votes.withColumn("merged", F.bit_or("held").over(near)).select(
        *of_row, "label", "start", full.alias("full"),
        F.when(~F.col("base"), F.bit_count("merged") / F.col("n_grams")).alias("covered"),
    )
    found = F.when(F.col("full") | (F.col("covered") >= least_covered), F.col("label"))
    names = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    out = spans.groupBy(*of_row).agg(
        F.count_if("full").alias("n_base"),
        F.min(F.when(F.col("full"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("full"), F.col("start"))).cast("long").alias("last_word"),
        names(F.when(F.col("full"), F.col("label"))).alias("base_labels"),
        names(found).alias("labels"),
        F.coalesce(F.max(F.when(F.col("full"), 1.0).otherwise(F.col("covered"))), F.lit(0.0)).alias("score"),
    )
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
