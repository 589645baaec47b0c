"""License scans by diagonal voting, all in DataFrame functions.

1. Every text's words give one rolling two-word gram a position; its XXH64 is
   joined to the grams of the templates (a fixed list, so a table of known size is
   broadcast).  Positions whose hash no template has don't reach the join; its
   condition compares the two words themselves.
2. A hit votes for its diagonal, word position minus template position.  Votes are
   folded before the exchange: a document without a hit is one row.
3. Neighbouring diagonals (words left out or put in) merge to islands.
4. Spans are verified: a phrase needs all its grams on one diagonal; a notice needs
   ``COVER`` of its distinct grams in an island.

Nothing is exchanged but a row per document and hit diagonal; a document's rows
are bounded by its own length.

Defined cases: null text counts as empty and has no words; documents without a hit
have null positions, empty labels and score zero.  Rows are told apart by row
number, so null and repeated ids each give a row; an empty table gives an empty table.
Letters beyond A-Z are lower-cased too, which changes no word boundary and no hit:
no other character lower-cases to a letter of the phrases alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_columns, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Part of a notice's grams that an island needs, and the step between diagonals that merge.
COVER, STEP = 0.85, 3

# The phrases that every scan has.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Longer notices: what this scan adds.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def template_grams(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(th, w1, w2, label, base, grams, tid, tpos): a row per gram; at most 63 grams a template."""
    rows = []
    for tid, (label, text, base) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        words = text.split()
        if not 2 <= len(words) <= 64:
            raise ValueError(f"a template has 2 to 64 words: {text}")
        rows += [(a, b, label, base, len(words) - 1, tid, i) for i, (a, b) in enumerate(zip(words, words[1:]))]
    table = spark.createDataFrame(rows, "w1 string, w2 string, label string, base boolean, grams int, tid int, tpos int")
    return table.withColumn("th", F.xxhash64("w1", "w2"))


def diagonals(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(uid, doc_id, n_words, tid, label, base, grams, diagonal, mask): a row per
    document and hit diagonal, and one without template per document."""
    docs = doc_columns(docs, ("doc_id", "bigint"), ("text", "string"))
    words = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.regexp_extract_all(F.lower(text_of()), F.lit(WORD), F.lit(0)).alias("words"))
    # Grams that no template has go before the explode; each row of it then holds two words, not the text's.
    known = [r.th for r in templates.select("th").distinct().collect()]
    hashes = F.transform("words", lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1)).alias("h"), i.alias("pos")))
    grams = F.transform(F.filter(hashes, lambda g: g.h.isin(known)), lambda g: F.struct(g.h, g.pos, F.get("words", g.pos).alias("a"), F.get("words", g.pos + 1).alias("b")))
    each = words.select("uid", "doc_id", F.size("words").cast("bigint").alias("n_words"), grams.alias("grams_")).select("uid", "doc_id", "n_words", F.explode_outer("grams_").alias("g"))
    each = each.select("uid", "doc_id", "n_words", "g.*")
    same = (F.col("h") == F.col("th")) & (F.col("a") == F.col("w1")) & (F.col("b") == F.col("w2"))
    hits = each.join(F.broadcast(templates), same, "left")
    return hits.groupBy("uid", "doc_id", "n_words", "tid", "label", "base", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("mask"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, cover: float = COVER, step: int = STEP) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per document."""
    found = diagonals(docs, template_grams(docs.sparkSession, phrases, notices))
    order = Window.partitionBy("uid", "tid").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > step, F.lit(True))
    # A phrase's diagonals stay apart: each is a place of its own.
    islands = found.withColumn("new", F.when(F.coalesce("base", F.lit(True)) | apart, 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    spans = islands.groupBy("uid", "doc_id", "n_words", "tid", "label", "base", "grams", "island").agg(F.bit_or("mask").alias("mask"), F.min("diagonal").alias("start"))
    cov = F.coalesce(F.bit_count("mask") / F.col("grams"), F.lit(0.0))
    spans = spans.withColumn("cover", cov)
    whole = F.col("base") & (F.col("cover") == 1)
    valid = whole | (~F.col("base") & (F.col("cover") >= cover))
    score = F.when(valid, 1.0).when(~F.col("base"), F.col("cover")).otherwise(0.0)

    def joined(labels):
        return F.array_join(F.array_sort(labels), ",")

    return spans.groupBy("uid", "doc_id", "n_words").agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(whole, F.col("start"))).cast("bigint").alias("last_word"),
        joined(F.collect_set(F.when(whole, F.col("label")))).alias("base_labels"),
        joined(F.collect_set(F.when(valid, F.col("label")))).alias("labels"),
        F.max(score).alias("score"),
    ).drop("uid")
