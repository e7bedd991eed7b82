"""Licence notices by MinHash sketches over overlapping windows, in DataFrame functions only.

A template's set is its word 5-shingles (all words if it has fewer).  Templates are put into size classes; a class reads
texts in windows of twice its size at steps of its size, so every occurrence lies whole in one window.  Only
shingles that some template has can be common to a window and a template; a bitmap of fixed size lets these through
and drops the rest where they are read, and windows are compared over what remains.

A template's sketch is the MinHash one of its own: those of its shingles with the least hashes, one more than a
matching window may lack and at least ``BANDS``.  A window that holds one of them retrieves the template, so whatever else it
holds, none that matches is missed.  Retrieved templates are verified by exact containment: the share of the template's shingles
that the window holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import bit_table, in_bits, row_key
from sourceloom.llm.decontamination import gram_hashes, words_of
from sourceloom.session import Workspace

SHINGLE = 5
BANDS = 16
CONTAINMENT = 80  # percent
SMALLEST = 16  # words of the smallest size class

# Public notices as they are commonly put at the head of a work.
TEMPLATES = [
    ("apache-2.0-short", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
     "with the License. You may obtain a copy of the License at"),
    ("mit-short", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl-3.0-short", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
]


def _shingled(df: DataFrame, shingle: int) -> DataFrame:
    """``df`` with words, replaced by grams: hashes of its shingles."""
    hashed = df.withColumn("_hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("words")).drop("words")
    return hashed.withColumn("grams", gram_hashes(F.col("_hashes"), shingle)).drop("_hashes")


def license_scan(ws: Workspace, docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id",
                 text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, percent: int = CONTAINMENT) -> DataFrame:
    """Per row: id, n_licenses, licenses (sorted ids, comma-joined), best (highest percentage of a template's shingles, 0 for none).

    A template matches a text if one window holds at least ``percent`` of its distinct shingles.  Templates need ``shingle`` words.
    Null and short texts match nothing.  Repeated rows come out alike, null ids as they are.  Other columns are not
    read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame(TEMPLATES if templates is None else templates, "license string, text string")
    known = _shingled(given.select("license", words_of(F.col("text")).alias("words")), shingle).where(F.size("grams") > 0)
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("n_words", F.lit(SMALLEST)).cast("double")))).cast("int")
    library = ws.save(known.select("license", power.alias("span"), F.explode_outer(F.array_distinct("grams")).alias("hash")))
    sizes = library.groupBy("license").agg(F.count(F.lit(1)).alias("size"))

    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), words_of(F.col(text_col)).alias("words"))
    grams = _shingled(texts, shingle).select("id", "row", F.posexplode_outer("grams").alias("pos", "hash"))
    # a first shingle, or none, stands for its row in the result
    bits = ws.save(bit_table(library.select("hash").distinct(), "hash"))
    passed = in_bits(grams, F.coalesce("hash", F.lit(0)), bits).where(F.col("_maybe") | F.coalesce("pos", F.lit(0)).eqNullSafe(F.lit(0)))
    found = ws.save(passed.select("id", "row", "pos", "hash"))

    # each position lies in two windows of every class that has its shingle
    classes = library.select("span", "hash").distinct()
    at = F.floor(F.col("pos") / F.col("span"))
    windows = ws.save(found.where("hash IS NOT NULL").join(classes, "hash").withColumn("window", F.explode_outer(F.array(at, at - 1)))
                      .select("id", "row", "span", "window", "hash").distinct())
    drawn = library.groupBy("license", "span").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("hash").alias("draw"), "hash"))).alias("drawn"))
    lacking = F.size("drawn") - F.ceil(F.size("drawn") * percent / 100)
    sketch = drawn.select("license", "span", F.explode_outer(F.slice("drawn", F.lit(1), F.greatest(F.lit(bands), lacking + 1).cast("int"))).alias("least"))
    retrieved = windows.join(sketch.select("license", "span", F.col("least.hash").alias("hash")), ["span", "hash"]).select(
        "id", "row", "span", "window", "license").distinct()

    in_window = lambda a, b: (F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))
                              & (F.col(f"{a}.span") == F.col(f"{b}.span")) & (F.col(f"{a}.window") == F.col(f"{b}.window")))
    held = retrieved.alias("r").join(windows.alias("w"), in_window("r", "w")).select("r.id", "r.row", "r.window", "r.license", "w.hash").join(
        library.select("license", "hash"), ["license", "hash"])
    share = F.floor(F.col("held") * 100 / F.col("size")).cast("int")
    verified = held.groupBy("id", "row", "window", "license").agg(F.count(F.lit(1)).alias("held")).join(sizes, "license").where(
        F.col("held") * 100 >= F.col("size") * percent).groupBy("id", "row", "license").agg(F.max(share).alias("share"))
    listed = verified.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n_licenses"),
                                               F.concat_ws(",", F.sort_array(F.collect_list("license"))).alias("licenses"), F.max("share").alias("best"))
    rows = found.where(F.coalesce("pos", F.lit(0)) == 0).select("id", "row").alias("d")
    joined = rows.join(listed.alias("l"), F.col("d.id").eqNullSafe(F.col("l.id")) & (F.col("d.row") == F.col("l.row")), "left")
    return joined.select(F.col("d.id").alias(id_col), F.coalesce("n_licenses", F.lit(0)).cast("bigint").alias("n_licenses"),
                         F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0)).alias("best"))
