"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every sentence or line of every text is a segment. Segments and templates are sparse TF-IDF vectors
(the weights of terms come from the templates); a segment takes the licence of the closest template
if the cosine reaches the threshold, a file that of its closest segment. A licence file (named
LICENSE, LICENCE, COPYING or NOTICE) speaks for its directory. A file without a licence of its own
takes that of the nearest directory above it that has one: directories, not files, are expanded to
their ancestors and joined by path. DataFrame operations only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.common import fresh, left_join_groups, staged

# Public licence headers and opening sentences of licence texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
)
LICENCE_FILE = r"(^|/)(LICEN[CS]E|COPYING|NOTICE)(\.[A-Za-z]+)?$"
TERM = "[a-z0-9]+"
# English function words, and the commonest of them.
MOST_COMMON = set("a and as at be by for from in is it of on or that the this to with".split())
COMMON = set("a all an and any are as at be by for from has have in into is it its no not of on or such that the their this to under was were which will with you your".split())


def template_vectors() -> tuple[list[tuple[int, str, float]], dict[str, float], float]:
    """Unit vectors (template, term, weight), the terms' inverse frequencies, and that of other terms."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    df = Counter(term for c in counts for term in c)
    rarity = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    vectors = []
    for i, c in enumerate(counts):
        norm = math.sqrt(sum((k * rarity[t]) ** 2 for t, k in c.items()))
        vectors += [(i, t, k * rarity[t] / norm) for t, k in sorted(c.items())]
    return vectors, rarity, math.log(1 + len(counts)) + 1


def needed_terms(threshold: float) -> list[str]:
    """Terms of which a segment must hold one to reach the threshold with any template: per
    template the heaviest ones, until the others together are too light. Any such choice is
    complete; common words come last, so that few texts hold one of them."""
    needed = set()
    for i in range(len(TEMPLATES)):
        own = sorted(((t in COMMON or len(t) < 2) + (t in MOST_COMMON), -w, t) for n, t, w in template_vectors()[0] if n == i)
        rest = 1.0
        for _, w, t in own:
            if rest < threshold**2 * 0.999:
                break
            needed.add(t)
            rest -= w * w
    return sorted(needed)


def own_licences(files: DataFrame, path_col: str, text_col: str, threshold: float) -> DataFrame:
    """`path`, `licence`, `cosine` of the files with a segment close enough to a template."""
    spark: SparkSession = files.sparkSession
    vectors, rarity, unseen = template_vectors()
    terms = spark.createDataFrame([(t, rarity[t], [(i, w) for i, u, w in vectors if u == t]) for t in sorted(rarity)], "term string, rarity double, templates array<struct<template:int,weight:double>>")
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(TEMPLATES)], "template int, licence string")
    any_needed = rf"\b({'|'.join(needed_terms(threshold))})\b"
    low = files.select(F.col(path_col).alias("path"), F.lower(text_col).alias("text")).where(F.col("path").isNotNull() & F.col("text").rlike(any_needed))
    lines = low.select("path", F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"([.;!?])[ \t\r\n]+", "$1\n"), "\n"))).alias("line")).where(F.col("line").rlike(any_needed))
    words = lines.select("path", F.xxhash64("line").alias("line"), F.explode(F.regexp_extract_all("line", F.lit(f"({TERM})"), F.lit(1))).alias("term"))
    counted = words.groupBy("path", "line", "term").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(terms), "term", "left")
    counted = counted.withColumn("weight", F.col("tf") * F.coalesce("rarity", F.lit(unseen)))
    # each term once for the norm: with its first template, or without any
    square = F.when(F.col("t").isNull() | (F.col("t.template") == F.col("lead")), F.col("weight") * F.col("weight")).otherwise(0.0)
    norms = counted.select("path", "line", "weight", F.element_at("templates", 1)["template"].alias("lead"), F.explode_outer("templates").alias("t"))
    norms = norms.select("path", "line", F.col("t.template").alias("template"), (F.col("weight") * F.col("t.weight")).alias("dot"), square.alias("square"))
    scored = norms.groupBy("path", "line", "template").agg(F.sum("dot").alias("dot"), F.sum("square").alias("square"))
    per_line = scored.groupBy("path", "line").agg(F.sum("square").alias("square"), F.max(F.struct(F.round("dot", 12).alias("dot"), (-F.col("template")).alias("template"))).alias("best"))
    cosine = F.round(F.col("best.dot") / F.sqrt("square"), 6)
    close = per_line.select("path", (-F.col("best.template")).alias("template"), cosine.alias("cosine")).where(F.col("cosine") >= threshold)
    best = close.groupBy("path").agg(F.max(F.struct("cosine", (-F.col("template")).alias("template"))).alias("best"))
    return best.select("path", (-F.col("best.template")).alias("template"), F.col("best.cosine").alias("cosine")).join(F.broadcast(names), "template").drop("template")


def scan_licences(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """`files` with `licence`, `licence_cosine` and `licence_from`: "own", "inherited" or null.

    The whole text of each file is searched; null, empty and licence-free texts have no licence of
    their own. A null path finds and inherits nothing. Rows that repeat a path share the closest
    licence found in any of them; of two licence files in a directory the closer match speaks, then
    the name first in order. Other columns stay; the three result columns are replaced.
    """
    results = ("licence", "licence_cosine", "licence_from")
    files = files.drop(*results)
    path, folder, size = fresh(files, "_path"), fresh(files, "_folder"), fresh(files, "_size")
    mine, my_cosine, above_licence, above_cosine = (fresh(files, n) for n in ("_own", "_own_cosine", "_inherited", "_inherited_cosine"))
    own = staged(own_licences(files, path_col, text_col, threshold), "own_licences")
    parent = lambda c: F.regexp_replace(F.when(F.col(c).contains("/"), F.col(c)).otherwise(F.concat(F.lit("/"), F.col(c))), "/[^/]*$", "")
    speaking = own.where(F.col("path").rlike(LICENCE_FILE)).select(parent("path").alias("folder"), "licence", "cosine")
    of_folder = speaking.groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("cosine"), "licence")).alias("best"))
    folders = files.where(F.col(path_col).isNotNull()).groupBy(parent(path_col).alias("below")).agg(F.count(F.lit(1)).alias(size))
    # "a/b/c" lies below "a/b/c", "a/b", "a" and ""
    steps = F.split("below", "/")
    above = folders.select("below", size, F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth"), steps.alias("steps"))
    above = above.select("below", size, "depth", F.array_join(F.slice("steps", F.lit(1), F.col("depth")), "/").alias("folder"))
    nearest = above.join(of_folder, "folder").groupBy("below", size).agg(F.max(F.struct("depth", "best.licence", "best.cosine")).alias("found"))
    nearest = staged(nearest.select(F.col("below").alias(folder), size, F.col("found.licence").alias(above_licence), (-F.col("found.cosine")).alias(above_cosine)), "nearest")
    total = files.count()
    keyed = files.withColumns({path: F.col(path_col), folder: parent(path_col)})
    rows = left_join_groups(keyed, nearest, folder, size, total).join(own.select(F.col("path").alias(path), F.col("licence").alias(mine), F.col("cosine").alias(my_cosine)), path, "left")
    found_in = F.when(F.col(mine).isNotNull(), "own").when(F.col(above_licence).isNotNull(), "inherited")
    return rows.select(*files.columns, F.coalesce(mine, above_licence).alias("licence"), F.coalesce(my_cosine, above_cosine).alias("licence_cosine"), found_in.alias("licence_from"))


def document_tree(docs: DataFrame) -> DataFrame:
    """A file tree for documents, which have no paths: source / thousand / hundred / file, where the
    first of each hundred, and of each thousand a level up, is the folder's licence file."""
    thousand, hundred = (F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 100))
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), thousand)
    name = F.when(F.col("doc_id") % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).when(F.col("doc_id") % 100 == 0, F.concat_ws("/", top, hundred, F.lit("LICENSE")))
    return docs.select("doc_id", F.coalesce(name, F.concat_ws("/", top, hundred, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))).alias("path"), "text")
