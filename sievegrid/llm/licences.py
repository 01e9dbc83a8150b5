"""Licence scans: sparse TF-IDF cosine of headers and whole files to licence templates, then inheritance by path joins.

Templates are headers, as files carry them, and whole licence texts (``licence_texts``). A text is
judged as a whole and by its header blocks: it is cut into pieces (lines, or the sentences of long
lines), and every run of up to five pieces is a block, so a header is found however it is wrapped. A
term weighs (1 + ln tf) * idf, with document frequencies counted over all texts.

Only what can reach the threshold is weighed, which loses nothing: by Cauchy-Schwarz a cosine is at
most the norm of the template's part on shared terms. So a block without a core term of a header (the
others carry too little of its norm), or with fewer terms than the heaviest that reach it, is left out, and so is a text, with all its blocks, whose terms
cover too little of every template: sums per row tell that before anything else is cut. What is left is
weighed twice: first with the least weight that words outside the templates can have, which bounds the
cosine from above and needs no counts of them; then, for the few units that pass, exactly. A row whose
whole text is at the threshold is a licence file of its directory. Rows without a licence of their own
inherit from the nearest directory above them that has one; ancestors are joined per distinct
directory, not per row.

DataFrame functions only. Sent whole to tasks: the templates' terms, a fixed list; and word and
directory tables only while their counted rows stay under a bound, beyond which they are joined by
a shuffle.

Defined results: a null text counts as empty and has no licence; null parts of a path are left out;
of equal cosines the whole text, then the earlier and then the shorter block, then the licence that
sorts first, wins; of licence files in one directory the one with the larger cosine, then the smaller
id; repeated rows are judged alike; an empty table gives no rows; only the id, path and text are read,
so other columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.common import materialise, named

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
# Headers as their licences word them.
HEADERS = [
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1").replace("program", "library")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3").replace("program", "library")),
    ("MIT", "Released under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
THRESHOLD = 0.75
#: A line of more words than that is cut into its sentences.
LONG_LINE = 40
#: Pieces in a block at most.
RUN = 5
#: Rows of a word or directory table that may be broadcast.
BROADCAST_ROWS = 200_000
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: A mark ends a sentence only before a space. Possessive, so that long lines need no deep stack.
SENTENCE = r"[^.;!?]+(?:[.;!?]+[^\s.;!?][^.;!?]*+)*+[.;!?]*"



@cache
def templates() -> tuple[tuple[str, str, bool], ...]:
    """(licence, text, is it a header) of all templates: headers, the tags that name a licence, and whole texts."""
    files = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    names = sorted({name for name, _ in [*HEADERS, *files]})
    headers = [*HEADERS, *[(name, f"SPDX-License-Identifier: {name}") for name in names]]
    return tuple([(*h, True) for h in headers] + [(*f, False) for f in files])


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def idf(df: float | Column, n: float | Column) -> float | Column:
    """1 + ln((n + 1) / (df + 1))."""
    if isinstance(df, Column):
        return F.lit(1.0) + F.log((F.lit(n) + 1.0) / (df + 1.0))
    return 1.0 + math.log((n + 1.0) / (df + 1.0))


def vectors(texts: list[str], weight: dict[str, float]) -> list[dict[str, float]]:
    """Unit TF-IDF vectors of the templates."""
    out = []
    for text in texts:
        w = {t: (1 + math.log(n)) * weight[t] for t, n in Counter(re.findall(TERM, text.lower())).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return out


def core_terms(unit: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms of which every block at the threshold has at least one.

    The cosine is at most the norm of the template's part on shared terms; the lightest terms
    whose part stays under the threshold cannot reach it by themselves.
    """
    core = set()
    for vector in unit:
        part = 0.0
        for term, w in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            part += w * w
            if math.sqrt(part) >= threshold - 1e-9:
                core.add(term)
    return sorted(core)


def fewest_terms(vector: dict[str, float], threshold: float) -> int:
    """How many of a template's terms a block at the threshold has at least: its heaviest ones must reach it together."""
    part = 0.0
    for n, w in enumerate(sorted(vector.values(), reverse=True), 1):
        part += w * w
        if math.sqrt(part) >= threshold - 1e-9:
            return n
    return len(vector)


def _sized(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast only if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def pieces_of(text: Column) -> Column:
    """Lines of a text, the long ones by their sentences."""
    cut = lambda line: F.when(F.size(F.split(line, " ")) > LONG_LINE, F.regexp_extract_all(line, F.lit(f"({SENTENCE})"), F.lit(1))).otherwise(F.array(line))
    return F.flatten(F.transform(F.split(text, "\n"), cut))


def blocks(df: DataFrame, unit: list[dict[str, float]], threshold: float) -> DataFrame:
    """Of df (r, text): (r, at, size, terms) for each run of pieces with a core term and enough terms of one of these headers."""
    core = core_terms(unit, threshold)
    some = F.lower("text").rlike("|".join(re.escape(t) for t in core))
    pieces = df.where(some).select("r", pieces_of(F.col("text")).alias("p"))
    ahead = [F.slice("p", F.lit(k + 1), F.greatest(F.size("p") - k, F.lit(0))).alias(f"p{k}") for k in range(RUN)]
    runs = pieces.select("r", F.posexplode(F.arrays_zip(*ahead)).alias("at", "z"))
    whole = [F.when(F.col(f"z.p{k}").isNotNull(), F.struct(F.lit(k + 1).alias("size"), F.concat_ws(" ", *[F.col(f"z.p{i}") for i in range(k + 1)]).alias("text"))) for k in range(RUN)]
    each = runs.select("r", "at", F.explode(F.array_compact(F.array(*whole))).alias("b"))
    each = each.where(F.lower("b.text").rlike("|".join(re.escape(t) for t in core))).select("r", "at", "b.size", terms_of(F.col("b.text")).alias("terms"))
    each = each.where(F.arrays_overlap("terms", F.array(*[F.lit(t) for t in core])))
    enough = F.lit(False)
    for vector in unit:
        enough = enough | (F.size(F.array_intersect("terms", F.array(*[F.lit(t) for t in sorted(vector)]))) >= fewest_terms(vector, threshold))
    return each.where(enough)


def covering(df: DataFrame, unit: list[dict[str, float]], threshold: float) -> DataFrame:
    """r of the rows of df (r, text) whose terms cover enough of any template for its threshold."""
    squares: dict[str, list[float]] = {}
    for i, vector in enumerate(unit):
        for t, w in vector.items():
            squares.setdefault(t, [0.0] * len(unit))[i] = w * w
    table = F.broadcast(df.sparkSession.createDataFrame(sorted(squares.items()), "term string, squares array<double>"))
    met = df.select("r", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).join(table, "term")
    summed = met.groupBy("r").agg(F.greatest(*[F.sum(F.get("squares", F.lit(i))) for i in range(len(unit))]).alias("most"))
    return summed.where(F.col("most") >= threshold**2 - 1e-9).select("r")


def found_licences(df: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Of df (r, text): (r, at, size, licence, cosine) for each block and whole text (at -1, size 0) at the threshold."""
    spark, known = df.sparkSession, templates()
    n = df.count()
    words = sorted({t for _, text, _ in known for t in re.findall(TERM, text.lower())})
    listed = F.array(*[F.lit(t) for t in words])
    # Only the templates' words leave the scan, and their counts fold in each task; at most one row a template word is collected.
    counted = {r.term: r.df for r in df.select(F.explode(F.array_intersect(terms_of(F.col("text")), listed)).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    unit = vectors([text for _, text, _ in known], {t: idf(counted.get(t, 0), n) for t in words})

    # A block has no terms that its text lacks, so texts that cover no template have no block to weigh either.
    texts = materialise(df.join(_sized(materialise(covering(df, unit, threshold), "licence-covering", free=True), broadcast_rows), "r"), "licence-texts")
    headers = blocks(texts, [u for u, k in zip(unit, known, strict=True) if k[2]], threshold)
    files = texts.select("r", F.lit(-1).alias("at"), F.lit(0).alias("size"), terms_of(F.col("text")).alias("terms"))
    spread = headers.unionByName(files).select("r", "at", "size", F.explode("terms").alias("term")).groupBy("r", "at", "size", "term").agg(F.count("*").alias("tf"))
    weights: dict[str, list[float]] = {t: [0.0] * len(unit) for t in words}
    for i, vector in enumerate(unit):
        for t, w in vector.items():
            weights[t][i] = w
    table = F.broadcast(spark.createDataFrame([(t, float(idf(counted.get(t, 0), n)), w) for t, w in sorted(weights.items())], "term string, own double, weights array<double>"))
    spread = materialise(spread.join(table.select("term", "own"), "term", "left"), "licence-terms", free=True)

    def scored(rows: DataFrame, weight: Column) -> DataFrame:
        """(r, at, size, licence, cosine): the best template of each unit. Blocks are held against headers only, whole texts against all."""
        weighed = rows.withColumn("w", (1 + F.log("tf")) * weight).join(table.select("term", "weights"), "term", "left")
        dots = weighed.groupBy("r", "at", "size").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *[F.sum(F.col("w") * F.get("weights", F.lit(i))).alias(f"d{i}") for i in range(len(unit))])
        fits = lambda i: F.lit(True) if known[i][2] else F.col("size") == 0
        each = F.array(*[F.struct(F.when(fits(i), -F.round(F.coalesce(F.col(f"d{i}"), F.lit(0.0)) / F.col("norm"), 9)).otherwise(0.0).alias("far"), F.lit(known[i][0]).alias("licence")) for i in range(len(unit))])
        best = dots.select("r", "at", "size", F.array_min(each).alias("b"))
        return best.select("r", "at", "size", F.col("b.licence").alias("licence"), (-F.col("b.far")).alias("cosine"))

    # A word weighs as one that every text has, or more; with that for all other words a norm is least and a cosine most.
    most = scored(spread, F.coalesce("own", F.lit(1.0)))
    able = materialise(most.where(F.col("cosine") >= threshold - 1e-8).select("r", "at", "size"), "licence-able", free=True)
    left = materialise(spread.join(_sized(able, broadcast_rows), ["r", "at", "size"]), "licence-left")
    # Words of what is left, counted over all texts.
    wanted = _sized(materialise(left.where("own is null").select("term").distinct(), "licence-words"), broadcast_rows)
    every = df.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    other = materialise(every.join(wanted, "term").groupBy("term").agg(F.count("*").alias("df")), "licence-wanted", free=True)
    known_df = left.join(_sized(other, broadcast_rows), "term", "left")
    return scored(known_df, F.coalesce("own", idf(F.col("df"), n))).where(F.col("cosine") >= threshold)


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of df: id, path, own_licence, cosine, is_file, inherited_from (a directory) and licence."""
    # Rows get their number in a written table: it stays the same when lost work is done again.
    rows = materialise(df.select(F.monotonically_increasing_id().alias("r"), named(id_col).alias("id"), path.alias("path"), F.coalesce(named(text_col), F.lit("")).alias("text")), "licence-rows")
    found = materialise(found_licences(rows.select("r", "text"), threshold, broadcast_rows), "licence-found")
    own = found.groupBy("r").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "at", "size", "licence")).alias("best"), F.max(F.col("size") == 0).alias("is_file"))
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    placed = rows.select("r", "id", "path", folder.alias("folder"))
    marked = placed.join(own, "r", "left").select("id", "path", "folder", F.col("best.licence").alias("own_licence"), (-F.col("best.far")).alias("cosine"), F.coalesce("is_file", F.lit(False)).alias("is_file"))
    marked = materialise(marked, "licence-marked")

    files = marked.where("is_file").groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("far"), F.col("id").isNull().alias("x"), "id", F.col("own_licence").alias("licence"))).alias("f"))
    files = files.select(F.col("folder").alias("above"), F.col("f.licence").alias("given"))
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.size(steps), F.lit(1)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    folders = marked.select("folder").distinct().select("folder", F.posexplode(above).alias("up", "above"))
    nearest = folders.join(files, "above").groupBy("folder").agg(F.min(F.struct("up", "above", "given")).alias("near"))
    nearest = materialise(nearest.select("folder", F.col("near.above").alias("above"), F.col("near.given").alias("given")), "licence-folders")
    told = marked.join(_sized(nearest, broadcast_rows), "folder", "left")
    without = F.col("own_licence").isNull()
    return told.select(
        F.col("id").alias(id_col), "path", "own_licence", "cosine", "is_file",
        F.when(without, F.col("above")).alias("inherited_from"),
        F.coalesce("own_licence", "given").alias("licence"),
    )
