"""License scans with DataFrame functions only: sparse TF-IDF cosine, then nearest-ancestor inheritance.

A text's passages are its sentences and lines ("headers") and the whole of it ("licence files").  Each is a sparse
vector of term counts times inverse document frequency, which is counted over all texts; a term outside the templates
weighs as one of no document.  A passage takes the template of highest cosine, from ``threshold`` on, the first name
of equals; a text takes the best of its passages.  It is a licence file if the whole of it is at the threshold, or if
it has a licence and its name says so.  A text without a licence inherits that of the nearest ancestor directory that
holds a licence file, by joins of the distinct directories' ancestors with the directories of licence files.

Texts and passages that cannot reach the threshold are left aside by a bound that loses none: a cosine is at most the
length of the template's vector over the shared terms (Cauchy-Schwarz), so the squared greatest weights of a passage's
template terms have to add up to the squared threshold.  What is broadcast is made of the templates (their terms,
weights and document frequencies), or counted first.

Defined results: null or empty texts have no passage; a null path has no directory; repeated rows are judged
alike; of several licence files in a directory the one of highest cosine counts, then the first name; the
result's columns are its own.  Rows are told apart by doc_id, path and the hash of the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark as S

THRESHOLD = 0.6
#: Texts with a licence, and directories that inherit one, up to which they are broadcast.
MOST_BROADCAST = 50_000
_TERM = r"[a-z0-9]+(?:[.][0-9]+)*"
_BREAK = r"\n|(?<=[.!?;])[ \t\r]+"
_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"
#: (licence, text): short statements, headers and openings of public licences.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 Terms and conditions for use, reproduction, and distribution"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def terms_of(text: str) -> list[str]:
    import re

    return re.findall(_TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_TERM), 0)


def _vectors(templates: list[tuple[str, str]], df: dict[str, int], n: int) -> list[tuple[str, str, float]]:
    """(term, licence, weight over the vector's length) of every template; equal licences' templates keep apart by number."""
    out = []
    for i, (name, text) in enumerate(templates):
        words = terms_of(text)
        weight = {t: words.count(t) * math.log((1 + n) / (1 + df.get(t, 0))) for t in words}
        length = math.sqrt(sum(w * w for w in weight.values()))
        out += [(t, f"{name}\n{i}", w / length) for t, w in sorted(weight.items()) if w > 0]
    return out


def _bound(terms: Column, most: dict[str, float]) -> Column:
    """What the squared cosine of a passage of these distinct template terms may be at most."""
    known = F.array(*map(F.lit, sorted(most)))

    def add(total: Column, term: Column) -> Column:
        step = None
        for name, square in sorted(most.items(), key=lambda x: -x[1]):
            step = F.when(term == name, square) if step is None else step.when(term == name, square)
        return total + step.otherwise(0.0)

    return F.aggregate(F.array_intersect(terms, known), F.lit(0.0), add)


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """doc_id, path, own and cosine (of the text's best passage, null for none), is_file, license of every row."""
    spark = files.sparkSession
    S.ready(spark)
    own = files.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    vocabulary = sorted({t for _, text in templates for t in terms_of(text)})
    known = F.array(*map(F.lit, vocabulary))
    # one row per term: bounded by the templates
    n = own.count()
    df = {r.term: r.n for r in own.select(F.explode(F.array_intersect(_terms(F.col("text")), known)).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    vectors = _vectors(templates, df, n)
    most: dict[str, float] = {}
    for term, _, w in vectors:
        most[term] = max(most.get(term, 0.0), w * w)
    least = threshold * threshold - 1e-6
    weights = F.broadcast(spark.createDataFrame(vectors or [("", "", 0.0)], "term string, template string, weight double"))
    idf = F.broadcast(spark.createDataFrame([(t, math.log((1 + n) / (1 + df.get(t, 0)))) for t in vocabulary], "term string, idf double"))

    named = F.regexp_extract("path", r"[^/]*$", 0).rlike(_FILE)
    able = own.where(_bound(_terms(F.col("text")), most or {"": 0.0}) >= least)
    parts = F.transform(F.split("text", _BREAK), lambda part, i: F.struct(i.alias("passage"), _terms(part).alias("terms")))
    whole = F.array(F.struct(F.lit(-1).alias("passage"), _terms(F.col("text")).alias("terms")))
    passages = F.filter(F.concat(whole, parts), lambda p: _bound(p["terms"], most or {"": 0.0}) >= least)
    row = F.struct("doc_id", "path", F.xxhash64("text").alias("mark"))
    parts = able.select(row.alias("row"), F.explode(passages).alias("p")).select(F.struct("row", "p.passage").alias("of"), F.explode("p.terms").alias("term"))
    counted = parts.groupBy("of", "term").agg(F.count("*").alias("tf"))
    counted = counted.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(math.log(1 + n))))
    counted = S.kept(counted.select("of", "term", "w"))
    lengths = counted.groupBy("of").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    products = counted.join(weights, "term").groupBy("of", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    # repeated rows add up both products and lengths, which leaves the cosine as it is
    cosine = F.round(F.col("dot") / F.col("length"), 9)
    close = products.join(lengths, "of").select("of.row", "of.passage", F.substring_index("template", "\n", 1).alias("license"), cosine.alias("cosine")).where(F.col("cosine") >= threshold)
    best = close.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best"), F.max(F.col("passage") < 0).alias("whole"))
    best = best.select("row.doc_id", "row.path", "row.mark", F.col("best.license").alias("own"), (-F.col("best.minus")).alias("cosine"), "whole")
    best, seen = S.counted(best.select("doc_id", "path", "mark", "own", "cosine", (F.col("whole") | F.coalesce(named, F.lit(False))).alias("is_file")))

    found = best.select(F.struct("doc_id", "path", "mark").alias("found"), "own", "cosine", "is_file")
    rows = own.select("doc_id", "path", row.alias("row"), directory(F.col("path")).alias("directory")).join(S.broadcast_if(found, seen["rows"] <= MOST_BROADCAST), F.col("row").eqNullSafe(F.col("found")), "left").drop("row", "found")
    held = best.where("is_file AND path IS NOT NULL").groupBy(directory(F.col("path")).alias("ancestor")).agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "own")).getField("own").alias("theirs"))
    ways = rows.where("own IS NULL AND directory IS NOT NULL").select("directory").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("ancestor"))
    nearest, seen = S.counted(ways.join(held, "ancestor").groupBy("directory").agg(F.max_by("theirs", F.length("ancestor")).alias("theirs")))
    return rows.join(S.broadcast_if(nearest, seen["rows"] <= MOST_BROADCAST), "directory", "left").select("doc_id", "path", "own", "cosine", F.coalesce("is_file", F.lit(False)).alias("is_file"), F.coalesce("own", "theirs").alias("license"))


def directory(path: Column) -> Column:
    """"" for a file at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """The directory itself, those above it and the top ("")."""
    steps = F.split(path, "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))))
