"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Templates are short notices.  For every template length T, a text is cut into windows of T + T/4 words at steps of T/4,
so that any occurrence lies wholly in one window.  Windows that hold none of the templates' marker words can't
reach the containment (the shingles without a marker are too few) and aren't hashed.  A window's min-hashes
under ``hashes`` hash functions, one a band, retrieve the templates with an equal one; then the share of the
template's shingles found in the window is computed exactly.

A window that contains the least share c of a template's m shingles has similarity J >= c*m / (m + T/4 + (1-c)*m); over the built-in templates
that is 0.27 or more, so 48 bands of one row miss it with probability (1 - 0.27)**48 < 1e-6.

DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import column
from cohortlab.llm.spotsigs import words_of

# Public notices.
TEMPLATES = (
    ("mit-released", "Released under the MIT License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-terms", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-any", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("all-rights-reserved", "All rights reserved."),
)


@dataclass(frozen=True)
class LicenseParams:
    shingle: int = 5
    containment: float = 0.75
    hashes: int = 48


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def _shingles(words: list[str], k: int) -> list[str]:
    k = min(k, len(words))
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def markers(templates, k: int, containment: float) -> list[str]:
    """Words of which any window with the least containment of a template holds one.

    So many shingles of each template hold a marker that the others are fewer than a match needs.
    Long words are taken first (short ones are common), of these the ones with the most hits.
    """
    chosen: list[str] = []
    for _, text in templates:
        shingles = [set(s.split()) for s in dict.fromkeys(_shingles(_words(text), k))]
        needed = -(-containment * len(shingles) // 1)
        left = [s for s in shingles if not s & set(chosen)]
        while len(left) >= needed:
            best = max(sorted({w for s in left for w in s}), key=lambda w: (min(len(w), 7), sum(w in s for s in left), w))
            chosen.append(best)
            left = [s for s in left if best not in s]
    return chosen


def _shingle_hashes(words: Column, k: Column) -> Column:
    """Distinct hashes of the k-word shingles of a window; of the whole window if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - k + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " "))))


def _bands(hashes: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda s: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, s))))


def scan(docs: DataFrame, templates=TEMPLATES, params: LicenseParams = LicenseParams()) -> DataFrame:
    """Per document and template found in it: doc_id, license, containment (the best), windows, first_word (of the first window).

    Words are lower-case runs of letters and digits.  Null and empty texts match nothing; rows of one
    doc_id are one document, null ids too; other columns are ignored.  Templates without words are left
    out.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    lengths = {name: len(_words(t)) for name, t in templates if _words(t)}
    texts = [(n, t) for n, t in templates if n in lengths]
    marks = markers(texts, params.shingle, params.containment)
    specs = sorted({(t, max(1, t // 4), min(params.shingle, t)) for t in lengths.values()})
    table = spark.createDataFrame([(n, t, lengths[n], min(params.shingle, lengths[n])) for n, t in texts], "license string, notice string, length int, k int")
    table = table.withColumn("shingles", _shingle_hashes(words_of(F.col("notice")), F.col("k")))
    table = table.select("license", "length", "shingles", F.posexplode(_bands(F.col("shingles"), params.hashes)).alias("band", "least"))

    low = F.lower("text")
    some = None
    for w in marks:
        some = F.contains(low, F.lit(w)) if some is None else some | F.contains(low, F.lit(w))
    base = docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").alias("text")).where(some)
    words = base.select("doc_id", words_of(F.col("text")).alias("words"))
    spec = F.array(*(F.struct(F.lit(t).alias("length"), F.lit(s).alias("step"), F.lit(k).alias("k")) for t, s, k in specs))
    cuts = words.select("doc_id", "words", F.explode(spec).alias("spec")).select("doc_id", "words", "spec.*")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words")), F.col("step"))
    windows = cuts.select("doc_id", "length", "k", F.explode(F.filter(
        F.transform(starts, lambda i: F.struct(i.alias("first"), F.slice("words", i, F.col("length") + F.col("step")).alias("part"))),
        lambda x: F.exists(x["part"], lambda w: w.isin(marks)),
    )).alias("x")).select("doc_id", "length", F.col("x.first").alias("first"), _shingle_hashes(F.col("x.part"), F.col("k")).alias("found"))
    hashed = windows.select("doc_id", "length", "first", "found", F.posexplode(_bands(F.col("found"), params.hashes)).alias("band", "least"))
    # the templates are few: their count times the hashes bounds the table
    hits = hashed.join(F.broadcast(table), ["length", "band", "least"])
    share = F.size(F.array_intersect("found", "shingles")) / F.size("shingles")
    hits = hits.select("doc_id", "license", "first", share.alias("containment")).where(F.col("containment") >= params.containment).distinct()
    return hits.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.count(F.lit(1)).alias("windows"), (F.min("first") - 1).alias("first_word")
    )
