"""License scans (DataFrame functions only): MinHash bands over overlapping text windows retrieve templates, exact shingle
containment decides.

Words are runs of letters and digits in lower case, shingles are `k` = 5 of them, each a 64-bit hash. Of a text, only shingles
that occur in a template matter to any template's containment, so a broadcast join keeps those (templates are a fixed list, their
shingles are counted, and the operator refuses more than `MAX_SHINGLES`); they are one table, read by all later steps.

Windows follow the templates' sizes: a template of s shingles has the span L, the least power of two that is 1.25 s or more, and
is looked for in windows of 2 L places that begin every L places, so a passage of up to L places lies whole in one of them. Of a
window only shingles of templates with this span are sketched. That leaves out what no such template holds, so a one-line notice
is not hidden by another licence beside it. As L < 2.5 s, a window that holds the share c of a template has a similarity of
c s / (5 s + (1 - c) s) at least: 0.154 at c = 0.8. Bands are of one row, as many as bring the chance to miss such a window down to
`miss` (97 bands at 1e-7). Pairs that share a band are verified over the whole text; no other pairs are. A template whose pieces
are scattered over more than L places is found if one window reaches a band with it.

Before any shingle is made, texts without a template's marker words are set aside. Marker words of a template stand in more than
1 - containment of its shingles, so a text that has none of them cannot reach the containment: nothing is lost.

Defined cases: null and empty texts match nothing; repeated rows are rows of their own with equal results; a template shorter than
k words is one shingle of all its words; very long texts have more windows; an empty table gives no rows; only doc_id and text are
looked at, whatever other columns are named.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import scratch, stored

MAX_SHINGLES = 100_000

TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
}


def _markers(templates: dict[str, str], k: int, containment: float) -> list[str]:
    """A few words such that each template has them in more than 1 - containment of its shingles; long words first."""
    out: set[str] = set()
    for text in templates.values():
        words = re.findall(r"[a-z0-9]+", text.lower())
        shingles = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
        need = (1 - containment) * len(shingles)
        for w in sorted(set(words), key=lambda w: (w not in out, -len(w), w)):
            if sum(bool(out & set(s)) for s in shingles) > need:
                break
            out.add(w)
    return sorted(out)


def _shingles(text: Column, k: int) -> Column:
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    at = F.sequence(F.lit(0), F.greatest(F.size("__w") - k, F.lit(0)))
    return words, F.when(F.size("__w") > 0, F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("__w", i + 1, k), " "))))


def bands(containment: float, miss: float) -> int:
    """How many one-row bands miss a window that holds `containment` of a template with a chance of `miss` at most."""
    return math.ceil(math.log(miss) / math.log1p(-containment / (6 - containment)))


def _sketched(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """For each group of rows(by, __h) its minimum of each of n hashes: by, __band, __low."""
    lows = rows.groupBy(*by).agg(*[F.min(F.xxhash64("__h", F.lit(i))).alias(f"__m{i}") for i in range(n)])
    return lows.select(*by, F.posexplode(F.array(*[f"__m{i}" for i in range(n)])).alias("__band", "__low"))


def retrieved(hits: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """__id and license where a window of hits(__id, __at, __h) shares a band with a template of pairs(license, __span, __h)."""
    near = hits.join(F.broadcast(pairs.select("__h", "__span").distinct()), "__h")
    of = F.floor(F.col("__at") / F.col("__span"))
    near = near.select("__id", "__span", F.explode(F.array(of, of - 1)).alias("__window"), "__h")
    texts = _sketched(near, ["__id", "__span", "__window"], n)
    return texts.join(F.broadcast(_sketched(pairs, ["license", "__span"], n)), ["__span", "__band", "__low"]).select("__id", "license").distinct()


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, k: int = 5, containment: float = 0.8, miss: float = 1e-7) -> DataFrame:
    """doc_id, license, containment (share of the template's shingles), first_word and last_word (where its shingles begin first
    and last) for each row of docs(doc_id, text) and template that it holds."""
    spark = docs.sparkSession
    folder = scratch(spark, "licenses")
    templates = templates or TEMPLATES
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("__t")) for n, t in templates.items()])).alias("x")
    words, shingles = _shingles(F.col("__t"), k)
    known = spark.range(1).select(listed).select("x.*").withColumn("__w", words).select("license", F.explode(shingles).alias("__h")).distinct()
    total = known.groupBy("license").agg(F.count("*").alias("__size"))
    span = F.pow(F.lit(2), F.ceil(F.log2(F.col("__size") * 1.25))).cast("int").alias("__span")
    pairs = stored(known.join(total, "license").select("license", "__h", "__size", span).coalesce(1), folder, "templates")
    vocabulary = pairs.select("__h").distinct()
    if (n := vocabulary.count()) > MAX_SHINGLES:
        raise ValueError(f"{n} template shingles; the bound is {MAX_SHINGLES}")
    has = F.lit(False)
    low = F.lower("text")
    for m in _markers(templates, k, containment):
        has = has | F.contains(low, F.lit(m))
    words, shingles = _shingles(F.col("text"), k)
    own = docs.select("doc_id", "text").where(has).select("doc_id", "text", F.monotonically_increasing_id().alias("__id"))
    own = own.withColumn("__w", words).select("__id", "doc_id", F.posexplode(shingles).alias("__at", "__h"))
    hits = stored(own.join(F.broadcast(vocabulary), "__h"), folder, "hits")
    found = stored(retrieved(hits, pairs, bands(containment, miss)), folder, "retrieved")
    held = hits.join(found, "__id").join(F.broadcast(pairs), ["license", "__h"])
    held = held.groupBy("__id", "license", "doc_id", "__size").agg(F.countDistinct("__h").alias("__n"), F.min("__at").alias("first_word"), F.max("__at").alias("last_word"))
    held = held.withColumn("containment", F.col("__n") / F.col("__size")).where(F.col("containment") >= containment)
    return held.select("doc_id", "license", "containment", "first_word", "last_word")
