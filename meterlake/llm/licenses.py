"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public notices, and whole bodies of short licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
        ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
        BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words_col: str, n: int) -> Column:
    """Hashes of the n-word shingles in order. The words must be a column, not an expression evaluated anew for each."""
    column = F.col(words_col)
    hashed = F.transform(F.sequence(F.lit(0), F.size(column) - n), lambda i: F.xxhash64(*[F.get(column, i + k) for k in range(n)]))
    return F.when(F.size(column) >= n, hashed).otherwise(F.array().cast("array<bigint>"))


def signature(hashes: Column, bands: int) -> Column:
    """One MinHash value for each band of one row."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j))))


def bands_for(template_words: int, n: int, containment: float, miss: float) -> int:
    """Bands of one row for which a window that holds so much of the template collides but for a chance of `miss`."""
    own, window = template_words - n + 1, 2 * template_words - n + 1
    common = math.ceil(containment * own)
    return math.ceil(math.log(miss) / math.log(1 - common / (window + own - common)))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]], n: int) -> DataFrame:
    """(number, license, size, shingles) of the templates, from literals."""
    rows = F.array(*[F.struct(F.lit(i).alias("number"), F.lit(a).alias("license"), F.lit(b).alias("text")) for i, (a, b) in enumerate(templates)])
    listed = spark.range(1).select(F.explode(rows).alias("t")).select("t.*").select("number", "license", words(F.col("text")).alias("words"))
    return listed.select("number", "license", F.size("words").alias("size"), F.array_distinct(shingles("words", n)).alias("template"))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    n: int = 5,
    containment: float = 0.8,
    miss: float = 1e-6,
) -> DataFrame:
    """One row for each document and template found in it: id_col, template, license, containment, begin, end (in words).

    For templates of s words the text is cut into windows of 2 s words, each starting s words after the last, so that a copy lies
    within one. A window's MinHash bands are compared to the template's by a join on (band, value); `bands_for` sets their number so that a
    window of enough content is missed with a chance of at most `miss`. A retrieved window counts when it holds at least `containment` of the
    template's shingles; the best window, and the first of equals, is returned, from its first to its last word in a shingle of the template.
    Templates that share most shingles (notices of one family) are all returned; the highest containment fits best.

    A band can only collide where the window holds the shingle behind the template's value, so signatures are computed for
    windows with one of those alone; the result is that of all windows. All by row before the join: no group grows
    with the data, and the templates, a list held by the caller, are the side that Spark may broadcast.

    NULL or empty texts, and those of under n words: no rows. Templates of under n words are refused. Repeated rows: equal ids are one document. Empty
    table: no rows.
    """
    table = template_table(docs.sparkSession, templates, n)
    sizes = [(r["size"], r["number"]) for r in table.select("size", "number").collect()]
    if not sizes or min(s for s, _ in sizes) < n:
        raise ValueError(f"templates must be given, of at least {n} words each")
    bands = max(bands_for(s, n, containment, miss) for s, _ in sizes)
    hashed = F.struct(F.xxhash64("h", "j").alias("value"), F.col("h").alias("h"))
    least = table.select("number", "size", F.explode("template").alias("h")).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(bands))))
    least = least.groupBy("number", "size", "j").agg(F.min(hashed).alias("m")).select("number", "size", "j", "m.value", "m.h")
    behind = [r["h"] for r in least.select("h").distinct().collect()]  # at most one for each template and band

    # Generators keep the arrays as columns; filters below would otherwise take their expressions into each lambda.
    worded = docs.select(F.col(id_col).alias("id"), F.explode(F.array(words(F.col(text_col)))).alias("words"))
    hashes = worded.where(F.size("words") >= n).select("id", F.explode(F.array(shingles("words", n))).alias("hashes"))
    hits = hashes.select("id", "hashes", F.filter(F.transform("hashes", lambda h, i: F.when(h.isin(behind), i)), lambda i: i.isNotNull()).alias("hits"))

    def windows(s: int) -> Column:
        """The two windows that each hit may lie in."""
        around = F.flatten(F.transform("hits", lambda p: F.array(F.floor(p / s), F.floor(p / s) - 1)))
        numbers = F.filter(F.array_distinct(around), lambda i: i >= 0)
        begin = lambda i: (i * s).cast("int")
        return F.transform(numbers, lambda i: F.struct(F.lit(s).alias("size"), begin(i).alias("begin"), F.slice("hashes", begin(i) + 1, 2 * s - n + 1).alias("window")))

    cut = hits.where(F.size("hits") > 0).select("id", F.explode(F.concat(*[windows(s) for s in sorted({s for s, _ in sizes})])).alias("w")).select("id", "w.*").where(F.size("window") > 0)
    signed = cut.select("id", "size", "begin", "window", F.posexplode(signature(F.col("window"), bands)).alias("band", "value")).withColumn("j", F.col("band") + 1)
    met = signed.join(least.select("number", "size", "j", "value"), ["size", "j", "value"]).dropDuplicates(["id", "size", "begin", "number"])
    judged = met.join(table.select("number", "license", "template"), "number")
    share = F.size(F.array_intersect("window", "template")) / F.size("template")
    found = judged.withColumn("containment", share).where(F.col("containment") >= containment)
    shared = F.filter(F.transform("window", lambda h, i: F.when(F.array_contains("template", h), i)), lambda i: i.isNotNull())
    placed = found.select("id", "number", "license", "containment", "begin", F.explode(F.array(shared)).alias("at"))
    bounds = F.struct("containment", (-F.col("begin")).alias("back"), F.array_min("at").alias("first"), F.array_max("at").alias("last"))
    best = placed.groupBy("id", "number", "license").agg(F.max(bounds).alias("b"))
    return best.select(
        F.col("id").alias(id_col), F.col("number").alias("template"), "license", "b.containment",
        (F.col("b.first") - F.col("b.back")).cast("long").alias("begin"), (F.col("b.last") - F.col("b.back") + n).cast("long").alias("end"),
    )
