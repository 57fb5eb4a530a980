"""License scan: MinHash bands over overlapping windows, exact containment, DataFrame operations only.

Templates and texts are runs of five-word shingles. A template of T shingles belongs to a size class
whose windows of W shingles, every W/4, are sure to hold it whole wherever it stands; the window's
MinHash signature has bands of one row, as many as make a collision with the template at least
1 - MISS likely. A band can only collide if the window holds the shingle that is the template's minimum
in that band, so signatures are computed just for windows that hold such a shingle (a constant bitmap
of fixed size tells); no window that could collide is left out. Collisions are verified by the share of
the template's shingles that the window holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.native_text import bitmap_literal, in_bitmap, log2_size, runs, words
from sparkloom.llm.store import cut

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-4

#: License notices as published by their authors.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MIT-license": "Licensed under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def size_class(shingles: int) -> tuple[int, int]:
    """Window size and step for templates of so many shingles."""
    width = 1
    while shingles > width - max(1, width // 4) + 1:
        width *= 2
    return width, max(1, width // 4)


def bands(width: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """One-row bands such that the smallest template of the class, a `containment` share of which is in
    a window, collides with a likelihood of 1 - miss."""
    least = next(t for t in range(1, width + 1) if size_class(t)[0] == width)
    shared = max(1, math.ceil(containment * least))
    jaccard = shared / (width + least - shared)
    return 1 if jaccard >= 1 else math.ceil(math.log(miss) / math.log(1 - jaccard))


def _constant(j: int) -> int:
    return (0x9E3779B97F4A7C15 * (j + 1) * (2 * j + 3) % 2**64) - 2**63


def _order(j: int):
    return lambda x: x.bitwiseXOR(F.lit(_constant(j)))


def _signature(values, count: int):
    """Minima of `count` orders of the hashes, each the order after a constant is xored in."""
    return F.array(*[F.array_min(F.transform(values, _order(j))) for j in range(count)])


def _held(bits, log2: int):
    """Places and hashes of the shingles that may be a minimum of some template in some class."""
    marked = F.transform("s", lambda h, i: F.when(in_bitmap(bits, h, log2), F.struct(i.alias("i"), h.alias("h"))))
    return F.filter(marked, lambda p: p.isNotNull())


def _windows(bits, log2: int, width: int, step: int):
    """Numbers of the class's windows that hold a shingle of the class's bitmap."""

    def around(p):
        return F.sequence(F.greatest(F.lit(0), F.ceil((p["i"] - width + 1) / step).cast("int")), F.floor(p["i"] / step).cast("int"))

    return F.array_distinct(F.flatten(F.transform(F.filter("held", lambda p: in_bitmap(bits, p["h"], log2)), around)))


def _cut_out(starts, width: int, step: int):
    return F.transform(
        starts, lambda b: F.struct(F.lit(width).alias("width"), (b * step).alias("first"), F.slice("s", b * step + 1, F.lit(width)).alias("win"))
    )


def _shingles(w):
    n = F.size(w)
    return F.when(n >= SHINGLE, runs(w, SHINGLE)).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, start_word, end_word) for every row of docs(doc_id, text) and
    template(license, text) that some window of the text holds to at least the given share; of the
    windows that hold most, the first. start_word and end_word bound that window's matching shingles.

    Words are runs of digits, letters and all beyond ASCII, A-Z lowered. A template of fewer than five
    words is one shingle of all of them and matches only a text of exactly these words; templates
    without words are ignored. Null and empty texts match nothing. Repeated rows are reported each;
    columns with other names are ignored."""
    if templates is None:
        templates = template_table(docs.sparkSession)
    t = templates.select("license", words(F.col("text")).alias("w"))
    t = cut(t.select("license", F.array_distinct(_shingles(F.col("w"))).alias("ts")).where(F.size("ts") > 0))
    sizes = [r["n"] for r in t.select(F.size("ts").alias("n")).distinct().collect()]
    classes = sorted({size_class(n)[0] for n in sizes})
    schema = "array<struct<width:int,first:int,win:array<bigint>>>"
    width_of = F.lit(0)
    for n in sizes:
        width_of = F.when(F.size("ts") == n, size_class(n)[0]).otherwise(width_of)
    t = t.withColumn("width", width_of)
    made = [
        t.where(F.col("width") == width).select("license", "width", F.posexplode(_signature(F.col("ts"), bands(width))).alias("band", "value"))
        for width in classes
    ]
    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    rows = rows.withColumn("s", _shingles(F.col("w")))
    found = []
    if made:
        keys = made[0]
        for x in made[1:]:
            keys = keys.unionAll(x)
        keys = cut(keys)
        # the shingle that is a template's minimum in a band: the band's value with the constant taken out
        undo = F.array(*[F.col("value").bitwiseXOR(F.lit(_constant(j))) for j in range(max(map(bands, classes)))])
        minima = cut(keys.select("width", F.element_at(undo, F.col("band") + 1).alias("m")).distinct())
        log2 = log2_size(minima.count())
        rows = rows.withColumn("held", _held(bitmap_literal(minima, "m", log2), log2))
        for width in classes:
            bits = bitmap_literal(minima.where(F.col("width") == width), "m", log2)
            step = size_class(next(n for n in range(1, width + 1) if size_class(n)[0] == width))[1]
            rows = rows.withColumn(f"b{width}", _windows(bits, log2, width, step))
            found.append(_cut_out(F.col(f"b{width}"), width, step))
    table = cut(
        rows.select("doc_id", F.monotonically_increasing_id().alias("row"), (F.concat(*found) if found else F.array().cast(schema)).alias("wins")).where(F.size("wins") > 0)
    )
    wins = table.select("row", "doc_id", F.explode("wins").alias("x")).select("row", "doc_id", "x.*")
    result = None
    for width in classes:
        probe = wins.where(F.col("width") == width)
        signed = probe.select("row", "doc_id", "first", "win", F.posexplode(_signature(F.col("win"), bands(width))).alias("band", "value"))
        hit = signed.join(keys.where(F.col("width") == width), ["band", "value"]).join(t.select("license", "ts"), "license")
        both = F.size(F.array_intersect("ts", "win"))
        hit = hit.select("row", "doc_id", "license", "first", (both / F.size("ts")).alias("containment"), F.filter(F.transform("win", lambda v, i: F.when(F.array_contains("ts", v), i)), lambda i: i.isNotNull()).alias("at"))
        hit = hit.where(F.col("containment") >= containment).select(
            "row", "doc_id", "license", "containment", (F.col("first") + F.array_min("at")).alias("start_word"), (F.col("first") + F.array_max("at") + SHINGLE).alias("end_word")
        )
        result = hit if result is None else result.unionAll(hit)
    if result is None:
        return docs.sparkSession.createDataFrame([], docs.select("doc_id").schema.add("license", "string").add("containment", "double").add("start_word", "long").add("end_word", "long"))
    best = result.groupBy("row", "license").agg(F.min(F.struct((-F.col("containment")).alias("c"), "start_word", "end_word", "doc_id")).alias("b"))
    return best.select("b.doc_id", "license", (-F.col("b.c")).alias("containment"), F.col("b.start_word").cast("long").alias("start_word"), F.col("b.end_word").cast("long").alias("end_word"))
