"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

DataFrame functions only.  A template of t shingles belongs to the window class W, the least power of two that is at least 2t; windows of W
shingles start every W/2, so that an occurrence lies whole in one of them.  A window that contains the share ``least`` of a template has a
Jaccard similarity of at least least * t / (W + (1 - least) * t), which is over least / (5 - least); single-row bands, as many as
``bands_for`` says, collide with the wanted probability at that similarity or above.

A window that shares no shingle with any template has other minima in all bands.  So documents without a template's shingle are let go
before any window is built, and windows without one too; nothing that MinHash could retrieve is lost.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin.llm.common import Scratch, own_columns

SHINGLE = 5
LEAST = 0.8
#: Probability with which a window that passes verification is retrieved.
SURE = 0.9999
#: Template text that may be broadcast; more templates are refused.
TEMPLATE_BYTES = 1 << 20

#: Notices by which public licences are named in texts.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def window_class(shingles: int) -> int:
    return 1 << max(1, math.ceil(math.log2(2 * shingles)))


def bands_for(least: float = LEAST, sure: float = SURE) -> int:
    """Bands of one row so that the least similarity of a window worth verifying collides with probability ``sure``."""
    return math.ceil(math.log(1 - sure) / math.log(1 - least / (5 - least)))


def templates(spark: SparkSession, notices: dict[str, list[str]] = NOTICES, shingle: int = SHINGLE) -> DataFrame:
    """license, part, words for each notice; those with fewer words than a shingle are refused."""
    rows = [(name, k, template_words(t)) for name, texts in sorted(notices.items()) for k, t in enumerate(texts)]
    if sum(len(w) for r in rows for w in r[2]) > TEMPLATE_BYTES:
        raise ValueError("more template text than may be broadcast")
    if any(len(r[2]) < shingle for r in rows):
        raise ValueError(f"a template needs at least {shingle} words")
    return spark.createDataFrame(rows, "license string, part int, words array<string>")


def _shingles(words: str, n: int, hashed: bool) -> Column:
    """Shingles of an array of words, as hashes or as text."""
    one = lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(n)]) if hashed else F.concat_ws(" ", *[F.get(F.col(words), i + k) for k in range(n)])
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), one)).otherwise(F.array().cast("array<bigint>" if hashed else "array<string>"))


def license_matches(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, shingle: int = SHINGLE, least: float = LEAST, sure: float = SURE) -> DataFrame:
    """One row per row of ``docs``: doc_id and matches, an array of (license, containment, start, end), by licence.

    Words are runs of digits and ASCII letters after lower-casing A-Z, ``shingle`` of them in a row a shingle.  A licence matches if some window holds at
    least the share ``least`` of the distinct shingles of one of its notices; the best window counts, then the first, and start and end are the
    first and last matching words (end exclusive).  Null and short texts match nothing.  Rows may repeat and keep null
    identifiers; no rows give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    t = templates(spark, notices, shingle).withColumn("t_hashes", F.array_distinct(_shingles("words", shingle, True))).withColumn("t_texts", F.array_distinct(_shingles("words", shingle, False)))
    t = scratch.table(t.coalesce(1), "templates")
    known = sorted({h for r in t.select("t_hashes").collect() for h in r[0]})
    sizes = {len(r[0]) for r in t.select("t_hashes").collect()}
    classes, bands = sorted({window_class(n) for n in sizes}), bands_for(least, sure)
    every = F.array(*[F.lit(h) for h in known])
    # The same hashes in cells of a few, one of which is looked into for a shingle.
    cells = 1 << max(1, len(known) - 1).bit_length()
    dealt: list[list[int]] = [[] for _ in range(cells)]
    for h in known:
        dealt[h % cells].append(h)
    cell = F.array(*[F.array(*[F.lit(h) for h in c]).cast("array<bigint>") for c in dealt])
    is_known = lambda h: F.array_contains(F.get(cell, F.pmod(h, F.lit(cells)).cast("int")), h)

    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[0-9a-z]+"), F.lit(0))
    d = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    hashed = d.withColumn("hashes", _shingles("words", shingle, True))
    near = F.coalesce(F.arrays_overlap("hashes", every), F.lit(False))
    rows = scratch.table(hashed.select("doc_id", F.monotonically_increasing_id().alias("row"), F.when(near, F.col("words")).alias("words"), F.when(near, F.col("hashes")).alias("hashes")), "rows")

    spots = rows.where("hashes is not null").withColumn("spots", F.filter(F.transform("hashes", lambda h, i: F.when(is_known(h), i)), lambda i: i.isNotNull()))
    # Only a window's own part of the text goes with it.
    part = lambda x: F.struct(x["w"].alias("w"), x["j"].alias("j"), F.slice("hashes", x["j"] + 1, x["w"]).alias("held"), F.slice("words", x["j"] + 1, x["w"] + (shingle - 1)).alias("words"))
    windows = spots.select("row", F.inline(F.transform(F.flatten(F.array(*[_windows("spots", w) for w in classes])), part)))
    minima = lambda column: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(column, lambda h: F.xxhash64(h, b))))
    signed = windows.select("row", "w", "j", "words", F.posexplode(minima(F.col("held"))).alias("band", "low"))
    w_of = F.element_at(F.create_map(*[F.lit(x) for n in sizes for x in (n, window_class(n))]), F.size("t_hashes"))
    keyed = t.withColumn("w", w_of).select("license", "part", "w", "t_texts", F.posexplode(minima(F.col("t_hashes"))).alias("band", "low"))
    met = signed.join(F.broadcast(keyed), ["w", "band", "low"]).dropDuplicates(["row", "w", "j", "license", "part"])

    own = _shingles("words", shingle, False)
    checked = met.withColumn("own", own).withColumn("found", F.filter(F.transform("own", lambda s, i: F.when(F.array_contains(F.col("t_texts"), s), i)), lambda i: i.isNotNull()))
    checked = checked.withColumn("containment", F.size(F.array_intersect("own", "t_texts")) / F.size("t_texts")).where(F.col("containment") >= least)
    best = F.struct((-F.col("containment")).alias("c"), (F.col("j") + F.array_min("found")).alias("start"), (F.col("j") + F.array_max("found") + shingle).alias("end"))
    best = checked.groupBy("row", "license").agg(F.min(best).alias("b"))
    lists = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("license", (-F.col("b.c")).alias("containment"), "b.start", "b.end"))).alias("matches"))
    none = F.array().cast("array<struct<license:string,containment:double,start:int,end:int>>")
    return rows.select("doc_id", "row").join(lists, "row", "left").select("doc_id", F.coalesce("matches", none).alias("matches"))


def _windows(spots: str, w: int) -> Column:
    """(w, start) of the windows of ``w`` shingles, every w/2 from 0, that hold one of the shingles at ``spots``."""
    half = w // 2
    last = lambda i: (i - F.pmod(i, F.lit(half))).cast("int")
    starts = F.flatten(F.transform(spots, lambda i: F.when(last(i) >= half, F.array(last(i) - half, last(i))).otherwise(F.array(last(i)))))
    return F.transform(F.array_distinct(starts), lambda j: F.struct(F.lit(w).alias("w"), j.alias("j")))
