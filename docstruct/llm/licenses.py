"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle
containment verifies them.

Texts are lower-cased words of letters and digits, shingles are five words; a template of fewer
words is one shingle of its own width, and texts are shingled at these widths too. Windows of WINDOW
shingles of one width begin every WINDOW / 2 shingles; each of BANDS bands is one minimum under its own hash. A
template of one shingle inside a window of 16 has similarity 1/16, so each of the two windows that
hold it meets it in some of 128 bands with probability 1 - (15/16)^128 = 0.9997; longer templates
are cut into windows of their own and meet more surely.

A window's band equals a template's only if the window holds the template's shingle of that band.
So only windows that hold a template shingle are hashed: the others could retrieve nothing. The
words of a text are read in one pass without a shuffle; what leaves it are these windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.llm.store import written

WORDS = 5
WINDOW = 16
BANDS = 128
CONTAINMENT = 0.8
MAX_TEMPLATE_WORDS = 1_000_000  # of all templates together: the bound of what is broadcast

# Notices as they stand in files. Fixed values.
NOTICES = {
    "MIT": [
        "MIT License", "SPDX-License-Identifier: MIT",
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"),"
        " to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,"
        " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    ],
    "Apache-2.0": [
        "Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD": [
        "BSD License", "BSD-2-Clause", "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "ISC": ["ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MPL-2.0": ["MPL-2.0", "Mozilla Public License 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced"],
}
GPL = ("GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License")
CREATIVE_COMMONS = ("CC BY", "CC BY-SA", "CC BY-NC", "CC BY-ND", "CC BY-NC-SA", "CC BY-NC-ND")


def default_templates() -> list[tuple[str, str]]:
    """(license, text) of well-known notices."""
    out = [(name, text) for name, texts in NOTICES.items() for text in texts]
    for name in GPL:
        short = "".join(w[0] for w in name.split()[1:] if w != "General").replace("PL", "GPL")
        for version in ("2", "3"):
            out.append((f"{short}-{version}", f"This work is licensed under the {name}, version {version}."))
            out.append((f"{short}-{version}", f"under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License"))
    for name in CREATIVE_COMMONS:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            code = f"{name} {version}".replace(" ", "-")
            out += [(code, f"Licensed under {name} {version}."), (code, f"This work is licensed under a {name} {version} license.")]
    return out


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    rows = default_templates() if templates is None else templates
    schema = T.StructType([T.StructField(c, t, False) for c, t in (("template", T.IntegerType()), ("license", T.StringType()), ("body", T.StringType()))])
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingle(words: str, at: Column, width: int = WORDS) -> Column:
    """With its width, unless that is WORDS: a hash of too few words must not equal a narrower one."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(width)], *[F.lit(width)] * (width < WORDS))


def _shingles(words: str, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: _shingle(words, i, width))


def _by_width(widths: list[int], value) -> Column:
    """value(width) for the width of the row."""
    out = F.lit(None)
    for k in widths:
        out = F.when(F.col("width") == k, value(k)).otherwise(out)
    return out


def _bands(shingles: Column) -> Column:
    """One minimum per band of an array of shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def scan_licenses(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and license found: id, license, first_word, last_word, containment.

    *templates* has (template int, license, body); a license is found where at least *containment*
    of the distinct shingles of one of its templates (five words, or the whole of a shorter template)
    stand within a span of the text as
    long as the template and a window around a retrieving window. first_word and last_word (from 0)
    span the shingles found, over all its places in the text; containment is the best of its
    templates. Templates without words match nothing, nor do null, empty or shorter texts. Rows that repeat an identifier are one document here; rows with a null identifier
    likewise. An empty table gives an empty result; further columns are ignored.
    """
    known = templates.select("template", "license", word_list(F.col("body")).alias("w")).where("size(w) > 0").withColumn("width", F.least(F.size("w"), F.lit(WORDS)))
    size, widths = known.agg(F.sum(F.size("w")), F.sort_array(F.collect_set("width"))).first()  # WORDS widths at most
    if (size or 0) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of {size} words together; they are broadcast, so {MAX_TEMPLATE_WORDS} is the bound")
    widths = widths or [WORDS]
    known = known.withColumn("s", _by_width(widths, lambda k: _shingles("w", k)))
    known = written(known.select("template", "license", "width", "s", F.size(F.array_distinct("s")).alias("size")), "license-templates")
    shingles = known.select("template", "width", "size", F.size("s").alias("long"), F.explode(F.array_distinct("s")).alias("s"))
    starts = lambda n: F.sequence(F.lit(0), F.greatest(n - WINDOW // 2, F.lit(0)), F.lit(WINDOW // 2))
    bands = known.select("template", F.explode(starts(F.size("s"))).alias("at"), "s").select("template", F.posexplode(_bands(F.slice("s", F.col("at") + 1, WINDOW))).alias("band", "least")).distinct()

    # The one pass over the texts.
    words = docs.select(F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), word_list(F.col(text_col)).alias("w")).where(F.size("w") >= widths[0])
    placed = words.select("id", "row", "w", F.explode(F.sequence(F.lit(0), F.size("w") - widths[0])).alias("pos"))
    placed = placed.select("id", "row", "w", "pos", F.explode(F.array(*[F.struct(F.lit(k).alias("width"), _shingle("w", F.col("pos"), k).alias("s")) for k in widths])).alias("x"))
    placed = placed.select("id", "row", "w", "pos", "x.width", "x.s").where(F.col("pos") + F.col("width") <= F.size("w"))
    placed = placed.join(F.broadcast(shingles.select("width", "s").distinct()), ["width", "s"])
    half = WINDOW // 2
    window = F.floor(F.col("pos") / half).cast("int")
    hits = placed.select("id", "row", "pos", "width", "s", window.alias("win"), F.slice("w", F.greatest(window - 1, F.lit(0)) * half + 1, F.col("width") + WINDOW + half - 1).alias("near"))
    hits = written(hits, "license-hits")  # from here on "row" is fixed; an identifier may stand in several rows

    # Windows around the hits, hashed once each.
    offset = F.least("win", F.lit(1))  # the slice begins a window earlier, except in the first
    both = hits.select("row", "width", "near", F.explode(F.array(F.struct(F.col("win").alias("win"), (offset * half).alias("from")), F.struct((F.col("win") - 1).alias("win"), F.lit(0).alias("from")))).alias("x"))
    both = both.select("row", "width", "x.win", F.slice("near", F.col("x.from") + 1, F.col("width") + WINDOW - 1).alias("near")).where("win >= 0 AND size(near) >= width").dropDuplicates(["row", "width", "win"])
    windows = both.select("row", "win", F.posexplode(_bands(_by_width(widths, lambda k: _shingles("near", k)))).alias("band", "least"))
    retrieved = windows.join(F.broadcast(bands), ["band", "least"]).select("row", "win", "template").distinct()

    # Exact containment of the template around each retrieving window.
    claims = retrieved.join(F.broadcast(shingles.select("template", "width", "size", "long", "s")), "template")
    found = claims.join(hits.select("id", "row", "pos", "s"), ["row", "s"]).where(
        (F.col("pos") >= F.col("win") * half - F.col("long")) & (F.col("pos") < F.col("win") * half + WINDOW + F.col("long"))
    )
    found = found.groupBy("id", "row", "win", "template", "size").agg(
        F.count_distinct("s").alias("shared"), F.min("pos").alias("first"), (F.max("pos") + F.first("width") - 1).alias("last")
    ).withColumn("containment", F.col("shared") / F.col("size")).where(F.col("containment") >= containment)
    named = found.join(F.broadcast(known.select("template", "license")), "template")
    return named.groupBy("id", "license").agg(
        F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.max("containment").alias("containment")
    ).withColumnRenamed("id", id_col)


def collision_probability(similarity: float, bands: int = BANDS) -> float:
    """That a window meets a template of this Jaccard similarity in some band."""
    return 1 - math.pow(1 - similarity, bands)
