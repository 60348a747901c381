"""License scans: MinHash bands over text windows retrieve templates, shingles verify them.

One scan with DataFrame functions. Words are lower-case runs of letters and digits. Windows are
runs of 5-word shingles that overlap by half; the signature of a window is, for each of
BANDS constants c, the least of (shingle hash xor c). Bands have one row, so a window that
shares a share J of shingles with a template window is found with probability
1 - (1 - J) ** BANDS: 0.99998 at J = 0.75 and 0.996 at J = 0.5. Templates of fewer than LONG shingles
have windows of one shingle, where any shared shingle is a hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .text_stats import let, window_hashes

SHINGLE = 5
WINDOW = 8
STRIDE = 4
LONG = 12
BANDS = 8
#: Places at which a template is searched, at least.
SPOTS = 64
SIMILARITY = 0.75
#: Words of the templates of one scan, about, a long one counted by the places it is searched at: their keys become part of the
#: plan. More templates are searched in several scans.
BLOCK_WORDS = 500

#: Wording of common public license notices.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["licensed under the GNU Lesser General Public License"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
}


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column) -> Column:
    last = F.size(w) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(SHINGLE))))).otherwise(F.array().cast("array<string>"))


def _constants() -> list[int]:
    """Spread over the top bits, so that each favours another part of the hashes."""
    step, out = 0x9E3779B97F4A7C15, []
    for k in range(1, BANDS + 1):
        c = (k * step) & 0xFFFFFFFFFFFFFFFF
        out.append(c - (1 << 64) if c >> 63 else c)
    return out


def band_keys(window: Column) -> list[Column]:
    """The key of each band for a window of WINDOW hashes; places past its end are NULL and don't count."""
    return [F.least(*(F.get(window, F.lit(j)).bitwiseXOR(F.lit(c)) for j in range(WINDOW))) for c in _constants()]


def _blocks(templates: dict[str, list[str]], words: int) -> list[dict[str, list[str]]]:
    """Licenses in scans of about so many words; one license is never parted."""
    blocks: list[dict[str, list[str]]] = [{}]
    held = 0
    for name, texts in sorted(templates.items()):
        size = sum(min(len(t.split()), SPOTS * STRIDE) for t in texts)
        if blocks[-1] and held + size > words:
            blocks.append({})
            held = 0
        blocks[-1][name] = texts
        held += size
    return blocks


def _template_rows(spark: SparkSession, templates: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(template, license, n, key, at, short) of each key, and (template, wanted) of each template.

    A long template is searched at SPOTS places: each is STRIDE windows in a row, one of which lies as a text's windows do.
    """
    rows = [(k, name, text) for k, (name, text) in enumerate((n, t) for n, ts in sorted(templates.items()) for t in ts)]
    both = let(license_words(F.col("t")), lambda w: F.struct(F.array_distinct(shingles(w)).alias("wanted"), window_hashes(w, SHINGLE).alias("h")))
    frame = spark.createDataFrame(rows, "template int, license string, t string").select("template", "license", both.alias("b")).select("template", "license", "b.*").where(F.size("h") > 0)
    frame = materialize(frame, "templates")  # else the hashes would be made anew for each window
    short = F.size("h") < LONG
    single = F.transform("h", lambda x, i: F.struct(x.alias("key"), i.alias("at")))
    step = F.greatest(F.lit(1), F.floor(F.size("h") / (SPOTS * STRIDE)).cast("int")) * STRIDE
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("h") - WINDOW, F.lit(0))), lambda i: i % step < STRIDE)
    windows = F.flatten(F.transform(starts, lambda i: F.transform(let(F.slice("h", i + 1, F.lit(WINDOW)), lambda s: F.array(*band_keys(s))), lambda x: F.struct(x.alias("key"), i.alias("at")))))
    keys = frame.select("template", "license", F.size("h").alias("n"), short.alias("short"), F.explode(F.when(short, single).otherwise(windows)).alias("k"))
    return keys.select("template", "license", "n", "k.key", "k.at", "short").distinct(), frame.select("template", "wanted")


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, similarity: float = SIMILARITY, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document row and license found, with the document's columns but its text.

    Adds license, containment (share of the template's distinct 5-word shingles in the region
    around the window, at least ``similarity``), first_word and end_word (of the region's
    matching shingles, in words). Of several finds of a license in a document the one of
    highest containment, then first, stays. NULL, empty and shorter texts, and templates of under
    five words, match nothing. Repeated rows are scanned one by one, told apart by their place
    in the input. Columns named like an output are replaced, others may have any names.

    Texts stay in the scan; only finds are shuffled. Templates may be of any number and length: of more than
    ``block_words`` words each block of licenses is a scan of its own.
    """
    docs = docs.drop("license", "containment", "first_word", "end_word")
    blocks = _blocks(TEMPLATES if templates is None else templates, block_words)
    return reduce(DataFrame.unionAll, (_scan_block(docs, b, similarity, text) for b in blocks))


def _scan_block(docs: DataFrame, templates: dict[str, list[str]], similarity: float, text: str) -> DataFrame:
    spark = docs.sparkSession
    keyed, bodies = _template_rows(spark, templates)
    keys = [r.asDict() for r in keyed.collect()]  # a block's keys
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    singles = sorted({r["key"] for r in keys if r["short"]}) or [0]
    banded = sorted({r["key"] for r in keys if not r["short"]}) or [0]

    def hits(h: Column) -> Column:
        at = lambda x, i: F.struct(x.alias("key"), i.cast("int").alias("at"))
        none = F.array().cast("array<struct<key:bigint,at:int>>")
        # most texts have no hash of a short template: they are told by one pass without structs
        short = F.when(F.exists(h, lambda x: x.isin(singles)), F.filter(F.transform(h, at), lambda s: s["key"].isin(singles))).otherwise(none)
        starts = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1, F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))

        def of_window(s: Column, i: Column) -> Column:
            keys = band_keys(s)
            some = reduce(lambda a, b: a | b, (k.isin(banded) for k in keys))
            return F.when(some, F.transform(F.filter(F.array(*keys), lambda x: x.isin(banded)), lambda x: at(x, i)))

        windows = F.transform(starts, lambda i: let(F.slice(h, i + 1, F.lit(WINDOW)), lambda s: of_window(s, i)))
        return F.concat(short, F.flatten(F.filter(windows, lambda x: x.isNotNull())))

    # the words stay one column, read by both the search and the check; a document's columns go as one
    row = F.monotonically_increasing_id().alias("row")
    worded = docs.select((F.struct(*kept) if kept else F.lit(0)).alias("doc"), license_words(F.col(f"`{text}`")).alias("w"), row)
    found = worded.select("doc", "w", "row", F.explode(let(window_hashes(F.col("w"), SHINGLE), hits)).alias("hit"))
    known = spark.createDataFrame([(r["key"], r["template"], r["license"], r["n"], r["at"]) for r in keys], "key long, template int, license string, n int, at int")
    pairs = found.join(F.broadcast(known), F.col("hit")["key"] == F.col("key")).join(F.broadcast(bodies), "template")
    slack = F.greatest(F.lit(2), F.floor(F.col("n") / 4).cast("int"))
    start = F.greatest(F.col("hit")["at"] - F.col("at") - slack, F.lit(0))
    region = F.slice("w", start + 1, F.col("n") + 2 * slack + SHINGLE - 1)
    # of the first shingle that the template has
    place = lambda s: (F.array_position(s, F.get(F.array_intersect(s, "wanted"), F.lit(0))) - 1).cast("int")
    checked = (
        pairs.withColumn("s", let(region, shingles)).withColumn("start", start)
        .withColumn("containment", F.size(F.array_intersect("s", "wanted")) / F.size("wanted"))
        .where(F.col("containment") >= similarity)
        .withColumn("first_word", F.col("start") + place(F.col("s")))
        .withColumn("end_word", F.col("start") + F.size("s") - 1 - place(F.reverse("s")) + SHINGLE)
    )
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("first"), "end_word")).alias("best")
    finds = checked.groupBy("row", "license").agg(best, F.first("doc").alias("doc"))
    return finds.select(*(["doc.*"] if kept else []), "license", F.col("best.containment").alias("containment"), (-F.col("best.first")).alias("first_word"), F.col("best.end_word").alias("end_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
