"""License scans by MinHash bands over overlapping windows, in DataFrame operations only.

Words are runs of letters and digits in lower case; shingles are five words. A document's shingles are cut into
windows of four that overlap by two, and so are the templates' (at every offset). A window's signature has a minimum
of its shingles' hashes for each of `bands` seeds, one row a band, so windows of Jaccard similarity s meet in at
least one band with probability 1 - (1 - s) ** bands; the smallest s that matters, a template of a single shingle in
a full window (1/4), is met with 0.99 at 16 bands, and three shared shingles (3/4) with 1 - 1e-9. Retrieved templates
are then verified: a template matches if at least `containment` of its distinct shingles, as text, occur within the
stretch around the window that the template can span.

Signatures are only made of documents with at least one of the templates' shingles: any other window's minimum can't
be one of a template's, so this loses nothing. The templates are a fixed table of a few kilobytes; what is
broadcast is theirs, and there is no shuffle of texts: candidates are judged where the document is.

Nulls and odd rows: null and empty texts, and texts of under five words, have no shingles and no licenses; repeated
rows come out as often as they went in; a template of under five words is refused; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .native import let, runs

WIDTH, WINDOW, STEP = 5, 4, 2

#: Well-known license notices, in their published wording.
TEMPLATES = (
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0-disclaimer", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("GPL-3.0-header", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC-permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT-notice", "Released under the MIT License"),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

#: All ASCII characters that are not letters or digits.
MARKS = "".join(map(chr, [*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(text), MARKS, " " * len(MARKS)), " "), "")


def signature(hashes: Column, bands: int) -> Column:
    """For each band the smallest hash under the band's permutation (exclusive or with a random number)."""
    seeds = F.array(*(F.lit(_signed(xxh64_intdigest(f"band {b}"))) for b in range(bands)))
    return F.transform(seeds, lambda s: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(s))))


def _shingle_texts(words: Column, low: Column, high: Column) -> Column:
    """Shingles as text, of positions low to high - 1 (from 0)."""
    return F.transform(F.sequence(low, high - 1), lambda i: F.array_join(F.slice(words, i + 1, WIDTH), " "))


def template_windows(templates: DataFrame, bands: int) -> DataFrame:
    """(license, band, value, hashes, shingles): the templates' signatures, one row a band and window."""
    w = templates.select("license", words(F.col("notice")).alias("words"))
    w = w.withColumn("hashes", runs(F.col("words"), WIDTH)).withColumn("n", F.size("hashes"))
    w = w.withColumn("shingles", F.array_distinct(_shingle_texts(F.col("words"), F.lit(0), F.col("n"))))
    at = w.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0)))))
    signed = at.select("license", "hashes", "shingles", signature(F.slice("hashes", F.col("i") + 1, WINDOW), bands).alias("s"))
    return signed.select("license", "hashes", "shingles", F.posexplode("s").alias("band", "value"))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, notice string")


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", bands: int = 16, containment: float = 0.8) -> DataFrame:
    """Per document: doc_id, n_words, n_windows (candidate windows), licenses (array of (license, containment, word of the first match), by name)."""
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    rows = template_windows(templates, bands).collect()  # a few per word of the templates
    if short := [r["license"] for r in templates.where(F.size(words(F.col("notice"))) < WIDTH).collect()]:
        raise ValueError(f"templates of under {WIDTH} words: {short}")
    vocabulary = sorted({h for r in rows for h in r["hashes"]})
    known = {r["license"]: r["shingles"] for r in rows}
    names = sorted(known)
    of: dict[tuple[int, int], set[str]] = {}
    for r in rows:
        of.setdefault((r["band"], r["value"]), set()).add(r["license"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))

    # Retrieval: for each band the templates' values and what they stand for, as literal maps.
    per_band = []
    for b in range(bands):
        entries = sorted((v, sorted(ls)) for (band, v), ls in of.items() if band == b)
        flat = [x for v, ls in entries for x in (F.lit(v), F.array(*(F.lit(names.index(name)) for name in ls)))]
        per_band.append(F.create_map(*flat))
    tables = F.array(*per_band)
    shingles_of = F.array(*(F.array(*map(F.lit, known[n])) for n in names))
    none = F.array().cast("array<struct<t:int,at:int,share:double>>")

    def matches(ws: Column, hashes: Column) -> Column:
        n = F.size(hashes)
        starts = F.sequence(F.lit(0), F.greatest(n - WINDOW + STEP - 1, F.lit(0)), F.lit(STEP))

        def retrieved(start: Column) -> Column:
            values = signature(F.slice(hashes, start + 1, WINDOW), bands)
            hit = F.flatten(F.transform(values, lambda v, b: F.coalesce(F.try_element_at(F.get(tables, b), v), F.array().cast("array<int>"))))
            return F.transform(F.array_distinct(hit), lambda t: F.struct(start.alias("at"), t.alias("t")))

        def verified(found: Column) -> Column:
            def share(x: Column) -> Column:
                own = F.get(shingles_of, x["t"])
                span = F.size(own)
                low, high = F.greatest(x["at"] - span, F.lit(0)), F.least(x["at"] + WINDOW + span, n)
                return F.size(F.array_intersect(own, _shingle_texts(ws, low, high))) / span

            scored = F.transform(found, lambda x: F.struct(x["t"].alias("t"), x["at"].alias("at"), share(x).alias("share")))
            return F.filter(scored, lambda x: x["share"] >= containment)

        has = F.exists(hashes, lambda h: h.isin(vocabulary))
        return F.when(has, F.flatten(F.transform(starts, retrieved))).otherwise(F.array().cast("array<struct<at:int,t:int>>")).alias("found"), verified

    def judge(ws: Column) -> Column:
        def with_hashes(hashes: Column) -> Column:
            found, verified = matches(ws, hashes)
            return let(found, lambda f: F.struct(F.size(ws).cast("bigint").alias("n_words"), F.size(f).cast("bigint").alias("n_windows"), F.when(F.size(f) > 0, verified(f)).otherwise(none).alias("hits")))

        return let(runs(ws, WIDTH), with_hashes)

    out = base.select("doc_id", let(words(F.col("text")), judge).alias("j")).select("doc_id", "j.*")
    best = lambda hits, t: F.filter(hits, lambda x: x["t"] == t)
    name_of = F.array(*map(F.lit, names))

    def summary(hits: Column) -> Column:
        kinds = F.sort_array(F.array_distinct(F.transform(hits, lambda x: x["t"])))
        return F.transform(
            kinds,
            lambda t: F.struct(
                F.get(name_of, t).alias("license"),
                F.array_max(F.transform(best(hits, t), lambda x: x["share"])).alias("containment"),
                F.array_min(F.transform(best(hits, t), lambda x: x["at"])).cast("bigint").alias("word"),
            ),
        )

    return out.select("doc_id", "n_words", "n_windows", summary(F.col("hits")).alias("licenses"))
