"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.
DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.text import table
from tidewater.spark import materialize

#: Words of a shingle; a shorter template is one shingle. A template is found where this share of its shingles stands.
WIDTH, CONTAINMENT = 5, 0.8

#: Notices in common use, word for word. Fixed values.
TEMPLATES = (
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def normal(text: Column) -> Column:
    """Lower-case words of letters and digits, one blank between them, one at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _words(text: str) -> list[str]:
    out = "".join(c.lower() if c.isalnum() else " " for c in text)
    return out.split()


def _groups(templates) -> dict[tuple[int, int], list[tuple[str, list[str]]]]:
    """Templates by (shingle width, class); the class is the power of two that holds the words."""
    out: dict[tuple[int, int], list[tuple[str, list[str]]]] = {}
    for name, text in templates:
        w = _words(text)
        if w:
            out.setdefault((min(WIDTH, len(w)), 1 << (len(w) - 1).bit_length()), []).append((name, w))
    return out


def _grams(words: list[str], width: int) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + width]) for i in range(len(words) - width + 1)))


def _anchors(templates) -> list[str]:
    """A few patterns, one of which is in every shingle of every template: long words, chosen greedily, or the whole shingle
    where it has none. Words with a k are no anchors, as a sign beyond ASCII (the Kelvin) has the same lower case."""
    left = [g.split() for (width, _), group in _groups(templates).items() for _, w in group for g in _grams(w, width)]
    out = []
    while left:
        words = sorted({w for g in left for w in g if len(w) >= 6 and "k" not in w})
        if not words:
            return sorted(out + ["[^\\p{L}\\p{N}]+".join(g) for g in left])
        best = max(words, key=lambda w: (sum(w in g for g in left), len(w)))
        out.append(best)
        left = [g for g in left if not any(best in w for w in g)]
    return sorted(out)


def _once(column: Column) -> Column:
    """A generator's output is computed once; a plain column would be repeated in every expression that names it."""
    return F.explode(F.array(column))


def _hashed(words: Column, width: int) -> Column:
    last = F.size(words) - width + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, width), " ")))).otherwise(F.array().cast("array<long>"))


def _seeds(spark: SparkSession, groups) -> list[list[int]]:
    """Hash seeds of the bands of each class, by which no template is missed: a band can't miss if the smallest hash among all
    shingles of the class is one of the template's and stands in the window. Bands are added until each template has more such
    shingles than may be absent."""
    rows = [(c, " ".join(g)) for c, ((width, _), group) in enumerate(groups) for g in sorted({tuple(g.split()) for _, w in group for g in _grams(w, width)})]
    hashed = materialize(spark.createDataFrame(rows, "c int, gram string"))
    out, seed, step = [[] for _ in groups], 0, 64
    left = [[[set(grams), sum(k / len(grams) >= CONTAINMENT for k in range(1, len(grams) + 1))] for _, w in group for grams in [_grams(w, width)]] for (width, _), group in groups]
    while any(left):
        low = hashed.withColumn("seed", F.explode(F.sequence(F.lit(seed), F.lit(seed + step - 1)))).groupBy("c", "seed").agg(F.min_by("gram", F.xxhash64(F.xxhash64("gram"), "seed")).alias("gram"))
        for c, b, gram in sorted(map(tuple, low.collect())):
            used = False
            for t in left[c]:
                if gram in t[0]:
                    t[0].discard(gram)
                    t[1] -= 1
                    used = True
            if used:
                out[c].append(b)
            left[c] = [t for t in left[c] if t[1] > 0]
        seed, step = seed + step, step * 2
    return out


def _bands(shingles: Column, seeds: list[int]) -> Column:
    """The smallest hash of the shingles under each seeded hash function, with the band's seed."""

    def low(b: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(b))))

    return F.array(*[F.struct(F.lit(b).alias("band"), low(b).alias("low")) for b in seeds])


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row for each document and each template found in it: doc_id, license, windows, first_word, containment.

    Words are lower-cased runs of letters and digits. For each class of templates the text is cut into windows of twice
    the class, half a window apart, so every place of a template lies in one. A window that shares no shingle with any template
    can't contain one and is passed over; of the others the shingles of templates count, since others only hide them; their
    bands retrieve every template that the window holds (see ``_seeds``), and one is found if at least CONTAINMENT of its distinct shingles stand in the window. ``windows`` counts those, ``first_word`` is where the first
    begins, ``containment`` the largest share. Null and empty texts have none; repeated rows count as one document's windows;
    very long texts are scanned whole; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    # one regular expression passes over the texts; only those with an anchor word are normalised and looked at shingle by shingle
    rows = docs.select("doc_id", "text").filter(F.rlike("text", F.lit("(?i)" + "|".join(_anchors(templates)))))
    rows = rows.select("doc_id", _once(normal(F.col("text"))).alias("_n"))
    found = None
    groups = sorted(_groups(templates).items())
    some = F.lit(False)
    for (width, _), group in groups:
        for g in sorted({g for _, w in group for g in _grams(w, width)}):
            some = some | F.contains(F.col("_n"), F.lit(f" {g} "))
    words = F.split(F.trim(F.col("_n")), " ")
    rows = materialize(rows.filter(some).select("doc_id", words.alias("_w")))
    for ((width, size), group), seeds in zip(groups, _seeds(spark, groups), strict=True):
        known = spark.createDataFrame([(n, _grams(w, width)) for n, w in group], "license string, grams array<string>")
        known = known.select("license", F.transform("grams", lambda g: F.xxhash64(g)).alias("_t"))
        hashes = F.array(*[F.xxhash64(F.lit(g)) for g in sorted({g for _, w in group for g in _grams(w, width)})])
        h = rows.select("doc_id", _once(_hashed(F.col("_w"), width)).alias("_h")).filter(F.size("_h") > 0)
        span = 2 * size - width + 1
        windows = F.transform(F.sequence(F.lit(0), F.size("_h") - 1, F.lit(size)), lambda i: F.struct(i.alias("at"), F.slice("_h", i + 1, span).alias("s")))
        near = materialize(h.select("doc_id", F.explode(F.filter(windows, lambda w: F.arrays_overlap(w["s"], hashes))).alias("w")).select("doc_id", F.col("w.at").alias("at"), F.array_intersect("w.s", hashes).alias("s")))
        probes = near.select("doc_id", "at", "s", F.explode(_bands(F.col("s"), seeds)).alias("k")).select("doc_id", "at", "s", "k.band", "k.low")
        bands = known.select("license", "_t", F.explode(_bands(F.col("_t"), seeds)).alias("k")).select("license", "_t", "k.band", "k.low")
        met = probes.join(F.broadcast(bands), ["band", "low"])  # as many rows as the templates have bands
        share = F.size(F.array_intersect("s", "_t")) / F.size("_t")
        hit = met.select("doc_id", "at", "license", share.alias("share")).filter(F.col("share") >= CONTAINMENT).distinct()
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("doc_id", "license").agg(F.count(F.lit(1)).alias("windows"), F.min("at").cast("long").alias("first_word"), F.round(F.max("share"), 6).alias("containment"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices in all ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
