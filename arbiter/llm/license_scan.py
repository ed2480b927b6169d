"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Words are runs of ``[a-z0-9]`` of the lower-cased text. A template of m words belongs to the class of
the next power of two L (8 at least); a text is cut into windows of 2L words, one every L words, so any
L words lie within one window. A window and a template share a band (one MinHash each) with the
probability of their Jaccard similarity, and a class has as many bands as it takes for a window with
0.8 of a template's five-word shingles to be retrieved with a probability of 0.9999 or more. A
retrieved template is a match if the window has at least 0.8 of its shingles, counted exactly.

Before that, texts without any of a template's anchor words are passed over. Anchors are words of more
than a fifth of a template's shingles, so such a text can't have 0.8 of them: no match is lost.

Only DataFrame functions are used. Null and empty texts have no matches; a template of fewer than five
words is one shingle of them all; very long texts have as many windows as it takes. Among windows of one
text, the one with most shingles is reported, the earliest of equals. Repeated rows match each. An empty
table gives no rows. Columns beyond the id and the text are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT

WIDTH = 5
CONTAINMENT = 0.8
FOUND = 0.9999

# Notices of public licenses, word for word (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_shingles(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))))


def class_of(words: list[str]) -> int:
    return max(8, 1 << (len(words) - 1).bit_length())


def bands_of(size: int, templates: list[list[str]]) -> int:
    """Bands that a class needs so that its hardest match is retrieved with the stated probability."""
    most = 2 * size - WIDTH + 1
    least = min(math.ceil(CONTAINMENT * (n := len(template_shingles(w)))) / (most + n - math.ceil(CONTAINMENT * n)) for w in templates)
    return math.ceil(math.log(1 - FOUND) / math.log(1 - least))


def anchors_of(words: list[str]) -> list[str]:
    """The longest words, as many as it takes to lie in more shingles than a match may lack."""
    shingles, out = [s.split(" ") for s in template_shingles(words)], []
    for w in sorted(dict.fromkeys(words), key=lambda w: (-len(w), w)):
        if sum(any(o in s for o in out) for s in shingles) > len(shingles) - math.ceil(CONTAINMENT * len(shingles)):
            break
        out.append(w)
    return out


def _minhashes(shingles: Column, bands: int) -> Column:
    """Of a window, one MinHash for each band, as keys that name the band."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda band: F.xxhash64(band, F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, band)))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, containment, window_word, n_windows`` of every match."""
    spark = docs.sparkSession
    words = {name: template_words(text) for name, text in (templates or TEMPLATES).items()}
    by_class: dict[int, list[str]] = {}
    for name, w in words.items():
        by_class.setdefault(class_of(w), []).append(name)
    low = F.lower(F.col(text_col))
    anchors = sorted({a for w in words.values() for a in anchors_of(w)})
    anchors = [a for a in anchors if not any(b != a and b in a for b in anchors)]
    some = docs.where(F.lower(F.col(text_col)).rlike("|".join(anchors))).select(F.col(id_col).alias("doc_id"), F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    count = F.size("words")
    shingle = F.transform(F.sequence(F.lit(1), F.greatest(count - (WIDTH - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("words", i, WIDTH), " ")))
    some = some.where(count > 0).select("doc_id", count.alias("n"), shingle.alias("shingles"))
    found = None
    for size, names in sorted(by_class.items()):
        bands = bands_of(size, [words[n] for n in names])
        per = 2 * size - WIDTH + 1
        windows = some.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest((F.col("n") - 1 - size) / size, F.lit(0)).cast("int"))).alias("k"), "shingles")
        windows = windows.select("doc_id", (F.col("k") * size).alias("window_word"), F.array_distinct(F.slice("shingles", F.col("k") * size + 1, per)).alias("has"))
        rows = [(name, s) for name in names for s in template_shingles(words[name])]
        known = spark.createDataFrame(rows, "license string, s string").groupBy("license").agg(F.array_sort(F.collect_set(F.xxhash64("s"))).alias("wants"))
        keys = known.select("license", "wants", F.explode(_minhashes(F.col("wants"), bands)).alias("key"))
        # Given templates may be many or long; their size is known, and beyond the bound the join shuffles.
        size_of_keys = len(names) * bands * (8 * max(len(template_shingles(words[n])) for n in names) + 64)
        keys = F.broadcast(keys) if size_of_keys <= BROADCAST_LIMIT else keys.hint("merge")
        # Windows carry their keys as one array; only those that share a key with a template go on.
        hits = windows.where(F.size("has") > 0).select("doc_id", "window_word", "has", F.explode(_minhashes(F.col("has"), bands)).alias("key")).join(keys, "key")
        shared = F.size(F.array_intersect("has", "wants")) / F.size("wants")
        part = hits.select("doc_id", "license", "window_word", shared.alias("containment")).where(F.col("containment") >= CONTAINMENT)
        found = part if found is None else found.unionAll(part)
    best = F.max(F.struct("containment", -F.col("window_word")))
    out = found.groupBy("doc_id", "license").agg(best.alias("b"), F.count_distinct("window_word").alias("n_windows"))
    return out.select("doc_id", "license", F.round("b.containment", 6).alias("containment"), (-F.col("b.col2")).cast("long").alias("window_word"), "n_windows")


def oracle(templates: dict[str, str] | None = None) -> str:
    """DuckDB SQL for the same matches by exact containment of every window."""
    rows = []
    for name, text in (templates or TEMPLATES).items():
        words = template_words(text)
        listed = ", ".join("'" + s + "'" for s in template_shingles(words))
        rows.append(f"('{name}', {class_of(words)}, [{listed}])")
    return f"""
WITH t(license, size, wants) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, len(words) AS n, list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' ')) AS sh FROM w WHERE len(words) > 0),
k AS (SELECT doc_id, size, sh, unnest(range(0, greatest((n - 1 - size) // size, 0) + 1)) AS k FROM s, (SELECT DISTINCT size FROM t)),
m AS (SELECT doc_id, license, k * k.size AS window_word, len(list_intersect(list_distinct(sh[k * k.size + 1:k * k.size + 2 * k.size - 4]), wants)) / len(wants) AS c FROM k JOIN t ON t.size = k.size)
SELECT doc_id, license, round(max(c), 6) AS containment, arg_min(window_word, (-c, window_word)) AS window_word, count(*) AS n_windows
FROM m WHERE c >= {CONTAINMENT} GROUP BY ALL
"""
