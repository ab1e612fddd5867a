"""License scans in DataFrame functions only: MinHash bands retrieve templates for text windows, containment verifies them.

A template of n words is looked for in windows of n + n/4 words that start every n/4 words, so some window holds all of
any occurrence. A window's Jaccard similarity with a template it contains is at least 0.43 (0.8 of the shingles present,
the window at its longest), and 40 bands of two MinHash values meet at 0.43 with a chance over 0.999; at 0.56, where
all of the template is there, the chance of missing it is 1e-6. What the bands retrieve is kept if the window contains at
least 0.8 of the template's shingles, each window and template compared once.

Which windows are made: an occurrence may lack at most a fifth of the template's shingles, so of any set of more than
a fifth one is there, and with it the words of that shingle. Each template has a few anchor words that hit that many
shingles; windows without an anchor can't match and aren't made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONTAINMENT, WORDS, BANDS, ROWS = 0.8, 5, 40, 2
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Public license notices, by name.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "MIT line": "Released under the MIT License.",
    "All rights reserved": "All rights reserved.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0 header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0 header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0 line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause third clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}


@dataclass(frozen=True)
class Shape:
    """How windows for a template are made: words in a shingle, words in a window, words between starts, anchors."""

    k: int
    length: int
    stride: int
    anchors: tuple[str, ...]


def template_words(text: str) -> list[str]:
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text.lower()).split()


def shape(text: str) -> Shape:
    """The window shape of a template. Anchors: its longest words, until they hit more shingles than may be missing."""
    found = template_words(text)
    if not found:
        raise ValueError("a template needs words")
    n, k = len(found), min(WORDS, len(found))
    grams = [set(found[i : i + k]) for i in range(n - k + 1)]
    most_missing = int((1 - CONTAINMENT) * len({tuple(found[i : i + k]) for i in range(n - k + 1)}) + 1e-9)
    anchors: list[str] = []
    for w in sorted(set(found), key=lambda w: (-len(w), w)):
        if sum(not g.isdisjoint(anchors) for g in grams) > most_missing + (len(grams) - len({frozenset(g) for g in grams})):
            break
        anchors.append(w)
    step = max(1, n // 4)
    return Shape(k, n + step, step, tuple(anchors))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def _shingles(words: Column, k: Column) -> Column:
    """Hashes of k words in a row; null if there are fewer."""
    return F.when(F.size(words) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))))


def _bands(shingles: Column, of: Column) -> Column:
    """Keys of the MinHash bands of a shingle array, for windows of shape `of`."""
    least = F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda j: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, j))))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(of, b, F.slice(least, b * ROWS + 1, ROWS)))


def families(templates: dict[str, str]) -> dict[str, int]:
    """Numbers of the templates' families: those that share half of the shingles of either one, directly or by others."""
    shingles = {}
    for name, text in templates.items():
        found = template_words(text)
        k = min(WORDS, len(found))
        shingles[name] = {tuple(found[i : i + k]) for i in range(len(found) - k + 1)}
    root = {name: i for i, name in enumerate(templates)}
    for a in templates:
        for b in templates:
            if root[a] != root[b] and 2 * len(shingles[a] & shingles[b]) >= max(len(shingles[a]), len(shingles[b])):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {name: new if r == old else r for name, r in root.items()}
    return root


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """`id_col`, license, containment, first_word, end_word: one row for each place of a text that holds a notice; words are
    numbered from 0, end_word is exclusive.

    Windows of one family of like templates that overlap are one place, of which the window and template with the largest
    containment are given (of equal ones the first window, then the first by name); a notice and a longer one that it
    is part of are both given. Null and empty texts, and an empty table, give no rows. Each of repeated rows gives its own;
    a null id is an id. `templates` are names and texts of a number that a broadcast bears (thousands); each needs a word.
    """
    spark: SparkSession = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    shapes = sorted({shape(t) for t in templates.values()}, key=lambda s: (s.k, s.length, s.anchors))
    of, family = {t: shapes.index(shape(t)) for t in templates.values()}, families(templates)
    known = spark.createDataFrame([(name, family[name], text, of[text], shapes[of[text]].k) for name, text in templates.items()], "license string, family int, text string, shape int, k int")
    known = known.withColumn("known", _shingles(_words(F.col("text")), F.col("k")))
    keys = known.select("license", F.explode(_bands(F.col("known"), F.col("shape"))).alias("band"))  # 40 rows a template

    low, anchors = F.lower(F.col("text")), sorted({a for s in shapes for a in s.anchors})
    may = F.lit(False)
    for a in anchors:
        may = may | F.contains(low, F.lit(a))
    kinds = F.array(*(F.struct(F.lit(i).alias("shape"), F.lit(s.k).alias("k"), F.lit(s.length).alias("length"), F.lit(s.stride).alias("stride"), F.array(*map(F.lit, s.anchors)).alias("anchors")) for i, s in enumerate(shapes)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(may).select("row", "id", _words(F.col("text")).alias("words"))
    rows = rows.select("row", "id", "words", F.explode(F.filter(kinds, lambda s: F.arrays_overlap(s["anchors"], F.col("words")))).alias("s"))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(F.col("s.anchors"), F.element_at("words", i + 1)))
    length, stride = F.col("s.length"), F.col("s.stride")
    starts = F.array_distinct(F.flatten(F.transform(at, lambda p: F.transform(F.sequence(F.greatest(F.lit(0), F.ceil((p - length + 1) / stride)).cast("int"), F.floor(p / stride).cast("int")), lambda w: (w * stride).cast("int")))))
    windows = F.transform(starts, lambda a: F.struct(a.alias("start"), F.slice("words", a + 1, length).alias("words")))
    rows = rows.select("row", "id", F.col("s.shape").alias("shape"), F.col("s.k").alias("k"), F.explode(windows).alias("w"))
    rows = rows.select("row", "id", "shape", F.col("w.start").alias("start"), F.size("w.words").alias("n"), _shingles(F.col("w.words"), F.col("k")).alias("own")).where("own is not null")
    rows = rows.select("row", "id", "start", "n", "own", F.explode(_bands(F.col("own"), F.col("shape"))).alias("band"))
    met = rows.join(F.broadcast(keys), "band").groupBy("row", "start", "n", "license").agg(F.first("id").alias("id"), F.first("own").alias("own"))  # a pair is verified once
    met = met.join(F.broadcast(known.select("license", "family", "known")), "license")
    share = F.size(F.array_intersect("known", "own")) / F.size("known")
    met = met.select("row", "id", "family", "license", "start", (F.col("start") + F.col("n")).alias("end"), share.alias("containment")).where(F.col("containment") >= CONTAINMENT)
    order = Window.partitionBy("row", "family").orderBy("start", "end", "license")
    apart = F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.sum(F.col("apart").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    best = met.withColumn("apart", apart).withColumn("place", place).groupBy("row", "family", "place").agg(F.first("id").alias("id"), F.min(F.struct((-F.col("containment")).alias("c"), "start", "license", "end")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("b.license").alias("license"), (-F.col("b.c")).alias("containment"), F.col("b.start").cast("long").alias("first_word"), F.col("b.end").cast("long").alias("end_word"))
