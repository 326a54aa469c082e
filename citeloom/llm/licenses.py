"""License scan: MinHash bands over overlapping word windows retrieve templates, shingles verify them.

Texts and templates become hashes of SHINGLE words. A template of t shingles is looked for in windows
of t shingles, one every t // STRIDE_PART of them. A window is reduced to BANDS minima, each under
another permutation (exclusive or with a constant), one row per band; it retrieves a template that has
the same minimum in the same band. The share of the template's shingles in the window's surroundings
is then counted exactly.

With a window at most an eighth of its length off, a text that holds 0.8 of a template shares at least
0.5 of the union with it, so one of 16 bands collides with probability 1 - 0.5^16 > 0.9999.

A band can only collide if the window holds a shingle that is a minimum of some template. Texts and
windows without any of those (a literal array, at most BANDS per template) are left out first; that
changes no collision. Templates are a parameter of bounded size; no text moves between tasks. A license
may have several: a notice, and the text that stands at the head of a file or of the license itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
LEAST = 0.8
BANDS = 16
STRIDE_PART = 4
_MARKS = ".,;:!?()[]{}<>\"'`*#/|"
_SPACES = "\t\n\x0b\x0c\r"

#: Notices as they stand in files and pages.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL"
        " was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
}
#: File headers and opening clauses, as published with the licenses.
BODIES = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the'
        " specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
        " copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of"
        " conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,"
        " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
        " distribution."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public"
        " License for more details."
    ),
}


def _words(text: Column) -> Column:
    """Lower-case words without the marks of _MARKS."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), _SPACES + _MARKS, " " * len(_SPACES))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingles(text: Column) -> Column:
    """Hashes of all runs of SHINGLE words, in order; an empty array for fewer words."""
    # The words are bound to a lambda's variable, so that they are made once and not for each shingle.
    return F.get(F.transform(F.array(_words(text)), _hashed), 0)


def _hashed(words: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    made = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, made).otherwise(F.array().cast("array<bigint>"))


def _minima(hashes: Column, seeds: list[int]) -> Column:
    return F.array(*[F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(s).cast("long")))) for s in seeds])


def _seeds(spark) -> list[int]:
    row = spark.range(1).select(*[F.xxhash64(F.lit(f"band {b}")) for b in range(BANDS)]).first()
    return list(row)


#: Each license with all that it is looked for by.
TEXTS = {name: [notice, *([BODIES[name]] if name in BODIES else [])] for name, notice in TEMPLATES.items()}


def scan(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEXTS, least: float = LEAST) -> DataFrame:
    """doc_id, text -> doc_id, license, containment, word: one row per document and license found.

    containment: the largest share of a template's distinct shingles within a window and its
    surroundings; word: where the first window with it begins (from 0). Empty and null texts, and texts
    of under five words, hold none; a template of under five words is an error. Rows that repeat an id
    give one row per id and template. Other columns are ignored.
    """
    spark = docs.sparkSession
    seeds = _seeds(spark)
    named = spark.createDataFrame([(name, text) for name in sorted(templates) for text in templates[name]], "license string, notice string")
    made = named.select("license", F.array_distinct(shingles(F.col("notice"))).alias("own")).withColumn("minima", _minima(F.col("own"), seeds))
    rows = made.collect()  # as many as templates were passed in
    if any(not r.own for r in rows):
        raise ValueError(f"templates need {SHINGLE} words")
    # What a minimum under a permutation is without it: the shingles that can collide at all.
    keys = sorted({m ^ s for r in rows for m, s in zip(r.minima, seeds)})
    marks = F.array(*[F.lit(k).cast("long") for k in keys]) if keys else F.array().cast("array<bigint>")
    bands = spark.createDataFrame(
        [(len(r.own), b, m, r.license, r.own) for r in rows for b, m in enumerate(r.minima)],
        "length int, band int, minimum long, license string, own array<long>",
    )
    hashed = docs.select("doc_id", shingles(F.col("text")).alias("hashes")).where(F.arrays_overlap("hashes", marks))

    def windows(length: int) -> Column:
        stride = max(1, length // STRIDE_PART)
        last = F.greatest(F.size("hashes") - length + 1, F.lit(1))
        starts = F.array_union(F.sequence(F.lit(1), last, F.lit(stride)), F.array(last))
        holding = F.filter(starts, lambda s: F.arrays_overlap(F.slice("hashes", s, length), marks))
        around = lambda s: F.greatest(s - stride, F.lit(1))
        return F.transform(
            holding,
            lambda s: F.struct(
                F.lit(length).alias("length"),
                s.alias("start"),
                _minima(F.slice("hashes", s, length), seeds).alias("minima"),
                F.array_distinct(F.slice("hashes", around(s), s - around(s) + length + stride)).alias("near"),
            ),
        )

    lengths = sorted({len(r.own) for r in rows})
    every = F.concat(*map(windows, lengths)) if lengths else None
    if every is None:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("word")).limit(0)
    opened = hashed.select("doc_id", F.explode(every).alias("w")).select("doc_id", "w.length", "w.start", "w.near", F.posexplode("w.minima").alias("band", "minimum"))
    # The templates' bands: BANDS rows for each template passed in.
    met = opened.join(F.broadcast(bands), ["length", "band", "minimum"])
    share = F.size(F.array_intersect("own", "near")) / F.size("own")
    found = met.select("doc_id", "license", (F.col("start") - 1).alias("word"), share.alias("containment")).where(F.col("containment") >= least)
    best = F.max(F.struct(F.col("containment"), (-F.col("word")).alias("back")))
    return found.groupBy("doc_id", "license").agg(best.alias("best")).select(
        "doc_id", "license", "best.containment", (-F.col("best.back")).alias("word")
    )
