"""Operator 4, license scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Native: DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words, each by its 64-bit hash. Templates fall into
classes by size: n shingles, 2^c <= n < 2^(c+1) = S. For class c a document's shingles are covered by windows of 3 S
shingles that start every S, so each stretch of 2 S shingles lies in one of them: an occurrence with n words put in
between still does. Shingles that no template of the class has can't raise a containment, so windows hold only those that
some has; most text leaves the plan at that join with the template shingles. A window holds at most 3 S <= 6 n of them,
so where it has 0.8 of a template's, its Jaccard similarity to the template is at least 0.8 / 6.2 = 0.129; 64 bands of
one row each then collide at least once with probability 1 - (1 - 0.129)^64 = 0.9998. Candidates are verified: the share
of the template's distinct shingles that the window has, at least 0.8. Templates are a list or a table of any size; they
are broadcast if their bytes are few, else joined by a shuffle.

Only hits shuffle: a window's hashes, never its text. A template in a third of all documents makes groups of a document
and a window each, so none is hot.

Defined cases: null and empty texts, and those under five words, match nothing; null doc_ids are returned as null; rows
with equal doc_id and text are one, with equal doc_id and other text are scanned apart and give the best of both; long
texts are scanned whole; an empty table gives an empty table; further columns are left out, whatever their names. A
template of under five words, which could never be found, is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen.llm import common

SHINGLE, BANDS, LEAST = 5, 64, 0.8
#: A window's length in steps.
STEPS = 3
#: Templates are a parameter; these are notices in common use.
TEMPLATES = [
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("mit-line", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-2-clause-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]


def shingle_hashes(text: Column) -> Column:
    """The hashes of a text's shingles in order; empty or null below five words, null for null."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def hashes(ws: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(SHINGLE))))
        return F.when(F.size(ws) >= SHINGLE, each)

    # an array of one: the lambda's variable is split and filtered once, an expression would be for each shingle
    return F.get(F.transform(F.array(words), hashes), F.lit(0))


def _bands(h: Column) -> Column:
    return F.array(*(F.min(F.xxhash64(h, F.lit(k))).alias(f"m{k}") for k in range(BANDS)))


def template_table(templates: DataFrame) -> DataFrame:
    """license, c, n, hs, bands: one row for each template (license, text)."""
    t = templates.select("license", F.explode_outer(F.array_distinct(shingle_hashes(F.col("text")))).alias("h"))
    short = F.raise_error(F.concat(F.lit("a template has under five words: "), F.col("license")))
    t = t.withColumn("h", F.coalesce("h", short.cast("long")))
    t = t.groupBy("license").agg(F.count("*").alias("n"), F.collect_list("h").alias("hs"), _bands(F.col("h")).alias("bands"))
    return t.withColumn("c", F.floor(F.log2("n")).cast("int"))


def scanned(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, containment (the best window's), first_word (of its hit), n_windows."""
    if not isinstance(templates, DataFrame):
        templates = docs.sparkSession.createDataFrame(templates, "license string, text string")
    known = common.written(template_table(templates), "templates")
    wanted = common.written(known.select("c", F.explode("hs").alias("h")).distinct(), "template-shingles")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.posexplode(shingle_hashes(F.col("text"))).alias("pos", "h"))
    hits = rows.join(common.bounded(wanted), "h")
    step = F.pow(F.lit(2), F.col("c") + 1).cast("int")
    w = F.floor(F.col("pos") / step)
    windows = hits.select("doc_id", "t", "c", "h", "pos", F.explode(F.array(*(w - k for k in range(STEPS)))).alias("w")).where("w >= 0")
    sets = windows.groupBy("doc_id", "t", "c", "w").agg(F.collect_set("h").alias("hs"), F.min("pos").alias("first_word"), _bands(F.col("h")).alias("bands"))
    banded = sets.select("doc_id", "t", "c", "w", "hs", "first_word", F.posexplode("bands").alias("band", "m"))
    keys = common.written(known.select("license", "c", "n", F.col("hs").alias("ths"), F.posexplode("bands").alias("band", "m")), "template-bands")
    found = banded.join(common.bounded(keys), ["c", "band", "m"])
    share = F.size(F.array_intersect("hs", "ths")) / F.col("n")
    found = found.select("doc_id", "t", "c", "w", "license", "first_word", share.alias("containment")).where(F.col("containment") >= least)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.countDistinct("t", "c", "w").alias("n_windows"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
