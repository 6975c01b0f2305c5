"""License notices in texts, by DataFrame functions only: MinHash bands over windows, then exact containment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, whole_text, written

WORDS, THRESHOLD = 5, 0.8
#: Bands of one row each. A window that holds THRESHOLD of a template has a Jaccard similarity with it of at least
#: 0.29 (see windows below), so a band collides with 1 - (1 - 0.29)**24 > 0.9997.
BANDS = 24
#: Shingles of all templates together; they are broadcast and stand in the plan as literals.
MOST_SHINGLES = 20_000
#: What separates words.
SEPARATORS = r"[^\p{L}\p{N}]+"

#: Notices of common licenses, by SPDX name.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def shingled(text: Column) -> Column:
    """The hashes of all runs of WORDS words of text, in order; none for shorter texts."""
    words = F.array_remove(F.split(F.lower(text), SEPARATORS), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def over(h: Column) -> Column:
        last = F.size(h) - WORDS
        some = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WORDS))))
        return F.when(last >= 0, some).otherwise(F.array().cast("array<bigint>"))

    # a one-element transform names the hashed words, so that they are computed once per text
    return F.get(F.transform(F.array(hashed), over), F.lit(0))


def minima(shingles: Column) -> Column:
    """The smallest value of a set of shingles under each of BANDS permutations."""
    return F.array(*(F.array_min(F.transform(shingles, permutation(k))) for k in range(BANDS)))


def permutation(k: int) -> Callable[[Column], Column]:
    return lambda x: F.xxhash64(F.lit(k), x)


def window_of(size: int) -> tuple[int, int]:
    """(length, stride) of the windows for templates of `size` shingles: with w the next power of two, windows of
    about 5/4 w every w/4, so each stretch of w shingles lies within one. A template has more than w/2."""
    w = 1 << (size - 1).bit_length()
    stride = max(1, w // 4)
    return w + stride - 1, stride


def _is_least(k: int) -> Callable[[Column], Column]:
    return lambda x: permutation(k)(x) == F.get(F.col("minima"), F.lit(k))


def template_table(spark: SparkSession, templates: dict[str, str]) -> list:
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    rows = rows.select("license", F.array_distinct(shingled(F.col("text"))).alias("shingles"))
    least = minima(F.col("shingles"))
    holds = F.array(*(F.filter("shingles", _is_least(k)) for k in range(BANDS)))
    found = rows.withColumn("minima", least).select("license", "shingles", "minima", F.array_distinct(F.flatten(holds)).alias("anchors")).collect()
    if short := [r["license"] for r in found if not r["shingles"]]:
        raise ValueError(f"templates of fewer than {WORDS} words: {short}")
    if sum(len(r["shingles"]) for r in found) > MOST_SHINGLES:
        raise ValueError(f"templates of more than {MOST_SHINGLES} shingles together")
    return found


def _bigints(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' if v != -(1 << 63) else 'bigint(-9223372036854775808)' for v in values)})")


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document and template found in it: doc_id, license, containment, word_start, n_windows.

    Windows over the whole text, of a length that suits each size of template, get MinHash bands; windows that
    share a band with a template are verified by the share of the template's shingles that they hold. A window's
    band value is the hash of one of its shingles, so a window can only collide if it holds a shingle that is some
    template's minimum: other texts and windows are passed over, which changes no result. containment is the best
    of a document's windows and word_start the first word of the first such window.

    Null and short texts match nothing; a null id and repeated ids are one document each; other columns are
    ignored. Templates are a parameter of at most MOST_SHINGLES shingles, broadcast. No Python runs on executors,
    and only matches are shuffled.
    """
    spark = docs.sparkSession
    known = template_table(spark, TEMPLATES if templates is None else templates)
    if not known:
        return spark.createDataFrame([], RESULT)
    anchors = sorted({x for r in known for x in r["anchors"]})
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), shingled(whole_text(text)).alias("s"))
    # few texts hold an anchor: they are written once, and each shape of window reads only them
    rows = written(rows.filter(F.arrays_overlap("s", _bigints(anchors))), "license-texts")
    out = None
    for shape in sorted({window_of(len(r["shingles"])) for r in known}):
        length, stride = shape
        own = [r for r in known if window_of(len(r["shingles"])) == shape]
        here = sorted({x for r in own for x in r["anchors"]})
        at = F.explode(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / stride).cast("int"))).alias("w")
        windows = rows.select("doc_id", "s", at).select("doc_id", (F.col("w") * stride).alias("word_start"), F.slice("s", F.col("w") * stride + 1, length).alias("window"))
        windows = windows.filter(F.arrays_overlap("window", _bigints(here)))
        banded = windows.select("doc_id", "word_start", "window", F.posexplode(minima(F.col("window"))).alias("band", "least"))
        table = spark.createDataFrame(
            [(k, v, r["license"], r["shingles"]) for r in own for k, v in enumerate(r["minima"])], "band int, least long, license string, shingles array<bigint>"
        )
        found = banded.join(F.broadcast(table), ["band", "least"])
        held = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
        found = found.select("doc_id", "license", "word_start", held.alias("containment")).filter(F.col("containment") >= threshold)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"),
        F.min(F.struct((-F.col("containment")).alias("c"), "word_start"))["word_start"].cast("long").alias("word_start"),
        F.countDistinct("word_start").alias("n_windows"),
    )
    return best.select("doc_id", "license", F.round("containment", 6).alias("containment"), "word_start", "n_windows")


RESULT = "doc_id long, license string, containment double, word_start long, n_windows long"


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def oracle_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same rows without MinHash: every window of every text against every template."""
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in (TEMPLATES if templates is None else templates).items())

    def grams(text: str) -> str:
        return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '{SEPARATORS}'), lambda x: x <> '')"

    return f"""
WITH t AS (
  SELECT license, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS ts
  FROM (SELECT license, {grams("text")} AS w FROM (VALUES {rows}) v(license, text))
), shaped AS (
  SELECT *, greatest(1, w2 // 4) AS stride, w2 + greatest(1, w2 // 4) - 1 AS length
  FROM (SELECT *, CAST(pow(2, ceil(log2(len(ts)))) AS BIGINT) AS w2 FROM t)
), d AS (
  SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, {grams("text")} AS w FROM documents)
), spots AS (
  SELECT doc_id, license, ts, s, length, unnest(range(0, (len(s) - 1) // stride + 1)) * stride AS word_start
  FROM d JOIN shaped ON list_has_any(s, ts)
), held AS (
  SELECT doc_id, license, word_start, len(list_intersect(s[word_start + 1:word_start + length], ts)) / len(ts) AS containment FROM spots
), kept AS (
  SELECT * FROM held WHERE containment >= {threshold}
)
SELECT doc_id, license, round(max(containment), 6) AS containment,
       CAST(first(word_start ORDER BY containment DESC, word_start) AS BIGINT) AS word_start,
       count(DISTINCT word_start) AS n_windows
FROM kept GROUP BY doc_id, license
"""


OP2_SQL = oracle_sql()
