"""Licence scan by a trained paragraph classifier (9). DataFrame functions only.

Paragraphs are runs of neighbouring lines that hold words of the vocabulary, wrapped lines joined: one ends
where a line ends a sentence, or the next is blank or holds fewer than GATE of the vocabulary's own words
(those of the templates but common words). All others are no licence text. Features are word 1- and 2-grams
of the templates. A multinomial logistic regression over the licence families and "unknown" is trained by
gradient descent, each step a join of features with weights and two aggregates; the weights stay a table.
Training rows are the templates, their halves, and one half of all corpus paragraphs that are near no template
(unknown); rows with the same features of the vocabulary are one with a count. The threshold on a family's
probability is calibrated on the other half, all of it: all but `false_share` of them fall below it. A family is confirmed if a template of it shares
enough words with the paragraph, or if enough of the paragraph's word pairs are a template's; else the
paragraph is "unknown". Of equal probabilities the family first by name counts.

Null and empty texts hold no paragraphs. Repeated rows are judged alike. Without such paragraphs only
templates train the model. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, table, written

# Notices of each family, as they are commonly written.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "This code is available under the 3-Clause BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "Available under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Not for commercial use: licensed under CC BY-NC-SA.",
        "You may not use the material for commercial purposes.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Released under the GNU GPL License, version 2 or later.",
        "Distributed under the terms of the GNU GPL v3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "This document is confidential and proprietary; no licence is granted without written permission.",
    ),
}
# Common words, which tell of no licence.
COMMON = frozenset("a all an and any are as at be but by can do for form free from hope if in is it its name names no nor not obtain of on one only or other person persons sell shall so text that the these this to under use used was which will with work you without".split())
GATE = 2  # distinct words of the vocabulary that a line of a paragraph holds
UNKNOWN = "unknown"
STEPS, RATE, DECAY = 20, 4.0, 1e-3
FALSE_SHARE, SHARED = 0.01, 0.5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?=\s|$)"), "")


def grams(own: Column) -> Column:
    """Distinct 1- and 2-grams."""
    pairs = F.zip_with(own, F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    two = F.slice(pairs, 1, F.greatest(F.size(own) - 1, F.lit(0)))
    return F.array_distinct(F.concat(own, two))


def gate_words() -> list[str]:
    """Words of the templates that are not common."""
    found = {w for ts in TEMPLATES.values() for t in ts for w in re.split(r"[^\w.]+|\.(?=\s|$)", t.lower())}
    return sorted(w for w in found if len(w) > 2 and w not in COMMON and not w.isdigit())


def holds_words(line: Column) -> Column:
    """Does a line hold GATE words of the vocabulary?"""
    some = F.split(F.lit(" ".join(gate_words())), " ")  # one folded constant
    return F.size(F.array_intersect(words(line), some)) >= GATE


def paragraphs(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, no, line, ws): paragraphs with the number of their first line."""
    lines = docs.select(*keep, F.posexplode_outer(F.split(F.col(text), "\n")).alias("no", "line"))
    lines = lines.filter(holds_words(F.col("line"))).dropDuplicates([*keep, "no"])  # rows that repeat have one key
    along = Window.partitionBy(*keep).orderBy("no")
    ended = F.lag(F.rtrim("line").rlike(r"[.!?:;]$")).over(along)
    begins = F.coalesce((F.lag("no").over(along) < F.col("no") - 1) | ended, F.lit(True))
    runs = lines.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(along))
    joined = runs.groupBy(*keep, "_run").agg(F.min("no").alias("no"), F.array_sort(F.collect_list(F.struct("no", "line"))).alias("ls"))
    return joined.select(*keep, "no", F.array_join(F.transform("ls", lambda x: x["line"]), " ").alias("line")).withColumn("ws", words(F.col("line")))


def template_rows(spark) -> DataFrame:
    """(family, ws) of each template, a bounded constant."""
    rows = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("line")) for f, ts in TEMPLATES.items() for t in ts]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.family", words(F.col("t.line")).alias("ws"))


def pairs(ws: Column) -> Column:
    """Distinct word pairs."""
    n = F.greatest(F.size(ws) - 1, F.lit(0))
    return F.array_distinct(F.slice(F.zip_with(ws, F.slice(ws, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)), F.lit(1), n))


def closeness(ws: Column, family: Column | None = None) -> Column:
    """The best share with a template: of words in common (of both, or of a template that the paragraph holds), or of a paragraph of five pairs or more its pairs."""
    best, own = [], pairs(ws)
    for f, ts in TEMPLATES.items():
        for t in ts:
            other = words(F.lit(t))
            both = F.size(F.array_intersect(ws, other))
            share = F.greatest(both / F.size(F.array_union(ws, other)), F.when(both == F.size(F.array_distinct(other)), 1.0).otherwise(0.0), F.when(F.size(own) >= 5, F.size(F.array_intersect(own, pairs(other))) / F.size(own)).otherwise(0.0))
            best.append(share if family is None else F.when(family == f, share).otherwise(0.0))
    return F.greatest(*best)


CLASSES = (*sorted(TEMPLATES), UNKNOWN)


def probabilities(rows: DataFrame, weights: DataFrame, *key: str) -> DataFrame:
    """rows (key, x: features) with p, an array of class probabilities; weights (f, w array) may lack features."""
    flat = rows.select(*key, "scale", F.explode("x").alias("f")).join(F.broadcast(weights), "f")  # as many as the vocabulary
    z = [F.sum(F.col("w")[k] * F.col("scale")) for k in range(len(CLASSES))]
    return flat.groupBy(*key).agg(F.array(*z).alias("z")).withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z")))).withColumn("p", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, b: a + b))).select(*key, "p")


def featured(rows: DataFrame) -> DataFrame:
    """x: 1- and 2-grams and a constant; scale: makes rows of any length as long."""
    out = rows.withColumn("x", F.concat(grams(F.col("ws")), F.array(F.lit("*"))))
    return out.withColumn("scale", 1.0 / F.sqrt(F.size("x").cast("double")))


def train(spark, unknown: DataFrame, *, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> DataFrame:
    """(f, w): a weight for each class of each vocabulary entry. unknown: (ws) of paragraphs that are no licence."""
    own = template_rows(spark)
    half = F.ceil(F.size("ws") / 2).cast("int")
    own = own.select("family", F.explode(F.array("ws", "ws", F.slice("ws", F.lit(1), half), F.slice("ws", half, half + 1))).alias("ws"))
    rows = own.unionByName(unknown.select(F.lit(UNKNOWN).alias("family"), "ws"))
    vocabulary = template_rows(spark).select(F.explode(grams(F.col("ws"))).alias("f")).distinct().unionByName(spark.range(1).select(F.lit("*").alias("f")))
    names = written(vocabulary.agg(F.array_sort(F.collect_list("f")).alias("fs")), "vocabulary")
    # Rows with the same features of the vocabulary and scale move the weights alike, so they are one with a count.
    known = featured(rows).crossJoin(F.broadcast(names)).withColumn("x", F.transform(F.array_intersect("x", "fs"), lambda f: (F.array_position("fs", f) - 1).cast("int")))
    rows = written(known.groupBy("family", "scale", F.array_sort("x").alias("x")).agg(F.count("*").alias("m")), "train")
    n = rows.groupBy("family").agg(F.sum("m").alias("n"))
    rows = written(rows.join(F.broadcast(n), "family").withColumn("share", F.col("m") / F.col("n") / len(CLASSES)), "train")  # classes count alike
    weights = written(names.select(F.posexplode("fs").alias("i", "f")).withColumn("w", F.array_repeat(F.lit(0.0), len(CLASSES))).coalesce(1), "weights")
    z = F.transform(F.array(*(F.lit(k) for k in range(len(CLASSES)))), lambda k: F.aggregate("x", F.lit(0.0), lambda a, i: a + F.get(F.get("ws", i), k)) * F.col("scale"))
    for _ in range(steps):
        # The weights, as many as the vocabulary, go to the rows; what rows move is summed where they are.
        table_of = weights.agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("t")).select(F.transform("t", lambda t: t["w"]).alias("ws"))
        e = rows.crossJoin(F.broadcast(table_of)).withColumn("z", z).withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
        p = e.withColumn("p", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)))
        off = F.array(*((F.get("p", F.lit(k)) - (F.col("family") == c).cast("double")) * F.col("share") * F.col("scale") for k, c in enumerate(CLASSES)))
        flat = p.select("x", off.alias("off")).select(F.explode("x").alias("i"), "off")
        slope = flat.groupBy("i").agg(F.array(*(F.sum(F.get("off", F.lit(k))) for k in range(len(CLASSES)))).alias("g"))
        weights = written(weights.join(slope, "i", "left").select("i", "f", F.transform("w", lambda w, k: w * (1 - rate * decay) - rate * len(CLASSES) * F.coalesce(F.get("g", k), F.lit(0.0))).alias("w")).coalesce(1), "weights")
    return weights.select("f", "w")


def licence_paragraphs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", false_share: float = FALSE_SHARE, shared: float = SHARED, steps: int = STEPS) -> DataFrame:
    """(key, no, family, probability, closeness) of every paragraph with an anchor; key is row_key(doc_id, text)."""
    spark = docs.sparkSession
    keyed = docs.select(row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    own = paragraphs(keyed, "text", "key")
    own = written(own.withColumn("near", closeness(F.col("ws"))), "paragraphs")
    # Paragraphs alike are one; a hash of them tells the half that trains from the half that calibrates.
    other = own.filter(F.col("near") < shared).select("ws", F.xxhash64("ws").alias("h")).dropDuplicates(["h"])
    other = written(other, "unknown")
    weights = train(spark, other.filter("h % 2 = 0"), steps=steps)
    at = featured(own).select("key", "no", "x", "scale")
    p = written(probabilities(at, weights, "key", "no"), "probabilities")
    best = F.array_max(F.slice("p", 1, len(CLASSES) - 1))
    family = F.get(F.array(*(F.lit(c) for c in CLASSES)), F.array_position("p", F.array_max("p")).cast("int") - 1)
    top = own.join(p, ["key", "no"], "left").withColumn("probability", F.coalesce(best, F.lit(0.0))).withColumn("guess", F.coalesce(family, F.lit(UNKNOWN)))
    kept_out = probabilities(featured(other.filter("h % 2 <> 0")).select("h", "x", "scale"), weights, "h").select(best.alias("b"))
    limit = kept_out.agg(F.greatest(F.coalesce(F.percentile_approx("b", F.lit(1 - false_share)), F.lit(0.0)), F.lit(1.0 / len(CLASSES))).alias("limit")).first()["limit"]
    near = closeness(F.col("ws"), F.col("guess"))
    sure = (F.col("guess") != UNKNOWN) & (F.col("probability") > limit) & (F.col("closeness") >= shared)
    return top.withColumn("closeness", near).select("key", "no", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", "closeness")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licence_paragraphs(docs).groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))), ",").alias("families"),
        F.count("*").alias("n_paragraphs"),
        F.sum((F.col("family") == UNKNOWN).cast("long")).alias("n_unknown"),
    )
    own = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key")).join(written(found, "found"), "key", "left")
    return own.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_paragraphs", "n_unknown")))
