"""License scans: phrases, and an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A template of n words is sought in blocks of 2 * step words, one at every step words, where step is the least of 16, 64, 256,
... that n fits in; so a notice lies whole in one block, however its lines are wrapped. A template of m distinct words is found
in a block that holds THRESHOLD of them and all that tell it from other licenses. Words are ordered from the rarest over the
whole corpus; a block that misses every word of a template's prefix, is too short, or has too few words left after the first
match cannot reach the threshold, and only what remains is counted in full.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import BROADCAST_ROWS, cut

#: Phrases and their labels, and the characters between words.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (label, text) of notices of common licenses.
TEMPLATES = (
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("agpl-3.0", "licensed under the GNU Affero General Public License version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "Released under the BSD License"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
)
#: The least share of a template's distinct words, as a fraction of whole numbers.
THRESHOLD = (4, 5)


@dataclass(frozen=True)
class Template:
    """A notice as a set of words. need: how many of them a block must hold; required: those among them that it must; within: places of templates of other licenses that hold all its words and more."""

    label: str
    words: tuple[str, ...]
    step: int
    need: int
    required: tuple[str, ...] = ()
    within: tuple[int, ...] = ()


def prepared(templates: tuple, threshold: tuple = THRESHOLD) -> list[Template]:
    """Templates from (label, text).

    Required are the words that the label names, such as a version, and those that are not in the text of another license which
    holds enough of the others. A template whose words are all in that of another license gives way where that one is found.
    """
    plain = []
    for label, text in templates:
        words = [w for w in re.split(BETWEEN_WORDS, text.translate(str.maketrans(UPPER, LOWER))) if w]
        step, distinct = 16, tuple(sorted(set(words)))
        while step < len(words):
            step *= 4
        plain.append(Template(label, distinct, step, -(-threshold[0] * len(distinct) // threshold[1])))
    out = []
    for t in plain:
        own = set(t.words)
        others = [(n, o.step, set(o.words)) for n, o in enumerate(plain) if o.label != t.label]
        required = own & set(re.findall("[a-z0-9]+", t.label))
        for *_, other in others:
            if len(own & other) >= t.need:
                required |= own - other
        within = tuple(n for n, step, other in others if step == t.step and own < other)
        out.append(Template(t.label, t.words, t.step, t.need, tuple(sorted(required)), within))
    return out


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, " ", ""))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES, threshold: tuple = THRESHOLD) -> DataFrame:
    """One row per row of docs: the key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of all PHRASES, first_word and last_word are the least and greatest word at which one starts, else
    null. labels adds those of the templates found in any block. score is 1 with a phrase, else the largest share of a found
    template's words in a block, else 0. A null text is empty; null and repeated keys are scanned each for itself; other columns
    are dropped.
    """
    spark, kinds = docs.sparkSession, prepared(templates, threshold)
    order = _order(docs, text, kinds)
    prefixes = [(n, i, w) for n, t in enumerate(kinds) for i, w in enumerate(sorted(t.words, key=order.__getitem__)[: len(t.words) - t.need + 1])]
    rare = F.split(F.lit(" ".join(sorted({w for *_, w in prefixes}))), " ")  # one literal, as words hold no spaces
    table = _phrases(docs, key, text).withColumn("words", F.split("__words", " ")).drop("__words")
    table = cut(table.withColumn("words", F.when(F.arrays_overlap("words", rare), F.col("words"))))  # a text without any rare word has no match
    ranked = _parameter(spark, list(order.items()), "word string, rank int")
    matches = cut(_join(_blocks(table, sorted({t.step for t in kinds}), rare), ranked, *_probes(spark, kinds, prefixes, order)))
    larger = _parameter(spark, [(n, m) for n, t in enumerate(kinds) for m in t.within], "smaller int, template int")
    block = ["row", "step", "j"]
    hidden = matches.join(larger, "template").select(*block, F.col("smaller").alias("template")).distinct()
    found = matches.join(hidden, [*block, "template"], "left_anti").groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    joined = table.drop("words").join(found, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return joined.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _parameter(spark: SparkSession, rows: list[tuple], shape: str) -> DataFrame:
    """A table made of the templates, broadcast unless it is large."""
    table = spark.createDataFrame(rows, shape)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def _text_words(text: Column) -> Column:
    """The words of a text in lower case, joined by spaces."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS, " "))


def _order(docs: DataFrame, text: str, kinds: list[Template]) -> dict[str, int]:
    """The rank of each template word, from the one in the fewest documents of the corpus."""
    known = sorted({w for t in kinds for w in t.words})
    words = docs.select(F.explode(F.array_distinct(F.split(_text_words(F.col(text)), " "))).alias("word"))
    counts = words.join(_parameter(docs.sparkSession, [(w,) for w in known], "word string"), "word").groupBy("word").agg(F.count("*").alias("n"))
    n = {r["word"]: r["n"] for r in counts.collect()}  # a row for each template word
    return {w: i for i, w in enumerate(sorted(known, key=lambda w: (n.get(w, 0), w)))}


def _phrases(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, __words, n_words, n_base, first_word, last_word, base)"""
    step = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), _text_words(F.col(text)).alias("__words"))
    step = step.withColumn("n_words", F.when(F.col("__words") == "", 0).otherwise(_spaces(F.col("__words")) + 1).cast("long"))
    step = step.withColumn("__padded", F.concat(F.lit(" "), "__words", F.lit(" ")))
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        there, size = F.contains("__padded", F.lit(f" {phrase} ")), len(phrase.split())
        places.append(F.when(there, F.regexp_count("__padded", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(there, _spaces(F.substr("__padded", F.lit(1), F.locate(f" {phrase} ", F.col("__padded")))) - 1))
        back = F.reverse("__padded")
        lasts.append(F.when(there, F.col("n_words") - size - _spaces(F.substr(back, F.lit(1), F.locate(f" {phrase[::-1]} ", back))) + 1))
        labels.append(F.when(there, F.lit(label)))
    return step.select("row", "key", "__words", "n_words", sum(places[1:], places[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("base"))


def _blocks(table: DataFrame, steps: list[int], rare: Column) -> DataFrame:
    """(row, step, j, block): the distinct words of the blocks of each step that hold a word of a template's prefix."""

    def of(step: int) -> DataFrame:
        last = F.greatest(F.ceil(F.size("words") / step).cast("int") - 2, F.lit(0))
        all_ = F.transform(F.sequence(F.lit(0), last), lambda j: F.slice("words", j * step + 1, 2 * step))
        return table.where("words is not null").select("row", F.lit(step).alias("step"), F.posexplode(all_).alias("j", "block"))

    made = list(map(of, steps))
    blocks = made[0] if made else table.select("row", F.lit(0).alias("step"), F.lit(0).alias("j"), "words").withColumnRenamed("words", "block").limit(0)
    for more in made[1:]:
        blocks = blocks.union(more)
    return blocks.where(F.arrays_overlap("block", rare)).withColumn("block", F.array_distinct("block"))


def _probes(spark: SparkSession, kinds: list[Template], prefixes: list[tuple], order: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """A row for each word of each template's prefix, and one for each template; sets of words are ranks in rising order."""
    ranks = lambda words: sorted(order[w] for w in words)
    words = [(kinds[n].step, order[w], n, len(kinds[n].words), kinds[n].need, i) for n, i, w in prefixes]
    sets = [(n, t.label, ranks(t.words), ranks(t.required)) for n, t in enumerate(kinds)]
    return _parameter(spark, words, "step int, rank int, template int, size int, need int, i int"), _parameter(spark, sets, "template int, label string, all array<int>, required array<int>")


def _join(blocks: DataFrame, ranked: DataFrame, probes: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, step, j, template, label, share) of the templates found in blocks."""
    c = F.col
    words = blocks.select("row", "step", "j", F.explode("block").alias("word")).join(ranked, "word")
    sets = words.groupBy("row", "step", "j").agg(F.sort_array(F.collect_set("rank")).alias("block"))
    pairs = sets.select("row", "step", "j", "block", F.posexplode("block").alias("at", "rank")).join(probes, ["step", "rank"])
    pairs = pairs.where(F.size("block") >= c("need"))  # length filter
    pairs = pairs.where(F.least("i", "at") + 1 + F.least(c("size") - c("i") - 1, F.size("block") - c("at") - 1) >= c("need"))  # positional filter
    shared = pairs.join(templates, "template").withColumn("shared", F.array_intersect("all", "block"))
    shared = shared.where((F.get("shared", F.lit(0)) == c("rank")) & (F.size("shared") >= c("need")) & (F.size(F.array_intersect("required", "block")) == F.size("required")))
    return shared.select("row", "step", "j", "template", "label", (F.size("shared").cast("double") / c("size")).alias("share"))


def _oracle() -> str:
    kinds = prepared(TEMPLATES)
    rows = ", ".join(f"({n}, '{t.label}', {list(t.words)!r}, {t.step}, {t.need}, {list(t.required)!r}::VARCHAR[], {list(t.within)!r}::INT[])" for n, t in enumerate(kinds))
    phrases = ", ".join(f"('{p}', '{label}', {p.split()!r})" for p, label in PHRASES.items())
    return rf"""
WITH t(n, label, words, step, need, required, within) AS (VALUES {rows}),
p(phrase, label, words) AS (VALUES {phrases}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
hits AS (SELECT doc_id, p.label, i - 1 AS i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) AS x JOIN p ON x.ws[x.i : x.i + len(p.words) - 1] = p.words),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base FROM hits GROUP BY doc_id),
steps AS (SELECT DISTINCT step FROM t),
places AS (SELECT doc_id, ws, step, unnest(range(0, greatest(1, CAST(ceil(len(ws) / step) AS INT) - 1))) AS j FROM w, steps),
blocks AS (SELECT doc_id, step, j, list_distinct(ws[j * step + 1 : j * step + 2 * step]) AS b FROM places),
matches AS (SELECT doc_id, x.step, j, n, label, within, len(list_intersect(b, words))::DOUBLE / len(words) AS share FROM blocks AS x JOIN t ON x.step = t.step
            WHERE len(b) >= need AND len(list_intersect(b, words)) >= need AND len(list_intersect(b, required)) = len(required)),
every AS (SELECT doc_id, step, j, list(n) AS ns FROM matches GROUP BY doc_id, step, j),
found AS (SELECT m.doc_id, list_sort(list(DISTINCT label)) AS found, max(share) AS share FROM matches AS m JOIN every AS e ON m.doc_id = e.doc_id AND m.step = e.step AND m.j = e.j
          WHERE len(list_intersect(ns, within)) = 0 GROUP BY m.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN found ON w.doc_id = found.doc_id
"""


ORACLE = _oracle()
