"""Licence scan by a positional index of rare words, in DataFrame functions only.

Licence texts are cut into stretches of some twenty words, and each stretch is known by its rarest words (anchors), by document frequencies
over the whole table. A file looks up the anchors that it holds, whichever and however many: places of anchors in the file, less their places
in the stretch, must agree on one offset. Only then are the licence's mandatory key phrases verified in the file.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonarium.plans.store import stash

# Phrases whose places are counted, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Fixed values: (label, text of the licence or of the notice that names it, mandatory key phrases as words in lower case).
LICENCES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license", "2 0"),
    ),
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", "This project is licensed under the terms of the MIT license.", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
        "all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        ("permission to use copy modify", "hereby granted"),
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
        "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must "
        "not be misrepresented; you must not claim that you wrote the original software.",
        ("alter it and redistribute it freely", "must not be misrepresented"),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("unencumbered software", "public domain"),
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
        ("person or organization obtaining a copy", "covered by this license"),
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license", "version 3")),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("general public license",),
    ),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1.", ("lesser general public license",)),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3.", ("affero general public license",)),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("mozilla public license",),
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc", "4 0")),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa", "4 0")),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial License", ("attribution noncommercial",)),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike License", ("attribution sharealike",)),
    ("cc0", "Creative Commons Zero CC0 1.0 Universal Public Domain Dedication", ("cc0",)),
    ("reserved", "Copyright. All rights reserved. No part may be reproduced without permission.", ("all rights reserved",)),
)
#: Words of a stretch, at most.
STRETCH = 24
#: Rarest distinct words that a stretch is known by.
ANCHORS = 8
#: Places of anchors that must agree on an offset: half of them, and as many as this if there are.
AGREE = 3

CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Stretch(NamedTuple):
    licence: int
    words: list[str]


def words_of(text: str) -> list[str]:
    return [w for w in re.split(CUT, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def stretches(licences: Sequence[tuple[str, str, tuple[str, ...]]]) -> list[Stretch]:
    """Each licence's text in stretches of nearly equal length."""
    out = []
    for i, (_, text, _) in enumerate(licences):
        w = words_of(text)
        n = -(-len(w) // STRETCH)
        out += [Stretch(i, w[len(w) * j // n : len(w) * (j + 1) // n]) for j in range(n)]
    return out


def _quoted(words: Sequence[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")" if words else "cast(array() as array<string>)"


def _places(phrase: str) -> str:
    """Places where the words of ``phrase`` stand consecutively; looked for only in texts that hold it."""
    words = phrase.split()
    hit = " and ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(words))
    return f"case when contains(norm, ' {phrase} ') then filter(sequence(0, n - {len(words)}), i -> {hit}) else cast(array() as array<int>) end"


def _cut(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, norm (words between single spaces), w (words) and n of every whole text."""
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # Only A-Z are lower-cased. lower() is faster; of the letters outside ASCII it maps just these two to ASCII.
    low = F.when(F.contains(t, F.lit("K")) | F.contains(t, F.lit("İ")), F.translate(t, _UPPER, _LOWER)).otherwise(F.lower(t))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.btrim(F.regexp_replace(low, CUT, " ")).alias("bare"))
    return d.select("doc_id", F.concat(F.lit(" "), "bare", F.lit(" ")).alias("norm"), F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", " ")).alias("w")).withColumn("n", F.size("w"))


def frequencies(docs: DataFrame, vocabulary: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of ``vocabulary``, which bounds what reaches the driver."""
    held = _cut(docs, id_col, text_col).select(F.explode(F.expr(f"concat(array(''), array_intersect(w, {_quoted(vocabulary)}))")).alias("w"))
    known = {r["w"]: r["c"] for r in held.groupBy("w").agg(F.count("*").alias("c")).collect()}
    return known.pop("", 0), known


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licences: Sequence[tuple[str, str, tuple[str, ...]]] = LICENCES) -> DataFrame:
    """One row for each document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    * n_base counts all places of the base phrases; first_word and last_word are the smallest and largest start, else null.
    * labels: the base labels and those of the licences found; both lists are distinct, sorted and comma-joined ('' if none). A licence is found
      where the anchors of one of its stretches agree on an offset and all its key phrases stand in the file. Any number is found in a file.
    * score: of the best licence found, the share of its anchors' weight (inverse document frequency) that stands at the offsets agreed on by
      its stretches; 1.0 at most, 0.0 if no licence is found.
    * Null text counts as empty. Null ids, repeated rows and ties are scanned row by row. An empty table gives an empty result.

    Two passes over the texts, neither with a shuffle: one counts document frequencies, one looks up anchors and their places. Places of
    anchors are shuffled only for files that hold enough anchors of some stretch.
    """
    cut = stretches(licences)
    total, known = frequencies(docs, sorted({w for s in cut for w in s.words}), id_col, text_col)
    weight = lambda w: math.log((1 + total) / (1 + known.get(w, 0))) + 1e-3
    anchors = [sorted(sorted(set(s.words)), key=lambda w: -weight(w))[:ANCHORS] for s in cut]
    postings = [(w, s, p, cut[s].licence, weight(w)) for s, own in enumerate(anchors) for p, w in enumerate(cut[s].words) if w in own]
    places = [sum(1 for x in postings if x[1] == s) for s in range(len(cut))]
    need = [max(min(AGREE, n), -(-n // 2)) for n in places]
    whole = [sum(x[4] for x in postings if x[3] == i) for i in range(len(licences))]

    d = _cut(docs, id_col, text_col)
    d = d.withColumn("base", F.expr("concat(" + ", ".join(f"transform({_places(p)}, i -> struct(i as i, '{label}' as label))" for p, label in BASE) + ")"))
    d = d.withColumn("held", F.expr(f"array_intersect(w, {_quoted(sorted({w for own in anchors for w in own}))})"))
    # Distinct anchors that agree on an offset are at least as many as places that agree, less their repeats within the stretch.
    wants = sorted({(tuple(own), need[s] - (places[s] - len(own))) for s, own in enumerate(anchors)})
    facts = "array(" + ", ".join(f"struct({_quoted(own)} as own, {max(1, n)} as need)" for own, n in wants) + ")"
    d = d.withColumn("may", F.expr(f"size(held) > 0 and exists({facts}, f -> size(array_intersect(f.own, held)) >= f.need)"))
    d = d.withColumn("lic", F.expr("case when may then filter(transform(sequence(0, n - 1), i -> case when array_contains(held, w[i]) then struct(w[i] as w, i as i) end), x -> x is not null) end"))
    phrases = sorted({k for _, _, ks in licences for k in ks})
    d = d.withColumn("keys", F.expr(f"case when may then filter({_quoted(phrases)}, k -> contains(norm, concat(' ', k, ' '))) end"))
    seen = stash(
        d.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.col("n").cast("long").alias("n_words"),
            F.size("base").cast("long").alias("n_base"),
            F.expr("cast(array_min(transform(base, x -> x.i)) as bigint)").alias("first_word"),
            F.expr("cast(array_max(transform(base, x -> x.i)) as bigint)").alias("last_word"),
            F.expr("array_sort(array_distinct(transform(base, x -> x.label)))").alias("base_found"),
            "lic",
            "keys",
        ),
        "licences",
    )
    spark = docs.sparkSession
    # Tables of the templates: their size does not depend on the documents.
    index = spark.createDataFrame(postings, "w string, s int, p int, licence int, weight double")
    stretch = spark.createDataFrame(list(enumerate(need)), "s int, need int")
    names = spark.createDataFrame([(i, label, list(ks), whole[i]) for i, (label, _, ks) in enumerate(licences)], "licence int, label string, needed array<string>, whole double")

    hits = seen.where("lic is not null").select("row", F.explode("lic").alias("x")).select("row", "x.w", "x.i").join(F.broadcast(index), "w")
    votes = hits.groupBy("row", "licence", "s", (F.col("i") - F.col("p")).alias("o")).agg(F.count("*").alias("c"), F.sum("weight").alias("weight"))
    stand = votes.join(F.broadcast(stretch), "s").where("c >= need").groupBy("row", "licence", "s").agg(F.max("weight").alias("weight"))
    found = stand.groupBy("row", "licence").agg(F.sum("weight").alias("weight")).join(F.broadcast(names), "licence")
    # Key phrases are verified for the licences that the index found.
    found = found.join(seen.where("lic is not null").select("row", "keys"), "row").where(F.size(F.array_except("needed", "keys")) == 0)
    verdict = found.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.least(F.lit(1.0), F.col("weight") / F.col("whole"))).alias("score"))
    return seen.join(verdict, "row", "left").select(
        F.col("doc_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_found", ",").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(base_found, coalesce(found, array()))), ',')").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
