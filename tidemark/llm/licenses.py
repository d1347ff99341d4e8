"""License scans: exact set-similarity join of text blocks with license templates. DataFrame functions only.

A block is a window of words, across line breaks: for templates of up to s words (s a power of two, 8 at least) windows of
2 s words that begin every s words, so that s words in a row lie whole in one of them. A template matches a block that
holds the share ``threshold`` of the template's different words (containment); one of fewer than ``whole_below`` different
words must be held whole, as a word more or less would be another license.

Only words of templates count, so a block is cut down to those; they are ordered by their document frequency over the
whole corpus, rarest first. With need = the least number of words in common: prefix filter: block and template must share a
word within the first |B| - need + 1 and |T| - need + 1 words; length filter: |B| >= need; positional filter: a word at
places i and j leaves at most 1 + min(|T| - i, |B| - j) - 1 in common. What is left is verified exactly.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NON_WORD, lower_ascii, materialize

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label -> notice. Public license notices, as their authors publish them; a parameter of scan_licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "boost-1.0-grant": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
    "bsd-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "cc-by-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gnu-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "gpl-3": "licensed under the GNU General Public License, version 3",
    "isc-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit": "Released under the MIT License",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
        do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    "zlib-grant": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
        and redistribute it freely, subject to the following restrictions""",
}


def normal(text: Column) -> Column:
    """The words, lower-cased and set between single spaces; no words: the empty text."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), f"{NON_WORD}+", " "))


def _n_spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" ")))).cast("long")


def _words(notice: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), notice))


def size_class(n: int) -> int:
    """The least power of two, 8 or more, that is no less than n."""
    return max(8, 1 << (n - 1).bit_length())


def _texts(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8, whole_below: int = 16) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, start, n_words, containment).

    matches lists every block that a template matches: the place of its first word, from 0, and its words. score is the
    best containment found, 1 where a phrase stands. Null and empty texts have no words and match nothing; repeated rows
    are scanned each; null ids stay; other columns are ignored; an empty table gives none; a template without words
    matches nothing. The tables of templates are bounded by the parameter, so they are literals and broadcast; the texts
    are read twice and never shuffled.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    spark = documents.sparkSession
    held = [(k, w, size_class(len(w))) for k, v in templates.items() if (w := _words(v))]
    text = F.col("text").cast("string")

    # frequency of the templates' words over all documents: as many rows as the templates have words
    vocabulary = sorted({x for _, w, _ in held for x in w})
    seen = documents.select(F.explode(F.array_intersect(F.split(normal(text), " "), _texts(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = {r["word"]: r["df"] for r in seen.collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (df.get(w, 0), w.encode())))}

    rows, keys, words_of, least_of = [], {}, {}, {}
    for label, w, size in held:
        t = sorted({rank[x] for x in w})
        need = len(t) if len(t) < whole_below else math.ceil(threshold * len(t) - 1e-9)
        rows += [(label, size, t, need, i, t[i]) for i in range(len(t) - need + 1)]
        keys.setdefault(size, set()).update(t[: len(t) - need + 1])
        words_of.setdefault(size, set()).update(w)
        least_of[size] = min(need, least_of.get(size, need))
    named = sorted(rank, key=rank.get)
    templates_of = spark.createDataFrame(rows, "label string, t_size int, t array<int>, need int, i int, key int")
    rank_of = F.create_map(*(F.lit(x) for w, r in rank.items() for x in (w, r))) if rank else F.create_map().cast("map<string,int>")

    say = "(?<= )(?:" + "|".join(phrases) + ")(?= )"
    scanned = documents.select("doc_id", F.concat(F.lit(" "), normal(text), F.lit(" ")).alias("whole"))
    w = F.split(F.trim("whole"), " ")

    def blocks(size: int) -> Column:
        """Of the windows of this size those with a word that begins a template: place of the first word, and the words that count."""
        many = F.greatest(F.lit(0), F.ceil(F.size(w) / size).cast("int") - 2)
        begins = _texts(named[k] for k in sorted(keys[size]))
        cut = F.transform(F.sequence(F.lit(0), many), lambda k: F.struct(F.lit(size).alias("size"), (k * size).alias("start"), F.array_intersect(F.slice(w, k * size + 1, 2 * size), _texts(sorted(words_of[size]))).alias("words")))
        return F.when(F.arrays_overlap(w, begins), F.filter(cut, lambda b: (F.size(b["words"]) >= least_of[size]) & F.arrays_overlap(b["words"], begins)))

    none = F.array().cast("array<struct<size:int,start:int,words:array<string>>>")
    found = F.concat(none, *(F.coalesce(blocks(size), none) for size in sorted(keys)))
    may = F.lit(False)
    for p in phrases:
        may = may | F.col("whole").contains(f" {p} ")
    scanned = scanned.select("doc_id", "whole", found.alias("blocks"))
    scanned = scanned.withColumn("gaps", F.when(may, F.split("whole", say, -1))).withColumn("said", F.when(may, F.regexp_extract_all("whole", F.lit(say), F.lit(0))))
    label_of = F.create_map(*(F.lit(x) for kv in phrases.items() for x in kv)) if phrases else F.create_map().cast("map<string,string>")
    scanned = scanned.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.col("whole") == "  ", 0).otherwise(_n_spaces(F.col("whole")) - 1).cast("long").alias("n_words"),
        F.coalesce(F.size("said"), F.lit(0)).cast("long").alias("n_base"),
        (_n_spaces(F.element_at("gaps", 1)) - 1).alias("first_word"),
        (_n_spaces(F.col("whole")) - 1 - _n_spaces(F.element_at("gaps", -1)) - _n_spaces(F.element_at("said", -1))).alias("last_word"),
        F.array_sort(F.array_distinct(F.coalesce(F.transform("said", lambda s: label_of[s]), F.array().cast("array<string>")))).alias("base"), "blocks",
    )
    scanned = materialize(scanned, "license-blocks")

    # ordered words of both sides, with their place
    b = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.size", "b.start", F.array_sort(F.transform("b.words", lambda x: rank_of[x])).alias("b"))
    least = F.create_map(*(F.lit(x) for kv in least_of.items() for x in kv))[F.col("size")] if least_of else F.lit(1)
    b = b.select("row", "size", "start", "b", F.posexplode(F.slice("b", F.lit(1), F.size("b") - least + 1)).alias("j", "word"))
    pairs = b.join(F.broadcast(templates_of), (F.col("word") == F.col("key")) & (F.col("size") == F.col("t_size")))
    pairs = pairs.where((F.size("b") >= F.col("need")) & (F.col("j") <= F.size("b") - F.col("need")) & (1 + F.least(F.size("t") - F.col("i"), F.size("b") - F.col("j")) - 1 >= F.col("need")))
    pairs = pairs.select("row", "size", "start", "label", "need", "b", "t").dropDuplicates(["row", "size", "start", "label"])
    common = F.size(F.array_intersect("b", "t"))
    met = pairs.where(common >= F.col("need")).select("row", F.struct("label", "start", (2 * F.col("size")).alias("n_words"), (common / F.size("t")).alias("containment")).alias("m"))
    met = met.groupBy("row").agg(F.array_sort(F.collect_list("m")).alias("matches")).withColumnRenamed("row", "at")
    out = scanned.drop("blocks").join(met, F.col("row") == F.col("at"), "left")
    own = F.coalesce(F.transform("matches", lambda m: m["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", F.when(F.col("n_base") > 0, F.col("first_word")).alias("first_word"), F.when(F.col("n_base") > 0, F.col("last_word")).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "matches",
    )
