"""License scan by the Dice coefficient over word bigrams, in DataFrame functions only.

Texts are normalised (lower case; every run of characters other than letters,
digits and ``.`` is one space; stops at word ends go; line ends are spaces) and compared window by
window, so a notice may be wrapped over lines or stand inside a longer line.  The score of a window and a template is
``2 * |A & B| / (|A| + |B|)`` over their sets of word bigrams; a text of one word
has that word as its only bigram.  A score of ``threshold`` is possible only if
``|A|`` lies between ``threshold / (2 - threshold)`` and the inverse of it times
``|B|``, and if as many bigrams of the template as that lower bound occur in the text at all: that leaves
few templates for few texts.  Their windows begin at every bigram of the template and end at every place up to the upper
bound, counted with repeats; the counts of a start's windows come from one pass.

Per document the best (window, template) is returned; ties go to the earlier window,
then the template's name.  The plan has no shuffle: the templates are literals.

Edge cases.  Null or empty text, or no window over the threshold: license null,
score 0, word_no null, licenses empty.  Repeated rows and null ids give a row
each; other columns are passed by; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Notices(tuple):
    """(licence, notice) pairs, read like a mapping in which a licence may stand several times."""

    def items(self) -> Notices:
        return self

    def values(self) -> list[str]:
        return [text for _, text in self]


#: Notices and licence texts as their publishers have them, several of a licence where they differ in more
#: words than the threshold bears.
TEMPLATES = Notices(
    [
        ("all-rights-reserved", "All rights reserved."),
        ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
        ("apache-2.0", "Licensed under the Apache License 2.0."),
        ("apache-2.0", "Released under the Apache License 2.0."),
        ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
        ("cc-by-4.0", "Licensed under CC BY 4.0."),
        ("cc-by-4.0", "Released under CC BY 4.0."),
        ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
        ("cc-by-nc-4.0", "Released under CC BY-NC 4.0."),
        ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
        ("cc-by-sa-4.0", "Released under CC BY-SA 4.0."),
        ("cc0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
        ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
        ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
        ("mit", "Licensed under the MIT License."),
        ("mit", "Released under the MIT License."),
        ("mit", "Distributed under the MIT License."),
        ("mit", "Available under the MIT License."),
        (
            "apache-2.0",
            "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
            "See the License for the specific language governing permissions and limitations under the License.",
        ),
        (
            "bsd-3-clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
            "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ),
        (
            "gpl-3.0",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ),
        (
            "isc",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ),
        (
            "lgpl-3.0",
            "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ),
        (
            "mit",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
            "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ),
        ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
        (
            "unlicense",
            "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ),
        ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ]
)
_OTHER = r"[^\p{L}\p{N}.]+|\.+(?=[^\p{L}\p{N}.]|$)"


def template_words(text: str) -> list[str]:
    kept = re.sub(r"[^\w.]+|_+|\.+(?=[^\w.]|$)", " ", text.lower()).strip(" ")
    return re.split(" +", kept) if kept else []


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({" ".join(x) for x in zip(words, words[1:])} or set(words))


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) > 1, pairs).otherwise(words)


def longest_window(n: int, threshold: float) -> int:
    """The most bigrams of a window that can reach the threshold against a template of n."""
    return math.floor(n * (2 - threshold) / threshold + 1e-9)


def license_scan(docs: DataFrame, *, templates: Mapping[str, str] | Notices = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, license, score, word_no (first word of the best window, from 1), licenses (all found, by comma)."""
    known = [(name, template_bigrams(text)) for name, text in sorted(templates.items())]
    known = [(name, grams) for name, grams in known if grams]
    if not known:
        raise ValueError("no template has a word")
    ratio = threshold / (2 - threshold) - 1e-9
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(grams)).alias("n"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(longest_window(len(grams), threshold)).alias("most")) for name, grams in known])
    every = F.array(*map(F.lit, sorted({g for _, grams in known for g in grams})))
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), _OTHER, " "), " +"), lambda w: w != "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", words.alias("words"))
    rows = rows.select("doc_id", _bigrams(F.col("words")).alias("grams"))
    rows = rows.select("doc_id", "grams", F.array_intersect(every, "grams").alias("held"))
    possible = F.filter(table, lambda t: F.size(F.array_intersect(t["grams"], F.col("held"))) >= ratio * t["n"])
    rows = rows.select("doc_id", "grams", F.when(F.size("held") >= ratio * min(len(g) for _, g in known), possible).alias("near"))

    def seen(g: Column, i: Column) -> Column:
        """Places back to the same bigram, 0 where no window that holds both is short enough."""
        return F.array_position(F.reverse(F.slice("grams", F.greatest(i - longest + 1, F.lit(1)), F.least(i, F.lit(longest)))), g).cast("int")

    def windows(t: Column) -> Column:
        """Per start the best score of its windows: the end goes on bigram by bigram, those that are new in the window and those of the template are counted."""
        flags = F.transform("marked", lambda m: F.struct(m["back"].alias("back"), F.array_contains(t["grams"], m["g"]).cast("int").alias("held")))
        none = F.struct(F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("score"))

        def longer(x: Column, f: Column) -> Column:
            fresh = F.when((f["back"] > 0) & (f["back"] <= x["i"]), 0).otherwise(1)
            at = F.struct((x["a"] + fresh).alias("a"), (x["b"] + fresh * f["held"]).alias("b"))
            return F.get(F.transform(F.array(at), lambda y: F.struct((x["i"] + 1).alias("i"), y["a"].alias("a"), y["b"].alias("b"), F.greatest(x["score"], 2.0 * y["b"] / (y["a"] + t["n"])).alias("score"))), 0)

        def scored(all_flags: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(all_flags)), lambda p: F.get(all_flags, p - 1)["held"] == 1)
            return F.transform(starts, lambda p: F.struct(F.aggregate(F.slice(all_flags, p, t["most"]), none, longer)["score"].alias("score"), p.alias("word_no"), t["name"].alias("name")))

        return F.get(F.transform(F.array(flags), scored), 0)

    longest = max(longest_window(len(grams), threshold) for _, grams in known)
    marked = F.transform("grams", lambda g, i: F.struct(g.alias("g"), F.when(i > 0, seen(g, i)).otherwise(0).alias("back")))
    rows = rows.select("doc_id", "near", F.when(F.size("near") > 0, marked).alias("marked"))
    hits = F.filter(F.flatten(F.transform("near", windows)), lambda h: h["score"] >= threshold - 1e-9)
    rows = rows.select("doc_id", F.coalesce(F.when(F.size("near") > 0, hits), F.array().cast("array<struct<score:double,word_no:int,name:string>>")).alias("hits"))
    better = lambda a, h: (h["score"] > a["score"]) | ((h["score"] == a["score"]) & ((h["word_no"] < a["word_no"]) | ((h["word_no"] == a["word_no"]) & (h["name"] < a["name"]))))
    best = F.reduce(F.col("hits"), F.get("hits", F.lit(0)), lambda a, h: F.when(better(a, h), h).otherwise(a))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"]))), ",")
    rows = rows.select("doc_id", best.alias("best"), names.alias("licenses"))
    return rows.select("doc_id", F.col("best.name").alias("license"), F.round(F.coalesce("best.score", F.lit(0.0)), 6).alias("score"), F.col("best.word_no").cast("long").alias("word_no"), "licenses")
