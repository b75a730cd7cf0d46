"""License scan: fixed phrases by position, and templates by an exact set-similarity join.

Templates are license texts, their standard headers, and short statements. Per template length a text is cut into
blocks of twice so many words (rounded up to a power of two, at least `BLOCK`) that overlap by half, so every stretch as
long as the template lies wholly in one. A block carries a template's label when it contains at least `PERCENT` % of
the template's distinct words. The join:

* the words of all templates (a fixed vocabulary) are counted over all documents and ordered from rare to frequent;
* a template can only be contained if one of its rarest `size - needed + 1` words is in the block (prefix filter), so
  blocks and templates meet on those words alone, and documents without any of them are never cut into blocks;
* the block must hold enough vocabulary words (length filter) and enough of them around the place where both meet in
  that order (positional filter); what is left is verified by its whole intersection.

Only the templates, a fixed list, are broadcast; their vocabulary is bounded by `MAX_VOCABULARY`. Only built-in
functions are used.

Null or empty text: no words, no labels, score 0. Rows are told apart by id and a digest of the text, so rows with equal
or null ids keep their own labels; other columns are not read. Empty input gives an empty result.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewarden.llm.text import UPPER, let, lower_ascii

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Names and texts of licenses, headers and statements.
TEMPLATES = (
    ("agpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("all-rights-reserved", "all rights reserved"),
    ("apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("gpl-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-notice", "this work is licensed under the gnu general public license version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("lgpl-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("mit-notice", "released under the mit license"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("public-domain", "this work is dedicated to the public domain"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
PERCENT = 90
BLOCK = 16
MAX_VOCABULARY = 10_000


def license_words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none of a null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD), "")


def template_words(text: str) -> list[str]:
    """The words of a template, cut like those of a text."""
    return [w for w in re.split(NO_WORD, text.translate(str.maketrans(UPPER, UPPER.lower()))) if w]


def block_of(n: int, least: int = BLOCK) -> int:
    """Words of the blocks in which a template of `n` words is looked for."""
    return max(least, 1 << (2 * n - 1).bit_length())


def phrase_places(found: Column, phrase: str) -> Column:
    """Indexes of the words at which the words of `phrase` start."""
    parts = phrase.split(" ")
    here = F.contains(F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" ")), F.lit(f" {phrase} "))

    def starts(i: Column) -> Column:
        same = F.get(found, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(found, i + k) == part)
        return F.coalesce(same, F.lit(False))

    none = F.array().cast("array<int>")
    return F.when(here, F.filter(F.sequence(F.lit(0), F.size(found) - 1), starts)).otherwise(none)


def base_columns(found: Column) -> Column:
    """Struct (n_words, n_base, first_word, last_word, labels) of the words of a text."""

    def facts(places: Column) -> Column:
        every = F.flatten(places)
        labels = [F.when(F.size(F.get(places, F.lit(k))) > 0, label) for k, (_, label) in enumerate(PHRASES)]
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.size(every).cast("long").alias("n_base"),
            F.array_min(every).cast("long").alias("first_word"),
            F.array_max(every).cast("long").alias("last_word"),
            F.sort_array(F.array_compact(F.array(*labels))).alias("labels"),
        )

    return let(F.array(*[phrase_places(found, phrase) for phrase, _ in PHRASES]), facts)


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary from rare to frequent, by the documents of `docs` (words) that hold a word; ties by the word."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    counts = docs.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count()
    seen = {row["word"]: row["count"] for row in counts.collect()}  # at most one row a word of the vocabulary
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def template_labels(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT, least: int = BLOCK) -> DataFrame:
    """(doc_id, digest, found: array of labels, score) of the rows of `docs` (doc_id, digest, words) with a contained template."""
    cut = [(label, template_words(text)) for label, text in templates]
    vocabulary = sorted({w for _, found in cut for w in found})
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"templates have {len(vocabulary)} words; {MAX_VOCABULARY} are allowed")
    order = word_order(docs, vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for label, found in cut:
        ordered = sorted(set(found), key=rank.get)
        needed = ceil(len(ordered) * percent / 100)
        for at, word in enumerate(ordered[: len(ordered) - needed + 1]):
            prefixes.append((word, block_of(len(found), least), label, at, needed, ordered))
    rows = [
        F.struct(
            F.lit(word).alias("word"),
            F.lit(length).alias("length"),
            F.lit(label).alias("label"),
            F.lit(at).alias("template_at"),
            F.lit(needed).alias("needed"),
            F.array(*[F.lit(w) for w in ordered]).alias("template"),
        )
        for word, length, label, at, needed, ordered in prefixes
    ]
    table = docs.sparkSession.range(1).select(F.inline(F.array(*rows)))
    rare = F.array(*[F.lit(w) for w in sorted({p[0] for p in prefixes})])
    # Words that open some template of a block length: a block without any of them is not kept.
    of_length = [(n, F.array(*[F.lit(w) for w in sorted({p[0] for p in prefixes if p[1] == n})])) for n in sorted({p[1] for p in prefixes})]
    in_order = F.array(*[F.lit(w) for w in order])

    def blocks_of(length: int, opening: Column) -> Column:
        half = length // 2
        starts = F.sequence(F.lit(1), F.greatest(F.size("words") - half, F.lit(1)), F.lit(half))
        cuts = F.transform(starts, lambda at: F.slice("words", at, F.lit(length)))
        meet = F.filter(cuts, lambda b: F.arrays_overlap(b, opening))
        rows = F.transform(meet, lambda b: F.struct(F.lit(length).alias("length"), F.array_intersect(in_order, b).alias("block")))
        return F.when(F.arrays_overlap("words", opening), rows)

    every = F.flatten(F.array_compact(F.array(*[blocks_of(n, opening) for n, opening in of_length])))
    blocks = docs.filter(F.arrays_overlap("words", rare)).select("doc_id", "digest", F.inline(every))
    met = blocks.select("doc_id", "digest", "length", "block", F.posexplode("block").alias("block_at", "word")).join(F.broadcast(table), ["word", "length"])
    left = lambda size, at: size - at - 1
    reach = (
        F.least("template_at", "block_at")
        + 1
        + F.least(left(F.size("template"), F.col("template_at")), left(F.size("block"), F.col("block_at")))
    )
    shared = F.size(F.array_intersect("template", "block"))
    verified = (
        met.filter((F.size("block") >= F.col("needed")) & (reach >= F.col("needed")))
        .select("doc_id", "digest", "label", "needed", shared.alias("shared"), F.size("template").alias("size"))
        .filter("shared >= needed")
    )
    return verified.groupBy("doc_id", "digest").agg(
        F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("size")).alias("score")
    )


def scan_licenses(docs: DataFrame, **settings) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    tokens = docs.select("doc_id", F.xxhash64("text").alias("digest"), license_words(F.col("text")).alias("words"))
    base = tokens.select("doc_id", "digest", let(F.col("words"), base_columns).alias("b"))
    found = template_labels(tokens, **settings)
    joined = base.alias("b").join(found.alias("f"), F.expr("b.doc_id <=> f.doc_id AND b.digest = f.digest"), "left")
    own = F.coalesce("f.found", F.array().cast("array<string>"))
    labels = F.sort_array(F.array_union("b.b.labels", own))
    score = F.when(F.size("b.b.labels") > 0, F.lit(1.0)).otherwise(F.coalesce("f.score", F.lit(0.0)))
    return joined.select(
        "b.doc_id",
        *[F.col(f"b.b.{name}").alias(name) for name in ("n_words", "n_base", "first_word", "last_word")],
        F.array_join("b.b.labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
