"""Licence scans by diagonal voting.

Templates are short notices and whole licence texts.  Every rolling run of ``K`` words of a
document, as a hash, is joined to the places of the same run in the templates (a table of a
few thousand rows).  A match votes for its diagonal: place in the document minus place in the
template.  Votes are summed up per diagonal, and those of diagonals close to each other (words put in or
left out) are taken together.  Every diagonal of a notice, however few its votes, is verified as a
beginning, with its own end and with that of the near diagonal that matches the template's latest words; one of a
whole text if near diagonals have matched a fifth of its runs.  A span counts from a likeness of 0.8, and
no more of an edit distance is computed than that allows.  A long text's diagonals are dealt out by place.
What shares no run of ``K`` words with a notice isn't found, nor a whole text of which less than a fifth of the runs is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 3
LIKE = 0.8
#: Share of a whole text's runs that near diagonals must have matched, and diagonals of a text that are looked at together.
LEAST = 0.2
BLOCK = 2048
#: Words from which a template is a whole text, not a notice; a place may have a label of either.
WHOLE = 60
#: Diagonals to either side among which an end is looked for: of a notice, of a whole text.
SPREAD = (8, 50)

#: Notices and whole texts by label, as their public texts have them (fixed values).
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-text": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "licensed under the gnu lesser general public license version 3",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4.0": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "mit-full": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "isc-full": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    "bsd-3-clause": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    "apache-2.0-header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "gpl-header": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details. You should have received a copy of the GNU General Public License along with this
        program. If not, see https://www.gnu.org/licenses/.""",
    "mpl-2.0-header": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

#: Phrases whose places are always reported, and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

#: Whatever can't be in a word: ASCII but digits and lower-case letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words (runs of ASCII letters and digits and of all beyond ASCII)."""
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def runs(hashed: Column, k: int = K) -> Column:
    """Hash of every run of k words, in order, from the words' hashes (a column of its own)."""
    at = F.sequence(F.lit(0), F.size(hashed) - k)
    return F.when(F.size(hashed) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _places(words: Column, phrase: tuple[str, ...]) -> Column:
    def start(w: Column, i: Column) -> Column:
        ok = w == phrase[0]
        for j, x in enumerate(phrase[1:], 1):
            ok = ok & F.get(words, i + j).eqNullSafe(F.lit(x))
        return F.when(ok, i)

    none = F.array().cast("array<int>")
    return F.when(F.array_contains(words, phrase[-1]), F.array_compact(F.transform(words, start))).otherwise(none)


def phrase_places(words: Column) -> dict[str, Column]:
    """Per label, the places (from 0) where its phrase's words stand one after another.
    Only a text that has a phrase's last word is gone through."""
    return {label: _places(words, phrase) for phrase, label in PHRASES.items()}


def template_rows(spark: SparkSession, templates: dict[str, str], k: int = K) -> DataFrame:
    """(label, template, n, tpos, run) of all templates, in the words of the scan."""
    rows = spark.createDataFrame(list(templates.items()), "label string, text string").select("label", words_of(F.col("text")).alias("words"))
    rows = rows.select("label", F.array_join("words", " ").alias("template"), F.size("words").alias("n"), hashes(F.col("words")).alias("hashed"))
    return rows.select("label", "template", "n", F.posexplode(runs(F.col("hashed"), k)).alias("tpos", "run"))


def measured(spark: SparkSession, docs: DataFrame, known: DataFrame) -> DataFrame:
    """One scan of rows (doc_id, text), written: doc_id, h (the text's hash), n_words, per phrase
    its places, and, of texts that share a run with the templates only, the words."""
    shared = ",".join(f"{r.run}L" for r in known.select("run").distinct().collect())  # as many as the templates have words
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    rows = rows.select("*", hashes(F.col("words")).alias("hashed"))
    places = phrase_places(F.col("words"))
    any_run = F.arrays_overlap(runs(F.col("hashed")), F.expr(f"array({shared})")) if shared else F.lit(False)
    rows = rows.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), *[c.alias(f"_{x}") for x, c in places.items()], F.when(any_run, F.col("words")).alias("words"))
    return common.written(spark, rows, "licence-words")


def spans(spark: SparkSession, rows: DataFrame, known: DataFrame, like: float = LIKE) -> DataFrame:
    """Verified spans of ``measured`` rows: doc_id, h, label, first_word, past_word, likeness.
    Rows of equal doc_id and text share their spans."""
    known = common.written(spark, known, "licence-templates")
    rows = rows.where(F.col("words").isNotNull()).select("doc_id", "h", "words")
    exploded = rows.select("doc_id", "h", hashes(F.col("words")).alias("hashed")).select("doc_id", "h", F.posexplode(runs(F.col("hashed"))).alias("pos", "run"))
    hits = exploded.join(F.broadcast(known.select("run", "label", "n", "tpos")), "run")  # as many as the templates have words
    votes = hits.groupBy("doc_id", "h", "label", "n", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.max("tpos").alias("last"), F.count("*").alias("votes"), F.collect_set("tpos").alias("matched"))
    # A window holds a block of one document's diagonals for one template, and those within reach on either side.
    block = F.floor(F.col("diagonal") / BLOCK)
    reach = F.array_distinct(F.array(F.floor((F.col("diagonal") - SPREAD[1]) / BLOCK), block, F.floor((F.col("diagonal") + SPREAD[1]) / BLOCK)))
    votes = votes.withColumn("home", block).withColumn("block", F.explode(reach))
    near = Window.partitionBy("doc_id", "h", "label", "block").orderBy("diagonal")
    latest = [F.max_by("diagonal", F.struct("last", "votes", "diagonal")).over(near.rangeBetween(-far, far)) for far in SPREAD]
    support = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("n") >= WHOLE, F.col("matched"))).over(near.rangeBetween(-SPREAD[1], SPREAD[1])))))
    chains = votes.withColumn("latest", F.when(F.col("n") < WHOLE, latest[0]).otherwise(latest[1])).withColumn("support", support).where("home = block")
    chains = chains.where((F.col("n") < WHOLE) | (F.col("support") >= F.lit(LEAST) * (F.col("n") - K + 1)))
    ends = F.array_distinct(F.array("diagonal", "latest"))
    found = chains.select("doc_id", "h", "label", F.greatest(F.lit(0), "diagonal").alias("first_word"), F.explode(ends).alias("end"), "n")
    found = found.select("doc_id", "h", "label", "first_word", (F.col("end") + F.col("n")).alias("past_word")).where("past_word > first_word")
    found = common.written(spark, found.distinct(), "licence-spans")
    near_rows = rows.join(common.small_side(found), rows.doc_id.eqNullSafe(found.doc_id) & (rows.h == found.h)).select(found["*"], rows.words)
    texts = known.select("label", "template", "n").distinct()
    near_rows = near_rows.join(F.broadcast(texts), "label").withColumn("past_word", F.least("past_word", F.size("words")))
    text = F.array_join(F.slice("words", F.col("first_word") + 1, F.col("past_word") - F.col("first_word")), " ")
    rest = ["doc_id", "h", "label", "first_word", "past_word", "n", "template"]
    near_rows = near_rows.where("past_word > first_word").select(*rest, text.alias("text")).distinct()
    longest = F.greatest(F.length("text"), F.length("template"))
    out = near_rows.where(F.abs(F.length("text") - F.length("template")) <= longest * (1 - like) + 1e-9)
    size = {r["whole"]: r["size"] for r in texts.groupBy((F.col("n") >= WHOLE).alias("whole")).agg(F.max(F.length("template")).alias("size")).collect()}
    most = {whole: int(x / like * (1 - like)) + 1 for whole, x in size.items()}  # edits that a notice, a whole text allows
    far = F.when(F.col("n") < WHOLE, F.levenshtein("text", "template", most.get(False, 0))).otherwise(F.levenshtein("text", "template", most.get(True, 0)))
    out = out.withColumn("far", far).where("far >= 0").withColumn("likeness", 1 - F.col("far") / longest).where(F.col("likeness") >= like - 1e-9)
    # Of spans that overlap, the likest stays: of notices, and of whole texts.
    out = out.select("doc_id", "h", (F.col("n") >= WHOLE).alias("whole"), "label", "first_word", "past_word", "likeness")
    before = Window.partitionBy("doc_id", "h", "whole").orderBy("first_word", "past_word", "label").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("new", F.coalesce((F.col("first_word") >= F.max("past_word").over(before)).cast("int"), F.lit(1)))
    out = out.withColumn("place", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = F.max("likeness").over(Window.partitionBy("doc_id", "h", "whole", "place"))
    return out.withColumn("best", best).where("likeness = best").drop("whole", "new", "place", "best")


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word, base_labels,
    labels and score (the best span's likeness, 0 without one), from the whole text."""
    known = template_rows(spark, templates)
    rows = measured(spark, docs, known)
    found = spans(spark, rows, known).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("label").alias("more"), F.max("likeness").alias("best"))
    every = F.concat(*[F.col(f"_{x}") for x in PHRASES.values()])
    names = F.array_compact(F.array(*[F.when(F.size(f"_{x}") > 0, F.lit(x)) for x in PHRASES.values()]))
    rows = rows.select("doc_id", "h", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(names).alias("base"))
    out = rows.join(found, rows.doc_id.eqNullSafe(found["_id"]) & (rows.h == found["_h"]), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all ``documents``.

    Null or empty text: no words, no labels, score 0.  Null doc_id and repeated rows: each
    has its row.  Ties: overlapping spans of equal likeness keep all their labels.  Very long texts:
    taken whole.  Other columns: ignored.  Empty table: no rows."""
    return scan(spark, common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
