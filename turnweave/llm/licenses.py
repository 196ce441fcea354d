"""Operator 4 [native]: scan for license texts with MinHash over overlapping windows.

Words are runs of ASCII letters and digits, A-Z lower-cased; a shingle is five words.

1. Retrieval.  A text is cut into windows, whose length goes with the template: WINDOW shingles, one window every STRIDE,
   for templates of at least two windows; one shingle for shorter ones, as most notices are.  Each of BANDS hash functions
   takes the minimum over a window's shingles, and a band whose minimum is a template's value retrieves this template for the
   document; so a window with a share f of its shingles in the template does it with chance 1 - (1 - f)**BANDS, and a window
   that lies in a copy does it surely.  A minimum over one shingle is the shingle, so there one band says all and nothing is
   left to chance.  A document that holds CONTAINMENT of a template of n shingles, however scattered, has shares that add up
   to CONTAINMENT * n / WINDOW over windows side by side, so it escapes with a chance of at most
   exp(-BANDS * CONTAINMENT * 2) = 1.2e-7, less for longer templates.
2. Verification.  Only documents with a retrieved template are cut into shingles again, and only the retrieved templates are counted
   in them: a document holds a license if at least CONTAINMENT of the template's distinct shingles occur in it.

Windows between one shingle and about 2 * BANDS would cost more band rows than a look at each shingle, so there are none.

Only DataFrame operations run here.  Templates are a parameter; blocks of BLOCK_WORDS of their words, a few megabytes as
band values, are broadcast one after another, and each block sees all documents.  The retrieved documents are written to the
shared folder; Spark broadcasts their ids where that table's size allows it and shuffles otherwise.

Defined results: null and empty texts, and texts under five words, hold nothing; rows that repeat a doc_id count as one
text, and so do rows without one; licenses that match equally are all reported; templates that repeat a name count as one; an
empty table gives no rows.  Extra columns are not read.  Very long texts are cut into overlapping segments, so no row grows
with the text's square.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SHINGLE, WINDOW, STRIDE, BANDS, CONTAINMENT = 5, 16, 8, 10, 0.8
SEGMENT_WORDS = 2048
BLOCK_WORDS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Licenses whose full text is a file of license_texts.
FULL_TEXTS = ("Apache-2.0", "GPL-3.0", "MPL-2.0")


def full_text(license: str) -> str:
    return (resources.files(__package__) / "license_texts" / f"{license}.txt").read_text(encoding="utf-8")


#: Notices by which texts state a license, and texts of licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("GPL-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    ),
    (
        "BSD-2-Clause-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
        OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSL-1.0-text",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
        works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright
        notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be
        included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works
        are solely in the form of machine-executable object code generated by a source language processor.""",
    ),
    (
        "Unlicense-text",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software
        to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
        intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
        law.""",
    ),
    (
        "Apache-2.0-header",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-header",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    ),
    *((f"{name}-text", full_text(name)) for name in FULL_TEXTS),
)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^A-Za-z0-9]+", text.lower()) if w]


def word_hashes(text: Column) -> Column:
    words = F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def windows_of(frame: DataFrame, keys: list[str]) -> DataFrame:
    """keys and s0.., the hashes of the shingles of each window, one every STRIDE; the last windows hold fewer, then null."""
    reach = SHINGLE + WINDOW - 1
    count = F.size("_h") - (SHINGLE - 1)
    segments = F.transform(F.sequence(F.lit(1), count, F.lit(SEGMENT_WORDS)), lambda i: F.slice("_h", i, SEGMENT_WORDS + reach))
    # a filter on the number of words would be pushed below the words and find them twice
    cut = frame.select(*keys, F.explode(F.when(count > 0, segments)).alias("_h")).where(F.size("_h") >= SHINGLE)
    starts = F.sequence(F.lit(0), F.least(F.size("_h") - SHINGLE, F.lit(SEGMENT_WORDS - 1)), F.lit(STRIDE))
    words = cut.select(*keys, "_h", F.explode(starts).alias("_i")).select(*keys, *[F.get("_h", F.col("_i") + j).alias(f"h{j}") for j in range(reach)])
    names = [[f"h{j + n}" for n in range(SHINGLE)] for j in range(WINDOW)]
    return words.select(*keys, *[F.when(F.col(n[-1]).isNotNull(), F.xxhash64(*n)).alias(f"s{j}") for j, n in enumerate(names)])


def shingles_of(frame: DataFrame, keys: list[str]) -> DataFrame:
    """keys and value, the hash of each shingle, once for each place."""
    places = F.array(*[F.col(f"s{j}") for j in range(STRIDE)])
    return windows_of(frame, keys).select(*keys, F.explode(places).alias("value")).where("value is not null")


def band_value(shingle: str, band: Column) -> Column:
    return F.when(F.col(shingle).isNotNull(), F.xxhash64(shingle, band))


def probes(windows: DataFrame, keys: list[str], single: bool, long: bool) -> DataFrame:
    """keys, value: the BANDS minima of each window if long, and its first STRIDE shingles, windows of one, if single.

    Places without a shingle have the value 0: a null would make the join compute each value once more, to filter it.
    """
    kinds = [*(range(-STRIDE, 0) if single else ()), *(range(BANDS) if long else ())]
    rows = windows.select("*", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("_k"))
    value = F.when(F.col("_k") >= 0, F.least(*[band_value(f"s{j}", F.col("_k")) for j in range(WINDOW)]))
    for j in range(STRIDE):
        value = value.when(F.col("_k") == -1 - j, F.col(f"s{j}"))
    return rows.select(*keys, F.coalesce(value, F.lit(0)).alias("value"))


def template_blocks(templates, block_words: int) -> list[list[tuple[str, int, str]]]:
    """(license, number of its distinct shingles, words joined by spaces) in blocks of about block_words words.

    All texts of one name are in one block.
    """
    words: dict[str, list[list[str]]] = {}
    for name, text in templates:
        words.setdefault(name, []).append(template_words(text))
    short = [name for name, texts in words.items() if any(len(w) < SHINGLE for w in texts)]
    if short:
        raise ValueError(f"templates under {SHINGLE} words: {short}")
    blocks, size = [], block_words
    for name, texts in words.items():
        if size >= block_words:
            blocks.append([])
            size = 0
        shingles = {tuple(w[i : i + SHINGLE]) for w in texts for i in range(len(w) - SHINGLE + 1)}
        blocks[-1] += [(name, len(shingles), " ".join(w)) for w in texts]
        size += sum(map(len, texts))
    return blocks


def retrieve(docs: DataFrame, known: DataFrame, sizes: list[int]) -> DataFrame:
    """_id and licenses: the templates that a band of some window retrieves for a document; written, as counting reads it."""
    is_long = F.col("n_shingles") >= 2 * WINDOW
    single, long = any(n < 2 * WINDOW for n in sizes), any(n >= 2 * WINDOW for n in sizes)
    bands = known.where(is_long).select("license", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("_k"), "value")
    index = known.where(~is_long).select("license", "value").unionAll(bands.select("license", band_value("value", F.col("_k")).alias("value")))
    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("_h"))
    met = probes(windows_of(hashed, ["doc_id"]), ["doc_id"], single, long).join(F.broadcast(index), "value")
    return materialize(met.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("license").alias("licenses")))


def scan_block(docs: DataFrame, templates: list[tuple[str, int, str]]) -> DataFrame:
    """doc_id, license, n_matched and n_shingles of the templates of one block that docs (doc_id, text) hold."""
    given = docs.sparkSession.createDataFrame(templates, "license string, n_shingles long, text string")
    known = shingles_of(given.withColumn("_h", word_hashes(F.col("text"))), ["license", "n_shingles"]).distinct()

    met = retrieve(docs, known, [n for _, n, _ in templates])
    suspects = docs.join(met, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "licenses", word_hashes(F.col("text")).alias("_h"))
    held = shingles_of(suspects, ["doc_id", "licenses"]).join(F.broadcast(known), "value").where(F.array_contains("licenses", F.col("license")))
    counted = held.select("doc_id", "license", "n_shingles", "value").distinct().groupBy("doc_id", "license", "n_shingles").agg(F.count("*").alias("n_matched"))
    enough = F.col("n_matched") * 10 >= F.col("n_shingles") * int(CONTAINMENT * 10)
    return counted.where(enough).select("doc_id", "license", "n_matched", "n_shingles")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, license, n_matched, n_shingles and containment of every license that a document holds."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [scan_block(texts, block) for block in template_blocks(templates, block_words)]
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, license string, n_matched long, n_shingles long, containment double")
    out = found[0]
    for block in found[1:]:
        out = out.unionAll(block)
    return out.withColumn("containment", F.col("n_matched") / F.col("n_shingles"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "license", "n_matched", "n_shingles", "containment")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP4_SQL = f"""
WITH templates(license, words) AS (VALUES {", ".join(f"({_sql_text(n)}, string_split({_sql_text(' '.join(template_words(t)))}, ' '))" for n, t in TEMPLATES)}),
model AS (
  SELECT DISTINCT license, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle
  FROM (SELECT license, words, unnest(range(1, len(words) - 3)) AS i FROM templates)
),
totals AS (SELECT license, count(*) AS n_shingles FROM model GROUP BY license),
texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda w: w <> '') AS words
  FROM documents WHERE text IS NOT NULL
),
seen AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM texts)
)
SELECT doc_id, license, count(*) AS n_matched, n_shingles, count(*) / n_shingles AS containment
FROM seen JOIN model USING (shingle) JOIN totals USING (license)
GROUP BY doc_id, license, n_shingles HAVING count(*) * 10 >= n_shingles * {int(CONTAINMENT * 10)}
"""
