"""Licence scans, with DataFrame operations only.

Two kinds of text are held against templates, as sparse TF-IDF vectors: headers, which are sentences,
against notices, and whole documents against the full texts of licences. A vector has a text's distinct
terms (runs of ASCII letters and digits, in lower case), each by its idf over all documents; a term that no
template has counts as one that no document has. The template of the best cosine is the text's licence: from LEAST on
for headers, from FILE_LEAST on for documents.

Every sentence and every document is looked at. Cauchy's inequality sorts out those that can't reach
the least cosine: the terms that they share with any template must weigh enough against the rest
(``within_reach``; weights are bounded by TIERS of idf, so this is a count of terms). What is left is scored
once for each distinct vector.

A document's licence is that of its whole text, else that of its best header. A document that matches a
full text, or of which headers are FILE_SHARE or more, is a licence file and gives its licence to its
directory. Documents without a licence of their own inherit from the nearest directory above them that
has one; that is found once for each directory.

Null or empty text has no header. Null path: nothing is inherited. Two licence files in a directory: the
licence more of them have, then the first by name. Repeated rows count as often as they come, and each gets
its result. Ties between templates go to the first by name. Texts are read whole, however long. Columns
other than doc_id, text and the path are not read. An empty table gives no rows. Vectors and directories
that many rows share are joined by broadcast (shared.join_uneven).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, join_uneven, written

#: Names and the usual short notices of common licences.
NOTICES = {
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "Apache-2.0": "licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "redistribution and use in source and binary forms, BSD 3-Clause License",
    "CC-BY-4.0": "licensed under CC BY 4.0, Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "licensed under CC BY-NC 4.0, Creative Commons Attribution NonCommercial 4.0",
    "CC-BY-SA-4.0": "licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike 4.0",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "MIT": "released under the MIT License, permission is hereby granted free of charge",
    "MPL-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "Proprietary": "copyright, all rights reserved, proprietary and confidential",
    "Unlicense": "free and unencumbered software released into the public domain, Unlicense",
}
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_END = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program."
#: The texts of short licences, and of longer ones the notice that their authors have put into files.
TEXTS = {
    "AGPL-3.0": _GNU.format("Affero ", 3),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": f"BSD 2-Clause License Copyright (c) {_BSD} {_BSD_END}",
    "BSD-3-Clause": f"BSD 3-Clause License Copyright (c) {_BSD} {_BSD_NAME} {_BSD_END}",
    "GPL-2.0": _GNU.format("", 2),
    "GPL-3.0": _GNU.format("", 3),
    "ISC": f"ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}",
    "LGPL-3.0": _GNU.format("Lesser ", 3),
    "MIT": f"MIT License Copyright (c) {_GRANT} {_AS_IS}",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS,
    "Zlib": "zlib License This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Sentences end at a line's end, or at white space behind a full stop, ! or ?.
CUT = r"\n+|(?<=[.!?])[ \t\r]+"
LEAST, FILE_LEAST, FILE_SHARE = 0.4, 0.7, 0.2
#: Classes of idf that bound the weight of known terms.
TIERS = 4
TERM = "[a-z0-9]+"


def words_of(body: str) -> list[str]:
    return sorted(set(re.findall(TERM, body.lower())))


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def among(found: Column, these: list[str]) -> Column:
    return F.filter(found, lambda x: x.isin(these))


class Weights:
    """idf of the templates' terms over all documents, and of terms that they don't have."""

    def __init__(self, docs: DataFrame, templates: list[dict[str, str]]):
        have = sorted({w for t in templates for body in t.values() for w in words_of(body)})
        counted = docs.select(F.explode(among(terms(F.col("text")), have)).alias("term"))
        df = dict(counted.groupBy("term").agg(F.count("*")).collect())  # a row for each term of the templates at most
        n = docs.count()
        idf = docs.sparkSession.createDataFrame([(w, df.get(w, 0)) for w in have], "term string, df long")
        self.table = idf.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
        self.idf = dict(self.table.collect())
        self.unknown = F.log(F.lit(1.0 + n)) + 1
        order = sorted(have, key=self.idf.__getitem__)
        cut = [order[len(order) * k // TIERS : len(order) * (k + 1) // TIERS] for k in range(TIERS)]
        self.tiers = [t for t in cut if t]

    def known(self, found: Column) -> Column:
        return among(found, sorted(self.idf))

    def within_reach(self, known: Column, others: Column, least: float) -> Column:
        """Whether the known terms may weigh ``least`` of the whole or more; never false for a text that reaches it."""
        least = least - 1e-5
        most = sum((F.size(among(known, t)) * F.lit(max(map(self.idf.__getitem__, t)) ** 2) for t in self.tiers), F.lit(0.0))
        rest = others * self.unknown * self.unknown
        return (F.size(known) > 0) & (most * (1 - least * least) >= rest * (least * least))


def vector(known: Column, others: Column) -> Column:
    """What tells vectors apart: the known terms in order, and how many others there are."""
    return F.struct(F.sort_array(known).alias("known"), others.alias("others"))


def scored(found: DataFrame, weights: Weights, templates: dict[str, str], least: float) -> DataFrame:
    """vector, _n (rows of ``found`` with it), license, score of each distinct vector; license and score are null below ``least``. Written."""
    spark = found.sparkSession
    rows = [(name, w) for name, body in sorted(templates.items()) for w in words_of(body)]
    idf = F.broadcast(weights.table)  # the templates' terms
    t = spark.createDataFrame(rows, "name string, term string").join(idf, "term")
    t_size = t.groupBy("name").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("t_size"))
    t = t.join(t_size, "name").select("name", "term", (F.col("idf") / F.col("t_size")).alias("tw"))
    # numbered in a written table, so that sums go by a number instead of a list of terms
    each = written(found.groupBy("vector").agg(F.count("*").alias("_n")).withColumn("number", F.monotonically_increasing_id()), "vectors")
    s = each.select("number", "vector.others", F.explode("vector.known").alias("term")).join(idf, "term")
    size = s.groupBy("number").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf")) + F.max("others") * weights.unknown * weights.unknown).alias("s_size"))
    dot = s.join(F.broadcast(t), "term").groupBy("number", "name").agg(F.sum(F.col("idf") * F.col("tw")).alias("dot"))  # the templates' terms
    cosine = dot.join(size, "number").select("number", "name", F.round(F.col("dot") / F.col("s_size"), 6).alias("score"))
    best = cosine.where(F.col("score") >= least).groupBy("number").agg(F.max("score").alias("score"), F.min_by("name", F.struct(-F.col("score"), F.col("name"))).alias("license"))
    return written(each.join(best, "number", "left").select("vector", "_n", "license", "score"), "scored")


def scan(docs: DataFrame, path: str = "path", notices: dict[str, str] = NOTICES, texts: dict[str, str] = TEXTS) -> DataFrame:
    """docs: doc_id, text, path. Returns doc_id, path, license, score, license_from (own: the path; inherited: the directory)."""
    parent = F.regexp_extract(F.col("path"), "^(.*)/[^/]*$", 1)
    docs = docs.select("doc_id", "text", F.col(path).alias("path"))
    weights = Weights(docs, [notices, texts])
    # each step's columns are used more than once in the next, so none is worked out again
    cut = docs.select("doc_id", "path", F.length("text").alias("chars"), F.transform(F.split("text", CUT), lambda s: F.struct(F.length(s).alias("long"), terms(s).alias("terms"))).alias("cut"))
    split = lambda s: F.struct(s["long"].alias("long"), weights.known(s["terms"]).alias("known"), F.size(s["terms"]).alias("n"))
    parts = F.filter(F.transform("cut", split), lambda s: weights.within_reach(s["known"], s["n"] - F.size(s["known"]), LEAST))
    units = cut.select("doc_id", "path", "chars", parts.alias("parts"), F.array_distinct(F.flatten(F.transform("cut", lambda s: s["terms"]))).alias("terms"))
    units = units.select("doc_id", "path", "chars", "parts", weights.known(F.col("terms")).alias("known"), F.size("terms").alias("n"))
    others = F.col("n") - F.size("known")
    units = units.select("doc_id", "path", "chars", "parts", F.when(weights.within_reach(F.col("known"), others, FILE_LEAST), vector(F.col("known"), others)).alias("vector"))
    units = written(units, "headers")
    headers = units.where(F.size("parts") > 0).select("doc_id", "path", "chars", F.explode("parts").alias("part"))
    headers = headers.select("doc_id", "path", "chars", F.col("part.long").alias("long"), vector(F.col("part.known"), F.col("part.n") - F.size("part.known")).alias("vector"))
    hits = join_uneven(headers, scored(headers, weights, notices, LEAST), "vector", headers.count()).where("license is not null")
    pick = F.struct(-F.col("score"), F.col("license"))
    by_header = hits.groupBy("doc_id", "path").agg(F.max("score").alias("score"), F.min_by("license", pick).alias("license"), (F.sum("long") / F.max("chars")).alias("share"))
    files = units.where("vector is not null").select("doc_id", "path", "vector")
    by_text = join_uneven(files, scored(files, weights, texts, FILE_LEAST), "vector", files.count()).where("license is not null")
    by_text = by_text.groupBy("doc_id", "path").agg(F.max("score").alias("score"), F.min_by("license", pick).alias("license")).withColumn("share", F.lit(1.0))
    # a match of the whole text comes before those of headers
    own = by_text.withColumn("first", F.lit(0)).unionByName(by_header.withColumn("first", F.lit(1)))
    own = own.groupBy("doc_id", "path").agg(*(F.min_by(c, "first").alias(c) for c in ("score", "license", "share")))
    given = own.where((F.col("share") >= FILE_SHARE) & F.col("path").isNotNull()).groupBy(parent.alias("dir"), "license").agg(F.count("*").alias("n"))
    given = given.groupBy("dir").agg(F.min_by("license", F.struct(-F.col("n"), F.col("license"))).alias("license"))
    steps = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    places = docs.where("path is not null").groupBy(parent.alias("at")).agg(F.count("*").alias("_n")).select("at", "_n", F.explode(above).alias("dir"))
    # directories without a licence above them are there too, as many rows may have one
    depth = F.when(F.col("license").isNotNull(), F.length("dir"))
    near = places.join(given, "dir", "left").groupBy("at", "_n").agg(F.max_by("license", depth).alias("near"), F.max_by("dir", depth).alias("from"))
    own = own.select(F.col("doc_id").alias("_id"), F.col("path").alias("_path"), "license", "score")
    rows = docs.select("doc_id", "path", parent.alias("at")).join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    rows = join_uneven(rows, written(near, "near"), "at", docs.count(), "left")
    source = F.when(F.col("license").isNotNull(), F.col("path")).when(F.col("near").isNotNull(), F.col("from"))
    return rows.select("doc_id", "path", F.coalesce("license", "near").alias("license"), "score", source.alias("license_from"))


#: ``documents`` has no paths; these stand for them: a directory for each source, thousand and hundred of ids.
PATH_SQL = "source || '/' || CAST(FLOOR(doc_id / 1000) AS BIGINT) || '/' || CAST(FLOOR(doc_id / 100) AS BIGINT) || '/' || doc_id"


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text", F.expr(PATH_SQL).alias("path")))


def _oracle() -> str:
    values = lambda t: ", ".join(f"('{k}', '{v}')" for k, v in sorted(t.items()))
    # DuckDB has no lookbehind: a mark behind each end instead
    cut = r"string_split_regex(regexp_replace(text, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), '\n+')"
    terms_of = lambda x: f"unnest(list_distinct(regexp_extract_all(lower({x}), '{TERM}')))"
    best = lambda units, kind, least: f"""
      SELECT unit, score, name AS license FROM (
        SELECT s.unit, t.name, round(sum(s.idf * t.idf) / (any_value(z.z) * any_value(tz.z)), 6) AS score
        FROM {units} s JOIN t ON t.term = s.term AND t.kind = {kind} JOIN z{kind} z ON z.unit = s.unit JOIN tz ON tz.name = t.name AND tz.kind = {kind} GROUP BY ALL)
      WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, name) = 1"""  # noqa: E731
    return rf"""
WITH d AS (SELECT doc_id, text, {PATH_SQL} AS path, row_number() OVER () AS unit FROM documents),
h AS (SELECT doc_id, path, chars, sentence, row_number() OVER () AS unit FROM (SELECT doc_id, path, length(text) AS chars, unnest({cut}) AS sentence FROM d)),
v AS (SELECT 0 AS kind, * FROM (VALUES {values(NOTICES)}) v(name, body) UNION ALL SELECT 1, * FROM (VALUES {values(TEXTS)}) v(name, body)),
tt AS (SELECT kind, name, {terms_of("body")} AS term FROM v),
n AS (SELECT count(*) AS n FROM d),
dt AS (SELECT unit, {terms_of("text")} AS term FROM d), ht AS (SELECT unit, {terms_of("sentence")} AS term FROM h),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY 1), vocabulary AS (SELECT DISTINCT term FROM tt),
i AS (SELECT term, ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM vocabulary LEFT JOIN df USING (term), n),
di AS (SELECT unit, term, coalesce(idf, ln(1.0::DOUBLE + n) + 1) AS idf FROM dt LEFT JOIN i USING (term), n),
hi AS (SELECT unit, term, coalesce(idf, ln(1.0::DOUBLE + n) + 1) AS idf FROM ht LEFT JOIN i USING (term), n),
t AS (SELECT * FROM tt JOIN i USING (term)), tz AS (SELECT kind, name, sqrt(sum(idf * idf)) AS z FROM t GROUP BY ALL),
z0 AS (SELECT unit, sqrt(sum(idf * idf)) AS z FROM hi GROUP BY 1), z1 AS (SELECT unit, sqrt(sum(idf * idf)) AS z FROM di GROUP BY 1),
bh AS ({best("hi", 0, LEAST)}), bf AS ({best("di", 1, FILE_LEAST)}),
o0 AS (SELECT doc_id, path, max(score) AS score, arg_min(license, (-score, license)) AS license, sum(length(sentence)) / max(chars) AS share FROM h JOIN bh USING (unit) GROUP BY ALL),
o1 AS (SELECT doc_id, path, max(score) AS score, arg_min(license, (-score, license)) AS license, 1.0 AS share FROM d JOIN bf USING (unit) GROUP BY ALL),
o AS (SELECT * FROM o1 UNION ALL SELECT * FROM o0 WHERE NOT EXISTS (SELECT 1 FROM o1 WHERE o1.doc_id IS NOT DISTINCT FROM o0.doc_id AND o1.path IS NOT DISTINCT FROM o0.path)),
f AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license, count(*) AS n FROM o WHERE share >= {FILE_SHARE} AND path IS NOT NULL GROUP BY ALL),
g AS (SELECT dir, license FROM f QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, license) = 1),
r AS (SELECT d.unit, d.doc_id, d.path, coalesce(o.license, g.license) AS license, o.score,
             CASE WHEN o.license IS NOT NULL THEN d.path ELSE g.dir END AS license_from, length(g.dir) AS depth
      FROM d LEFT JOIN o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND d.path IS NOT DISTINCT FROM o.path
      LEFT JOIN g ON starts_with(d.path, g.dir || '/'))
SELECT doc_id, path, license, score, license_from FROM r
QUALIFY row_number() OVER (PARTITION BY unit ORDER BY depth DESC NULLS LAST) = 1
"""


ORACLE = _oracle()
