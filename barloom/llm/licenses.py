"""License scan with DataFrame functions only: statements and licence files against templates, then inheritance.

Statements are the lines of a text that speak of a licence; a file that is a licence file by its name, or whose words
are mostly statements, also declares for its directory. Term vectors are sparse rows (passage, term, weight); their cosine to a
template is a join on terms and a sum. A file without a licence of its own takes that of the nearest directory above
it that has one, by joins on paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import left_join_hot, n_words
from barloom.sources.stage import stage

#: Public notices by which licences are declared, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike."),
    ("CC0-1.0", "CC0 1.0 Universal, dedicated to the public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License. Permission is hereby granted, free of charge."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_WARRANTY = "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
_FREE = "you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed " + _WARRANTY + " See the GNU {0} General Public License for more details. You should have received a copy of the GNU {0} General Public License along with this program. If not, see https://www.gnu.org/licenses/."
_ASIS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Texts of many lines: file headers, and the licences short enough to be a file of their own.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD + _ASIS),
    ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _ASIS),
    ("GPL-2.0-or-later", "This program is free software; " + _FREE.format("", "2")),
    ("GPL-3.0-or-later", "This program is free software: " + _FREE.format("", "3")),
    ("LGPL-3.0-or-later", "This library is free software: " + _FREE.format("Lesser", "3")),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Titles at the head of licence texts that are files of many pages: a paragraph of its own there.
TITLES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
_ID = r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"
#: A licence by an expression of identifiers: SPDX-License-Identifier: MIT OR Apache-2.0.
SPDX = rf"(?i)spdx-license-identifier:[ \t]*(\(*{_ID}\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*{_ID}\)*)*)"
#: Identifiers in use, in lower case; others are no licence, but for those that a project names by LicenseRef-.
IDENTIFIERS = """0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause
bsd-2-clause bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0
cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3-only
gfdl-1.3-or-later gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later isc lgpl-2.0-only
lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl
ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 ruby unicode-3.0 unlicense upl-1.0 vim
w3c wtfpl x11 zlib zpl-2.1""".split()
#: A statement that denies the licence it names.
DENIED = r"(?i)\bnot\s+(?:be\s+)?(?:licen[cs]ed|released|covered|distributed|available)\b"
#: A line with one of these is a statement.
CUE = r"(?i)licen[cs]e|copyright|spdx|permission is hereby|redistribution and use|public domain"
#: File names that make a licence file.
NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
LEAST = 0.6
#: A file is a licence file if statements have at least this share of its words.
SHARE = 0.5


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))


def _counts(passages: DataFrame, key: str) -> DataFrame:
    terms = passages.select(key, F.explode(_terms(F.col("passage"))).alias("term"))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def template_rows(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template long, license string, passage string")


def statements(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, passage: every distinct line with a cue that denies nothing, of whole texts; for licence files by name also the whole text."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(CUE) & ~x.rlike(DENIED))
    whole = F.when(F.coalesce(F.col(path).rlike(NAMED), F.lit(False)), F.array(F.coalesce(F.col(text), F.lit("")))).otherwise(F.array().cast("array<string>"))
    some = files.filter(F.col(text).rlike(CUE) | F.col(path).rlike(NAMED))
    return some.select(F.col(path).alias("path"), F.explode(F.array_distinct(F.concat(lines, whole))).alias("passage"))


def match(passages: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """passage, license, cosine of distinct passages to their best template (ties: first licence in order).

    Document frequencies count distinct passages of the whole corpus and the templates. Terms outside the templates weigh
    in a passage's length, not in the product. A frequent passage is one row here, however many files have it.
    """
    one = passages.select("passage").distinct().withColumn("id", F.xxhash64("passage"))
    tf = stage(_counts(one, "id"), "license-terms")
    tt = stage(_counts(templates, "template"), "license-templates")
    both = tf.select("term").unionByName(tt.select("term"))
    total = tf.select("id").distinct().count() + tt.select("template").distinct().count()
    idf = both.groupBy("term").agg((F.log((F.lit(float(total)) + 1) / (F.count(F.lit(1)) + 1)) + 1).alias("idf"))
    idf = stage(idf, "license-idf")
    v = stage(tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w")), "license-vectors")
    t = tt.join(idf, "term").select("template", "term", (F.col("tf") * F.col("idf")).alias("x"))
    t = t.join(templates.select("template", "license"), "template")
    norms, tnorms = v.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nw")), t.groupBy("template").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"))
    t = t.join(tnorms, "template")  # a table of constants, of the templates' size
    dots = v.join(F.broadcast(t), "term").groupBy("id", "template", "license", "nx").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("nw") * F.col("nx")), 6)
    scored = dots.join(norms, "id").select("id", "license", cosine.alias("cosine")).filter(F.col("cosine") >= least)
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("m"), "license")).alias("b"))
    return one.join(best, "id").select("passage", F.col("b.license").alias("license"), (-F.col("b.m")).alias("cosine"))


def blocks(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, passage: paragraphs of several lines with a cue, and whole texts with a cue that are not much longer than a licence."""
    whole = F.coalesce(F.col(text), F.lit(""))
    some = F.filter(F.split(whole, r"\n[ \t\r]*\n"), lambda x: x.rlike(CUE) & ~x.rlike(DENIED) & x.contains("\n"))
    full = F.when(F.col(path).rlike(NAMED) | (n_words(whole) <= 2 * max(len(t.split()) for _, t in HEADERS)), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return files.filter(F.col(text).rlike(CUE)).select(F.col(path).alias("path"), F.explode(F.array_distinct(F.concat(some, full))).alias("passage"))


def identified(files: DataFrame) -> DataFrame:
    """path, license of files (path, text) with SPDX expressions of known identifiers: as written, several joined by AND."""
    said = F.array_distinct(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)))
    known = [F.lit(x) for x in IDENTIFIERS]

    def valid(said: Column) -> Column:
        ids = F.regexp_extract_all(F.regexp_replace(F.lower(said), rf"[ \t]+with[ \t]+{_ID}", ""), F.lit(_ID), F.lit(0))
        return F.forall(ids, lambda x: x.isin("and", "or") | F.array_contains(F.array(*known), F.rtrim(x, F.lit("+"))) | x.startswith("licenseref-"))

    def inside(said: Column) -> Column:
        return F.when(F.lower(said).contains(" or "), F.concat(F.lit("("), said, F.lit(")"))).otherwise(said)

    found = files.filter(F.col("text").rlike(SPDX)).select("path", F.filter(said, valid).alias("said")).filter(F.size("said") > 0)
    whole = F.when(F.size("said") == 1, F.element_at("said", 1)).otherwise(F.array_join(F.transform("said", inside), " AND "))
    return found.select("path", whole.alias("license"))


def long_forms(files: DataFrame, least: float) -> DataFrame:
    """path, own_license, cosine, said of files with a block like one of HEADERS or TITLES.

    A null text has none; the best cosine counts, then the first licence in order; no rows give no rows.
    """
    found = stage(blocks(files), "license-blocks")
    rated = match(found, template_rows(files.sparkSession, HEADERS + TITLES), least)
    counts = found.groupBy("passage").agg(F.count(F.lit(1)).alias("n")).join(rated, "passage")
    like = left_join_hot(found, counts, "passage", "n", found.count(), F.xxhash64("path")).filter(F.col("license").isNotNull())
    every = like.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("m"), "license")).alias("b"), F.max(n_words(F.col("passage"))).alias("said"))
    return every.select("path", F.col("b.license").alias("own_license"), (-F.col("b.m")).alias("cosine"), "said")


def ancestors(path: Column) -> Column:
    """All directories of a path, nearest first: /a/b/c -> /a/b, /a, /."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.when(k == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), k), "/")))


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST, path: str = "path", text: str = "text") -> DataFrame:
    """path, own_license, cosine, license, inherited_from and n_words of every file; one row per input row.

    ``license`` is the file's own, else that of the nearest directory above it with a licence file (the best cosine,
    then first licence in order, then first path), else null. Null texts have no licence of their own and inherit; a null
    path has no directory and nothing to inherit; repeated rows are judged alike; no rows give no rows.
    """
    spark = files.sparkSession
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    said = stage(statements(rows), "license-statements")
    rated = match(said, template_rows(spark, templates or TEMPLATES), least)
    # a statement that a third of all files share is joined as a hot key
    counts = said.groupBy("passage").agg(F.count(F.lit(1)).alias("n")).join(rated, "passage")
    hits = left_join_hot(said, counts, "passage", "n", said.count(), F.xxhash64("path")).filter(F.col("license").isNotNull())
    words = n_words(F.col("passage"))
    per_file = hits.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("m"), "license")).alias("b"), F.sum(words).alias("said"))
    short = stage(per_file.select("path", F.col("b.license").alias("own_license"), (-F.col("b.m")).alias("cosine"), "said"), "license-short")
    # an identifier goes before a notice; files with neither: headers, licence texts and their titles
    ids = stage(identified(rows), "license-ids").groupBy("path").agg(F.min("license").alias("id"))
    stated = short.join(ids, "path", "full").select(
        "path", F.coalesce("id", "own_license").alias("own_license"), F.when(F.col("id").isNotNull(), F.lit(1.0)).otherwise(F.col("cosine")).alias("cosine"),
        (F.coalesce("said", F.lit(0)) + F.when(F.col("id").isNotNull(), F.lit(2)).otherwise(F.lit(0))).alias("said"))
    stated = stage(stated, "license-stated")
    own = stage(stated.unionByName(long_forms(rows, least).join(stated.select("path"), "path", "left_anti")), "license-own")
    sizes = rows.select("path", n_words(F.col("text")).alias("n_words"), F.element_at(ancestors(F.col("path")), 1).alias("dir"))
    judged = stage(sizes.join(own, "path", "left"), "license-files")
    declares = F.col("own_license").isNotNull() & (F.col("path").rlike(NAMED) | (F.col("said") >= SHARE * F.col("n_words")))
    dirs = judged.filter(declares).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("m"), "own_license", "path")).alias("b"))
    dirs = stage(dirs.select(F.col("dir").alias("up"), F.col("b.own_license").alias("dir_license"), F.col("b.path").alias("from")), "license-dirs")
    # directories first, each once; files then join their own directory
    places = judged.filter(F.col("dir").isNotNull()).groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    chain = places.select("dir", F.posexplode(F.concat(F.array("dir"), ancestors(F.col("dir")))).alias("far", "up"))
    nearest = chain.join(dirs, "up").groupBy("dir").agg(F.min(F.struct("far", "dir_license", "from")).alias("d"))
    known = places.join(nearest, "dir").select("dir", "n", "d.dir_license", "d.from")
    out = left_join_hot(judged, known, "dir", "n", judged.count(), F.xxhash64("path"))
    from_dir = F.col("own_license").isNull() & F.col("dir_license").isNotNull()
    return out.select("path", "own_license", "cosine", F.coalesce("own_license", "dir_license").alias("license"), F.when(from_dir, F.col("from")).alias("inherited_from"), "n_words")


def oracle() -> str:
    """The scan of documents as files /source/lang/doc_id, as SQL."""
    values = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TEMPLATES))
    known = ", ".join(f"'{x}'" for x in IDENTIFIERS)
    return rf"""
WITH files AS (
  SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', '', source, lang, doc_id::VARCHAR) AS path,
         concat_ws('/', '', source, lang) AS dir0 FROM documents),
f AS (SELECT *, CASE WHEN dir0 = '' THEN '/' ELSE dir0 END AS dir, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words FROM files),
said AS (
  SELECT DISTINCT path, l AS passage FROM (SELECT path, unnest(string_split(text, chr(10))) AS l FROM f)
  WHERE regexp_matches(l, '{CUE[4:]}', 'i') AND NOT regexp_matches(l, '{DENIED[4:]}', 'i')),
t(template, license, passage) AS (VALUES {values}),
terms AS (
  SELECT passage, term, count(*) AS tf
  FROM (SELECT passage, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+(?:\.[0-9]+)*')) AS term FROM (SELECT DISTINCT passage FROM said))
  GROUP BY ALL),
tt AS (
  SELECT template, license, term, count(*) AS tf
  FROM (SELECT template, license, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+(?:\.[0-9]+)*')) AS term FROM t) GROUP BY ALL),
n AS (SELECT (SELECT count(DISTINCT passage) FROM terms) + (SELECT count(DISTINCT template) FROM tt) AS n),
idf AS (
  SELECT term, ln((n + 1.0) / (count(*) + 1)) + 1 AS idf
  FROM (SELECT term FROM terms UNION ALL SELECT term FROM tt), n GROUP BY term, n),
v AS (SELECT passage, term, tf * idf AS w FROM terms JOIN idf USING (term)),
x AS (SELECT template, license, term, tf * idf AS x FROM tt JOIN idf USING (term)),
nv AS (SELECT passage, sqrt(sum(w * w)) AS nw FROM v GROUP BY passage),
nx AS (SELECT template, sqrt(sum(x * x)) AS nx FROM x GROUP BY template),
c AS (
  SELECT passage, license, round(sum(w * x) / (nw * nx), 6) AS cosine
  FROM v JOIN x USING (term) JOIN nv USING (passage) JOIN nx USING (template) GROUP BY passage, template, license, nw, nx),
best AS (
  SELECT passage, license, cosine FROM c WHERE cosine >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY passage ORDER BY cosine DESC, license) = 1),
hit AS (SELECT path, license, cosine, len(regexp_extract_all(passage, '[^\x20\x09-\x0D]+')) AS k FROM said JOIN best USING (passage)),
noticed AS (
  SELECT path, license AS own_license, cosine, sum(k) OVER (PARTITION BY path) AS said FROM hit
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, license) = 1),
spdx AS (SELECT path, unnest(e) AS expr, generate_subscripts(e, 1) AS nth FROM (SELECT path, regexp_extract_all(text, '{SPDX[4:]}', 1, 'i') AS e FROM f)),
ids AS (SELECT path, expr, nth, unnest(regexp_extract_all(regexp_replace(lower(expr), '[ \t]+with[ \t]+{_ID}', '', 'g'), '{_ID}')) AS id FROM spdx),
valid AS (
  SELECT path, expr, min(nth) AS nth FROM ids GROUP BY path, expr
  HAVING bool_and(id IN ('and', 'or', {known}) OR rtrim(id, '+') IN ({known}) OR starts_with(id, 'licenseref-'))),
named AS (
  SELECT path, CASE WHEN count(*) = 1 THEN min(expr)
    ELSE string_agg(CASE WHEN contains(lower(expr), ' or ') THEN '(' || expr || ')' ELSE expr END, ' AND ' ORDER BY nth) END AS id
  FROM valid GROUP BY path),
own AS (
  SELECT path, coalesce(id, own_license) AS own_license, CASE WHEN id IS NULL THEN cosine ELSE 1 END AS cosine,
         coalesce(said, 0) + CASE WHEN id IS NULL THEN 0 ELSE 2 END AS said
  FROM noticed FULL JOIN named USING (path)),
j AS (SELECT * FROM f LEFT JOIN own USING (path)),
dirs AS (
  SELECT dir AS up, own_license AS dir_license, path AS from_path FROM j WHERE own_license IS NOT NULL AND said >= {SHARE} * n_words
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, own_license, path) = 1),
near AS (
  SELECT dir, dir_license, from_path FROM (SELECT DISTINCT dir FROM j) JOIN dirs ON dir = up OR starts_with(dir, up || '/') OR up = '/'
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1)
SELECT doc_id, own_license, cosine, coalesce(own_license, dir_license) AS license,
       CASE WHEN own_license IS NULL THEN from_path END AS inherited_from, n_words::BIGINT AS n_words
FROM j LEFT JOIN near USING (dir)
"""
