"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory above.

All of it is DataFrame operations. A file is compared in units: its lines and its blocks
(between blank lines) that hold a licence word, the comment that it opens with, and its
whole text. Each different unit is compared once, by the digest of its text. Weights are
logarithmic term frequency times inverse document frequency over all units of the corpus.
The templates are one-line notices, standard headers, titles of long licences and the full
texts of short ones. A unit takes a template's licence only where both name the same
licences and versions and say so in the same way (:func:`facts`): what the cosine calls
near may be another version or another member of a family, or deny the licence. An SPDX
tag names a licence, or an expression of several, by itself. A file whose words are mostly
licence text, or whose name says so, is the licence file of its directory; files without a
licence of their own inherit from the nearest directory at or above theirs that has one,
found by joining the ancestors of each directory with the licensed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import meet, salted, spread, stored

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {thing}. If not, see http://www.gnu.org/licenses/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

# One-line notices, standard headers, titles and full texts of common licences, without quotation marks.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(thing="program", name="General Public License", version=3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format(thing="program", name="General Public License", version=2)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format(thing="library", name="Lesser General Public License", version=3)),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", _GNU.format(thing="program", name="Affero General Public License", version=3)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD.format(third=_THIRD)),
    ("BSD-2-Clause", _BSD.format(third="")),
    ("ISC", _ISC),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
)
SIGNAL = r"(?i)licen[sc]|copyright|all rights reserved|public domain|redistribution|permission"
#: An SPDX tag and its expression: identifiers, AND, OR, WITH and brackets, to the end of the line or comment.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()\t -]+)"
SPDX_ENDING = r"(?i)(-only|-or-later|\+)$"
SPDX_FORM = r"^\(*[A-Za-z0-9.+-]+\)*( (AND|OR) \(*[A-Za-z0-9.+-]+\)*| WITH [A-Za-z0-9.+-]+\)*)*$"
# Words that name a licence or a member of its family, and short names of several words.
NAMED = "apache mit isc bsd mozilla mpl gnu gpl lgpl agpl lesser affero cc cc0 by nc sa nd eclipse epl boost bsl artistic zlib python cddl eupl wtfpl unlicense unlicensed proprietary ofl psf".split()
SYNONYMS = {"gpl": "gnu", "lgpl": "lesser", "agpl": "affero", "mpl": "mozilla", "epl": "eclipse", "bsl": "boost"}
#: Words before "license" that name none, and words between a name and "license".
PLAIN = "a above accompanying all an and any any applicable appropriate as by clause copy following for free in its mit of open or other our permissive same source standard such terms that the this under with your".split()
BETWEEN = "public software documentation general".split()
#: Words behind which a number is a version, and words that deny with one of these close behind.
BEFORE_VERSION = "version v ver license licence public apache gnu gpl lgpl agpl mpl epl cddl eupl lesser affero mozilla eclipse boost bsl artistic by nc sa nd cc0 bsd".split()
DENIES, DENIED = "not never nor isn aren wasn".split(), "licensed licenced released distributed available covered offered under mit apache gpl".split()
#: What stands between blocks: a blank line, or one with a comment mark only.
BLANK = r"\n[ \t]*[#*;%/-]*[ \t]*\n"
#: The comment and blank lines that a file opens with.
HEADER = r"^(?:[ \t]*(?:(?://|#|/\*|\*|;|--|<!--|%)[^\n]*)?\n)+"
NAMES = r"(?i)(^|/)(licen[sc]e|copying|notice)([.-][^/]*)?$"
#: Cosine that a unit must reach, in thousandths.
MIN_COSINE = 600


def _tokens(text: str) -> str:
    return rf"filter(split(lower({text}), '[^a-z0-9.]+', -1), x -> x rlike '[a-z0-9]')"


def _cleaned(tokens: str) -> str:
    return f"transform({tokens}, x -> rtrim('.', x))"


def _parted(text: str) -> str:
    """A text with short names parted from the version that follows them."""
    return f"regexp_replace(lower({text}), '(gpl|mpl|apache|epl)v?([0-9])', '$1 $2')"


def _slashed(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def _listed(words: list[str], sql: bool) -> str:
    return ("[{}]" if sql else "array({})").format(", ".join(f"'{w}'" for w in words))


def facts(tokens: str, sql: bool = False) -> str:
    """An expression for what a text says of licences, from its tokens: the names in it, their versions, and whether it denies one.

    Names are known words and whatever else stands before "license"; a version is a number
    behind a name or the word version. The same in Spark's SQL and, with ``sql``, DuckDB's.
    """
    held = (lambda x, words: f"list_contains({_listed(words, True)}, {x})") if sql else (lambda x, words: f"array_contains({_listed(words, False)}, {x})")
    at = (lambda k: f"{tokens}[{k}]") if sql else (lambda k: f"try_element_at({tokens}, greatest(1, {k}))")
    n = f"len({tokens})" if sql else f"size({tokens})"
    places = f"generate_series(1, {n})" if sql else f"CASE WHEN {n} > 0 THEN sequence(1, {n}) ELSE array() END"
    each = (lambda e: f"list_transform({places}, lambda k: {e})") if sql else (lambda e: f"transform({places}, k -> {e})")
    like = (lambda x, rx: f"regexp_matches({x}, '{rx}')") if sql else (lambda x, rx: f"{x} rlike '{rx}'")
    own = at("k")
    same = "CASE " + " ".join(f"WHEN {own} = '{a}' THEN '{b}'" for a, b in SYNONYMS.items()) + f" ELSE {own} END"
    before = f"CASE WHEN {held(at('k - 1'), BETWEEN)} THEN {at('k - 2')} ELSE {at('k - 1')} END"
    licence = f"{own} IN ('license', 'licence') AND k > 1"
    named = f"CASE WHEN {held(own, NAMED)} AND NOT ({own} IN ('by', 'sa', 'nc', 'nd') AND NOT coalesce({held(at('k - 1'), ['cc', 'by', 'nc', 'sa', 'nd'])}, false)) THEN {same} WHEN {licence} AND NOT coalesce({held(before, PLAIN + BETWEEN + NAMED)}, true) THEN {before} END"
    trunc = f"regexp_replace({own}, '^v|([.]0)+$', '', 'g')" if sql else f"regexp_replace({own}, '^v|([.]0)+$', '')"
    version = f"CASE WHEN k > 1 AND {like(own, '^v?[0-9]+([.][0-9]+)*$')} AND ({held(at('k - 1'), BEFORE_VERSION)} OR coalesce({at('k + 1')}, '') = 'clause') THEN {trunc} END"
    near = " OR ".join(f"coalesce({held(at(f'k + {j}'), DENIED)}, false)" for j in (1, 2, 3, 4))
    denies = f"CASE WHEN {held(own, DENIES)} AND ({near}) THEN 'no' END"
    if sql:
        one = lambda e: f"array_to_string(list_sort(list_distinct(list_filter({each(e)}, lambda x: x IS NOT NULL))), ' ')"
    else:
        one = lambda e: f"array_join(array_sort(array_distinct(filter({each(e)}, x -> x IS NOT NULL))), ' ')"
    return f"concat({one(named)}, '/', {one(version)}, '/', {one(denies)})"


def spdx_name(expression: Column, known: list[str]) -> Column:
    """An SPDX expression with known licences by their own names, or null where it isn't one or names an unknown licence."""
    flat = F.trim(F.regexp_replace(expression, r"[ \t]+", " "))
    tokens = F.split(flat, " ")
    names = F.create_map(*[x for name in known for x in (F.lit(name.lower()), F.lit(name))])
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, "[()]", ""), SPDX_ENDING, "")
    word = lambda x: F.upper(x).isin("AND", "OR", "WITH")
    own = lambda x, k: F.when(word(x), F.upper(x)).when(F.upper(F.get(tokens, k - 1)) == "WITH", x).otherwise(F.concat(F.regexp_extract(x, r"^\(*", 0), names[F.lower(bare(x))], F.regexp_extract(x, r"\)*$", 0)))
    mapped = F.transform(tokens, own)
    whole = F.array_join(mapped, " ")
    fits = (F.size(F.filter(mapped, lambda x: x.isNull())) == 0) & whole.rlike(SPDX_FORM) & (F.length(F.replace(whole, F.lit("("), F.lit(""))) == F.length(F.replace(whole, F.lit(")"), F.lit(""))))
    return F.when(fits, F.regexp_replace(whole, r"^\(([^()]*)\)$", "$1"))


def match_units(units: DataFrame, templates: DataFrame) -> DataFrame:
    """unit, license, cosine (thousandths): the best template of each ``unit``, where it reaches ``MIN_COSINE`` and says the same.

    ``units`` has unit (a digest), body (its text) and n, how often it occurs. Ties go to
    the first licence by name. A unit with an SPDX tag takes what the tag names, or nothing.
    """
    counted = units.select("unit", "n", F.explode(F.expr(_cleaned(_tokens("body")))).alias("w")).groupBy("unit", "w").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    counted = stored(counted)
    total = float(units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rows = counted.count()
    df = stored(counted.groupBy("w").agg(F.sum("n").alias("df"), F.count("*").alias("n")))
    terms = templates.withColumn("w", F.explode(F.expr(_cleaned(_tokens("text"))))).groupBy("template", "license", "w").agg(F.count("*").alias("tf"))
    idf = F.log((1.0 + F.lit(total)) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    weight = (1.0 + F.log("tf")) * idf
    own = meet(counted.drop("n"), df, "w", rows).select("unit", "w", weight.alias("x"))
    given = terms.join(df, "w", "left").select("template", "license", "w", weight.alias("y"))
    sides = given.groupBy("template").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("side"))
    norms = own.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    # as large as the templates
    pairs = own.join(F.broadcast(given), "w")
    dots = pairs.groupBy("unit", "template", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot")).join(norms, "unit").join(F.broadcast(sides), "template")
    near = dots.select("unit", "template", "license", F.round(1000 * F.col("dot") / (F.col("norm") * F.col("side"))).cast("int").alias("cosine")).where(F.col("cosine") >= MIN_COSINE)
    near = stored(near)
    # an array of one, so that the tokens are made once and not for each place
    said = lambda df, text: df.withColumn("facts", F.expr(f"transform(array(struct({_cleaned(_tokens(_parted(text)))} AS w)), s -> {facts('s.w')})[0]"))
    # stored, so that only what is near a template is looked at
    bodies = stored(said(units.join(near.select("unit").distinct(), "unit").select("unit", "body"), "body").select("unit", F.col("facts").alias("own_facts")))
    near = near.join(bodies, "unit").join(F.broadcast(said(templates, "text").select("template", "facts")), "template").where("facts = own_facts")
    tagged = units.select("unit", F.regexp_extract("body", SPDX, 1).alias("tag")).where("tag <> ''")
    known = [r.license for r in templates.select("license").distinct().collect()]  # as many as there are templates
    named = tagged.select("unit", spdx_name(F.col("tag"), sorted(known)).alias("license"), F.lit(1000).alias("cosine")).where("license IS NOT NULL")
    best = near.select("unit", "license", "cosine").join(tagged.select("unit"), "unit", "left_anti").unionByName(named).groupBy("unit").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("unit", "b.license", (-F.col("b.c")).alias("cosine"))


def template_table(spark: SparkSession) -> DataFrame:
    """template (a number), license and text of the built-in templates."""
    rows = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, license, text)")


def scan_licenses(files: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """id, path, license, cosine, via (own, inherited, none) and from_dir for every row of ``files`` (id, path, text).

    A null or empty text has no units; a null path has no directory and inherits
    nothing. Of several units of a file, and of several licence files in a directory, the
    best cosine counts, then the first licence by name. Repeated rows get repeated results;
    an empty table gives an empty one; further columns are ignored.
    """
    spark = files.sparkSession
    templates = template_table(spark) if templates is None else templates
    files = files.select("id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    signal = f"x -> x rlike '{SIGNAL}'"
    lines, blocks = (f"filter(split(text, '{_slashed(cut)}', -1), {signal})" for cut in (r"\n", BLANK))
    every = f"concat({lines}, {blocks}, filter(array(regexp_extract(text, '{_slashed(HEADER)}', 0), text), {signal}))"
    heads = F.expr(f"CASE WHEN text rlike '{SIGNAL}' THEN array_distinct({every}) ELSE array() END")
    words = lambda c: F.size(F.filter(F.split(c, r"\s+", -1), lambda x: x != ""))
    rows = files.select("id", "path", directory.alias("dir"), F.coalesce(heads, F.array().cast("array<string>")).alias("heads"), words(F.coalesce("text", F.lit(""))).alias("words"), F.coalesce(F.col("path").rlike(NAMES), F.lit(False)).alias("named"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    bodies = rows.select("row", "dir", "words", "named", F.explode("heads").alias("body")).withColumns({"unit": F.md5(F.col("body").cast("binary")), "held": words(F.col("body"))})
    different = stored(bodies.groupBy("unit").agg(F.count("*").alias("n"), F.first("body").alias("body")))
    matched = stored(match_units(different, templates))
    hits = salted(bodies.drop("body"), "row").join(spread(matched), ["unit", "salt"])  # the commonest unit's rows are spread
    best = hits.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"), F.sum("held").alias("held"), F.first("words").alias("words"), F.first("named").alias("named"), F.first("dir").alias("dir"))
    own = stored(best.select("row", "dir", F.col("b.license").alias("own"), (-F.col("b.c")).alias("own_cosine"), (F.col("named") | (2 * F.col("held") >= F.col("words"))).alias("whole")))
    per_dir = own.where("whole AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), "own")).alias("b")).select(F.col("dir").alias("above"), F.col("b.own").alias("given"), (-F.col("b.c")).alias("given_cosine"))
    dirs = rows.where("dir IS NOT NULL").select("dir").distinct()
    parts = "split(dir, '/', -1)"
    ups = dirs.withColumn("above", F.explode(F.expr(f"CASE WHEN dir = '' THEN array('') ELSE concat(array(''), transform(sequence(1, size({parts})), k -> array_join(slice({parts}, 1, k), '/'))) END")))
    met = salted(ups, "dir").join(spread(per_dir), ["above", "salt"])  # all directories lie below the root
    nearest = met.groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "given", "given_cosine")).alias("m")).select("dir", F.col("m.above").alias("above"), F.col("m.given").alias("given"), F.col("m.given_cosine").alias("given_cosine"))
    nearest = stored(nearest)
    joined = rows.select("row", "id", "path", "dir").join(own.select("row", "own", "own_cosine"), "row", "left").join(nearest, "dir", "left")
    via = F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        "id", "path", F.coalesce("own", "given").alias("license"), F.coalesce("own_cosine", "given_cosine", F.lit(0)).alias("cosine"), via.alias("via"), F.when(F.col("own").isNull(), F.col("above")).alias("from_dir")
    )



def scan_documents(documents: DataFrame) -> DataFrame:
    """The licences of the documents table, one row a document."""
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(documents.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")


_VALUES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
SQL = rf"""
    WITH templates(template, license, text) AS (VALUES {_VALUES}),
    files AS (
        SELECT doc_id, source || '/' || (doc_id // 1000)::VARCHAR || '/' || (doc_id // 100)::VARCHAR AS dir, text,
               source || '/' || (doc_id // 1000)::VARCHAR || '/' || (doc_id // 100)::VARCHAR || '/' || doc_id::VARCHAR || '.txt' AS path,
               len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS words
        FROM documents),
    units AS (
        SELECT doc_id, dir, words, unnest(list_distinct(list_filter(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '{BLANK}'), [regexp_extract(text, '{HEADER}', 0), text]), lambda x: regexp_matches(x, '{SIGNAL}')))) AS unit
        FROM files WHERE regexp_matches(text, '{SIGNAL}')),
    different AS (SELECT unit, count(*) AS n FROM units GROUP BY unit),
    total AS (SELECT sum(n)::DOUBLE AS total FROM different),
    counted AS (SELECT unit, w, count(*) AS tf, any_value(n) AS n FROM (
        SELECT unit, n, rtrim(unnest(list_filter(regexp_split_to_array(lower(unit), '[^a-z0-9.]+'), lambda x: regexp_matches(x, '[a-z0-9]'))), '.') AS w FROM different) GROUP BY unit, w),
    df AS (SELECT w, sum(n) AS df FROM counted GROUP BY w),
    terms AS (SELECT template, license, w, count(*) AS tf FROM (
        SELECT template, license, rtrim(unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9.]+'), lambda x: regexp_matches(x, '[a-z0-9]'))), '.') AS w FROM templates) GROUP BY ALL),
    own AS (SELECT unit, w, (1 + ln(tf)) * (ln((1 + total) / (1.0::DOUBLE + coalesce(df, 0))) + 1) AS x FROM counted LEFT JOIN df USING (w), total),
    given AS (SELECT template, license, w, (1 + ln(tf)) * (ln((1 + coalesce(total, 0)) / (1.0::DOUBLE + coalesce(df, 0))) + 1) AS y FROM terms LEFT JOIN df USING (w), total),
    norms AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM own GROUP BY unit),
    sides AS (SELECT template, sqrt(sum(y * y)) AS side FROM given GROUP BY template),
    tagged AS (SELECT unit, regexp_replace(lower(trim(regexp_extract(unit, '{SPDX}', 1))), '{SPDX_ENDING}', '') AS tag FROM different WHERE regexp_matches(unit, '{SPDX}')),
    close AS (
        SELECT unit, template, license, round(1000 * dot / (norm * side))::INTEGER AS cosine
        FROM (SELECT unit, template, license, sum(x * y) AS dot FROM own JOIN given USING (w) GROUP BY ALL) JOIN norms USING (unit) JOIN sides USING (template)),
    said AS (SELECT body, {facts("w", True)} AS facts FROM (
        SELECT body, list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(body), '(gpl|mpl|apache|epl)v?([0-9])', '\1 \2', 'g'), '[^a-z0-9.]+'), lambda x: regexp_matches(x, '[a-z0-9]')), lambda x: rtrim(x, '.')) AS w
        FROM (SELECT DISTINCT unit AS body FROM close WHERE cosine >= {MIN_COSINE} UNION SELECT text FROM templates))),
    near AS (
        SELECT unit, c.license, cosine FROM close c JOIN templates t USING (template) JOIN said a ON a.body = c.unit JOIN said b ON b.body = t.text
        WHERE cosine >= {MIN_COSINE} AND a.facts = b.facts AND unit NOT IN (SELECT unit FROM tagged)
        UNION ALL SELECT DISTINCT unit, license, 1000 FROM tagged JOIN templates ON lower(license) = tag),
    matched AS (SELECT unit, license, cosine FROM near WHERE cosine >= {MIN_COSINE} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, license) = 1),
    hits AS (SELECT doc_id, dir, words, license, cosine, len(list_filter(regexp_split_to_array(unit, '\s+'), lambda x: x <> '')) AS held FROM units JOIN matched USING (unit)),
    licensed AS (
        SELECT doc_id, any_value(dir) AS dir, min(struct_pack(c := -cosine, l := license)) AS b, 2 * sum(held) >= any_value(words) AS whole FROM hits GROUP BY doc_id),
    per_dir AS (SELECT dir AS above, min(b) AS b FROM licensed WHERE whole GROUP BY dir),
    ups AS (
        SELECT DISTINCT dir, unnest(['', split_part(dir, '/', 1), split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2), dir]) AS above FROM files),
    nearest AS (SELECT dir, above, b FROM ups JOIN per_dir USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1)
    SELECT f.doc_id, f.path, coalesce(l.b.l, n.b.l) AS license, coalesce(-l.b.c, -n.b.c, 0) AS cosine,
           CASE WHEN l.doc_id IS NOT NULL THEN 'own' WHEN n.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS via,
           CASE WHEN l.doc_id IS NULL THEN n.above END AS from_dir
    FROM files f LEFT JOIN licensed l USING (doc_id) LEFT JOIN nearest n ON n.dir = f.dir
"""
