"""License scans by canonical digest lookup. Native.

A text is put in a canonical form - lower case, lines of copyright notices dropped, equivalent spellings
made one, all but letters and digits turned to single spaces - and the SHA-256 of that form is looked up
among the digests of known licences by a hash join. The whole text has to be a licence; a second column
looks up each whole line among the known one-line notices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.llm.license_digests import DIGESTS

# Equivalent spellings (the right one stands for both), after lower-casing.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("per cent", "percent"), ("https:", "http:"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("behaviour", "behavior"), ("favour", "favor"), ("fulfil ", "fulfill "), ("judgement", "judgment"),
    ("organisation", "organization"), ("recognise", "recognize"), ("authorisation", "authorization"), ("copyright owner", "copyright holder"), ("©", "(c)"), ("&", " and "),
]
# Fixed value: a line that begins so, after blanks and marks, is a copyright notice.
NOTICE = r"^[\s*#/;.\-]*(?:portions )?(?:copyright|\(c\)|all rights reserved)"

# Texts of known licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEXTS = [
    ("MIT", f"MIT License\n\n{_MIT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_NO_WARRANTY}"),
    ("MIT", f"{_MIT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_NO_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n\n{_MIT}.\n\n{_NO_WARRANTY}"),
    ("ISC", f"ISC License\n\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC}.\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD}\n{_BSD_THIRD}\n\n{_BSD_WARRANTY}"),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE),
]
# One-line notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def canonical(text: Column) -> Column:
    """The canonical form: '' for texts of copyright notices, marks and blanks only; null for null."""
    low = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), SPELLINGS, F.lower(text))
    body = F.array_join(F.filter(F.split(low, "\n", -1), lambda line: ~line.rlike(NOTICE)), " ")
    return F.trim(F.regexp_replace(body, r"[^\p{L}\p{Nd}]+", " "))


def known(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    """(license, digest), one row per digest: as many as the fixed entries."""
    rows = spark.createDataFrame(entries, "license string, text string")
    return rows.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS, notices: list[tuple[str, str]] = NOTICES, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(doc_id, text) -> (doc_id, digest, license, notices), one row per input row.

    digest is the SHA-256 of the canonical whole text (null for a null text); license the known licence
    with that digest, of the given texts or the table of digests, or null. notices are the licences of lines that are a known notice, sorted and
    joined by commas, '' if none; notices may be any lines, but blank ones are ignored. A text that is nothing but copyright lines, marks or blanks has the
    digest of '' and no licence. Repeated rows are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "text", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    # the broadcast tables hold the given entries and nothing else
    notes = _digests(spark, notices)
    lookup = F.create_map(*[x for e, name, _ in notes for x in (F.lit(e), F.lit(name))]) if notes else F.lit(None).cast("map<string,string>")
    lines = F.filter(F.split("text", "\n", -1), lambda line: _may_be(F.lower(line), [c for _, _, c in notes]))
    named = F.transform(lines, lambda line: F.element_at(lookup, F.sha2(canonical(line), 256)))
    table = spark.createDataFrame(digests, "license string, digest string")
    whole = known(spark, texts).unionByName(table).groupBy("digest").agg(F.min("license").alias("license"))
    out = base.join(F.broadcast(whole), "digest", "left")
    return out.select("doc_id", "digest", "license", F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))), ","), F.lit("")).alias("notices"))


def _digests(spark: SparkSession, entries: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(digest, license, canonical form) of each entry that isn't blank."""
    if not entries:
        return []
    rows = spark.createDataFrame(entries, "license string, text string").withColumn("form", canonical(F.col("text"))).filter("form <> ''")
    return [tuple(r) for r in rows.groupBy("form").agg(F.min("license").alias("license")).select(F.sha2("form", 256), "license", "form").orderBy("form").collect()]


def _may_be(low: Column, forms: list[str]) -> Column:
    """Whether a line, in lower case, holds all words of some canonical form that no spelling rule can have made: only such lines are digested."""
    made = [x.strip() for _, x in SPELLINGS]
    some = F.lit(False)
    for form in forms:
        sure = [w for w in set(form.split()) if not any(w in x or x in w for x in made)]
        some = some | reduce(lambda c, w: c & F.contains(low, F.lit(w)), sorted(sure, key=lambda w: (-len(w), w)), F.lit(True))
    return some


def _sql_canonical(text: str) -> str:
    low = reduce(lambda t, p: f"replace({t}, '{p[0]}', '{p[1]}')", SPELLINGS, f"lower({text})")
    return rf"trim(regexp_replace(array_to_string(list_filter(string_split({low}, chr(10)), lambda line: not regexp_matches(line, '{NOTICE}')), ' '), '[^\pL\p{{Nd}}]+', ' ', 'g'))"


def sql() -> str:
    rows = lambda entries: " union all ".join("select '" + n + "' license, '" + t.replace("'", "''") + "' text" for n, t in entries)
    return f"""
with texts as (select sha256({_sql_canonical('text')}) digest, min(license) license from ({rows(TEXTS)}) group by 1),
notices as (select sha256({_sql_canonical('text')}) digest, min(license) license from ({rows(NOTICES)}) group by 1),
lines as (select doc_id, unnest(string_split(text, chr(10))) line from documents),
found as (select doc_id, string_agg(distinct license, ',' order by license) notices from lines join notices on digest = sha256({_sql_canonical('line')}) group by 1)
select doc_id, sha256({_sql_canonical('text')}) digest, license, coalesce(notices, '') notices
from documents left join texts on texts.digest = sha256({_sql_canonical('text')}) left join found using (doc_id)"""
