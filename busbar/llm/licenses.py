"""Licence scans by canonical digest lookup, in built-in functions only.

A text is brought to a canonical form (copyright lines dropped, A-Z lower-cased,
equivalent spellings made one, everything but letters and digits a single space)
and its digest is looked up among the digests of known licence texts with a hash
join. What is looked up are entire texts: the whole document, every line of it
that speaks of a licence, up to RUN_LINES lines over which a notice may be wrapped,
and inside a longer document every run of lines that begins like a known licence
text and has its number of words.
"""

from __future__ import annotations

import hashlib
import re
import textwrap
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Names by which notices call a licence, under its SPDX identifier.
NAMES = {
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC0-1.0": ["Creative Commons Zero v1.0 Universal", "CC0 1.0", "CC0", "CC0-1.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "ISC": ["ISC License", "ISC"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3", "LGPL-3.0"],
    "MIT": ["MIT License", "Expat License", "MIT"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License", "Zlib"],
}
# Sentences with which a notice names its licence.
NOTICES = [
    "This work is licensed under {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}.",
    "This software is licensed under the {}.",
    "This project is licensed under the {}.",
    "This software is released under the {}.",
    "Licensed under {}.",
    "Licensed under the {}.",
    "Released under {}.",
    "Released under the {}.",
    "Distributed under the {}.",
    "Available under the {}.",
    "License: {}",
    "SPDX-License-Identifier: {}",
]
# Short licence texts, without title and copyright line; the long ones are the files of FILES.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a
source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT
HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
# Long licence texts, each in a file of `license_texts` as it was published.
FILES = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
#: The last line of the terms; what follows them, on how to apply them, is often left out.
_TERMS_END = re.compile(r"^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$", re.M)
#: Widths at which short texts may be wrapped: a line that begins with "copyright" is dropped from the canonical form.
WIDTHS = range(50, 133)
# Spellings that count as equal, as words of the canonical form.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "and or": "or",
    "copyright owner": "copyright holder",
    "favour": "favor",
    "fulfil": "fulfill",
    "https": "http",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "merchantibility": "merchantability",
    "non commercial": "noncommercial",
    "non infringement": "noninfringement",
    "organisation": "organization",
    "share alike": "sharealike",
    "sub license": "sublicense",
    "while": "whilst",
}

#: A line with one of these, lower-cased, is looked up as a text of its own.
ANCHOR = "licen[cs]e|spdx|released under|distributed under|available under"
#: A notice may be wrapped over so many lines.
RUN_LINES = 4
#: Documents, and first lines, that a wrapped notice may be in, lower-cased.
_RUN_GUARD = "licen[cs]e|spdx|released|distributed|available"
_RUN_HEAD = r"^[^0-9a-z]*(this|licen[cs]ed?|released|distributed|available|spdx)([^0-9a-z]|$)"
#: Words by which the beginning of a known text is recognised inside a document.
HEAD_WORDS = 6
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_COPYRIGHT = r"(^|\n)[^0-9a-z\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
_ANY_COPYRIGHT = r"copyright|\(c\)|©|all rights reserved"
_MARKS = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
_VERSION = " (?:version |v)([0-9])"
_ANY_SPELLING = " (?:" + "|".join(SPELLINGS) + ") "


def canonical(text: str) -> str:
    """The canonical form of one text, for the table of known texts."""
    text = re.sub(_COPYRIGHT, r"\1 ", text.translate(str.maketrans(_UPPER, _LOWER)))
    text = " " + re.sub("[^0-9a-z\x80-\U0010ffff]+", " ", text).strip(" ") + " "
    text = re.sub(_VERSION, r" \1", text)
    for one, other in SPELLINGS.items():
        text = text.replace(f" {one} ", f" {other} ")
    return text.strip(" ")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _layouts(text: str) -> list[str]:
    """A text as it stands, with one line for each paragraph, and if it is short at every usual width."""
    paragraphs = [" ".join(x.split()) for x in re.split(r"\n[ \t]*\n", text)]
    widths = WIDTHS if len(text) < 4000 else []
    return [text, "\n\n".join(paragraphs), *("\n\n".join(textwrap.fill(x, w) for x in paragraphs) for w in widths)]


@cache
def whole_texts() -> dict[str, str]:
    """SPDX identifier of every whole licence text without a title added, by canonical form."""
    texts = list(TEXTS.items())
    folder = resources.files(__package__) / "license_texts"
    for spdx in FILES:
        text = (folder / f"{spdx}.txt").read_text("utf-8")
        texts.append((spdx, text))
        if end := _TERMS_END.search(text):
            texts += [(spdx, text[: end.start()]), (spdx, text[: end.end()])]
    # Clauses are numbered or have bullets.
    texts += [(spdx, re.sub(r"^[0-9]\. ", "* ", text, flags=re.M)) for spdx, text in TEXTS.items() if spdx.startswith("BSD")]
    return {canonical(x): spdx for spdx, text in texts for x in _layouts(text)}


def known_texts() -> dict[str, str]:
    """SPDX identifier of every known text, by canonical form: notices from their rule, and whole licences."""
    found: dict[str, str] = {}
    for spdx, names in NAMES.items():
        for name in [*names, spdx]:
            for notice in NOTICES:
                found.setdefault(canonical(notice.format(name)), spdx)
    for form, spdx in whole_texts().items():
        found[form] = spdx
        found[f"{canonical(NAMES[spdx][0])} {form}"] = spdx
    return found


def with_canonical(rows: DataFrame, text: str, form: str) -> DataFrame:
    """`rows` with the canonical form of a column; null is empty.

    The costlier steps are guarded by what they look for, which few texts have.
    """
    step = F.col(form)
    rows = rows.withColumn(form, F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER))
    rows = rows.withColumn(form, F.when(F.regexp_like(step, F.lit(_ANY_COPYRIGHT)), F.regexp_replace(step, _COPYRIGHT, "$1 ")).otherwise(step))
    rows = rows.withColumn(form, F.concat(F.lit(" "), F.btrim(F.regexp_replace(step, _MARKS, " "), F.lit(" ")), F.lit(" ")))
    rows = rows.withColumn(form, F.when(F.regexp_like(step, F.lit(_VERSION)), F.regexp_replace(step, _VERSION, " $1")).otherwise(step))
    spelt: Column = step
    for one, other in SPELLINGS.items():
        spelt = F.replace(spelt, F.lit(f" {one} "), F.lit(f" {other} "))
    return rows.withColumn(form, F.btrim(F.when(F.regexp_like(step, F.lit(_ANY_SPELLING)), spelt).otherwise(step), F.lit(" ")))


def _marked_words(text: Column) -> Column:
    """The words of the canonical form; one that begins a line has a line break before it."""
    x = F.regexp_replace(F.translate(text, _UPPER, _LOWER), _COPYRIGHT, "$1 ")
    x = F.regexp_replace(F.regexp_replace(x, _MARKS.replace("0-9", r"\n0-9", 1), " "), r" ?\n[ \n]*", "\n")
    x = F.concat(F.lit("\n"), F.btrim(x, F.lit(" \n")), F.lit("\n"))
    x = F.regexp_replace(x, "([ \n])(?:version[ \n]|v)([0-9])", "$1$2")
    for one, other in SPELLINGS.items():
        x = F.regexp_replace(x, f"([ \n]){one.replace(' ', '[ \n]')}([ \n])", f"$1{other}$2")
    return F.split(F.ltrim(F.replace(F.rtrim(x, F.lit("\n")), F.lit("\n"), F.lit(" \n"))), " ")


def _inner_texts(text: Column, form: Column) -> Column:
    """Whole lines of a text that begin like a known text and have as many words: (place, words, digest) each."""
    lengths: dict[str, set[int]] = {}
    for known in whole_texts():
        words = known.split(" ")
        lengths.setdefault(" ".join(words[:HEAD_WORDS]), set()).add(len(words))
    heads = F.create_map(*[x for head, n in sorted(lengths.items()) for x in (F.lit(head), F.array(*map(F.lit, sorted(n))))])

    def within(words: Column) -> Column:
        stretch = lambda i, n: F.replace(F.array_join(F.slice(words, i, n), " "), F.lit("\n"), F.lit(""))
        begins = lambda i: F.coalesce(F.get(words, i - 1).startswith("\n"), F.lit(True))
        at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: begins(i) & F.map_contains_key(heads, stretch(i, HEAD_WORDS)))
        spans = F.flatten(F.transform(at, lambda i: F.transform(F.element_at(heads, stretch(i, HEAD_WORDS)), lambda n: F.struct(i.alias("at"), n.alias("n")))))
        spans = F.filter(spans, lambda x: (x["at"] + x["n"] <= F.size(words) + 1) & begins(x["at"] + x["n"]))
        return F.transform(spans, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.sha2(stretch(x["at"], x["n"]).cast("binary"), 256).alias("digest")))

    found = F.flatten(F.transform(F.array(_marked_words(text)), within))  # the words are made once
    guard = "(?:^| )(?:" + "|".join(sorted(lengths)) + ") "
    return F.when(F.regexp_like(form, F.lit(guard)), found).otherwise(F.array().cast("array<struct<at int, n int, digest string>>"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: digest of its canonical text, the licence that the whole text is, and the licences named inside it.

    Null and empty texts have the digest of an empty text and no licence. A line
    that names a licence twice, or two equal lines, count as they stand; the
    list of licences has each once, sorted. A notice wrapped over up to RUN_LINES
    lines counts once, if no line of it is a notice by itself; a licence text
    inside a longer document counts once. Repeated rows each have their row; other
    columns are not read.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(digest(t), s) for t, s in known_texts().items()], "digest string, spdx string")
    rows = docs.select(F.monotonically_increasing_id().alias("nr"), F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    lower = lambda x: F.translate(x, _UPPER, _LOWER)
    like = lambda x, pattern: F.regexp_like(lower(x), F.lit(pattern))
    none = F.array().cast("array<struct<kind string, at int, n int, unit string>>")
    unit = lambda kind, at, n, x: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), n.cast("int").alias("n"), x.alias("unit"))
    split = F.split("t", "\n")
    lines = F.filter(F.transform(split, lambda x, i: unit("line", i, F.lit(1), x)), lambda u: like(u["unit"], ANCHOR))
    # Neither end of a run may be a line that the canonical form drops: it would be a shorter run once more.
    real = lambda x: like(x, "[0-9a-z]") & ~like(x, "^[^0-9a-z]*(copyright|\\(c\\)|©|all rights reserved)")
    firsts = F.filter(F.transform(split, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda u: like(u["x"], _RUN_HEAD) & real(u["x"]))
    run = lambda i, n: unit("run", i, n, F.array_join(F.slice(split, i + 1, n), "\n"))
    runs = F.flatten(F.transform(firsts["i"], lambda i: F.transform(
        F.filter(F.sequence(F.lit(2), F.lit(RUN_LINES)), lambda n: (i + n <= F.size(split)) & real(F.get(split, i + n - 1))), lambda n: run(i, n))))
    units = F.concat(F.array(unit("whole", F.lit(0), F.lit(0), F.col("t"))), F.when(like(F.col("t"), ANCHOR), lines).otherwise(none),
                     F.when(like(F.col("t"), _RUN_GUARD), runs).otherwise(none))
    formed = with_canonical(rows.select("nr", "doc_id", F.inline(units)), "unit", "form")
    own = F.array(F.struct("kind", "at", "n", F.sha2(F.col("form").cast("binary"), 256).alias("digest")))
    inner = F.transform(_inner_texts(F.col("unit"), F.col("form")), lambda x: F.struct(F.lit("text").alias("kind"), x["at"].alias("at"), x["n"].alias("n"), x["digest"].alias("digest")))
    formed = formed.select("nr", "doc_id", F.inline(F.when(F.col("kind") == "whole", F.concat(own, inner)).otherwise(own)))
    found = formed.join(F.broadcast(known), "digest", "left")  # a fixed table of known texts
    whole, named = F.col("kind") == "whole", F.col("spdx").isNotNull()
    of = lambda kind: F.collect_list(F.when((F.col("kind") == kind) & named, F.struct("at", "n", "spdx"))).alias(kind)
    got = found.groupBy("nr", "doc_id").agg(
        F.max(F.when(whole, F.col("digest"))).alias("text_sha256"), F.max(F.when(whole, F.col("spdx"))).alias("license"), of("line"), of("run"), of("text")
    )
    within = lambda x, y: (y["at"] <= x["at"]) & (x["at"] + x["n"] <= y["at"] + y["n"])
    meets = lambda x, y: (y["at"] < x["at"] + x["n"]) & (x["at"] < y["at"] + y["n"])
    longest = lambda xs: F.filter(xs, lambda x: ~F.exists(xs, lambda y: within(x, y) & (y["n"] > x["n"])))
    wrapped = longest(F.filter("run", lambda x: ~F.exists("line", lambda y: meets(x, y))))
    # A document that is a known text as a whole is not looked through for the texts inside it.
    inside = F.when(F.col("license").isNull(), F.concat(wrapped, longest(F.col("text")))).otherwise(wrapped)
    got = got.withColumn("named", F.concat("line", inside))
    return got.select(
        "doc_id", "text_sha256", "license",
        F.array_join(F.array_sort(F.array_distinct(F.col("named")["spdx"])), ",").alias("line_licenses"),
        F.size("named").cast("long").alias("n_license_lines"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    lower = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    form = lower.format("unit")
    form = f"regexp_replace({form}, {quote(_COPYRIGHT)}, '\\1 ', 'g')"
    form = f"' ' || trim(regexp_replace({form}, {quote(_MARKS)}, ' ', 'g'), ' ') || ' '"
    form = f"regexp_replace({form}, {quote(_VERSION)}, ' \\1', 'g')"
    for one, other in SPELLINGS.items():
        form = f"replace({form}, ' {one} ', ' {other} ')"
    known = ", ".join(f"({quote(digest(t))}, {quote(s)})" for t, s in known_texts().items())
    return f"""
WITH known(digest, spdx) AS (VALUES {known}),
     d AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS t FROM documents),
     units AS (SELECT nr, doc_id, TRUE AS whole, t AS unit FROM d
               UNION ALL SELECT nr, doc_id, FALSE, unit FROM (SELECT nr, doc_id, unnest(string_split(t, chr(10))) AS unit FROM d)
               WHERE regexp_matches({lower.format("unit")}, '{ANCHOR}')),
     found AS (SELECT nr, doc_id, whole, spdx, u.digest
               FROM (SELECT nr, doc_id, whole, sha256(trim({form}, ' ')) AS digest FROM units) u LEFT JOIN known USING (digest))
SELECT doc_id, max(digest) FILTER (whole) AS text_sha256, max(spdx) FILTER (whole) AS license,
       coalesce(string_agg(DISTINCT spdx, ',' ORDER BY spdx) FILTER (NOT whole), '') AS line_licenses,
       count(spdx) FILTER (NOT whole) AS n_license_lines
FROM found GROUP BY nr, doc_id
"""


QUERIES = {"op3_licenses": op3_licenses}
SQL = {"op3_licenses": _oracle()}
