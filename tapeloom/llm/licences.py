"""Licence scan by canonical digest lookup.

A text's canonical form is lower-cased, has no lines that state a copyright, the usual spelling for
words that licences spell in several ways, and words of letters and digits only with one space
between them. Whole texts, blocks between empty lines and lines are each reduced to the digest of
their canonical form and hash-joined to the digests of known licence texts and notices. Nothing is
searched inside a unit: a unit is a known text as a whole or it is none. Before the canonical form of a
unit is made, its letters that no spelling rule touches are compared with those of the known texts;
units that differ there cannot have an equal digest.

`known` is a table (name, text); known() gives a built-in one. It is as long as the list of licences.
Null or empty texts, and units without letters or digits, match nothing. Each row of documents gives
one row; rows with equal texts get equal results; an empty table gives an empty one.
"""
from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import known_size, stage
from .common import pick

#: Lines that state a copyright or reserve rights, and a url's scheme.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: Spellings that licence comparison takes as equal, the left one written as the right one.
EQUAL = {
    "http://": "https://", "&": " and ", "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze",
    "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber",
    "cancelled": "canceled", "capitalisation": "capitalization", "catalogue": "catalog", "categorise": "categorize",
    "centre": "center", "copyright holder": "copyright owner", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil ": "fulfill ", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "per cent": "percent",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "sub-license": "sublicense", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
    "non-commercial": "noncommercial", "e-mail": "email",
}
WORDS = r"[^\p{L}\p{N}]+"
BLOCKS, LINES = r"\n[ \t\r]*\n", r"\n"

#: Names of licences as notices give them.
NAMES = {
    "MIT": ["MIT License", "MIT license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License - Version 1.0"],
    "Unlicense": ["Unlicense"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    **{f"CC-{k.replace(' ', '-')}-{v}": [f"CC {k} {v}", f"CC {k} {v} license", f"Creative Commons {long} {v} International License", f"Creative Commons {long} {v} License"]
       for k, long in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
                       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items()
       for v in ("2.0", "2.5", "3.0", "4.0")},
}
NOTICES = ("Released under the {}.", "Released under {}.", "Licensed under the {}.", "Licensed under {}.", "Distributed under the {}.",
           "Distributed under the terms of the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
           "This work is licensed under {}.", "This project is licensed under the {}.", "This software is released under the {}.",
           "License: {}", "SPDX-License-Identifier: {}", "Available under the {}.", "{}", "The {}")

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_LIABLE = """ IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + _AS_IS + _LIABLE
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.

{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole texts; each is also known with its title in front.
TEXTS = {
    ("MIT", "MIT License"): _MIT,
    ("ISC", "ISC License"): _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD", "Zero-Clause BSD"): _ISC.format(""),
    ("BSD-2-Clause", "BSD 2-Clause License"): _BSD.format(""),
    ("BSD-3-Clause", "BSD 3-Clause License"): _BSD.format("""3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission.

"""),
    ("Zlib", "zlib License"): """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ("Apache-2.0", "Apache License, Version 2.0"): """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
}


def known_texts() -> list[tuple[str, str]]:
    out = [(name, form.format(n)) for name, names in NAMES.items() for n in names for form in NOTICES]
    out += [(name, name) for name in NAMES] + [(name, form.format(name)) for name in NAMES for form in NOTICES]
    for (name, title), text in TEXTS.items():
        out += [(name, text), (name, f"{title}\n\n{text}"), (name, f"The {title}\n\n{text}")]
    return sorted(set(out))


def known(spark: SparkSession) -> DataFrame:
    """(name, text) of the built-in licences and notices."""
    return spark.createDataFrame(known_texts(), "name string, text string")


def _stable() -> str:
    """Letters that every rule keeps, in number and order."""
    kept = [c for c in ascii_lowercase if all(a.count(c) == b.count(c) for a, b in EQUAL.items())]
    only = lambda t: [c for c in t if c in kept]
    assert all(only(a) == only(b) for a, b in EQUAL.items())
    return "".join(kept)


def skeleton(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), F.lit(COPYRIGHT), F.lit(" "))
    return F.regexp_replace(bare, f"[^{_stable()}]+", "")


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), F.lit(COPYRIGHT), F.lit(" "))
    for a, b in EQUAL.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, WORDS, " "))


def digest(text: Column) -> Column:
    """Null where nothing is left to compare."""
    c = canonical(text)
    return F.when(c != "", F.sha2(c, 256))


def digests(known: DataFrame) -> DataFrame:
    """(digest, name, skeleton): one name for each digest, the first."""
    return (known.select(digest(F.col("text")).alias("digest"), skeleton(F.col("text")).alias("skeleton"), "name").where("digest is not null")
            .groupBy("digest").agg(F.min("name").alias("name"), F.first("skeleton").alias("skeleton")))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, whole, licenses, n_licenses): the licence that the whole text is, and all that its
    units are, for every row of docs (doc_id, text)."""
    docs = pick(docs, "doc_id", "text").withColumns({"at": F.xxhash64("text"), "size": F.length("text")})
    units = F.array_distinct(F.concat(F.array("text"), F.split("text", BLOCKS, -1), F.split("text", LINES, -1)))
    listed = known_size(digests(known))
    # written down, or the planner would test the digest of every unit before this join
    alike = stage(docs.where("text is not null").select("at", "size", F.posexplode(units).alias("unit", "part"))
                  .join(known_size(listed.select("skeleton").distinct()), skeleton(F.col("part")) == F.col("skeleton"), "left_semi")
                  .distinct())
    found = (alike.select("at", "size", "unit", digest(F.col("part")).alias("digest"))
             .join(listed.drop("skeleton"), "digest")
             .groupBy("at", "size").agg(F.min(F.when(F.col("unit") == 0, F.col("name"))).alias("whole"),
                                        F.array_sort(F.collect_set("name")).alias("licenses")))
    none = F.array().cast("array<string>")
    return (docs.select("doc_id", "at", "size").join(found, ["at", "size"], "left")
            .select("doc_id", "whole", F.coalesce("licenses", none).alias("licenses"), F.coalesce(F.size("licenses"), F.lit(0)).alias("n_licenses")))


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    c = f"regexp_replace(lower(@), '{q(COPYRIGHT)}', ' ', 'g')"
    for a, b in EQUAL.items():
        c = f"replace({c}, '{q(a)}', '{q(b)}')"
    c = f"trim(regexp_replace({c}, '{q(WORDS)}', ' ', 'g'))"
    rows = ", ".join(f"('{q(n)}', '{q(t)}')" for n, t in known_texts())
    return f"""
WITH known(name, text) AS (VALUES {rows}),
names AS (SELECT {c.replace('@', 'text')} AS form, min(name) AS name FROM known GROUP BY 1),
units AS (
  SELECT doc_id, text, unnest(list_distinct([text] || string_split_regex(text, '{q(BLOCKS)}') || string_split(text, chr(10)))) AS part
  FROM documents WHERE text IS NOT NULL),
forms AS (SELECT doc_id, part = text AS entire, {c.replace('@', 'part')} AS form FROM units),
found AS (SELECT doc_id, min(name) FILTER (entire) AS whole, list_sort(list(DISTINCT name)) AS names
  FROM forms JOIN names USING (form) WHERE form <> '' GROUP BY doc_id)
SELECT doc_id, whole, coalesce(array_to_string(names, ','), '') AS licenses, CAST(coalesce(len(names), 0) AS INTEGER) AS n_licenses
FROM documents LEFT JOIN found USING (doc_id)
"""


SQL = _sql()
