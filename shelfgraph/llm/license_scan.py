r"""License scans by canonical digests.

A text is cut into lines, lower-cased; copyright statements at the start of a line or behind a title, and lines that
reserve all rights, are dropped (oracle_sql still drops the whole line, by COPYRIGHT); equivalent spellings become one; runs of anything but letters and digits become a space. The SHA-256 of all
canonical lines, joined by a space, is hash-joined to the digests of known licence texts, canonised alike, so
case, layout, punctuation, copyright holders and spelling don't matter and nothing else does. A line that is
a known notice by itself is found by the same digests, looked up in place.

Known texts are a table, given or KNOWN (short licences with and without their usual titles, full texts from the
files in licenses/, and common wordings of notices); it is broadcast only when it has at most MOST_KNOWN
rows. Defined results: null and blank texts have the digest of the empty text and no licence; a text that
matches two known ids reports the least; repeated rows each get their row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_KNOWN = 10_000
COPYRIGHT = r"^[^\p{L}\p{N}(©]*(copyright|\(c\)|©)[^\p{L}\p{N}]*((\(c\)|c|©)[^\p{L}\p{N}]*)?([0-9]{4}|<year>|\[yyyy\]|\[year\])|^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
# words after "copyright" that make it prose, as in a licence's own wrapped lines
_PROSE = r"(?:holders?|owners?|notices?|laws?|treaty|treaties|acts?|licen[sc]es?|statements?|interests?|and|or|in|of|is|are|as|information|protection|disclaimer|status|rights?|permission|materials?|works?|terms|management|ownership|claims?|infringement|to|for|on|with|that|which|shall|may|must|not|office|this|line)\b"
_YEAR = r"(?:[0-9]{4}|<year>|\[yyyy\]|\[year\])"
_MARK = r"(?:copyright[^\p{L}\p{N}]*(?:(?:\(c\)|c\b|©)[^\p{L}\p{N}]*)?|(?:\(c\)|©)[^\p{L}\p{N}]*(?:copyright[^\p{L}\p{N}]*)?)"
# a year after the mark; a sign beside it and any holder; a holder and then a year; a capitalised holder
_BEGIN = rf"(?:{_MARK}{_YEAR}|(?:copyright\s*(?:\(c\)|©)|©)\s*[\p{{L}}<\[]|copyright\s+(?!{_PROSE})[^\n.;:]{{1,80}}?\b(?:19|20)[0-9]{{2}}\b|(?-i:Copyright)\s+(?!{_PROSE})(?-i:\p{{Lu}}))"
# where a licence or notice begins behind the holder
_OPEN = r"(?<![\p{L}\p{N}])(?:all rights reserved|permission is hereby|permission to use|permission is granted|redistributions? and use|licen[sc]ed under|released under|distributed under|available under|published under|spdx-licen[sc]e|licen[sc]e:|this (?:work|project|software|program|code|file|library|document|source code form) is|this licen[sc]e|everyone is permitted)"
_ABBREVIATED = r"(?<!\b(?:inc|ltd|co|corp|llc|gmbh|jr|sr|dr|st|bros|\p{L}))"
BREAK = r"[^\p{L}\p{N}]+"
# fixed values: spellings held equal when licence texts are matched
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("acknowledgment", "acknowledgement"), ("analogue", "analog"),
    ("authorisation", "authorization"), ("centre", "center"), ("favour", "favor"), ("fulfil ", "fulfill "), ("initialise", "initialize"), ("judgment", "judgement"),
    ("labour", "labor"), ("non-commercial", "noncommercial"), ("organisation", "organization"), ("per cent", "percent"),
    ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"), ("https://", "http://"), ("ς", "σ"),
)

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# fixed values: texts of well-known short licences and notices, without titles and copyright lines
_SHORT = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_WARRANTY}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_WARRANTY}"),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# fixed values: the usual titles of the short licences, and the names by which notices call each
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero-Clause License (0BSD)", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng License"),
}
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"),
    "Zlib": ("zlib License", "zlib/libpng License", "Zlib"),
    "Apache-2.0": ("Apache License, Version 2.0", 'Apache License, Version 2.0 (the "License")', "Apache License 2.0", "Apache License v2.0", "Apache License v2", "Apache Version 2.0 License", "Apache 2.0 License", "Apache 2.0", "Apache 2 License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GNU General Public License 3.0", "GNU GPL, version 3", "GNU GPL v3.0", "GNU GPL v3", "GNU GPLv3", "GPL v3.0", "GPL v3", "GPLv3", "GPLv3 License", "GPL-3.0 License", "GPL-3.0", "GPL-3.0-only"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License v2.0", "Mozilla Public License 2.0", "MPL 2.0 License", "MPL 2.0", "MPL v2.0", "MPLv2"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "CC0", "CC0 License", "CC0 1.0 License", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal License"),
} | {
    f"CC-{k}-4.0": (f"CC {k} 4.0", f"CC-{k} 4.0", f"CC {k} 4.0 License", f"Creative Commons {n} 4.0", f"Creative Commons {n} 4.0 License", f"Creative Commons {n} 4.0 International", f"Creative Commons {n} 4.0 International License", f"Creative Commons {n} 4.0 International Public License")
    for k, n in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"))
}
_THINGS = ("work", "project", "software", "program", "code", "file", "library", "document")
# fixed values: wordings of notices around a name, with and without "the" before it
_FORMS = (
    "Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "Published under {}", "Licensed under the terms of {}", "Released under the terms of {}", "Distributed under the terms of {}",
    *(f"This {t} is {how} under {{}}" for t in _THINGS for how in ("licensed", "released", "distributed")),
)


def _whole() -> list[tuple[str, str]]:
    """The long licences from their files, as they are and without the lines of their titles."""
    skipped = {"Apache-2.0": 3, "GPL-3.0": 2, "MPL-2.0": 2, "CC0-1.0": 2, "CC-BY-SA-4.0": 1}
    out = []
    for name, n in skipped.items():
        text = (Path(__file__).parent / "licenses" / f"{name}.txt").read_text(encoding="utf-8")
        lines = [x for x in text.split("\n") if x.strip()]
        out += [(name, text), (name, "\n".join(lines[n:]))]
    # the file is often shipped without the appendix on how to apply it
    out += [(name, cut) for name, text in list(out) for mark in ("END OF TERMS AND CONDITIONS",) if mark in text for cut in (text[: text.index(mark)], text[: text.index(mark)] + mark)]
    return out


def _notices() -> list[tuple[str, str]]:
    out = []
    for name, called in NAMES.items():
        out += [(name, f.format(the + n)) for n in called for f in _FORMS for the in ("", "the ", *(("a ",) if n.startswith("Creative") else ()))]
        out += [(name, f"{f}{n}") for n in (*called, name) for f in ("License: ", "SPDX-License-Identifier: ")]
    out += [("GPL-3.0", f"SPDX-License-Identifier: GPL-3.0-{x}") for x in ("only", "or-later")]
    return out


KNOWN = (*_SHORT, *((n, f"{t}\n{x}") for n, x in _SHORT if "\n" in x for t in TITLES[n]), *_whole(), *_notices())


_TITLED = "|".join(sorted({r"[^\p{L}\p{N}]+".join(re.findall(r"\w+", t)) for ts in TITLES.values() for t in ts}, key=lambda t: (-len(t), t)))
# a copyright statement: mark, years and holder up to a licence's or notice's beginning, a sentence's end or the line's end; a title before it stays
STATEMENT = rf"(?i)^((?:[^\p{{L}}\p{{N}}(©]*(?:{_TITLED})(?![\p{{L}}\p{{N}}]))?)[^\p{{L}}\p{{N}}(©]*{_BEGIN}(?:[^\n]*?(?={_OPEN})|[^\n]*?{_ABBREVIATED}[.!?](?=\s+(?-i:\p{{Lu}}))|[^\n]*)(?:all rights reserved[^\p{{L}}\p{{N}}]*)?"
RESERVED = r"^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"

def _spelt(sql: str) -> str:
    for a, b in SPELLINGS:
        if a != b:
            sql = f"replace({sql}, '{a}', '{b}')"
    return sql


def canonical(text: str | None) -> str:
    """The canonical form in Python, for known texts."""
    import regex

    lines = [regex.sub(STATEMENT, r"\1 ", x).lower() for x in (text or "").split("\n")]
    lines = [x for x in lines if not regex.search(RESERVED, x)]
    for a, b in SPELLINGS:
        lines = [x.replace(a, b) for x in lines]
    lines = [regex.sub(BREAK, " ", x).strip(" ") for x in lines]
    return " ".join(x for x in lines if x)


def digest(text: str | None) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


@cache
def known_digests(known: tuple = KNOWN) -> dict[str, str]:
    """Digest to least licence id."""
    out: dict[str, str] = {}
    for name, text in sorted(known):
        out.setdefault(digest(text), name)
    return out


def scan(docs: DataFrame, known: tuple = KNOWN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, license (of the whole text, or null), n_notices (lines that are known by themselves), notices (their ids, sorted, joined by ;) for each row."""
    spark = docs.sparkSession
    table = known_digests(known)
    lines = F.transform(F.expr("split(coalesce(__text, ''), '\\n')"), lambda x: F.lower(F.regexp_replace(x, STATEMENT, "$1 ")))
    kept = F.filter(lines, lambda x: ~x.rlike(RESERVED))
    plain = F.filter(F.transform(kept, lambda x: F.trim(F.regexp_replace(_replaced(x), BREAK, " "))), lambda x: x != "")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).withColumn("__lines", plain)
    plains = {c for c in (canonical(t) for _, t in known) if c}
    # a line that is a known text by itself has the length, first and last word of one
    lengths, firsts, lasts = sorted({len(c) for c in plains}), sorted({c.split(" ", 1)[0] for c in plains}), sorted({c.rsplit(" ", 1)[-1] for c in plains})
    # one literal, folded to a map once
    lookup = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in sorted(table.items()))), F.lit("\x02"), F.lit("\x01")) if table else F.lit(None).cast("map<string,string>")
    found = F.filter(F.transform(F.filter("__lines", lambda x: F.length(x).isin(lengths) & F.substring_index(x, " ", 1).isin(firsts) & F.substring_index(x, " ", -1).isin(lasts)), lambda x: F.element_at(lookup, F.sha2(x, 256))), lambda x: x.isNotNull())
    own = own.select("doc_id", F.sha2(F.array_join("__lines", " "), 256).alias("digest"), found.alias("__found"))
    ids = spark.createDataFrame(sorted(table.items()) or [], "digest string, license string")
    joined = own.join(F.broadcast(ids) if len(table) <= MOST_KNOWN else ids, "digest", "left")
    return joined.select("doc_id", "digest", "license", F.size("__found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("__found")), ";").alias("notices"))


def _replaced(x):
    for a, b in SPELLINGS:
        if a != b:
            x = F.replace(x, F.lit(a), F.lit(b))
    return x


def oracle_sql(known: tuple = KNOWN) -> str:
    """The scan of documents in DuckDB's SQL."""
    table = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests(known).items()))
    return f"""
WITH known(digest, license) AS (VALUES {table}),
cut AS (SELECT doc_id, row_number() OVER () AS uid, list_filter(list_transform(
    list_filter(string_split(lower(coalesce(text, '')), chr(10)), lambda x: NOT regexp_matches(x, '{COPYRIGHT}')),
    lambda x: trim(regexp_replace({_spelt("x")}, '{BREAK}', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
notices AS (SELECT uid, count(*) AS n, string_agg(DISTINCT license, ';' ORDER BY license) AS ids
  FROM (SELECT uid, unnest(ls) AS l FROM cut) JOIN known ON sha256(l) = digest GROUP BY uid)
SELECT doc_id, sha256(coalesce(array_to_string(ls, ' '), '')) AS digest, license, coalesce(n, 0)::BIGINT AS n_notices, coalesce(ids, '') AS notices
FROM cut LEFT JOIN known ON sha256(coalesce(array_to_string(ls, ' '), '')) = known.digest LEFT JOIN notices USING (uid)"""
