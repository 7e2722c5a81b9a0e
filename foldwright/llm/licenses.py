"""Licence scan by canonical digests (DataFrame operations only).

A text is made canonical: copyright statements removed, ASCII letters to lower case, equivalent spellings unified, punctuation and
white space to single spaces.  Its SHA-256 is joined to the digests of known licences.  The same join runs over every line of a
text, where one-sentence notices stand.  The known table is fixed, so it is broadcast.
"""

from __future__ import annotations

import pkgutil
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.session import collect_bounded

MAX_KNOWN = 10_000

# Equivalent spellings (written with spaces for punctuation).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("licence", "license"),
    ("organisation", "organization"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("sub license", "sublicense"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
]
#: Words that may follow "copyright" where a line of a licence body begins with it.
BODY_WORDS = (
    "notices?|holders?|owners?|licen[sc]es?|laws?|statements?|interests?|rights?|and|or|also|means|on|in|to|is|are|of|for|with|as|claims?|protections?|treat(?:y|ies)|acts?|"
    "permissions?|ownership|infringements?|disclaimers?|management|information|status|materials?|works?|lines?|control|permits?|if|when|that|which|this|under|from|may|shall|will|must|not|"
    "applies|policy|registration|patents?|trademarks?|terms?|assignment|the (?:work|program|software|library)"
)
#: A line that is a copyright statement: a sign, a year, or a holder follows; or all rights are reserved and nothing more.
STATEMENT = (
    r"(^|\n)[^A-Za-z0-9\n]*(?:"
    r"(?i:copyright)\b[ \t:,]*(?:\([cC]\)|©|&copy;)"
    r"|(?i:copyright)\b[^A-Za-z0-9\n]*(?:(?:19|20)\d\d|(?<=[\[<{(])(?i:year|yyyy|name|fullname|date)\b)"
    rf"|(?i:copyright)\b[ \t:,]+(?:(?i:by|the)[ \t]+)?(?!(?i:{BODY_WORDS})\b)[A-Z]"
    rf"|(?i:copyright)\b[ \t:,]+(?!(?i:{BODY_WORDS})\b)[^\n]*\b(?:19|20)\d\d\b"
    r"|\([cC]\)[ \t,]*(?:(?i:copyright)\b|(?:19|20)\d\d)"
    r"|(?:©|&copy;)"
    r"|(?i:all rights reserved)[^A-Za-z0-9\n]*(?=\n|$)"
    r")[^\n]*"
)
#: The rule of the SQL, which takes every line that begins so.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F‘’“”–—…]+"

# Licence texts and one-sentence notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution."""
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "The MIT License (MIT) " + _MIT),
    ("MIT", "MIT License " + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License " + _ISC),
    ("Zlib", _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
]


FULL_TEXTS = ["Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"]
#: Where the appendix on applying a licence begins; the text is also known without it.
APPENDIX = {"Apache-2.0": "APPENDIX: How to apply", "GPL-1.0": "Appendix: How to Apply", "GPL-2.0": "How to Apply These Terms", "GPL-3.0": "How to Apply These Terms", "LGPL-2.0": "How to Apply These Terms", "LGPL-2.1": "How to Apply These Terms"}


def full_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the files in license_texts, with and without appendix; BSD with numbers and with bullets."""
    out = []
    for name in FULL_TEXTS:
        text = pkgutil.get_data("foldwright.llm", f"license_texts/{name}.txt").decode()
        out.append((name, text))
        if name in APPENDIX:
            out.append((name, text[: text.rindex(APPENDIX[name])]))
        if name == "BSD-3-Clause":
            body = text[text.index("Redistribution and use") :]
            three = re.sub(r"(?m)^[ \t]*(?:\d\.|[*-])[ \t]+", "* ", body)
            two = re.sub(r"(?s)\* Neither the name.*?permission\.", "", three)
            for key, bullets, title in (("BSD-3-Clause", three, "BSD 3-Clause License\n\n"), ("BSD-2-Clause", two, "BSD 2-Clause License\n\n")):
                number = iter("123")
                numbered = re.sub(r"(?m)^\* ", lambda _, n=number: f"{next(n)}. ", bullets)
                out += [(key, head + t) for head in ("", title) for t in (bullets, numbered)]
    return out


def _unified(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, text)


def canonical_lines(text: Column) -> Column:
    """Canonical text with its line breaks; null counts as empty."""
    stated = F.regexp_replace(F.coalesce(text, F.lit("")), STATEMENT, "$1")
    low = F.translate(stated, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return _unified(F.regexp_replace(low, PUNCTUATION, " "))


def canonical(lines: Column) -> Column:
    """Canonical text in one line."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def match_digest(whole: Column) -> Column:
    """Digest of a canonical text in one line, with spellings unified that a line break had cut."""
    return F.sha2(_unified(whole), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    table = spark.createDataFrame(KNOWN + full_texts() if known is None else known, "license_id string, text string")
    return table.select("license_id", match_digest(canonical(canonical_lines(F.col("text")))).alias("digest")).distinct()


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, text_digest, license_id (of the whole text, or null), notices.

    ``notices`` lists, in order and without repeats, the licences that some whole line of the row's own text names.  Null texts count
    as empty; an empty canonical text or line matches nothing.  Rows are judged one by one, also where they share an id or have none;
    repeated rows stay; other columns are ignored; an empty table gives an empty result.  ``known`` has (license_id, digest) with one
    row per digest and at most MAX_KNOWN rows.
    """
    table = known if known is not None else known_digests(docs.sparkSession)
    names = {r["digest"]: r["license_id"] for r in collect_bounded(table.select("digest", "license_id"), MAX_KNOWN, "known licences")}
    by_digest = F.create_map(*[F.lit(v) for pair in names.items() for v in pair]) if names else F.lit(None).cast("map<string,string>")
    rows = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    lines = F.filter(F.transform(F.array_distinct(F.split("lines", "\n")), lambda line: F.trim(line)), lambda line: line != "")
    digests = F.filter(F.transform(lines, lambda line: F.sha2(line, 256)), lambda d: d.isin(list(names)))
    notices = F.array_join(F.array_sort(F.array_distinct(F.transform(digests, lambda d: F.element_at(by_digest, d)))), ",")
    texts = rows.select("doc_id", canonical(F.col("lines")).alias("whole"), notices.alias("notices"))
    return texts.select("doc_id", F.sha2("whole", 256).alias("text_digest"), match_digest(F.col("whole")).alias("digest"), "notices").select(
        "doc_id", "text_digest", F.when(F.col("digest").isin(list(names)), F.element_at(by_digest, F.col("digest"))).alias("license_id"), "notices"
    )


def oracle() -> str:
    """The same scan in SQL, over the texts of KNOWN and with COPYRIGHT_LINE for STATEMENT."""
    quoted = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = rf"regexp_replace(regexp_replace({low}, '{COPYRIGHT_LINE}', '\1', 'g'), '{PUNCTUATION}', ' ', 'g')"
    unified = reduce(lambda c, pair: f"replace({c}, '{pair[0]}', '{pair[1]}')", SPELLINGS, plain)
    one = r"sha256(trim(regexp_replace({}, '[ \n]+', ' ', 'g'), ' '))"
    return f"""
    WITH k AS (SELECT DISTINCT license_id, {one.format(unified)} AS digest FROM (VALUES {quoted}) t(license_id, text)),
    d AS (SELECT row_number() OVER () AS row, doc_id, {unified} AS lines FROM documents),
    l AS (SELECT DISTINCT row, trim(unnest(string_split(lines, chr(10))), ' ') AS line FROM d),
    h AS (SELECT row, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
          FROM l JOIN k ON sha256(line) = digest WHERE line <> '' GROUP BY row)
    SELECT d.doc_id, {one.format("lines")} AS text_digest, k.license_id, coalesce(h.notices, '') AS notices
    FROM d LEFT JOIN k ON {one.format("lines")} = k.digest LEFT JOIN h ON d.row = h.row
    """
