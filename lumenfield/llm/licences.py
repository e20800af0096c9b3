"""Licence scan by canonical digests of whole texts.

A text is brought to a canonical form: lower case, marks of emphasis, quotes and dashes unified, copyright and "all rights reserved" lines dropped, equivalent spellings
replaced (license for licence, and so on), punctuation removed, white space single. The digest of that form is joined with the digests of known licences, brought to
the same form. Only whole texts match; a text that holds more than a licence does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Variant spellings that licence matching guidelines treat as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "copyright holder": "copyright owner", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "noncommercial": "non commercial", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Short licence texts and notices, as published.
KNOWN = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
        ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
        this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
        this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
        as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}

# Each step: pattern, replacement. The patterns mean the same to Java's and to RE2's regular expressions.
_LINES = [
    (r"(?m)^[ \t#*/;%>.-]*(copyright|\(c\)|©)[^\n]*$", " "),
    (r"(?m)^[ \t#*/;%>.-]*all rights reserved[^\n]*$", " "),
]
_MARKS = [(r"[^0-9a-z\x{00DF}-\x{00F6}\x{00F8}-\x{024F}\x{0370}-\x{1FFF}\x{3040}-\x{D7FF}]+", " ")]


def canonical(text: Column) -> Column:
    """Canonical form; null stays null."""
    text = F.lower(text)
    for pattern, put in [*_LINES, *_MARKS]:
        text = F.regexp_replace(text, pattern, put)
    # spellings are whole words between single spaces
    text = F.concat(F.lit(" "), F.trim(text), F.lit(" "))
    for a, b in SPELLINGS.items():
        text = F.replace(text, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(text)


def canonical_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    text = f"lower({text})"
    for pattern, put in [*_LINES, *_MARKS]:
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    text = f"' ' || trim({text}) || ' '"
    for a, b in SPELLINGS.items():
        text = f"replace({text}, ' {a} ', ' {b} ')"
    return f"trim({text})"


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """(digest, licence): one row per digest, the least name where two texts share a form."""
    rows = spark.createDataFrame(sorted(known.items()), "licence string, body string")
    return rows.select(F.md5(canonical(F.col("body"))).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: dict[str, str] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (MD5 of the canonical form), licence (null: not a known licence), n_copyright (lines that the form leaves out).

    Null texts have no digest and no licence; empty texts, and texts of nothing but marks or copyright lines, have the digest of an empty form. Repeated rows and null ids come back as given; an empty
    table gives an empty result; other columns are not looked at. The known licences are a parameter of fixed size, so their side of the join is the one that is broadcast.
    """
    text = F.col(text_col).cast("string")
    lines = F.regexp_count(F.lower(text), F.lit(_LINES[0][0])) + F.regexp_count(F.lower(text), F.lit(_LINES[1][0]))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(canonical(text)).alias("digest"), F.coalesce(lines, F.lit(0)).cast("long").alias("n_copyright"))
    return rows.join(F.broadcast(known_digests(docs.sparkSession, known)), "digest", "left").select("doc_id", "digest", "licence", "n_copyright")


def oracle(known: dict[str, str] = KNOWN) -> str:
    """DuckDB SQL of ``scan`` over ``documents``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(known.items()))
    lines = " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p, _ in _LINES)
    return f"""WITH known AS (SELECT md5({canonical_sql('body')}) digest, min(licence) licence FROM (VALUES {values}) k(licence, body) GROUP BY 1)
        SELECT doc_id, digest, licence, n_copyright FROM
        (SELECT doc_id, md5({canonical_sql('text')}) digest, CAST(coalesce({lines}, 0) AS BIGINT) n_copyright FROM documents) d LEFT JOIN known USING (digest)"""
