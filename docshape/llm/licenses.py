"""Licence scans by canonical digest, with DataFrame functions only (operator 7).

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings removed), digested whole, and joined to the digests of
known licence texts.  Lines that mention a licence are looked up the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, as the public licence-matching guidelines list them.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("noncommercial", "non commercial"), ("sublicence", "sublicense"), ("https", "http"), ("copyright owner", "copyright holder"),
]

# Known licence texts and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    *[(i, f"SPDX-License-Identifier: {i}") for i in ("MIT", "ISC", "Apache-2.0", "GPL-3.0", "GPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "CC-BY-4.0", "CC-BY-NC-4.0")],
]


def canonical(text: Column) -> Column:
    """The text in lower case without copyright lines and punctuation, spellings made equal, words parted by one space.  Null stays null."""
    lines = F.regexp_replace(F.lower(text), "(?m)^[^\\p{L}\\p{N}\\n]*(?:copyright\\b|\\(c\\)|©)[^\\n]*(?:\\n|$)", "")
    # Two spaces between words while spellings are replaced: each word has borders of its own, so that neighbours are all found.
    words = F.trim(F.regexp_replace(F.regexp_replace(lines, "&", " and "), "[^\\p{L}\\p{N}]+", " "))
    out = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence, n_canonical), one row for each canonical text; as many rows as ``known`` at most, so it may be broadcast."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "licence string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "licence", F.length(canonical(F.col("text"))).alias("n")).groupBy("digest").agg(F.min("licence").alias("licence"), F.max("n").alias("n"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row of ``docs``: id, digest of the whole canonical text, licence (of the whole text, or null), line_licences (sorted, distinct).

    Null and empty texts have the digest of the empty text and no licence, repeated rows each get a row; other
    columns are not read.  The known digests are a short list, joined by broadcast: no shuffle of documents."""
    found = known_digests(docs.sparkSession, known)
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.lower(x).rlike("licen[cs]e"))
    # The list of known digests is short by construction; for lines it is a literal map, so that lines need no join back.
    table = F.create_map(*[F.lit(x) for r in found.select("digest", "licence").collect() for x in r])
    kept = src.select("_id", digest(F.col("_t")).alias("digest"), F.transform(lines, digest).alias("_lines"))
    whole = F.broadcast(found.select(F.col("digest").alias("_d"), "licence"))
    return kept.join(whole, F.col("digest") == F.col("_d"), "left").select(
        F.col("_id").alias(id_col), "digest", "licence",
        F.array_sort(F.array_distinct(F.array_compact(F.transform("_lines", lambda d: F.try_element_at(table, d))))).alias("line_licences"),
    )
