"""Operator 6, licence scan: canonical digests of whole texts, looked up among those of known licences.

A document is looked up as a whole, and so is each of its lines, as notices are mostly lines of their
own. Both sides are brought to one form first: letters, marks, spellings and copyright lines that differ
between copies of one licence are the same afterwards. The lookup is a hash join on the digests.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spellings of one word, as in lists of equivalent words for comparing licences.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("organisations", "organizations"), ("favour", "favor"), ("behaviour", "behavior"), ("whilst", "while"), ("per cent", "percent"),
    ("holder", "owner"), ("holders", "owners"), ("non commercial", "noncommercial"), ("v2", "version 2"), ("v3", "version 3"),
)
#: Short licences and notices in their published words.
PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
    "freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software "
    "in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
    "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We "
    "intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright "
    "law."
)
APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
    "obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\n"
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
    "limitations under the License."
)
KNOWN = (
    ("MIT", f"MIT License\n{PERMISSION}\n{AS_IS}"),
    ("MIT", f"{PERMISSION}\n{AS_IS}"),
    ("ISC", f"ISC License\n{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{ISC_AS_IS}"),
    ("0BSD", f"Zero-Clause BSD\n{ISC_GRANT}.\n{ISC_AS_IS}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{BSD_GRANT}\n{BSD_AS_IS}"),
    ("BSD-2-Clause", f"{BSD_GRANT}\n{BSD_AS_IS}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{BSD_GRANT}\n{BSD_NAMES}\n{BSD_AS_IS}"),
    ("BSD-3-Clause", f"{BSD_GRANT}\n{BSD_NAMES}\n{BSD_AS_IS}"),
    ("Zlib", f"zlib License\n{ZLIB}"),
    ("Zlib", ZLIB),
    ("Unlicense", f"{UNLICENSE}\n{AS_IS}\nFor more information, please refer to <https://unlicense.org/>"),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)
#: What follows the word copyright where a licence speaks of it, so that the line is not one that names an owner.
SPOKEN_OF = r"^copyright (owners?|notices?|laws?|licenses?|interests?|and|or|in|to|statements?)( |$)"
_MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_lines(text: Column) -> Column:
    """The lines of the text with A-Z lower-cased, copyright signs as the word, spellings made equal, and marks as single spaces."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.replace(F.replace(out, F.lit("(c)"), F.lit(" copyright ")), F.lit("©"), F.lit(" copyright "))
    out = F.concat(F.lit(" "), F.replace(F.regexp_replace(out, _MARKS, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.transform(F.split(F.regexp_replace(out, r" {2,}", " "), "\n"), lambda x: F.trim(x))


def canonical_text(lines: Column) -> Column:
    """Lines of ``canonical_lines`` as one text, without empty ones and copyright lines: those that begin with that word and go on with an owner or a year."""
    return F.array_join(F.filter(lines, lambda x: (x != "") & (~x.startswith("copyright") | x.rlike(SPOKEN_OF))), " ")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """digest, licence and length for (licence, text); equal digests go to the least name, texts without words are left out."""
    lines = known.select("licence", canonical_lines(F.col("text")).alias("lines"))
    text = lines.select("licence", canonical_text(F.col("lines")).alias("text")).where("text <> ''")
    return text.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"), F.min(F.length("text")).alias("length"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: doc_id, text_sha256, licence, n_lines, line_licences.

    ``text_sha256`` is the digest of the whole canonical text, ``licence`` the known one with that digest
    or null. ``n_lines`` counts lines that are a known licence or notice as a whole, ``line_licences``
    lists theirs, each once, sorted and comma-joined (empty if none). ``known`` (licence, text) is a list of licences and
    small against the documents; by default it is ``KNOWN``. Null texts count as empty, whose canonical text
    is empty and no licence; repeated rows each get a row, other columns are not read.
    """
    known = docs.sparkSession.createDataFrame(list(KNOWN), "licence string, text string") if known is None else known
    digests = known_digests(known)
    #: Whole lengths of known texts; a line of another length has another digest and needs none.
    lengths = [r["length"] for r in digests.select("length").distinct().collect()] or [-1]
    lines = docs.select(F.col(id_column).alias("doc_id"), canonical_lines(F.col(text_column)).alias("lines"))
    asked = F.transform(F.filter("lines", lambda x: F.length(x).isin(lengths)), digest)
    # Each text is brought to its form once, and its row numbered once.
    rows = keep(lines.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest(canonical_text(F.col("lines"))).alias("text_sha256"), asked.alias("asked")))
    by_line = rows.select("row", F.explode("asked").alias("digest")).join(digests.select("digest", "licence"), "digest")
    found = by_line.groupBy("row").agg(F.count("*").alias("n_lines"), F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("line_licences"))
    named = rows.join(digests.select(F.col("digest").alias("text_sha256"), "licence"), "text_sha256", "left").join(found, "row", "left")
    return named.select("doc_id", "text_sha256", "licence", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("line_licences", F.lit("")).alias("line_licences"))
