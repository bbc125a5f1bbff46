"""Licence scans: canonical digest lookup, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, UPPER_AZ, ascii_lower

# Short licence texts and notices that are public, and pairs of spellings
# that mean the same.
KNOWN_TEXTS: dict[str, str] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "SPDX-MIT-line": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0-line": "SPDX-License-Identifier: Apache-2.0",
}
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
]

#: A line that holds a copyright statement or "all rights reserved", whole.
COPYRIGHT_LINE = r"(?m)^[^\n\w]*(copyright[ \t]+(\(c\)|©|[0-9])|\(c\)[ \t]+[0-9]|©|all rights reserved)[^\n]*$"


def respelled(t: Column) -> Column:
    """Words between single spaces in their one spelling; twice, as neighbours share a space."""
    for one, other in SPELLINGS:
        for _ in range(2):
            t = F.replace(t, F.lit(f" {one} "), F.lit(f" {other} "))
    return t


def canonical(text: Column) -> Column:
    """The canonical form of a whole text: A-Z lower-cased, copyright lines gone, everything
    but ASCII letters, digits and other alphabets' letters turned into single spaces, and
    equivalent spellings made alike. Null counts as empty."""
    t = ascii_lower(F.coalesce(text, F.lit("")))
    t = F.when(t.contains("copyright") | t.contains("(c)") | t.contains("©") | t.contains("all rights reserved"), F.regexp_replace(t, COPYRIGHT_LINE, "")).otherwise(t)
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    return F.trim(respelled(t))


#: Title lines, and lines that name a copyright holder: "copyright" and a sign or a year, or a name
#: that is not a word of a licence's own sentences.
TITLE_LINE = r"(?m)^[^\p{L}\p{N}\n]*(the )?(mit|isc|apache|bsd|zero-clause bsd|0bsd|bsd zero clause)( 2\.0)? licen[sc]e([ ,]+version 2\.0)?( \([^\n()]*\))?[^\p{L}\p{N}\n]*$"
HOLDER_LINE = r"(?m)^[^\p{L}\p{N}\n]*((portions )?copyright\b(?=[^\n]*(\(c\)|©|\b(19|20)[0-9]{2}\b)|[ \t]+(?!(notices?|holders?|owners?|laws?|licen[sc]es?|statements?|disclaimers?|and|or|in|is|to|of|by|the|this|that|shall|may|with|for|are)\b)[^\n]{1,60}$)|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$"


def canonical_wide(text: Column) -> Column:
    """The form by which a text is looked up when its digest is unknown: as canonical(), but title
    lines and all lines of copyright holders go, and everything but Unicode letters and digits
    is a space."""
    t = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"\r\n?|[\u0085\u2028\u2029]", "\n")
    for line in (TITLE_LINE, HOLDER_LINE):
        t = F.regexp_replace(t, line, "")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.trim(respelled(t))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license_id and digest of the known texts, in both forms; of equal digests the smallest name stays."""
    rows = list((KNOWN_TEXTS if texts is None else texts).items())
    df = spark.createDataFrame(rows, "license_id string, text string")
    forms = F.array(digest(F.col("text")), F.sha2(canonical_wide(F.col("text")).cast("binary"), 256))
    return df.select("license_id", F.explode(F.array_distinct(forms)).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Which whole texts are known licences: key, digest, license_id (null: none), is_license.

    Each text is reduced to the SHA-256 of its canonical form, and digests are joined to those
    of `known` (license_id, digest); what they do not name is looked up by its wide form, in which
    quotes and dashes of any kind, titles and holders do not count. Only keys and digests reach the join; Spark broadcasts the
    known side only if its size allows, else it is a sort-merge join, which AQE splits if one
    digest (copies of one text) holds many rows.

    Null and empty texts have the digest of an empty text, which is no licence unless listed;
    repeated rows are judged one by one; null keys stay; other columns are not read.
    """
    wide = F.sha2(canonical_wide(F.col(text)).cast("binary"), 256)
    mine = docs.select(F.col(key), digest(F.col(text)).alias("digest"), wide.alias("_wide"))
    other = known.select(F.col("digest").alias("_wide"), F.col("license_id").alias("_other"))
    met = mine.join(known.select("digest", "license_id"), "digest", "left").join(other, "_wide", "left")
    found = F.coalesce("license_id", "_other")
    return met.select(key, "digest", found.alias("license_id"), found.isNotNull().alias("is_license"))
