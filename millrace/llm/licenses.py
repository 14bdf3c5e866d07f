"""License scans by canonical digest, with DataFrame functions only.

A whole text is brought to a canonical form and its digest is looked up among the digests of known licences, by a join.
The form follows the public matching guidelines for licence texts: copyright lines and the marks of lists go, letters are
lower-cased, quotes, dashes and all other punctuation become spaces, equivalent spellings become one, and runs of white space
become one space.

Nulls and ties: a null text counts as empty, and an empty canonical form is no licence. Two licences with the same form
are reported by the smaller name. Repeated rows are reported each; texts of any length are read whole. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session

# Equivalent spellings, each pair (variant, canonical), from the public licence matching guidelines.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("non commercial", "noncommercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

# The notices and short licences that are known by their whole text.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
KNOWN = {
    "MIT": f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MIT-0": f"{_MIT_GRANT}. {_AS_IS}",
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_END}",
    "BSD-2-Clause": f"{_BSD_START} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_START} {_BSD_THIRD} {_BSD_END}",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:MIT": "Released under the MIT License.",
}

# Titles under which the short licences are often given.
TITLES = {"MIT": "MIT License", "MIT-0": "MIT No Attribution", "ISC": "ISC License", "0BSD": "Zero-Clause BSD", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}

# Digests of the canonical forms of the long licences, from their official plain texts.
DIGESTS = {
    "Apache-2.0": "0767a15f6a1414801c4a78b00ef7542aed022f93a0169cf370643bf41adbfa4c",
    "Artistic-1.0-Perl": "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49",
    "CC0-1.0": "51c4bf27767d074bdefc84db7420b4c55e27827dac6d8de3ef0d37b2042fb6fa",
    "GFDL-1.2": "66c938a4f3d2114cc3d60f4233a4f26e8c730064aa767788d4745dedea334da1",
    "GFDL-1.3": "196b51c8977291f601cc4b0712d6ab94eee07ddbc100b9ceaba3df650297607c",
    "GPL-1.0": "fe80ccaae90d81557cc6613b788c47dd1819c7a5ae034f77e7d60bb6b879677e",
    "GPL-2.0": "9c942f6942a3d44037aa20b92138b7de02aafd88adea708e7c93f34a145aeaa1",
    "GPL-3.0": "1d853c80efe5ceb4de7b2f36ad97f5659946947afc9c6c75fa3fa50e20368ef2",
    "LGPL-2.0": "76e95bde887e452fdbf364b6e132f70904f43582182b76e0f71d88a2d8911ef7",
    "LGPL-2.1": "3c172029ca14deedef915e5d03e83bcc73647736d10c2be07d384571ca06b440",
    "LGPL-3.0": "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",
    "MPL-1.1": "348dae231334f0be4051bc83647d4097767657eff1ffa9a9f631d9a33e49cb56",
    "MPL-2.0": "fc5ef606318beaac131b21d5691374d00169e4c8a7bbfa49f73a7842a3a2bb49",
}

#: A line that states a copyright; one that merely begins with the word, as in a wrapped paragraph, is text.
_COPYRIGHT_LINE = r"(?im)^[ \t]*(?:#|//|\*)*[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|[\[<{]|by\b|:)|\(c\)[ \t]|©|all rights reserved).*$"
#: A number or letter of a list with its dot or bracket, at the start of a line or after the end of a clause.
_LIST_MARK = r"(?:^|[\r\n]|[.:;,)][ \t]+)[ \t]*\(?(?:[0-9]{1,2}|[A-Za-z])[.)][ \t]+"
#: Known digests that are broadcast; beyond that many the join is shuffled, with salted digests.
BROADCAST_KNOWN = 100_000
SALTS = 64


def known_texts(known: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(license_id, text): the named texts, or those of this module with and without their titles."""
    return sorted((known or KNOWN).items()) + ([] if known else sorted((k, f"{title}. {KNOWN[k]}") for k, title in TITLES.items()))


def canonical(text: Column) -> Column:
    """The canonical form: lower-case words, one space between them, none at the ends."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), _COPYRIGHT_LINE, " ")
    plain = F.regexp_replace(plain, _LIST_MARK, " ")
    plain = F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " "))
    # One pass finds whether any variant is there at all; few texts have one.
    padded = reduce(lambda t, pair: F.regexp_replace(t, rf"\b{pair[0]}\b", pair[1]), SPELLINGS, F.concat(F.lit(" "), plain, F.lit(" ")))
    variants = r"\b(?:" + "|".join(a for a, _ in SPELLINGS) + r")\b"
    return F.when(plain.rlike(variants), F.trim(padded)).otherwise(plain)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, known: dict[str, str] | None = None) -> DataFrame:
    """(canonical_sha256, license_id) of the known licences; texts are canonicalised by the same expression as documents."""
    rows = spark.createDataFrame(known_texts(known), "license_id string, text string").select("license_id", digest(F.col("text")).alias("canonical_sha256"))
    if not known:
        rows = rows.union(spark.createDataFrame(sorted(DIGESTS.items()), "license_id string, canonical_sha256 string"))
    return rows.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, canonical_sha256 and license_id (null: none known) of each row."""
    digests = docs.select("doc_id", digest(F.col("text")).alias("canonical_sha256"))
    table = known_digests(session(docs), known)
    if len(known or KNOWN) <= BROADCAST_KNOWN:
        return digests.join(F.broadcast(table), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = digests.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["canonical_sha256", "_salt"], "left").select("doc_id", "canonical_sha256", "license_id")


def _variants() -> list[tuple[int, str]]:
    """The known texts in other letters, with list marks, copyright lines, spaces and spellings that make no difference."""
    changes = (
        lambda t: t,
        lambda t: t.upper(),
        lambda t: f"Copyright (c) 2020 Someone\nAll rights reserved.\n\n{t}\n",
        lambda t: t.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("Neither", "\n3. Neither"),
        lambda t: re.sub(r"((?:\S+ ){7}\S+) ", r"\1\n  ", t).replace('"', "''").replace("License ", "Licence "),
        lambda t: t + " And more.",
    )
    return [(100 * i + k, change(text)) for i, (_, text) in enumerate(known_texts()) for k, change in enumerate(changes)]


def license_variants(spark, sf_dir: str) -> DataFrame:
    """The scan over variants of the known texts: all but the last of each are found."""
    return scan(spark.createDataFrame(_variants(), "doc_id long, text string"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(documents: str) -> str:
    """The same form in DuckDB's dialect; variants that need a word boundary stand between spaces there too."""
    form = rf"regexp_replace(regexp_replace(coalesce(text, ''), '{_COPYRIGHT_LINE}', ' ', 'g'), '{_LIST_MARK}', ' ', 'g')"
    form = rf"trim(regexp_replace(lower({form}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    spelled = "' ' || plain || ' '"
    for a, b in SPELLINGS:
        spelled = rf"regexp_replace({spelled}, '\b{a}\b', '{b}', 'g')"
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in known_texts())
    digests = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(DIGESTS.items()))
    return f"""
WITH known_rows AS (SELECT license_id, sha256(trim({spelled})) AS canonical_sha256
  FROM (SELECT license_id, {form} AS plain FROM (VALUES {values}) v(license_id, text))
  UNION ALL SELECT * FROM (VALUES {digests}) d(license_id, canonical_sha256)),
known AS (SELECT min(license_id) AS license_id, canonical_sha256 FROM known_rows GROUP BY canonical_sha256),
digests AS (SELECT doc_id, sha256(trim({spelled})) AS canonical_sha256 FROM (SELECT doc_id, {form} AS plain FROM {documents}))
SELECT doc_id, canonical_sha256, license_id FROM digests LEFT JOIN known USING (canonical_sha256)
"""


SQL = _sql("documents")
VARIANTS_SQL = _sql("(SELECT CAST(n AS BIGINT) AS doc_id, text FROM (VALUES " + ", ".join(f"({n}, {_quoted(t)})" for n, t in _variants()) + ") t(n, text))")
