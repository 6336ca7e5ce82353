"""License scans by canonical digest.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation, white space) and
its SHA-256 is looked up among the digests of known licence texts. Whole documents are looked up, and each line
is too, as an entire text of its own: a line such as ``Released under the MIT License.`` is a notice.

Defined cases: null text counts as empty; a text without letters or digits has the digest of the empty text and
matches nothing; repeated rows are looked up each for itself; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

# Known licence texts and notices, by SPDX identifier.
KNOWN = [
    ("MIT", "notice", "Released under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("MIT", "text", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "text", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "text", "Zero-Clause BSD Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]
# Titles that may stand before a text, or not. Texts are files of ``license_texts``, named by SPDX identifier.
TITLES = {
    "MIT": ["The MIT License (MIT)", "The MIT License", "MIT License (MIT)"], "ISC": ["The ISC License", "ISC License (ISC)"], "0BSD": ["BSD Zero Clause License", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"],
    "Zlib": ["zlib License", "The zlib License"], "Unlicense": ["The Unlicense", "Unlicense"],
}
# Names of licences in notices of one line.
NAMES = {
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License"], "0BSD": ["Zero-Clause BSD License"], "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"], "Zlib": ["zlib License"], "Unlicense": ["Unlicense"], "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"], "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "Mozilla Public License, v. 2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0"], "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"], "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"], "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"],
    "GFDL-1.3-only": ["GNU Free Documentation License, Version 1.3"], "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    **{f"CC-{k}-{v}": [f"CC {k} {v}", f"CC-{k}-{v}", f"Creative Commons {n} {v} {w} License"] + [f"Creative Commons {n} {v} License", f"Creative Commons {n} License {v}"] for v, w in (("4.0", "International"), ("3.0", "Unported"))
       for k, n in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
_SUBJECTS = ["", "This work is ", "This project is ", "This software is ", "This code is "]
WORDINGS = [f"{s}{v} under {t}{{}}" for s in _SUBJECTS for v in ("licensed", "released", "distributed") for t in ("", "the ")]


def _more() -> list[tuple[str, str, str]]:
    texts = [(p.stem, p.read_text("utf-8")) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))]
    # The Apache licence is also given without its appendix.
    texts += [(i, t[: t.index("APPENDIX: How to apply")]) for i, t in texts if i == "Apache-2.0"]
    texts += [(i, t.split(" ", n)[n]) for (i, n), t in zip((("MIT", 2), ("ISC", 2), ("0BSD", 2)), (t for _, kind, t in KNOWN if kind == "text"))]
    out = [(i, "text", f"{head}{t}") for i, t in texts for head in ("", *[f"{x}\n\n" for x in TITLES.get(i, [])])]
    out += [(i, "notice", w.format(name)) for i, names in NAMES.items() for name in names for w in WORDINGS]
    return out + [(i, "notice", f"SPDX-License-Identifier: {i.removesuffix('-only')}{end}") for i in NAMES for end in ("", "-only")[: 1 + i.endswith("-only")]]


KNOWN += _more()
# Spellings held to be equivalent, after punctuation has become spaces.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability")]
# Copyright lines: with a digit; with a sign or a placeholder; short ones that begin a paragraph; and reserved rights.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t]*((copyright|\(c\)|©)[^\n]*[0-9][^\n]*|(copyright[ \t]*(\(c\)|©|[<\[{])|©)[^\n]*|all rights reserved\.?[ \t\r]*(\n|$))"
    r"|(^|\n[ \t\r]*\n)([ \t]*((copyright|\(c\)|©)[^\n]*[0-9][^\n]*|copyright [^\n]{0,100}|all rights reserved\.?[ \t\r]*)(\n|$))+"
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column) -> Column:
    out = ascii_lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, "\n"), NOT_WORD, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """spdx, kind, digest: one row for each known text; of equal canonical forms the first counts."""
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(KNOWN if known is None else known)], "n int, spdx string, kind string, known_text string")
    rows = rows.select("n", "spdx", "kind", F.sha2(canonical(F.col("known_text")), 256).alias("known_digest"))
    return rows.groupBy("known_digest").agg(F.min_by("spdx", "n").alias("spdx"))


def scan_licenses(documents: DataFrame, known=None) -> DataFrame:
    """doc_id, digest, license (null unless the entire text is a known one), notices (sorted, comma-joined), n_notices.

    The text of a document and each of its lines are entire texts, each with its digest, and all are joined to the known
    digests by hash. These are a fixed list of some thousand rows, so they are broadcast and texts are never shuffled:
    the lines of a row meet again in one record of its matches.
    """
    digests = F.broadcast(known_digests(documents.sparkSession, known))
    docs = documents.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = docs.select("_row", "doc_id", "text", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.split(F.coalesce("text", F.lit("")), "\n", -1))).alias("n", "line"))
    # Number 0 stands for the whole text.
    texts = texts.select("_row", "doc_id", (F.col("n") == 0).alias("whole"), F.sha2(canonical(F.when(F.col("n") == 0, F.col("text")).otherwise(F.col("line"))), 256).alias("digest"))
    found = texts.join(digests, F.col("digest") == F.col("known_digest"), "left")
    line = F.when(~F.col("whole"), F.col("spdx"))
    out = found.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"), F.max(F.when(F.col("whole"), F.col("spdx"))).alias("license"),
        F.collect_set(line).alias("found"), F.count(line).alias("n_notices"))
    return out.select("doc_id", "digest", "license", F.concat_ws(",", F.array_sort("found")).alias("notices"), "n_notices")


def _canonical_sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace(regexp_replace({out}, '{COPYRIGHT_LINE}', chr(10), 'g'), '{NOT_WORD}', ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out})"


def oracle_sql() -> str:
    known = ", ".join("({}, '{}', '{}')".format(i, spdx, text.replace("'", "''")) for i, (spdx, _, text) in enumerate(KNOWN))
    return f"""
WITH known AS (SELECT sha256({_canonical_sql('known_text')}) AS known_digest, arg_min(spdx, n) AS spdx
               FROM (VALUES {known}) k(n, spdx, known_text) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
notices AS (SELECT doc_id, string_agg(DISTINCT spdx, ',' ORDER BY spdx) AS notices, count(*) AS n_notices
            FROM lines JOIN known ON sha256({_canonical_sql('line')}) = known_digest GROUP BY doc_id)
SELECT d.doc_id, sha256({_canonical_sql('d.text')}) AS digest, k.spdx AS license,
       coalesce(n.notices, '') AS notices, CAST(coalesce(n.n_notices, 0) AS BIGINT) AS n_notices
FROM documents d LEFT JOIN known k ON sha256({_canonical_sql('d.text')}) = k.known_digest LEFT JOIN notices n ON n.doc_id = d.doc_id"""
