"""License scans by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings do not count), and its SHA-256 is looked up among the digests
of known licences, which went through the same expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEXTS

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TERMS_END = "END OF TERMS AND CONDITIONS"
#: Known licence texts, and the one-line notices that stand for them.  A parameter of the scan.
#: A ``-body`` is a text up to its closing line, without what follows on how to apply it.
LICENSES = {
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS,
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_TAIL,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    **TEXTS,
    **{f"{k}-body": v.partition(_TERMS_END)[0] + _TERMS_END for k, v in TEXTS.items() if _TERMS_END in v},
}
#: Words that count as one, as the public matching guidelines list them.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"),
    ("favour", "favor"), ("organisation", "organization"), ("judgement", "judgment"), ("fulfil", "fulfill"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("merchantibility", "merchantability"),
)


#: A line that is a copyright notice: the word or sign, then a year or a place for one, or the sign "(c)" and a holder.
_MARK, _YEAR = "(?:\\(c\\)|©)", "(?:[0-9]{4}|[<\\[{(](?:yyyy|years?)[>\\]})])"
NOTICE = f"\\n[ \\t*#/>;-]*(?:copyright[ \\t]+{_YEAR}|copyright[ \\t]*{_MARK}|{_MARK}[ \\t]*(?:copyright|{_YEAR}))[^\\n]*"


def own_notices(licenses: dict[str, str]) -> str:
    """A pattern of the copyright notices inside the known texts, which matches them however the lines break."""
    found = {tuple(re.findall(r"[^\W_]+", line.lower())) for text in licenses.values() for line in re.findall(f"(?i){NOTICE}", "\n" + text)}
    return "(?i)" + "|".join("[^\\p{L}\\p{N}]+".join(words) for words in sorted(found, key=lambda w: (-len(w), w)))


def canonical(text: Column, notices: str | None = None) -> Column:
    """The canonical form: copyright notices dropped, lower case, runs of other than letters and digits as one space, equivalent spellings alike; null as empty.

    A line is a notice if the word or sign stands first in it and a year, a place for
    one or the sign follows; notices of the known texts go wherever lines break.
    """
    out = F.concat(F.lit("\n"), F.coalesce(text, F.lit("")))
    cut = F.regexp_replace(F.regexp_replace(out, notices or own_notices(LICENSES), " "), f"(?i){NOTICE}", "\n")
    # most texts hold no notice, and a look for the words is cheaper than the patterns
    out = F.lower(F.when(F.lower(out).rlike("copyright|\\(c\\)|©"), cut).otherwise(out))
    # a word has a space of its own on either side, so that neighbours are both replaced
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, "[^\\p{L}\\p{N}]+", "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column, notices: str | None = None) -> Column:
    return F.sha2(canonical(text, notices).cast("binary"), 256)


def known(spark: SparkSession, licenses: dict[str, str] | None = None) -> DataFrame:
    """(license_digest, license_id) of the known texts; of texts with one canonical form the first id."""
    rows = sorted((licenses or LICENSES).items())
    table = spark.createDataFrame(rows, "license_id string, text string")
    return table.groupBy(digest(F.col("text"), own_notices(dict(rows))).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license_digest, license_id) of every row of docs(doc_id, text): the licence that the entire text is, else null.

    Null and empty texts have the digest of nothing and no licence.  Repeated rows and
    null ids stay; other columns are ignored.  The known texts are a parameter of the
    program (not data), and broadcast.
    """
    notices = own_notices(licenses or LICENSES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text"), notices).alias("license_digest"))
    return rows.join(F.broadcast(known(docs.sparkSession, licenses)), "license_digest", "left").select("doc_id", "license_digest", "license_id")


def _sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql(licenses: dict[str, str] | None = None, documents: str = "documents") -> str:
    notices = _sql_literal(own_notices(licenses or LICENSES))

    def form(x: str) -> str:
        out = f"regexp_replace(chr(10) || coalesce({x}, ''), {notices}, ' ', 'g')"
        out = f"lower(regexp_replace({out}, {_sql_literal('(?i)' + NOTICE)}, chr(10), 'g'))"
        out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
        for a, b in SPELLINGS:
            out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"sha256(trim(replace({out}, '  ', ' ')))"

    values = ", ".join(f"({_sql_literal(k)}, {_sql_literal(v)})" for k, v in sorted((licenses or LICENSES).items()))
    return f"""
WITH k AS (SELECT {form('t')} AS license_digest, min(id) AS license_id FROM (VALUES {values}) v(id, t) GROUP BY 1),
d AS (SELECT doc_id, {form('text')} AS license_digest FROM {documents})
SELECT doc_id, license_digest, license_id FROM d LEFT JOIN k USING (license_digest)
"""
