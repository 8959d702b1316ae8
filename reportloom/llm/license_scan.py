"""Licence scans by canonical digest lookup.

A text is brought to one canonical form (lower case, no copyright lines, no
punctuation, single spaces, one spelling of words that licences spell in two
ways) and its whole digest is looked up among those of known licence texts.
"""

from __future__ import annotations

import hashlib
import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.common import table

#: Spellings that count as equal.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("judgement", "judgment"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
]
#: A line that names the holder of the rights: with a sign, a year, a place for one, or "by".
COPYRIGHT_LINE = (
    r"(?im)^[^\p{L}\p{N}\n]*(copyright[^\p{L}\p{N}\n]*(\(c\)|©|[0-9]{4}|yyyy|year\b|by\b)|©|\(c\)[^\p{L}\p{N}\n]*[0-9]{4}|all rights reserved)[^\n]*$"
)
MARKS = r"[^\p{L}\p{N}]+"

_CONDITIONS = """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution."""
_ENDORSEMENT = """
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission."""
_DISCLAIMER = """
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Licences whose full texts lie in ``licenses``, as their publishers word them.
FILES = ["Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0"]
#: Titles that may stand before a text, which counts with any of them and with none.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "GPL-1.0": ["GNU GENERAL PUBLIC LICENSE Version 1, February 1989"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.0": ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MPL-1.1": ["MOZILLA PUBLIC LICENSE Version 1.1"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"],
}
#: Where the terms end in texts that explain afterwards how to apply them.
END = "END OF TERMS AND CONDITIONS"

#: Well-known licence texts.
KNOWN = {
    "MIT": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    "ISC": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _CONDITIONS + _DISCLAIMER,
    "BSD-3-Clause": _CONDITIONS + _ENDORSEMENT + _DISCLAIMER,
    "Unlicense": """
        This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
        copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
        For more information, please refer to <https://unlicense.org>""",
    **{name: pkgutil.get_data("reportloom.llm", f"licenses/{name}.txt").decode() for name in FILES},
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, MARKS, " "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return out


def canonical_text(text: str) -> str:
    """The same form of a driver-side text."""
    out = re.sub(COPYRIGHT_LINE.replace(r"[^\p{L}\p{N}\n]", r"(?:[^\w\n]|_)"), "", text.lower())
    out = " ".join(re.findall(r"[^\W_]+", out))
    for one, other in SPELLINGS:
        out = out.replace(one, other)
    return out


def forms(name: str, text: str) -> set[str]:
    """The canonical forms of a known text: with each of its titles and with none, with and without what follows its end."""
    whole, titles = canonical_text(text), [canonical_text(t) for t in TITLES.get(name, [])]
    bare = next((whole[len(t) :].strip() for t in sorted(titles, key=len, reverse=True) if whole.startswith(t + " ")), whole)
    end = canonical_text(END)
    cut = bare.rpartition(end)[0].strip()
    bodies = {bare, *([cut, f"{cut} {end}"] if cut else [])}
    return {whole, *bodies, *(f"{t} {b}" for t in titles for b in bodies)}


def digests(known: dict[str, str]) -> dict[str, str]:
    return {hashlib.sha256(form.encode()).hexdigest(): name for name, text in known.items() for form in sorted(forms(name, text))}


def license_scan(docs: DataFrame, known: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, canonical_chars, digest, license (null where unknown).

    ``known`` maps names to texts; of texts with one canonical form the last
    named wins; those of ``TITLES`` count with and without title. Whole texts are
    compared: a licence inside a longer text is not found. A null text counts as empty; an empty
    canonical form matches nothing unless it is among ``known``. Repeated rows
    and null ids stay; other columns are ignored; an empty table gives no rows.
    The known digests are as many as the caller lists, so their side of the join
    is broadcast.
    """
    found = digests(KNOWN if known is None else known)
    lookup = docs.sparkSession.createDataFrame(list(found.items()), "digest string, license string")
    form = docs.select(F.col(id_col).alias("id"), canonical(F.coalesce(text_col, F.lit(""))).alias("form"))
    keyed = form.select("id", F.length("form").cast("long").alias("canonical_chars"), F.sha2("form", 256).alias("digest"))
    return keyed.join(F.broadcast(lookup), "digest", "left").select(
        F.col("id").alias(id_col), "canonical_chars", "digest", "license"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    form = f"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT_LINE}', '', 'g'), '{MARKS}', ' ', 'g'), ' ')"
    for one, other in SPELLINGS:
        form = f"replace({form}, '{one}', '{other}')"
    values = ", ".join(f"('{d}', '{name}')" for d, name in digests(KNOWN).items())
    return f"""
WITH known(digest, license) AS (VALUES {values}),
  forms AS (SELECT doc_id, {form} AS form FROM documents),
  keyed AS (SELECT doc_id, length(form)::BIGINT AS canonical_chars, sha256(form) AS digest FROM forms)
SELECT doc_id, canonical_chars, keyed.digest, license FROM keyed LEFT JOIN known ON keyed.digest = known.digest
"""


SQL = _sql()
