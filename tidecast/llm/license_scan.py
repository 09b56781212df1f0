"""License scans: canonical digests of entire texts, hash-joined to known ones.

A text is canonical once A-Z is lower-cased, copyright statements and "all rights
reserved" are gone, equivalent spellings are one, and every run of characters
other than ASCII letters and digits is one space.  Entire canonical texts are digested with
SHA-256 and looked up among the digests of known licences.  Three kinds of text
are looked up: each whole document, each of its lines, as notices mostly
stand on a line of their own, and each paragraph of two or more lines, as longer ones are wrapped.
A paragraph ends at a line without letters and digits, so that of a comment block does too.

A copyright statement starts its line and reaches to the line's end, or to the end of its sentence
if the next one opens as a notice does (``OPENERS``).  Text that merely speaks of
a copyright notice, at the start of a wrapped line too, stays.

Defined results: null, empty and purely punctuated texts match nothing; a
repeated notice gives one row per line; repeated documents give repeated rows;
an empty table of documents or licences gives an empty result; other columns
are ignored.  Two known licences with one canonical text both match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, id_and_text

#: Spellings that count as one (in text of letters, digits and single spaces, replacement).
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("https ", "http "),
]

#: Words that open a sentence of a notice, and copyright statements, on one lower-cased line.
OPENERS = ("all", "distributed", "licensed", "permission", "redistribution", "released", "this", "use")
COPYRIGHT_STATEMENT = (r"(?s)^[ \t#*/;%!>-]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9<\[]|by[ \t]|the[ \t])|\(c\)[ \t]*(?:copyright|[0-9])|©)"
                       r".*?(?:\.[ \t]+((?:" + "|".join(OPENERS) + r")[ \t].*)\z|\z)")
RIGHTS_RESERVED = r"all rights reserved\.?"

#: Licence notices and short licences, as published.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
          "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
          "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
          "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TERMS = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
              "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
              "documentation and/or other materials provided with the distribution. ")
_BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
              "software without specific prior written permission. ")
_BSD_WARRANTY = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
                 "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
                 "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
                 "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
                 "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
                 "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

#: Entire licences, as published, without their copyright statements; (license, titles, text).
ENTIRE = [
    ("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)"],
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to "
     "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
     "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
     "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
     "THE SOFTWARE."),
    ("ISC", ["ISC License", "The ISC License"],
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
     "copyright notice and this permission notice appear in all copies. " + _AS_IS),
    ("0BSD", ["Zero-Clause BSD", "BSD Zero Clause License"],
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The 2-Clause BSD License"], _BSD_OPENING + _BSD_TERMS + _BSD_WARRANTY),
    ("BSD-3-Clause", ["BSD 3-Clause License", "The 3-Clause BSD License"], _BSD_OPENING + _BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY),
    ("Unlicense", ["The Unlicense"],
     "This is free and unencumbered software released into the public domain. "
     "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means. "
     "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
     "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication "
     "to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
     "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
     "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
     "For more information, please refer to <https://unlicense.org>"),
    ("Zlib", ["zlib License", "The zlib License"],
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
     "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
     "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
     "the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
     "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
     "3. This notice may not be removed or altered from any source distribution."),
]


def known_texts() -> list[tuple[str, str]]:
    """Notices, and entire licences with and without a title and the numbers of their items."""
    found = list(KNOWN)
    for license, titles, text in ENTIRE:
        for body in dict.fromkeys((text, re.sub(r"(?<= )[0-9]\. ", "", text))):
            found += [(license, body), *((license, f"{title} {body}") for title in titles)]
    return found


def spelled(c: Column) -> Column:
    """One spelling of each; lines that are joined are spelled again, as a break may stand in between."""
    for spelling, one in SPELLINGS:
        c = F.replace(c, F.lit(spelling), F.lit(one))
    return c


def canonical(text: Column) -> Column:
    """Canonical form of one line (or of a text without line breaks)."""
    c = ascii_lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(c, COPYRIGHT_STATEMENT, "$1")
    c = F.regexp_replace(c, RIGHTS_RESERVED, " ")
    return spelled(F.trim(F.regexp_replace(c, "[^a-z0-9]+", " ")))


def canonical_lines(text: Column) -> Column:
    """Array of the canonical lines of a text, blank ones included."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r", -1), canonical)


def joined(lines: Column) -> Column:
    return spelled(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def paragraphs(lines: Column) -> Column:
    """(line_no, c, wrapped) of each run of canonical lines without a blank one; ``wrapped``: two lines or more."""
    runs = F.filter(F.transform(F.split(F.array_join(lines, "\n"), "\n\n+", -1), lambda p: F.trim(p, F.lit("\n"))), lambda p: p != "")
    opens = F.filter(F.transform(lines, lambda x, i: F.when((x != "") & (F.coalesce(F.get(lines, i - 1), F.lit("")) == ""), (i + 1).cast("int"))),
                     lambda n: n.isNotNull())
    return F.zip_with(opens, runs, lambda n, p: F.struct(n.alias("line_no"), spelled(F.translate(p, "\n", " ")).alias("c"), F.contains(p, F.lit("\n")).alias("wrapped")))


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, text) of the fixed tables above."""
    return spark.createDataFrame(known_texts(), "license string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  broadcast_licenses: int = 50_000) -> DataFrame:
    """One row per entire text that is a known licence: doc_id, unit
    (``document``, ``paragraph`` or ``line``), line_no (0 for a document, else its first line, from 1),
    license, digest.

    Up to ``broadcast_licenses`` known texts (they are counted) are broadcast, so
    that texts aren't shuffled; more are joined by a shuffle of the digests alone."""
    lines = id_and_text(docs, id_col, text_col).select("doc_id", canonical_lines(F.col("text")).alias("lines"))

    def unit(name, line_no, c):
        return F.struct(F.lit(name).alias("unit"), line_no.cast("int").alias("line_no"), c.alias("c"))

    whole = unit("document", F.lit(0), joined(F.col("lines")))
    each = F.filter(F.transform("lines", lambda x, i: unit("line", i + 1, x)), lambda x: x["c"] != "")
    wrapped = F.transform(F.filter(paragraphs(F.col("lines")), lambda p: p["wrapped"]), lambda p: unit("paragraph", p["line_no"], p["c"]))
    units = (lines.select("doc_id", F.explode(F.concat(F.array(whole), each, wrapped)).alias("u"))
             .where("u.c <> ''")
             .select("doc_id", F.col("u.unit").alias("unit"), F.col("u.line_no").alias("line_no"), digest(F.col("u.c")).alias("digest")))
    texts = (known.select("license", joined(canonical_lines(F.col("text"))).alias("c")).where("c <> ''")
             .select("license", digest(F.col("c")).alias("digest")).distinct())
    if known.count() <= broadcast_licenses:
        texts = F.broadcast(texts)
    return units.join(texts, "digest").select("doc_id", "unit", "line_no", "license", "digest")
