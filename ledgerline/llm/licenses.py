"""License scans by canonical digests, in built-in functions only.

A text is brought to a canonical form: lower case, runs of punctuation and white space one space, without copyright
lines, equivalent spellings alike. White space is collapsed before anything is looked for, so that neither line breaks
nor punctuation decide. Its SHA-256 is looked up among those of known license texts, whole text against whole text. A
document's lines are looked up the same way among known one-line notices, as a document that is not a license says by
such a line what it is under; lines longer in canonical form than any notice are none and are not hashed.

The catalogue's size is checked before it is broadcast. A null text is the empty text, which is no license; a very long
text costs in proportion to its length. Rows equal in id and text get equal results. Columns of docs other than key and
text are not read, so their names clash with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key, written

#: Characters that count as others, before runs are collapsed: fixed values.
SIGNS = (("&", " and "), ("https:", "http:"), ("©", "(c)"))
#: Runs that are one space: ASCII punctuation and white space but the newline, no-break space, dashes, quotes, bullets.
RUNS = r"[\x00-\x09\x0B-\x20!-/:-@\[-`{-~\x{A0}\x{2010}-\x{201F}\x{2022}\x{FEFF}]+"
#: A line that is, after that, a copyright line.
COPYRIGHT_LINE = r"(?m)^ ?((portions |parts )?copyright (c |[0-9]|yyyy|year|by |[^\n]*(19|20)[0-9][0-9])|c [0-9]|all rights reserved ?$)[^\n]*"
#: Spellings that count as one, in the order they are replaced; none begins or ends with a space: fixed values.
SPELLINGS = (
    ("licenc", "licens"), ("sub licens", "sublicens"), ("non commercial", "noncommercial"), ("non infring", "noninfring"), ("per cent", "percent"), ("isation", "ization"), ("authoris", "authoriz"), ("organis", "organiz"),
    ("recognis", "recogniz"), ("utilis", "utiliz"), ("favour", "favor"), ("labour", "labor"), ("honour", "honor"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("wilful", "willful"),
    ("fulfilment", "fulfillment"), ("whilst", "while"), ("programme", "program"), ("artefact", "artifact"), ("copyright owner", "copyright holder"),
)
#: A text is at most so many times as long as its form: every spelling by itself, and one upon the other.
LONGER = prod(max(1.0, len(old) / len(new)) for old, new in SPELLINGS)
#: Rows that a catalogue may have to be broadcast.
CATALOGUE_MOST = 100_000

#: Public license texts without title and copyright lines: fixed values.
LICENSES = {
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
        "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
        "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
        "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
        "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or "
        "in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND "
        "NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment "
        "in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone "
        "to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}
#: Title lines that license files begin with, besides none: fixed values.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "Unlicense": ("The Unlicense",),
    "Zlib": ("zlib License", "The zlib/libpng License"),
}
#: Digests of the canonical forms of longer public texts, whole and up to the end of their terms: fixed values.
DIGESTS = {
    "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543": "Apache-2.0",
    "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40": "Apache-2.0",
    "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b": "GFDL-1.2",
    "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d": "GFDL-1.3",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0",
    "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70": "GPL-1.0",
    "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6": "GPL-1.0",
    "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",
    "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1": "GPL-2.0",
    "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191": "GPL-3.0",
    "5e06bcb7b8c914d3ffb433229937b503a624ae6c7bb9ac1cad01e35a324bcb6d": "GPL-3.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",
    "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2": "LGPL-2.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0",
    "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d": "LGPL-2.0",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",
    "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df": "LGPL-2.1",
    "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "c723f1c8033214c990abc66d271f80fce0ec8b02e61de8e6af2f8368a0e6727b": "MPL-1.1",
    "12274540925f246f7614a52b7ebddfbe0463ff1ab194088c554c73552c45582d": "MPL-2.0",
}
#: What notices call a license; each id is a name of its own, too: fixed values.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL v3", "GPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL v3", "AGPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL v3"),
    "ISC": ("ISC License",),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "Unlicense": ("Unlicense",),
}
#: What stands before a name.
OPENINGS = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This software is released under", "Published under")
NOTICES = [(name, f"{opening}{article} {x}.") for name, known in NAMES.items() for x in dict.fromkeys((name, *known)) for opening in OPENINGS for article in ("", " the", " the terms of the")]
NOTICES += [(name, f"SPDX-License-Identifier: {name}") for name in NAMES] + [("all-rights-reserved", "All rights reserved.")]
TEXTS = [(name, f"{title}\n\n{text}") for name, text in LICENSES.items() for title in ("", *TITLES.get(name, ()))]


def tidy(text: Column) -> Column:
    """A text in lower case, what counts as punctuation or white space one space, its lines kept apart."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for old, new in SIGNS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, RUNS, " ")


def spelled(form: Column) -> Column:
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(old), F.lit(new))
    return form


def whole_form(tidied: Column) -> Column:
    """The canonical form of a whole text, from its tidy lines."""
    return spelled(F.trim(F.regexp_replace(F.regexp_replace(tidied, COPYRIGHT_LINE, ""), "[ \n]+", " ")))


def line_form(tidied: Column) -> Column:
    """The canonical form of one tidy line."""
    return spelled(F.trim(tidied))


def digest(form: Column) -> Column:
    """SHA-256 of a canonical form; none where that is empty."""
    return F.when(form != "", F.sha2(form, 256))


def catalogue(spark, texts: list[tuple[str, str]], name: str, form, digests: dict[str, str]) -> DataFrame:
    """known digest, its license id and the length of its form, of each text and digest, its size checked for broadcasting."""
    if len(texts) + len(digests) > CATALOGUE_MOST:
        raise ValueError(f"a catalogue of {len(texts) + len(digests)} texts is too large to broadcast")
    known = spark.createDataFrame([*((x, t, None) for x, t in texts), *((x, None, d) for d, x in digests.items())], f"{name} string, known_text string, known_digest string")
    known = known.withColumn("form", form(tidy(F.col("known_text"))))
    known = known.groupBy(F.coalesce("known_digest", digest(F.col("form"))).alias(f"known_{name}")).agg(F.min(name).alias(name), F.max(F.length("form")).alias("chars"))
    return known


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", licenses: list[tuple[str, str]] = TEXTS, notices: list[tuple[str, str]] = NOTICES, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """Per row: doc_id, canonical_digest, license_id of the whole text or null, notice_ids of its lines, joined by commas, and how many lines.

    licenses and notices are (id, text), of any number for an id; digests are ids by canonical digest.
    """
    spark = docs.sparkSession
    notes = catalogue(spark, notices, "notice_id", line_form, {})
    longest = notes.agg(F.max("chars")).first()[0] or 0
    rows = docs.select(F.col(key).alias("doc_id"), text_key(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), tidy(F.col(text)).alias("tidied"))
    # lines that are too long to have a notice's form under any spelling, with a space at each end
    short = F.filter(F.split("tidied", "\n"), lambda x: F.length(x).between(1, int(LONGER * longest) + 3))
    rows = rows.select("doc_id", "text_key", digest(whole_form(F.col("tidied"))).alias("canonical_digest"), F.transform(short, lambda x: digest(line_form(x))).alias("lines"))
    rows = written(rows, "canonical")
    lines = rows.select("doc_id", "text_key", F.posexplode("lines").alias("i", "line"))
    found = lines.join(F.broadcast(notes.drop("chars")), F.col("line") == F.col("known_notice_id"))
    found = found.select("doc_id", "text_key", "i", "notice_id").distinct().groupBy("doc_id", "text_key").agg(F.array_join(F.sort_array(F.collect_set("notice_id")), ",").alias("notice_ids"), F.count(F.lit(1)).alias("n_notices"))
    found = written(found.withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"}), "notices")
    whole = F.broadcast(catalogue(spark, licenses, "license_id", whole_form, digests).drop("chars"))
    out = rows.join(whole, F.col("canonical_digest") == F.col("known_license_id"), "left")
    out = out.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    return out.select("doc_id", "canonical_digest", "license_id", F.coalesce("notice_ids", F.lit("")).alias("notice_ids"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def tidy_sql(text: str) -> str:
    """tidy() in DuckDB's SQL."""
    out = f"lower(coalesce({text}, ''))"
    for old, new in SIGNS:
        out = f"replace({out}, {quoted(old)}, {quoted(new)})"
    return f"regexp_replace({out}, {quoted(RUNS)}, ' ', 'g')"


def spelled_sql(form: str) -> str:
    for old, new in SPELLINGS:
        form = f"replace({form}, {quoted(old)}, {quoted(new)})"
    return form


def whole_sql(text: str) -> str:
    """The canonical form of a whole text in DuckDB's SQL."""
    kept = f"regexp_replace({tidy_sql(text)}, {quoted(COPYRIGHT_LINE)}, '', 'g')"
    return spelled_sql(f"trim(regexp_replace({kept}, '[ \\n]+', ' ', 'g'), ' ')")


def line_sql(text: str) -> str:
    return spelled_sql(f"trim({tidy_sql(text)}, ' ')")


def values_sql(pairs) -> str:
    return ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in pairs)
