"""Licence recognition by canonical digests.

Texts are brought to one form: lower case, equivalent spellings united, copyright
lines dropped, punctuation and white space reduced to single blanks. The SHA-256
of that form is hash-joined to the digests of known licence texts. A document is
looked up as a whole and by each of its lines, so that both licence files and
one-line notices are found; there is no partial matching.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_texts as L

#: Spellings that count as equal, applied in this order to lower-case text without punctuation.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"), ("authorise", "authorize"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("per cent", "percent"))
#: Words that follow "copyright" in licence prose, where a wrapped line may begin with it.
PROSE = (
    "also and are as disclaim disclaimer disclaimers doctrines for holder holders if in interest interests is law laws license licensed licenses licence licences like line notice notices "
    "of on or owner owners ownership patent permission right rights statement statements that the this those to treaty under"
).split()


def _other(words: list[str]) -> str:
    """A pattern, without lookahead, for a run of other characters than blanks that isn't one of ``words``."""
    heads = sorted({w[0] for w in words})
    parts = [f"[^ {''.join(heads)}][^ ]*"]
    for h in heads:
        tails = [w[1:] for w in words if w[0] == h]
        longer = _other([t for t in tails if t]) if any(tails) else "[^ ]+"
        parts.append(h + (f"(?:{longer})" if "" in tails else f"(?:{longer})?"))
    return "|".join(parts)


#: What a copyright line starts with, after punctuation is gone.
COPYRIGHT = (
    r"^(copyright( c)?|c) ?([0-9]{4}.*|year.*|the .* (authors|contributors))$|^all rights reserved$|^portions copyright .*$"
    rf"|^(c )?copyright (copyright )?({_other(PROSE)})( .*)?$"
)
_KEPT = r"[^\p{L}\p{N}]+"

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TERMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _bsd(n: int) -> list[str]:
    """The text with ``n`` terms, numbered and with bullets."""
    return ["\n".join([_BSD_HEAD, *(f"{mark(i)} {t}" for i, t in enumerate(_BSD_TERMS[:n], 1)), _BSD_END]) for mark in (lambda i: f"{i}.", lambda i: "*")]


def _titled(titles: list[str], texts: list[str]) -> list[str]:
    """Each text as it is and after each title line."""
    return [*texts, *(f"{title}\n\n{t}" for title in titles for t in texts)]


def _whole(text: str, end: str | None = None) -> list[str]:
    """A long text, up to the end of its terms too, with addresses in both schemes."""
    cut = [text, text[: text.index(end) + len(end)]] if end else [text]
    return list(dict.fromkeys(x for t in cut for x in (t, t.replace("https://", "http://"), t.replace("http://", "https://"))))


#: Known texts, licence by licence. Notices are whole lines.
KNOWN = {
    "MIT": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "SPDX-License-Identifier: ISC",
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ],
}


#: Title lines before the text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", "BSD License", "The BSD License", "New BSD License", "Modified BSD License", 'BSD 3-Clause "New" or "Revised" License'],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", "BSD License", "The BSD License", "Simplified BSD License", "FreeBSD License", 'BSD 2-Clause "Simplified" License'],
}
_END = "END OF TERMS AND CONDITIONS"
FULL = {
    **{k: KNOWN[k][:1] for k in ("MIT", "ISC", "Zlib")},
    "BSD-3-Clause": _bsd(3),
    "BSD-2-Clause": _bsd(2),
    "Apache-2.0": _whole(L.APACHE_2, _END),
    "GPL-2.0": _whole(L.GPL_2, _END),
    "GPL-3.0": _whole(L.GPL_3, _END),
    "LGPL-2.1": _whole(L.LGPL_2_1, _END),
    "LGPL-3.0": _whole(L.LGPL_3),
    "MPL-2.0": _whole(L.MPL_2),
}
_NOTICES = {"BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"], "MPL-2.0": ["SPDX-License-Identifier: MPL-2.0"], **{k: [f"SPDX-License-Identifier: {k}-only", f"SPDX-License-Identifier: {k}-or-later"] for k in ("GPL-2.0", "LGPL-2.1", "LGPL-3.0")}}
KNOWN = {k: list(dict.fromkeys([*KNOWN.get(k, []), *_titled(TITLES.get(k, []), FULL.get(k, [])), *_NOTICES.get(k, [])])) for k in sorted({*KNOWN, *FULL, *_NOTICES})}


def canonical_lines(text: Column) -> Column:
    """A text's lines in canonical form; empty for copyright lines and lines without letters or digits."""
    plain = F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(F.lower(line), _KEPT, " ")))
    united = lambda line: reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, line)
    return F.transform(plain, lambda line: F.when(line.rlike(COPYRIGHT), F.lit("")).otherwise(united(line)))


def known_licenses(spark: SparkSession, known: dict[str, list[str]] = KNOWN) -> DataFrame:
    """(license_id, digest) of the given texts; one licence per digest, the first by name."""
    rows = [(k, t) for k, texts in known.items() for t in texts]
    lines = F.filter(canonical_lines(F.col("text")), lambda x: x != "")
    df = spark.createDataFrame(rows, "license_id string, text string").select("license_id", F.sha2(F.array_join(lines, " "), 256).alias("digest"))
    return df.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def find_licenses(df: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 20_000) -> DataFrame:
    """One row for each part of a document whose canonical form is a known text.

    Columns: ``doc_id``, ``part`` (0: the whole document; n: its n-th line, from 1;
    a document of one line only as a whole), ``license_id``, ``digest``. Null and
    empty texts give no rows; rows with a null id are looked up all the same;
    repeated rows are reported each. ``known`` is (license_id, digest), one row
    for each digest; up to ``broadcast_rows`` of them are broadcast, beyond that the
    digests of all parts are shuffled to them.
    """
    lines = df.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.col(text)).alias("lines"))
    used = F.filter("lines", lambda x: x != "")
    whole = F.struct(F.lit(0).alias("part"), F.sha2(F.array_join(used, " "), 256).alias("digest"))
    each = F.transform("lines", lambda x, i: F.struct((i + 1).alias("part"), F.when(x != "", F.sha2(x, 256)).alias("digest")))
    parts = F.when(F.size(used) > 1, F.concat(F.array(whole), F.filter(each, lambda x: x["digest"].isNotNull()))).when(F.size(used) == 1, F.array(whole))
    # An outer explode, as Spark would work the lines out once more to filter texts without a part.
    rows = lines.select("doc_id", F.explode_outer(parts).alias("p")).where("p is not null").select("doc_id", "p.part", "p.digest")
    known = known.select("license_id", "digest")
    if known.count() <= broadcast_rows:
        known = F.broadcast(known)
    return rows.join(known, "digest").select("doc_id", "part", "license_id", "digest")
