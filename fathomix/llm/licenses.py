"""Licence scan by canonical digests: whole texts are normalised and hash-joined to licences.

DataFrame functions only.  Two texts have the same canonical form if they differ in case,
punctuation, white space, copyright lines and spellings that licence matching treats as equal.  A
sentence that happens to wrap right before "copyright the ..." looks like a copyright line.
The join is on the SHA-256 of the canonical form, one row per document.  Short licences are stated
as texts, long ones as digests; ``scan`` takes any other table of digests.

Defined cases: a null or empty text, or one of copyright lines only, has the empty canonical form
and matches nothing; repeated rows are matched one by one; a null doc_id is kept; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching guidelines treat as equal.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("percent", "per cent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Short texts of public licences and licence notices.
KNOWN = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
    ),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

_MIT = KNOWN[0][1]
_BSD_2 = next(t for n, t in KNOWN if n == "BSD-2-Clause")
_ISC = next(t for n, t in KNOWN if n == "ISC")
KNOWN += [
    (
        "BSD-3-Clause",
        _BSD_2.replace(
            "\nTHIS SOFTWARE",
            f"\n3. Neither the name of {owner} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE",
        ),
    )
    for owner in ("the copyright holder", "the copyright owner")
]
KNOWN += [
    ("ISC", _ISC.replace("and/or distribute", "and distribute")),
    (
        "MIT-0",
        _MIT.replace(", subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "."),
    ),
]
# Conditions are counted in some copies of the BSD texts and have stars or dashes in others.
KNOWN += [(n, re.sub(r"^\d\. ", "", t, flags=re.M)) for n, t in KNOWN if n.startswith("BSD-")]

# First lines of licence files.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License", "Zero Clause BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
KNOWN += [(n, f"{title}\n\n{t}") for n, t in KNOWN if "\n" in t for title in TITLES[n]]

# Canonical digests of whole licences too long to state here; of those with terms and
# an appendix also without the appendix, with and without the line between.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "dbb777d3ad1fb948fbe99e6748cbd3fea3f269381f3f7efe3f4259a28a9269c9"),
    ("Apache-2.0", "9ce71eb31a8abf79414c431def165019f9604548c79edc94fe0d7d50b2f8703e"),
    ("Apache-2.0", "37aa90548985ac0057637d42c3153e8b5d107a21d9556d7fbe60e3e426fdacaa"),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "8446e2329e3fe2b35501056164a645d74fef33dc1b8a2a132629bf1935fa72e7"),
    ("GFDL-1.2", "9d570a7110338b3eacc840b5643cc88bd41ffb358c687f93890528b8fb33308b"),
    ("GFDL-1.3", "961b6d8afa12e353079f8676ad28084c800a46123e76f7f4f7e7f81df82289dc"),
    ("GFDL-1.3", "5371fc4f9303e1edf123c5c02914bd79da38ca56e37592703dd48ac98152313d"),
    ("GPL-1.0", "2b62a0899e7031347a9577241eb9b504d0eafb4d91b28e1f99580099701d0a1a"),
    ("GPL-1.0", "c4d0d6a72ff991b9d8d8b8de6b66b3ed4e1ace78a8cfb4061b2b63c98deb700b"),
    ("GPL-1.0", "fb6d85b04cce9e961a8ac49322a422ceed03720cc44b403f8769a1966d803f0b"),
    ("GPL-2.0", "d3d1ea54d09952fcd9626a8c4c7c325e00c7f6febdc41bf004285919d6bfaa0a"),
    ("GPL-2.0", "ddaa86ecaccd4e34457b7bf4dc7686fa86c10d64951e30e8968efc41b4fba4f1"),
    ("GPL-2.0", "c2043b33557c653c50c7526295a77726952cb3ecaffc4bfd33a9d0bd36a4fb38"),
    ("GPL-3.0", "68ca42869e9a3e25843be66c6f296ce2b1f3629ac71d77465db0636dc8781c06"),
    ("GPL-3.0", "71ebfd10fca4514433d163174bf2f5e27e4829ad059834ac56dae1098f4ebe49"),
    ("GPL-3.0", "df20d6920a2688bef2bb6fb95fc7472aa40799a7027c0ce468190c67658a9656"),
    ("LGPL-2.0", "1862ecc2c3c5e3b9e88481e95603c88e089c43e9d5702b2ec01391491b606a9e"),
    ("LGPL-2.0", "b927da98cda221c8fbc56dfd2b6b2e80f6df686482d12dbac6b79da1ce6bb98a"),
    ("LGPL-2.0", "e29dcc167f8a363847b3c4b0a7ced67d7a2bb7b9112a3311b6877a9c0570d635"),
    ("LGPL-2.1", "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5"),
    ("LGPL-2.1", "2a9689b90bf823adea3df9024818d21d6041c74f3f12ab46ac5ac4d86f654b2e"),
    ("LGPL-2.1", "2858f5a00f6672bd47f63b69b9bf4e1bc31f3541b08a5a263e59d9b384f72fdc"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "2ccf6e5e40827e08f861c75b089d4ee0714ef61b39cfbbccc919708ff48113bd"),
    ("MPL-2.0", "2ae5d4417f09cff2e3412d0e35c4ee2439f6c18ca69d7d9cc799b33614c368a5"),
]

# Words that follow "copyright" in a sentence; any other begins a holder's name.
IN_SENTENCES = """act and are as at attribution claim claims disclaimer disclaimers doctrine doctrines for grant grants holder holders if in
information infringement interest interests is it law laws legend legends licence licences license licenses line lines management
may message messages mark marks notice notices of on or owner owners ownership patent patents permission permissions protection
protections relinquishment resulting right rights shall statement statements status term terms that to treaties treaty which with""".split()


def other_word(words: list[str], ends: tuple[str, ...] = (r"[^\x00-\x7f]",)) -> str:
    """Pattern for the beginning of a word that is none of words, without looking ahead."""
    after: dict[str, list[str]] = {}
    for w in words:
        if w:
            after.setdefault(w[0], []).append(w[1:])
    more = [c + other_word(rest, (r"[^a-z\n]", "(?m:$)")) for c, rest in sorted(after.items())]
    letters = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in after)
    return "(" + "|".join([*more, f"[{letters}]", *([] if "" in words else ends)]) + ")"


# Copyright lines, and whatever isn't a letter or digit; both in the syntax common to engines.  A
# line that begins with the word copyright is one if a sign, a year or a holder follows; one that
# begins with (c) only if it has a year or the word, since clauses are lettered too.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t#*/;-]*((copyright[ \t]*:?[ \t]*(\(c\)|©|&copy;|[0-9<\[{])"
    r"|copyright([ \t]+|[ \t]*:[ \t]*)" + other_word(IN_SENTENCES) + r"|©|&copy;"
    r"|\(c\)[ \t]*(copyright|[0-9<\[{]|[^\n]*[^0-9\n](19|20)[0-9][0-9]([^0-9]|$)))[^\n]*"
    r"|all rights reserved)"
)
OTHER = r"[^\p{L}\p{N}]+"
#: What must be in a lower-case text for COPYRIGHT_LINE to find anything.
_SIGNS = ("copyright", "(c)", "©", "&copy;", "all rights reserved")


def any_of(words: list[str]) -> str:
    """Pattern for any of some words, letter by letter, so that most places fail at once."""
    after: dict[str, list[str]] = {}
    for w in words:
        if w:
            after.setdefault(w[0], []).append(w[1:])
    inner = "|".join(c + any_of(rest) for c, rest in sorted(after.items()))
    return f"(?:{inner})?" if "" in words and inner else f"(?:{inner})" if len(after) > 1 else inner


_SPELT = f" {any_of([a.replace(' ', '  ') for a, _ in EQUIVALENT])} "


def _bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c evaluated once, however often use names it."""
    return F.transform(F.array(c), use)[0]


def canonical(text: Column) -> Column:
    """Canonical form: lower case, no copyright lines, one blank for each run of anything but
    letters and digits, equivalent spellings made one.

    Words stand between blanks of their own, so that neighbours are respelt alike."""

    def respelt(c: Column) -> Column:
        out = F.concat(F.lit(" "), c, F.lit(" "))
        for a, b in EQUIVALENT:
            out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
        # few texts hold any of the spellings: one look decides
        return F.trim(F.replace(F.when(F.concat(F.lit(" "), c, F.lit(" ")).rlike(_SPELT), out).otherwise(c), F.lit("  "), F.lit(" ")))

    def without_lines(c: Column) -> Column:
        signs = [F.contains(c, F.lit(x)) for x in _SIGNS]
        return F.when(reduce(lambda a, b: a | b, signs), F.regexp_replace(c, COPYRIGHT_LINE, " ")).otherwise(c)

    c = _bound(F.lower(F.coalesce(text, F.lit(""))), without_lines)
    return _bound(F.trim(F.regexp_replace(c, OTHER, "  ")), respelt)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(digest, license) of the texts and digests above; its size is that of the lists."""
    rows = spark.createDataFrame(KNOWN, "license string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    rows = rows.unionByName(spark.createDataFrame(DIGESTS, "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text) as doc_id, canonical_chars, digest, license (null: none).

    ``known`` (digest, license) may be any table of canonical digests in place of the list; it is
    broadcast only if Spark knows it to be small."""
    known = F.broadcast(known_licenses(docs.sparkSession)) if known is None else known.select("digest", "license")
    form = _bound(canonical(F.col("text")), lambda c: F.struct(F.length(c).cast("long").alias("n"), F.when(F.length(c) > 0, F.sha2(c, 256)).alias("d")))
    own = docs.select("doc_id", form.alias("_f")).select("doc_id", F.col("_f.n").alias("canonical_chars"), F.col("_f.d").alias("digest"))
    return own.join(known, "digest", "left").select("doc_id", "canonical_chars", "digest", "license")


def oracle() -> str:
    """The scan as DuckDB SQL."""

    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(c: str) -> str:
        c = f"regexp_replace(lower(coalesce({c}, '')), {text(COPYRIGHT_LINE)}, ' ', 'g')"
        c = f"' ' || trim(regexp_replace({c}, {text(OTHER)}, '  ', 'g')) || ' '"
        for a, b in EQUIVALENT:
            c = f"replace({c}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"trim(replace({c}, '  ', ' '))"

    rows = ", ".join(f"({text(a)}, {text(b)})" for a, b in KNOWN)
    digests = ", ".join(f"({text(a)}, {text(b)})" for a, b in DIGESTS)
    return f"""
WITH known AS (SELECT digest, min(l) AS license FROM (SELECT sha256({form('t')}) AS digest, l FROM (VALUES {rows}) v(l, t) UNION ALL SELECT d, l FROM (VALUES {digests}) v(l, d)) GROUP BY 1),
own AS (SELECT doc_id, {form('text')} AS c FROM documents),
d AS (SELECT doc_id, CAST(length(c) AS BIGINT) AS canonical_chars, CASE WHEN length(c) > 0 THEN sha256(c) END AS digest FROM own)
SELECT doc_id, canonical_chars, d.digest, license FROM d LEFT JOIN known k ON d.digest = k.digest"""
