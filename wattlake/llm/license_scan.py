"""License scan: whole texts and their lines against licence templates by Dice coefficient over word bigrams.

Texts are normalised to lower-case words, and a text, a line or a template is the
set of its word bigrams. Two sizes ``a`` and ``b`` can reach a coefficient ``t`` only
if ``b`` lies between ``a * t / (2 - t)`` and ``a * (2 - t) / t``: templates out of these
bounds are never compared. Before that, only the bigrams that occur in some
template at all are kept, and a unit with too few of them for any template of a
fitting size is done. What is left - a handful of units - is compared exactly.

A notice that is wrapped over lines or stands inside a sentence is found by windows:
as many words of the text as the template has, from each place where one of its bigrams
stands. To reach ``t`` a window holds the share ``t / (2 - t)`` of the template's bigrams, so a text that lacks
more than the rest of them is out, and so is every place from which too few of them follow.
Of windows that overlap the best stays, which tells versions of a licence apart.

Templates are a fixed small table, so the scan is one pass without a shuffle. All
of it is built-in functions.

Defined cases: a null or empty text has no unit and no hit; a unit of one word has no bigram
and no hit; repeated rows give their hits once each; equal coefficients of a unit go to the
first template by name; equal windows to the longer template, then the first by name, then the first place; a window at the
end of a text may be shorter; texts and lines of any length are compared whole; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import text_of

THRESHOLD = 0.8

# Names and notices of common licences.
NAMES = {
    "Apache-2.0": "Apache License, Version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC0-1.0": "CC0 1.0 Universal",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "ISC": "ISC License",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "MIT": "MIT License",
    "MPL-2.0": "Mozilla Public License, version 2.0",
}
PHRASES = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}")
# Licence texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation,
Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see
http://www.gnu.org/licenses/.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}


def templates() -> list[tuple[str, str]]:
    """``(licence, text)``: every notice and every licence text."""
    notices = [(key, phrase.format(name)) for key, name in NAMES.items() for phrase in PHRASES]
    return notices + list(TEXTS.items())


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template, by the same rule as those of a text."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bigram_sets(table: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """``(licence, bigrams)`` without repeated pairs or templates of one word, by licence."""
    distinct = {(key, tuple(template_bigrams(text))) for key, text in table}
    return sorted((key, list(grams)) for key, grams in distinct if grams)


def window_templates(table: list[tuple[str, str]], threshold: float) -> list[tuple[str, list[str], int, int]]:
    """``(licence, bigrams, words, need)``: the words of each template and how many of its bigrams a window must hold."""
    words = {key: set() for key, _ in table}
    for key, text in table:
        found = re.findall(r"[a-z0-9]+", text.lower())
        words[key].add((tuple(template_bigrams(text)), len(found)))
    share = threshold / (2 - threshold) * (1 - 1e-9)
    return sorted(
        (key, list(grams), n, math.ceil(share * len(grams))) for key, sizes in words.items() for grams, n in sizes if grams
    )


def anchors(grams: list[str], need: int) -> list[str]:
    """Bigrams of a template of which every window that holds ``need`` has one; long ones, as they are rare."""
    return sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - need + 1]


def _windows(fit: Column, table: list[tuple[str, list[str], int, int]], known: list[str], threshold: float) -> list[Column]:
    """Columns to be selected one after another over ``words``' bigrams ``grams`` and the known ones among them, ``shared``."""
    rare = sorted({a for _, grams, _, need in table for a in anchors(grams, need)})
    entry = "array<struct<license:string,grams:array<string>,words:int,need:int>>"
    all_of = F.array(*[
        F.struct(F.lit(k).alias("license"), F.lit(g).alias("grams"), F.lit(w).alias("words"), F.lit(n).alias("need"))
        for k, g, w, n in table
    ])
    possible = F.when(
        fit & F.exists("shared", lambda g: g.isin(rare)),
        F.filter(all_of, lambda t: F.size(F.array_intersect(F.col("shared"), t["grams"])) >= t["need"]),
    ).otherwise(F.array().cast(entry))
    gram = lambda i: F.get(F.col("grams"), i - 1)
    at = F.when(
        F.size("possible") > 0, F.filter(F.sequence(F.lit(1), F.size("grams")), lambda i: gram(i).isin(known))
    ).otherwise(F.array().cast("array<int>"))
    placed = F.transform(
        "possible",
        lambda t: F.struct(
            t["license"].alias("license"), t["grams"].alias("grams"), t["words"].alias("words"), t["need"].alias("need"),
            F.filter("at", lambda i: F.array_contains(t["grams"], gram(i))).alias("at"),
        ),
    )
    starts = F.transform(
        "placed",
        lambda t: F.struct(
            t["license"].alias("license"), t["grams"].alias("grams"), t["words"].alias("words"),
            # A place and the need-th known bigram from it lie in one window; repeats of a bigram only let more through.
            F.filter(
                t["at"], lambda p, j: F.get(t["at"], j + t["need"] - 1) - p <= t["words"] - 2
            ).alias("starts"),
        ),
    )

    def score(t: Column, p: Column) -> Column:
        window = F.slice(F.col("grams"), p, t["words"] - 1)
        both = F.size(F.array_intersect(window, t["grams"]))
        return F.struct(
            (-2.0 * both / (F.size(F.array_distinct(window)) + F.size(t["grams"]))).alias("minus"),
            (-t["words"]).alias("minus_words"), t["license"].alias("license"), p.alias("word"),
        )

    best = F.transform("starts", lambda t: F.array_min(F.transform(t["starts"], lambda p: score(t, p))))
    hits = F.array_distinct(F.filter("windows", lambda b: b["minus"] <= -threshold))
    overlap = lambda x, y: (x["word"] < y["word"] - y["minus_words"]) & (y["word"] < x["word"] - x["minus_words"])
    alone = F.filter("found", lambda x: ~F.exists("found", lambda y: (y < x) & overlap(x, y)))
    return [c.alias(n) for c, n in ((possible, "possible"), (at, "at"), (placed, "placed"), (starts, "starts"), (best, "windows"), (hits, "found"), (alone, "found"))]


def _words(unit: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(unit), r"[^a-z0-9]+", " "))
    return F.split(plain, " ")


def scan(
    docs: DataFrame, table: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, unit, license, dice, word)``: what reaches ``threshold``.

    Unit 0 is the whole text, unit ``n`` its line ``n``, each with its best template. Unit -1 are windows of the text, of each
    template the best one unless it overlaps a better window, from word ``word`` (from 1; null elsewhere).
    """
    table = templates() if table is None else table
    sets = bigram_sets(table)
    known = sorted({g for _, grams in sets for g in grams})
    least, most = min(len(g) for _, g in sets), max(len(g) for _, g in sets)
    # With slack for rounding: a size that reaches the threshold exactly stays in, the coefficient itself decides.
    low, high = threshold / (2 - threshold) * (1 - 1e-9), (2 - threshold) / threshold * (1 + 1e-9)

    # No filter below: a filter on a derived column would be moved below it and compute it
    # anew for every element. Each step is a column that is empty where the unit is out already.
    text, nothing = text_of(text_col), F.array().cast("array<string>")
    units = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.posexplode_outer(F.concat(F.array(text), F.split(text, "\n"))).alias("unit", "part"),
    ).select("doc_id", "unit", _words(F.col("part")).alias("words"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda i: F.concat_ws(" ", F.get(F.col("words"), i - 1), F.get(F.col("words"), i)),
    )
    # A unit of w words has at most w - 1 bigrams.
    fits = (F.size("words") >= 2) & (F.size("words") - 1 >= least * low)
    units = units.select("doc_id", "unit", F.when(fits, pairs).otherwise(nothing).alias("grams"))
    units = units.select("doc_id", "unit", "grams", F.array_distinct(F.filter("grams", lambda g: g.isin(known))).alias("shared"))
    # Even the smallest fitting template needs this many bigrams in common.
    enough = F.size("shared") >= threshold / 2 * (1 + low) * least
    units = units.select("doc_id", "unit", "grams", "shared", F.when(enough, F.size(F.array_distinct("grams"))).alias("n"))
    candidates = F.filter(
        F.array(*[F.struct(F.lit(key).alias("license"), F.lit(grams).alias("grams")) for key, grams in sets]),
        lambda t: (F.size(t["grams"]) >= F.col("n") * low) & (F.size(t["grams"]) <= F.col("n") * high),
    )
    scored = F.transform(
        candidates,
        lambda t: F.struct(
            (-2.0 * F.size(F.array_intersect(F.col("shared"), t["grams"])) / (F.col("n") + F.size(t["grams"]))).alias("minus"),
            t["license"].alias("license"),
        ),
    )
    fitting = (F.col("n") <= most * high) & (2 * F.size("shared") >= threshold * (1 + low) * F.col("n"))
    units = units.select("doc_id", "unit", "grams", "shared", F.when(fitting, F.array_min(scored)).alias("best"))
    for column in _windows(F.col("unit") == 0, window_templates(table, threshold), known, threshold):
        units = units.select(*[c for c in units.columns if c != "found"], column)
    rows = F.concat(
        F.transform(
            F.filter(F.array("best"), lambda b: b["minus"] <= -threshold),
            lambda b: F.struct(F.col("unit").alias("unit"), b["license"].alias("license"), b["minus"].alias("minus"), F.lit(None).cast("int").alias("word")),
        ),
        F.transform(
            "found",
            lambda b: F.struct(F.lit(-1).alias("unit"), b["license"].alias("license"), b["minus"].alias("minus"), b["word"].alias("word")),
        ),
    )
    hits = units.select("doc_id", F.explode_outer(rows).alias("hit")).where("hit IS NOT NULL")
    return hits.select("doc_id", "hit.unit", "hit.license", (-F.col("hit.minus")).alias("dice"), "hit.word")
