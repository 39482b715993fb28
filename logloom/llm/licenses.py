"""License scan: normalised text against licence templates by the Dice coefficient of their sets of word bigrams.

DataFrame functions only. A text's lines, and the text as a whole, are units; passages are found apart from them. A unit whose set has a bigrams can reach the
threshold t with a template of b bigrams only if t/(2-t) <= a/b <= (2-t)/t and it shares t/(2-t) of the template's bigrams; and to reach it with any template at all, it must have
t/(2-t) of its bigrams among those of all templates. Both bounds are checked before any Dice coefficient is worked out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices and short licence texts that name or grant a licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Licensed under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

NOT_WORD = r"[^\p{L}\p{N}]+"


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted(set(map(" ".join, zip(words, words[1:]))))


def keys(grams: list[str], low: float) -> list[str]:
    """Words and bigrams of which a text must hold one to share the part `low` of a template's bigrams.

    What holds none of them shares only bigrams that no key touches, and these are too few. Long words come first.
    """
    left, spare, out = set(grams), math.ceil(len(grams) * low - 1e-9) - 1, []
    words = sorted({w for g in grams for w in g.split() if len(w) > 6}, key=lambda w: (-sum(w in g.split() for g in grams), w))
    for k in [*words, *sorted(grams, key=lambda g: (-len(g), g))]:
        if len(left) <= spare:
            break
        touched = {g for g in left if g == k or k in g.split()}
        if touched:
            out.append(k)
            left -= touched
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def _every(made: dict[str, list[str]]) -> Column:
    return F.array(*[F.lit(x) for x in sorted({y for x in made.values() for y in x})]) if made else F.array().cast("array<string>")


def _hopeful(docs: DataFrame, made: dict[str, list[str]], low: float, text_col: str) -> DataFrame:
    """The rows whose text holds a key of some template; most end here. The normalised text is bound once to a lambda's variable."""
    wanted = F.array(*[F.lit(f" {k} ") for k in sorted({k for g in made.values() for k in keys(g, low)})]) if made else F.array().cast("array<string>")
    norm = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), NOT_WORD, " "), F.lit(" "))
    return docs.filter(F.exists(F.transform(F.array(norm), lambda t: F.exists(wanted, lambda k: F.contains(t, k))), lambda b: b))


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one column more that is worked out once a row: no filter or later expression is planned below an outer explode."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _best(made: dict[str, list[str]], grams: Column, n: Column, low: float, high: float) -> Column:
    """The best template of a unit by its set of bigrams, as (dice, license); dice is -1 where no template's size fits."""
    tried = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("size"), F.array(*[F.lit(x) for x in g]).alias("own")) for name, g in made.items()])
    fit = F.filter(tried, lambda t: (n >= t["size"] * low - 1e-9) & (n <= t["size"] * high + 1e-9))
    scored = F.transform(fit, lambda t: F.struct((2.0 * F.size(F.array_intersect(grams, t["own"])) / (n + t["size"])).alias("dice"), t["license"].alias("license")))
    return F.aggregate(scored, F.struct(F.lit(-1.0).alias("dice"), F.lit("").alias("license")), lambda a, x: F.when(x["dice"] > a["dice"], x).otherwise(a))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every unit that matches a template: id, line_no (from 1; 0 for a whole text of several lines), license, dice.

    Of several templates the best counts, of equal ones the first by name. Null and empty texts and units of less than two
    words match nothing; repeated rows give repeated results. templates: literals of the plan, so a list of hundreds at most;
    such of less than two words are ignored.
    """
    made = {name: found for name, text in sorted(templates.items()) if (found := bigrams(text))}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min((len(x) for x in made.values()), default=1) * low, max((len(x) for x in made.values()), default=0) * high
    every = _every(made)
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    docs = _hopeful(docs, made, low, text_col)
    # words of at least one character and a separator: a bound on the count of words that needs no splitting
    units = docs.select(F.col(id_col), F.posexplode(F.when(F.size(lines) > 1, F.concat(F.array(F.col(text_col)), lines)).otherwise(F.concat(F.array(F.lit("")), lines))).alias("line_no", "unit"))
    units = units.filter(F.length("unit") >= 2 * least + 1).withColumn("words", _words(F.col("unit")))
    units = units.filter(F.size("words") - 1 >= F.lit(least)).withColumn("grams", _bigrams(F.col("words"))).withColumn("n", F.size("grams"))
    units = units.filter((F.col("n") >= F.lit(least)) & (F.col("n") <= F.lit(most)))
    units = units.filter(F.size(F.array_intersect("grams", every)) >= F.col("n") * F.lit(low) - 1e-9)
    if not made:
        return docs.select(id_col, F.lit(0).alias("line_no"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).filter("false")
    best = _best(made, F.col("grams"), F.col("n"), low, high)
    return units.select(id_col, F.col("line_no").cast("int").alias("line_no"), best.alias("best")).filter(F.col("best.dice") >= threshold).select(id_col, "line_no", F.col("best.license").alias("license"), F.round("best.dice", 6).alias("dice"))


def scan_passages(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences that scan_licenses has no unit for: wrapped over lines of a longer text, or a sentence of a longer line.

    A passage is a run of as many words as a template has, placed so that one of the template's bigrams stands where the
    template has it (less at the ends of the text). One row for every passage: id, line_no of its first word, license, dice.
    Of passages that overlap the best stays, then the longer one, the first by name, the first in the text. A passage within
    a line that scan_licenses reports, or in a text that it reports as a whole, is left out. Otherwise as scan_licenses.
    """
    made = {name: found for name, text in sorted(templates.items()) if (found := bigrams(text))}
    if not made:
        return docs.select(id_col, F.lit(0).alias("line_no"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).filter("false")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    tried = []
    for name, g in made.items():
        w = re.sub(r"[\W_]+", " ", templates[name].lower()).split()
        places = F.array(*[F.struct(F.lit(" ".join(x)).alias("gram"), F.lit(i).alias("at")) for i, x in enumerate(zip(w, w[1:]))])
        tried.append(F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("size"), F.lit(len(w) - 1).alias("long"), F.array(*[F.lit(x) for x in g]).alias("own"), places.alias("places")))
    d = _hopeful(docs, made, low, text_col).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = _bound(d.select(id_col, "text"), "per", F.transform(F.split("text", "\n"), _words)).drop("text")
    d = _bound(d, "words", F.flatten("per")).filter(F.size("words") > 1)
    d = _bound(d, "grams", F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).drop("words")
    d = _bound(d, "shared", F.array_intersect("grams", _every(made)))
    d = _bound(d, "may", F.filter(F.array(*tried), lambda t: F.size(F.array_intersect(t["own"], F.col("shared"))) >= t["size"] * low - 1e-9)).drop("shared").filter(F.size("may") > 0)
    n = F.size("grams")

    def windows(t: Column) -> Column:
        hits = F.filter(F.transform("grams", lambda g, i: F.struct(g.alias("gram"), i.alias("at"))), lambda h: F.array_contains(t["own"], h["gram"]))
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.filter(t["places"], lambda x: x["gram"] == h["gram"]), lambda x: h["at"] - x["at"]))))
        spans = F.transform(starts, lambda s: F.struct(F.greatest(s, F.lit(0)).alias("a"), F.least(s + t["long"], n).alias("b")))

        def dice(x: Column, own: Column) -> Column:
            return F.struct((-2.0 * F.size(F.array_intersect(own, t["own"])) / (F.size(own) + t["size"])).alias("rank"), (x["a"] - x["b"]).alias("short"), t["license"].alias("license"), x["a"].alias("a"), x["b"].alias("b"))

        scored = F.flatten(F.transform(spans, lambda x: F.transform(F.array(F.array_distinct(F.slice("grams", x["a"] + 1, x["b"] - x["a"]))), lambda own: dice(x, own))))
        return F.filter(scored, lambda x: -x["rank"] >= threshold)

    d = _bound(d, "ranked", F.array_sort(F.flatten(F.transform("may", windows)))).drop("may").filter(F.size("ranked") > 0)
    # a to b are bigrams, so words a to b: a passage overlaps another if it starts at or before the other's last word
    none = F.slice("ranked", 1, 0)
    d = _bound(d, "found", F.aggregate("ranked", none, lambda kept, x: F.when(F.exists(kept, lambda y: (x["a"] <= y["b"]) & (y["a"] <= x["b"])), kept).otherwise(F.concat(kept, F.array(x)))))
    d = _bound(d, "line_of", F.flatten(F.transform("per", lambda w, i: F.array_repeat(i + 1, F.size(w)))))
    d = _bound(d, "whole", F.array_distinct("grams")).filter((F.size("per") == 1) | (_best(made, F.col("whole"), F.size("whole"), low, high)["dice"] < threshold))
    d = d.select(id_col, "per", "line_of", F.explode_outer("found").alias("x"))
    d = d.withColumn("line_no", F.element_at("line_of", F.col("x.a") + 1)).withColumn("last", F.element_at("line_of", F.col("x.b") + 1))
    d = _bound(d, "line", _bigrams(F.element_at("per", F.col("line_no"))))
    d = d.filter((F.col("last") > F.col("line_no")) | (_best(made, F.col("line"), F.size("line"), low, high)["dice"] < threshold))
    return d.select(id_col, F.col("line_no").cast("int").alias("line_no"), F.col("x.license").alias("license"), F.round(-F.col("x.rank"), 6).alias("dice"))


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of scan_licenses and of scan_passages."""
    return scan_licenses(docs, templates, threshold, id_col, text_col).unionByName(scan_passages(docs, templates, threshold, id_col, text_col))
