"""Find licence texts: Dice coefficient over word bigrams against templates, pruned by size bounds and rare bigrams.

Text and templates are normalised alike (lower case, anything but letters and digits is one blank), so wrapping,
comment marks and line breaks do not matter. A template with b bigrams reaches the threshold t only in a window
that holds at least b t / (2 - t) of them; so at least one of any b - ceil(b t / (2 - t)) + 1 bigrams of the
template must be there. The rarest ones serve as anchors: most documents hold none and are done. Around every
anchor the window of the template's length is laid so that the anchor has the place it has in the template,
and the window's coefficient is taken. With a bigrams in the window the coefficient is at most
2 min(a, b) / (a + b), which bounds the windows that are compared.

Defined cases: null, empty and blank texts match nothing; a window is cut at the text's ends; the best template of
a document is the one with the highest coefficient, then the first by name; repeated rows give repeated
results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import let, named, staged

THRESHOLD = 0.8

# Public licence notices and texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder "
        "nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Proprietary": "All rights reserved.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
        "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
}


def plain(text: str) -> list[str]:
    """Normalised words of a template."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams(text: str) -> list[str]:
    w = plain(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def bounds(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Fewest and most bigrams that a window can have beside a template with ``size`` of them."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


@dataclass(frozen=True)
class Template:
    """Distinct bigrams in order, the places of their first occurrence, the window's bigrams, and the anchors."""

    name: str
    grams: tuple[str, ...]
    places: tuple[int, ...]
    length: int
    anchors: tuple[str, ...]


def prepared(templates: Mapping[str, str], threshold: float = THRESHOLD) -> list[Template]:
    """Templates with the rarest bigrams as anchors: those in the fewest templates, then the longest."""
    held = Counter(g for t in templates.values() for g in set(bigrams(t)))
    out = []
    for name, text in sorted(templates.items()):
        w, grams = plain(text), bigrams(text)
        every = [f"{a} {b}" for a, b in zip(w, w[1:])]
        n_anchors = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9) + 1
        rare = sorted(grams, key=lambda g: (held[g], -len(g), g))[:n_anchors]
        out.append(Template(name, tuple(grams), tuple(every.index(g) for g in grams), len(every), tuple(rare)))
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, threshold: float = THRESHOLD,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with a licence: doc_id, licence (best), dice, n_licences (templates that are found)."""
    own = prepared(templates, threshold)
    anchors = sorted({a for t in own for a in t.anchors})
    normal = F.btrim(F.regexp_replace(F.lower(F.coalesce(named(text), F.lit(""))), r"[^a-z0-9]+", " "))
    grams = let(F.split(normal, " "), lambda w: F.transform(
        F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))
    x = docs.select(named(doc_id).alias("doc_id"), grams.alias("grams"))
    # nearly all documents end here: no anchor, no window
    x = staged(x.where(F.arrays_overlap("grams", F.lit(anchors))), "licence-candidates")

    def place_in(t: Template, i: Column) -> Column:
        return F.get(F.lit(list(t.places)), (F.array_position(F.lit(list(t.grams)), F.get(F.col("grams"), i)) - 1).cast("int"))

    def best(t: Template, hits: Column) -> Column:
        """The highest coefficient of the template's windows around its anchors among ``hits``."""
        low, high = bounds(len(t.grams), threshold)
        mine = F.filter(hits, lambda i: F.array_contains(F.lit(list(t.anchors)), F.get(F.col("grams"), i)))
        starts = F.array_distinct(F.transform(mine, lambda i: i - place_in(t, i)))

        def dice(s: Column) -> Column:
            first = F.greatest(s, F.lit(0))
            window = F.array_distinct(F.slice(F.col("grams"), first + 1, F.greatest(F.least(s + t.length, F.size("grams")) - first, F.lit(0))))
            return let(window, lambda w: F.when(F.size(w).between(low, high), F.lit(2.0) * F.size(
                F.array_intersect(w, F.lit(list(t.grams)))) / (F.size(w) + len(t.grams))))

        top = F.array_max(F.transform(starts, dice))
        return F.when(top >= threshold, F.struct(top.alias("dice"), F.lit(t.name).alias("licence")))

    few = F.array_intersect("grams", F.lit(anchors))
    hits = let(few, lambda held: F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.array_contains(held, F.get(F.col("grams"), i))))
    found = let(hits, lambda at: F.filter(F.array(*[best(t, at) for t in own]), lambda h: h.isNotNull()))
    x = x.select("doc_id", found.alias("found")).where(F.size("found") > 0)
    return x.select("doc_id", let(F.col("found"), _first).alias("b"), F.size("found").cast("bigint").alias("n_licences")).select(
        "doc_id", F.col("b.licence").alias("licence"), F.col("b.dice").alias("dice"), "n_licences")


def _first(hits: Column) -> Column:
    """The hit with the highest coefficient, then the first by name."""
    return F.aggregate(hits, F.lit(None).cast("struct<dice:double,licence:string>"),
                       lambda a, h: F.when(a.isNull() | (h["dice"] > a["dice"])
                                           | ((h["dice"] == a["dice"]) & (h["licence"] < a["licence"])), h).otherwise(a))
