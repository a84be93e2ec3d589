"""Licence notices and texts, by the Dice coefficient of word bigrams; DataFrame functions only.

The whole of a text, each of its lines and, for notices that stand in a longer line or over several lines, runs of
its words are compared with templates. Two sets of bigrams can only reach a
coefficient t if the smaller has at least t / (2 - t) times the bigrams of the larger, so a unit is compared
with few templates. Most texts lack all the words of which a match must hold one, and aren't cut at all.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
MOST_TEMPLATES = 1000
_WORD = "[A-Za-z0-9]+"
#: Frequent English words, which anchor templates only if nothing else does.
FREQUENT = frozenset("a all and any are as at be by can for from has have in is it may not of on or that the this to under use with without work you your".split())

#: Public notices and short licence texts, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
)


def _let(value: Column, f) -> Column:
    """``f(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower)


def _bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words; none if there are fewer than two words."""
    at = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return _let(words, lambda ws: F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.get(ws, i - 1), F.get(ws, i)))))  # slice() would copy all words


def compiled(templates: DataFrame) -> list[tuple[str, list[str]]]:
    """Templates (license_id, text) as their bigrams. At most 1000, each a text of a few KB; more are refused."""
    rows = templates.where("license_id IS NOT NULL AND text IS NOT NULL").select("license_id", _words(F.col("text")).alias("words")).select("license_id", _bigrams(F.col("words")).alias("b"))
    found = sorted((r.license_id, sorted(r.b)) for r in rows.limit(MOST_TEMPLATES + 1).collect() if r.b)
    if len(found) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return found


def anchors(ready: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every matching unit holds at least one.

    A match shares threshold / (2 - threshold) of a template's bigrams or more, so words are taken until each template
    has fewer bigrams than that without one of them; always the word in most of the bigrams still to be covered,
    frequent words last.
    """
    left = [[b.split(" ") for b in bigrams] for _, bigrams in ready]
    needed = [threshold / (2 - threshold) * len(pairs) - 1e-9 for pairs in left]
    out: set[str] = set()
    while open_ones := [pairs for pairs, n in zip(left, needed, strict=True) if len(pairs) >= n]:
        counts = Counter(w for pairs in open_ones for p in pairs for w in {*p})
        word = min(counts, key=lambda w: (w in FREQUENT or len(w) < 2, -counts[w], w))
        out.add(word)
        left = [[p for p in pairs if word not in p] for pairs in left]
    return sorted(out)


def _apart(runs: Column) -> Column:
    """Of runs in order of preference, those that share no bigram with one preferred to them."""
    clear = lambda kept, r: ~F.exists(kept, lambda k: (k["start"] <= r["end"]) & (r["start"] <= k["end"]))
    return F.aggregate(runs, F.slice(runs, 1, 0), lambda kept, r: F.when(clear(kept, r), F.concat(kept, F.array(r))).otherwise(kept))


def _best_end(marks: Column, kind: Column, threshold: float) -> Column:
    """minus (the score) and size of the best match among the beginnings of a run of bigrams; null if none reaches ``threshold``.

    ``marks`` of the run's bigrams: 0 came before, 1 new, 2 new and in the template.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("all"), F.lit(0).alias("shared"), F.lit(0.0).alias("score"), F.lit(0).alias("size"), F.lit(0).alias("of"))

    def step(s: Column, mark: Column) -> Column:
        at, every, shared = s["at"] + 1, s["all"] + F.least(mark, F.lit(1)), s["shared"] + F.greatest(mark - 1, F.lit(0))
        score = F.when(mark == 2, 2.0 * shared / (every + kind["n"])).otherwise(0.0)
        better = score > s["score"]
        held = (F.when(better, new).otherwise(s[old]).alias(old) for old, new in (("score", score), ("size", at), ("of", shared)))
        return F.struct(at.alias("at"), every.alias("all"), shared.alias("shared"), *held)

    return _let(F.aggregate(marks, start, step), lambda s: F.when(s["score"] >= threshold, s))


def _neighbours(codes: Column) -> Column:
    """For each place (from 1) of ``codes`` the last place before it and the first after it with the same code; 0 and 2^31 - 1 without one."""
    placed = F.array_sort(F.transform(codes, lambda c, k: F.struct(c.alias("c"), (k + 1).alias("p"))))

    def linked(order: Column) -> Column:
        same = lambda x, j, none: F.coalesce(F.when(F.get(order, j)["c"] == x["c"], F.get(order, j)["p"]), F.lit(none))
        found = F.transform(order, lambda x, j: F.struct(x["p"].alias("p"), same(x, j - 1, 0).alias("before"), same(x, j + 1, (1 << 31) - 1).alias("after")))
        return F.array_sort(found)

    return _let(placed, linked)


def _runs(words: Column, kinds: Column, vocabulary: list[int], threshold: float) -> Column:
    """The runs of words, wherever they stand, that match: minus_shared, minus (the score), license_id, start, end (bigrams, from 1).

    A run that matches best begins and ends with bigrams of the template, of which it has ``need`` at least; runs of up
    to ``most`` bigrams are tried. Of runs that overlap, the best of a template stays, then that which shares most
    bigrams with its template. Bigrams are compared by a hash of 64 bits; where each one stands next is worked out once
    for the text, so that a run costs its length. Of places of the template's bigrams that follow each other, only the
    first begins a run, unless a bigram comes again near by: a run from it is better than one from the next place.
    """
    none = F.array().cast("array<struct<minus_shared:int,minus:double,license_id:string,start:int,end:int>>")
    at = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))

    def of_kind(kind: Column, codes: Column, near: Column, hits: Column) -> Column:
        def alone(p: Column) -> Column:
            return _let(F.get(near, p - 1), lambda x: (p - x["before"] > kind["most"]) & (x["after"] - p > kind["most"]))

        def dense(own: Column) -> Column:
            enough = lambda p, k: F.coalesce(F.get(own, k + kind["need"] - 1) - p < kind["most"], F.lit(False))
            follows = lambda p, k: F.coalesce(F.get(own, k - 1) == p - 1, F.lit(False)) & alone(p) & alone(p - 1)
            return F.filter(own, lambda p, k: enough(p, k) & ~follows(p, k))

        def run(p: Column, ours: Column) -> Column:
            places = F.sequence(p, F.least(p + kind["most"] - 1, F.size(ours)))  # slice() would copy the whole text for each run
            marks = F.transform(places, lambda i: _let(F.get(ours, i - 1), lambda x: F.when(x["before"] >= p, 0).otherwise(x["mark"])))
            found = _let(marks, lambda r: _best_end(r, kind, threshold))
            return _let(found, lambda s: F.when(s.isNotNull(), F.struct((-s["score"]).alias("minus"), p.alias("start"), (p + s["size"] - 1).alias("end"), s["of"].alias("of"))))

        def matches(starts: Column) -> Column:
            mark = lambda c: F.when(c.isin(vocabulary) & F.array_contains(kind["codes"], c), 2).otherwise(1)
            ours = F.zip_with(codes, near, lambda c, x: F.struct(x["before"].alias("before"), mark(c).alias("mark")))
            found = _let(ours, lambda o: F.filter(F.transform(starts, lambda p: run(p, o)), lambda r: r.isNotNull()))
            return _let(F.array_sort(F.when(F.size(starts) > 0, found).otherwise(F.array().cast("array<struct<minus:double,start:int,end:int,of:int>>"))), _apart)

        own = F.transform(F.filter(hits, lambda h: F.array_contains(kind["codes"], h["c"])), lambda h: h["p"])
        kept = _let(_let(own, dense), matches)
        return F.transform(kept, lambda r: F.struct((-r["of"]).alias("minus_shared"), r["minus"].alias("minus"), kind["license_id"].alias("license_id"), r["start"].alias("start"), r["end"].alias("end")))

    def of_text(codes: Column) -> Column:
        hits = F.filter(F.transform(codes, lambda c, k: F.struct((k + 1).alias("p"), c.alias("c"))), lambda h: h["c"].isin(vocabulary))
        every = lambda near, hs: F.flatten(F.transform(kinds, lambda kind: of_kind(kind, codes, near, hs)))
        found = _let(hits, lambda hs: F.when(F.size(hs) > 0, _let(_neighbours(codes), lambda near: every(near, hs))).otherwise(none))
        return _let(F.array_sort(found), _apart)

    codes = _let(words, lambda ws: F.transform(at, lambda i: F.xxhash64(F.get(ws, i - 1), F.get(ws, i))))
    return F.coalesce(_let(codes, of_text), none)


def _codes(spark: SparkSession, bigrams: list[str]) -> dict[str, int]:
    """The hash of each bigram, as ``_runs`` has it."""
    rows = spark.createDataFrame([(b, *b.split(" ")) for b in bigrams], "b string, first string, second string")
    return {r.b: r.c for r in rows.select("b", F.xxhash64("first", "second").alias("c")).collect()}


def scan(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, runs: bool = False) -> DataFrame:
    """doc_id, unit (0: the whole text, n: its n-th line), license_id, score: every unit that matches a template.

    ``score`` is the Dice coefficient of the sets of bigrams of ASCII words, at ``threshold`` or more; of a unit's
    templates the best is given, ties to the id that sorts first. Null, empty and wordless texts match nothing.
    Repeated rows give repeated matches; extra columns of ``docs`` are not looked at.

    With ``runs``, also runs of words that match wherever they stand, in a line or over several; their unit is -n if
    they begin with the n-th word. A run in a line or text that matches as a whole with the same license is left out.
    """
    spark = docs.sparkSession
    ready = compiled(templates if templates is not None else spark.createDataFrame(TEMPLATES, "license_id string, text string"))
    if not ready:
        return docs.select("doc_id", F.lit(0).alias("unit"), F.lit("").alias("license_id"), F.lit(0.0).alias("score")).limit(0)
    sizes = [len(b) for _, b in ready]
    narrow = threshold / (2 - threshold)
    bounds = lambda n: (F.lit(max(1, math.ceil(n * narrow - 1e-9))).alias("need"), F.lit(math.floor(n / narrow + 1e-9)).alias("most"))
    codes = _codes(spark, sorted({b for _, bigrams in ready for b in bigrams})) if runs else {}
    coded = lambda b: F.array(*(F.lit(codes[x]).cast("long") for x in b)) if runs else F.array().cast("array<bigint>")
    kinds = F.array(*(F.struct(F.lit(name).alias("license_id"), F.lit(len(b)).alias("n"), *bounds(len(b)), F.array(*map(F.lit, b)).alias("bigrams"), coded(b).alias("codes")) for name, b in ready))
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.transform(F.split(text, "\n"), lambda u, k: F.struct((k + 1).alias("unit"), _words(u).alias("words"), F.lit(None).cast("array<int>").alias("sizes"))).alias("__lines"))
    lengths = F.transform("__lines", lambda u: F.size(u["words"]))
    whole = F.struct(F.lit(0).alias("unit"), F.flatten(F.transform("__lines", lambda u: u["words"])).alias("words"), lengths.alias("sizes"))  # no word crosses lines
    held = F.array(*map(F.lit, anchors(ready, threshold)))
    units = F.filter(F.concat(F.array(whole), "__lines"), lambda u: F.arrays_overlap(u["words"], held))
    # explode_outer: for explode, Spark would push a filter with the whole expression down into the scan
    likely = lines.select("doc_id", F.explode_outer(units).alias("u")).where("u IS NOT NULL").select("doc_id", "u.unit", "u.words", "u.sizes")

    def best(b: Column) -> Column:
        """minus (the score) and license_id of the best template for a set of bigrams; null if none reaches the threshold."""
        near = F.filter(kinds, lambda t: (F.size(b) >= t["n"] * narrow) & (t["n"] >= F.size(b) * narrow))
        scored = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(b, t["bigrams"])) / (F.size(b) + t["n"])).alias("minus"), t["license_id"].alias("license_id")))
        found = _let(F.array_min(scored), lambda x: F.when(x["minus"] <= -threshold, x))
        return F.when(F.size(b).between(min(sizes) * narrow, max(sizes) / narrow), found)

    def row(unit: Column, found: Column) -> Column:
        return F.struct(unit.cast("int").alias("unit"), found["license_id"].alias("license_id"), (-found["minus"]).alias("score"))

    def loose(r: Column, over: Column) -> Column:
        """Neither the whole text, whose match is ``over``, nor the line around a run matches with the run's license."""
        def line(p: Column) -> Column:  # of the p-th word: the words before it and the number of its own
            return F.aggregate("sizes", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("own")), lambda s, n: F.when(s["sum"] + s["own"] < p, F.struct((s["sum"] + s["own"]).alias("sum"), n.alias("own"))).otherwise(s))

        def within(x: Column) -> Column:
            return (r["end"] + 1 <= x["sum"] + x["own"]) & F.coalesce(_let(_bigrams(F.slice("words", x["sum"] + 1, x["own"])), best)["license_id"] == r["license_id"], F.lit(False))

        return ~(F.coalesce(over["license_id"] == r["license_id"], F.lit(False)) | _let(line(r["start"]), within))

    own = _let(_bigrams(F.col("words")), best)
    matched = lambda x: F.when(x.isNotNull(), F.array(row(F.col("unit"), x))).otherwise(F.array().cast("array<struct<unit:int,license_id:string,score:double>>"))
    found = _let(own, matched)
    if runs:
        vocabulary = sorted(codes.values())
        inside = lambda x: F.transform(F.filter(_runs(F.col("words"), kinds, vocabulary, threshold), lambda r: loose(r, x)), lambda r: row(-r["start"], r))
        found = _let(own, lambda x: F.when(F.col("unit") == 0, F.concat(matched(x), inside(x))).otherwise(matched(x)))
    return likely.select("doc_id", F.explode_outer(found).alias("m")).where("m IS NOT NULL").select("doc_id", "m.unit", "m.license_id", "m.score")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_units (runs too), licenses (distinct ids, sorted, joined by commas) and best_score of each document."""
    # by id and text, so that rows that repeat an id keep to themselves; units are counted once if a whole row repeats
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_id")).alias("doc_id"), "text")
    found = scan(keyed, runs=True).groupBy(F.col("doc_id").alias("key")).agg(F.count_distinct("unit").alias("n_units"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"), F.max("score").alias("best_score"))
    named = keyed.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("key")), "left").select("doc_id.doc_id", "n_units", "licenses", "best_score")
    return named.select("doc_id", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))
