"""License scan by MinHash bands over overlapping windows of words and exact shingle containment, in native DataFrame operations.

A license text of h words stands in a document where a window of 2h words, begun at every h-th word, holds at least
`THRESHOLD` of the text's shingles, its runs of three words; so a text of h words in a row is always whole in some
window. Windows and license texts are given `BANDS` MinHash values, each a band of its own, as a text fills only half
of its window: the threshold can be met at a Jaccard similarity of 4/13, the least of all `LICENSES`, and two such sets
have no band in common less than once in 100,000 times. A window can share a band only if it holds the shingle that gives the text its least value there, its
anchor. So only windows with an anchor are hashed, which leaves out none that shares a band. Windows that share a band
are then held against the license's shingles word by word.

Everything happens inside a document's row and nothing is shuffled.

Defined results: null and wordless texts and those of fewer than three words have no licenses; places are counted in
words; the span of a window goes from its first shingle of the license to the end of its last, and overlapping spans of
one license text are one; spans are ordered by start, then by the order of `LICENSES`; different license texts may
overlap, also of one name; repeated rows are each returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import pieces
from tessera.plans.views import spread

SHINGLE = 3
THRESHOLD = 0.8
BANDS = 32
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class License:
    """A text that grants a license or names it."""

    name: str
    text: str

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text.translate(_LOWER))

    @cached_property
    def shingles(self) -> list[str]:
        return sorted({" ".join(self.words[i : i + SHINGLE]) for i in range(len(self.words) - SHINGLE + 1)})

    @property
    def least(self) -> int:
        """How many of its shingles a window must hold."""
        return math.ceil(len(self.shingles) * THRESHOLD - 1e-9)


_AS_IS_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: The notices that name a license first, then license texts and the headers that they ask for.
LICENSES = (
    License("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    License("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    License("MIT", "Released under the MIT License."),
    License("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    License(
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    License(
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    License(
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    License(
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
        + _AS_IS_BSD,
    ),
    License(
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    License(
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    License(
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)

_SPANS = "array<struct<start:int,order:int,stop:int>>"


def _texts(values: list[str]) -> Column:
    """A constant array, as one literal: a literal for each value takes long to build."""
    return F.split(F.lit("\n".join(values)), "\n")


def _numbers(values: list[int]) -> Column:
    return _texts([str(x) for x in values]).cast("array<long>")


def _keys(words: Column) -> Column:
    """The hash of the shingle that begins at each word, as far as one does."""
    key = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    none = F.array().cast("array<long>")
    return F.when(F.size(words) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), key)).otherwise(none)


def _value(key: Column, band: Column) -> Column:
    return F.xxhash64(key, band)


def sketches(spark: SparkSession, licenses: tuple[License, ...] = LICENSES) -> list[list[tuple[int, int]]]:
    """Of each license text, for each band: its least value and its anchor, the shingle's key that has it."""
    keys = [F.transform(_texts(x.shingles), lambda s: F.xxhash64(*[F.get(F.split(s, " "), F.lit(k)) for k in range(SHINGLE)])) for x in licenses]
    least = lambda held: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(held, lambda k: F.struct(_value(k, b).alias("value"), k.alias("key")))))
    row = spark.range(1).select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).select(*[least(F.col(f"k{i}")).alias(f"b{i}") for i in range(len(keys))]).first()
    return [[(x["value"], x["key"]) for x in bands] for bands in row]


def _standing(keys: list[int]) -> Column:
    """The places at which one of these shingles begins."""
    return F.filter("at", lambda i: F.array_contains(_numbers(keys), F.get("keys", i)))


def _windows(at: Column, h: int) -> Column:
    """The windows that hold one of these places: their numbers in order."""
    both = F.flatten(F.transform(at, lambda i: F.array(F.floor(i / h).cast("int") - 1, F.floor(i / h).cast("int"))))
    return F.array_sort(F.array_distinct(F.filter(both, lambda j: j >= 0)))


def _banded(windows: Column, keys: Column, h: int, bands: list[tuple[int, int]]) -> Column:
    """Those windows that share a band with the license text."""
    least, each = _numbers([value for value, _ in bands]), F.sequence(F.lit(0), F.lit(len(bands) - 1))
    inside = lambda j: F.slice(keys, j * h + 1, 2 * h - SHINGLE + 1)
    return F.filter(windows, lambda j: F.exists(each, lambda b: F.array_min(F.transform(inside(j), lambda k: _value(k, b))) == F.get(least, b)))


def _contained(windows: Column, words: Column, license_: License, order: int) -> Column:
    """The spans of the windows that hold enough of the license text's shingles, compared as words."""
    h, shingles = len(license_.words), _texts(license_.shingles)
    shingle = lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " ")
    end = lambda j: F.least(j * h + 2 * h, F.size(words)) - SHINGLE
    places = F.transform(windows, lambda j: F.when(end(j) >= j * h, F.filter(F.sequence(j * h, end(j)), lambda i: F.array_contains(shingles, shingle(i)))).otherwise(F.array().cast("array<int>")))
    good = F.filter(places, lambda p: F.size(F.array_distinct(F.transform(p, shingle))) >= license_.least)
    spans = F.transform(good, lambda p: F.struct(F.get(p, F.lit(0)).alias("start"), F.lit(order).alias("order"), (F.element_at(p, -1) + SHINGLE).alias("stop")))

    def merged(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), last["order"].alias("order"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(done) > 0) & (last["stop"] > s["start"]), longer).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(_SPANS), lambda done, s: merged(done, s).cast(_SPANS))


def scanned(docs: DataFrame, licenses: tuple[License, ...] = LICENSES) -> DataFrame:
    """Per row: doc_id and spans (start, order of the license text, stop), ordered."""
    bands = sketches(docs.sparkSession, licenses)
    anchors = [sorted({key for _, key in of}) for of in bands]
    every = sorted({key for of in anchors for key in of})
    rows = docs.select("doc_id", F.array_remove(pieces(F.col("text")), "").alias("words"))
    rows = rows.withColumn("keys", _keys(F.col("words")))
    rows = rows.withColumn("at", F.expr(f"filter(transform(keys, (k, i) -> IF(k IN ({', '.join(map(str, every))}), i, NULL)), i -> i IS NOT NULL)"))
    none = F.array().cast(_SPANS)
    found = []
    for n, (license_, of, own) in enumerate(zip(licenses, bands, anchors, strict=True)):
        h = len(license_.words)
        banded = _banded(_windows(_standing(own), h), F.col("keys"), h, of)
        found.append(F.when(F.size("at") > 0, _contained(banded, F.col("words"), license_, n)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """One row per document: how many licenses it names or holds, and where, in words."""
    found = scanned(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    names = F.array(*[F.lit(x.name) for x in LICENSES])
    name = lambda s: F.get(names, s["order"])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", F.size(F.array_distinct(F.transform("spans", name))).cast("long").alias("n_licenses"), F.size("spans").cast("long").alias("n_spans"), text.alias("spans"))


_VALUES = ", ".join(f"({n}, '{x.name}', {len(x.words)}, {x.least}, '{s}')" for n, x in enumerate(LICENSES) for s in x.shingles)

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
v(o, name, h, least, s) AS (VALUES {_VALUES}),
p AS (SELECT rid, i - 1 AS a, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d WHERE len(w) >= {SHINGLE})),
m AS (SELECT rid, o, name, h, least, a, s, unnest([a // h - 1, a // h]) AS j FROM p JOIN v USING (s)),
f AS (SELECT rid, o, name, j, min(a) AS a, max(a) + {SHINGLE} AS e FROM m WHERE j >= 0 AND a + {SHINGLE} <= j * h + 2 * h GROUP BY rid, o, name, j, least HAVING count(DISTINCT s) >= least),
g AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY rid, o ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > a THEN 0 ELSE 1 END AS fresh FROM f),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, o ORDER BY j) AS nr FROM g),
x AS (SELECT rid, o, name, min(a) AS a, max(e) AS e FROM k GROUP BY rid, o, name, nr),
t AS (SELECT rid, count(DISTINCT name) AS n_licenses, count(*) AS n_spans, string_agg(name || ':' || CAST(a AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY a, o) AS spans FROM x GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n_licenses, 0) AS BIGINT) AS n_licenses, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (rid)
"""
