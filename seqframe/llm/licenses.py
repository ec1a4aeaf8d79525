"""License scans with MinHash bands over overlapping text windows.

Templates fall into classes by length; a class reads windows of twice its length, which overlap by half,
so any passage as long as a template lies in one window whole. Only shingles that occur in a template of
the class count: others change no containment. The minima of BANDS seeded hashes of a window's shingles
are looked up among those of the templates. A band agrees with a probability of the shingles that both
have over those that either has, and of a template found at all a window of any class has 0.8: at worst
one shingle of the twelve that a window of 16 words can count, 4 of 28, 11 of 60, or more. The template is
then missed with a probability of at most (11/12) ** BANDS, 1e-5. Every template retrieved is verified by
the exact share of its shingles that the window holds.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm.scratch import written

WORDS, CONTAINMENT, BANDS = 5, 0.8, 132
#: Public licence texts and notices.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
        "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE."
    ),
    "bsd-3-clause-condition": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "lgpl-3.0-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."
    ),
    "mit-notice": "Released under the MIT License",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense-opening": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
    ),
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def stride(n_words: int) -> int:
    """The class of a template: the power of two, 8 at least, that it fits in."""
    s = 8
    while s < n_words:
        s *= 2
    return s


def template_rows(templates: dict[str, str]) -> list[tuple[str, int, str]]:
    """(license, class, shingle)"""
    out = []
    for name, text in sorted(templates.items()):
        words = template_words(text)
        if len(words) < WORDS:
            raise ValueError(f"template {name} has fewer than {WORDS} words")
        out += [(name, stride(len(words)), " ".join(words[i : i + WORDS])) for i in range(len(words) - WORDS + 1)]
    return sorted(set(out))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` and licence found: ``doc_id, license, containment, word_start, n_windows``.

    Words are runs of a-z and 0-9 after lower-casing. A licence is found where a window holds at least
    0.8 of its distinct five-word shingles; given are the best share (six digits), the first word of
    the first window that reaches it, and the number of windows that reach 0.8. Null, empty and short
    texts have none. Rows are scanned each by itself, also where they share an id or are repeated. An
    empty table gives an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    rows = template_rows(TEMPLATES if templates is None else templates)
    known = written(spark.createDataFrame(pa.table(list(zip(*rows)), names=["license", "stride", "shingle"])).withColumn("stride", F.col("stride").cast("int")).withColumn("h", F.xxhash64(F.split("shingle", " "))), "templates")
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    # the words are an element of an array and so bound once; no filter below may bring their definition back in
    shingles = F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) >= WORDS, F.transform(
        F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.struct(i.alias("p"), F.xxhash64(F.slice(w, i + 1, WORDS)).alias("h")))
    ).otherwise(F.array().cast("array<struct<p:int,h:bigint>>"))))
    # row numbers come before the explode, which would number its own rows
    at = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    at = at.select("rid", "doc_id", F.explode(shingles).alias("s")).select("rid", "doc_id", "s.p", "s.h")
    # templates are a parameter: the broadcasts have as many rows as they have shingles or bands, whatever the corpus is
    of = known.select(F.col("h").alias("of"), "stride").distinct()
    seen = at.join(F.broadcast(of), F.col("h") == F.col("of")).select(
        "rid", "doc_id", "stride", "h", F.explode(F.expr("filter(array(p div stride - 1, p div stride), j -> j >= 0 and p + 5 <= (j + 2) * stride)")).alias("win")
    )
    # a window holds at most 2 * stride shingles
    windows = written(seen.groupBy("rid", "doc_id", "stride", "win").agg(F.collect_set("h").alias("hs")), "windows")
    minima = lambda hs: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.array_min(F.transform(hs, lambda h: F.xxhash64(h, i))))
    own = known.groupBy("license", "stride").agg(F.collect_set("h").alias("ths"))
    banded = own.select(F.col("license").alias("name"), F.col("stride").alias("c"), F.posexplode(minima(F.col("ths"))).alias("b", "v"))
    found = windows.select("rid", "stride", "win", F.posexplode(minima(F.col("hs"))).alias("band", "m")).join(
        F.broadcast(banded), (F.col("stride") == F.col("c")) & (F.col("band") == F.col("b")) & (F.col("m") == F.col("v"))
    ).select(F.col("rid").alias("d"), F.col("stride").alias("t"), F.col("win").alias("u"), "name").distinct()
    # exact containment of every retrieved template
    shared = (
        windows.join(found, (F.col("rid") == F.col("d")) & (F.col("stride") == F.col("t")) & (F.col("win") == F.col("u")))
        .join(F.broadcast(own.select("license", "ths")), F.col("name") == F.col("license"))
        .select("rid", "doc_id", "license", "stride", "win", F.size(F.array_intersect("hs", "ths")).alias("both"), F.size("ths").alias("n"))
        .withColumn("share", F.round(F.col("both") / F.col("n"), 6)).where(F.col("both") >= F.lit(CONTAINMENT) * F.col("n"))
    )
    best = F.max(F.struct("share", (-F.col("win") * F.col("stride")).alias("at")))
    return shared.groupBy("rid", "doc_id", "license").agg(best.alias("best"), F.count("*").alias("n_windows")).select(
        "doc_id", "license", F.col("best.share").alias("containment"), (-F.col("best.at")).cast("long").alias("word_start"), "n_windows"
    )
