"""License scans by MinHash bands over overlapping word windows, then exact shingle containment. DataFrame operations only.

A template of fewer than WORDS words is one shingle of its own width, found by comparing each place's words with it.
For the others, a window has as many five-word shingles as the template it is tried for and starts at any word. Its MinHash of HASHES
values is cut into bands of ROWS; windows and templates that agree on a band are compared exactly. A window that holds
a share c of a template's n shingles has Jaccard similarity of at least c / (2 - c), two thirds for c = 0.8, and so
meets the template in a band with probability 1 - (1 - (2/3)**ROWS)**(HASHES / ROWS), over 0.9999.

A window's MinHash can equal a template's only if the shingle with that hash stands in the window. So only windows
around such shingles of the templates are hashed, which loses nothing and passes over most texts with one look a word.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm.common import materialise

WORDS, HASHES, ROWS, CONTAINED = 5, 32, 2, 0.8

# Customary wordings of public licence notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "All-rights": "All rights reserved. No part of this publication may be reproduced",
    "All-rights-reserved": "All rights reserved.",
    "MIT-terms": "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "Apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    "GPL-2.0-or-later": "either version 2 of the License, or (at your option) any later version",
    "GPL-3.0-or-later": "either version 3 of the License, or (at your option) any later version",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BSD-3-endorse": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-whole": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-whole": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "BSD-2-whole": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
        WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib-whole": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingles(w: Column) -> Column:
    """All runs of WORDS words, none if there are fewer."""
    at = F.sequence(F.lit(1), F.greatest(F.size(w) - WORDS + 1, F.lit(1)))
    return F.filter(F.transform(at, lambda i: F.array_join(F.slice(w, i, WORDS), " ")), lambda _: F.size(w) >= WORDS)


def minhash(own: Column, p: int) -> Column:
    return F.array_min(F.transform(own, lambda x: F.xxhash64(x, F.lit(p))))


def least_shingle(own: Column, p: int) -> Column:
    """The shingle that gives minhash(own, p)."""
    return F.array_min(F.transform(own, lambda x: F.struct(F.xxhash64(x, F.lit(p)).alias("h"), x.alias("s")))).getField("s")


def bands(own: Column) -> Column:
    """Array of (band, key)."""
    return F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64(*(minhash(own, b * ROWS + r) for r in range(ROWS))).alias("key")) for b in range(HASHES // ROWS)))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, own: distinct shingles, n) of templates of WORDS words or more; their number is small and fixed."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    rows = rows.select("license", F.array_distinct(shingles(words(F.col("text")))).alias("own"))
    return rows.select("license", "own", F.size("own").alias("n")).filter("n > 0")


def short_templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, phrase, width) of templates of fewer than WORDS words."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", words(F.col("text")).alias("w"))
    return rows.select("license", F.array_join("w", " ").alias("phrase"), F.size("w").alias("width")).filter(F.col("width").between(1, WORDS - 1))


def brief_places(w: Column, places: Column, width: int, known: list[str]) -> Column:
    """(start, phrase) where one of the known phrases of `width` words stands."""
    firsts = sorted({p.split(" ")[0] for p in known})
    held = F.filter(places, lambda i: F.get(w, i).isin(firsts) & F.array_join(F.slice(w, i + 1, width), " ").isin(known))
    return F.transform(held, lambda i: F.struct(i.cast("int").alias("start"), F.array_join(F.slice(w, i + 1, width), " ").alias("phrase")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, license, containment, start_word, n_windows) for each template that a text holds to `contained` or more.

    containment is that of the best window, start_word its first word from 0 (the earliest of equal ones), n_windows
    the number of windows that pass. Null and empty texts match nothing; equal rows count once; a template with fewer
    than WORDS words is held where all its words follow each other. Rows with a null doc_id are scanned like others; an
    empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates or TEMPLATES)
    brief = short_templates(spark, templates or TEMPLATES)
    phrases: dict[int, list[str]] = {}
    for r in brief.collect():
        phrases.setdefault(r.width, []).append(r.phrase)
    # The shingles that give the templates' MinHashes: at most HASHES of each.
    giving = F.array_distinct(F.array(*(least_shingle(F.col("own"), p) for p in range(HASHES))))
    pivots = table.select(F.explode(giving).alias("pivot"), "n").distinct()
    at_most = sorted({r.pivot for r in pivots.select("pivot").collect()})
    first, last = sorted({p.split(" ")[0] for p in at_most}), sorted({p.split(" ")[-1] for p in at_most})

    def hits(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0)))
        return F.filter(places, lambda i: F.get(w, i).isin(first) & F.get(w, i + (WORDS - 1)).isin(last) & F.array_join(F.slice(w, i + 1, WORDS), " ").isin(at_most))

    def brief_hits(w: Column) -> Column:
        """(start, phrase) of the short templates."""
        places = F.sequence(F.lit(0), F.size(w))
        out = [F.array().cast("array<struct<start:int,phrase:string>>")]
        for width, known in sorted(phrases.items()):
            out.append(brief_places(w, places, width, known))
        return F.concat(*out)

    # The words are bound as a lambda's variable, or they would be split anew for each place.
    found = F.transform(F.array(words(F.col("t"))), lambda w: F.struct(hits(w).alias("hits"), brief_hits(w).alias("brief")))[0]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).filter("t is not null")
    rows = rows.select("doc_id", "t", found.alias("f")).select("doc_id", "t", "f.hits", "f.brief").filter((F.size("hits") > 0) | (F.size("brief") > 0))
    rows = materialise(rows.select("doc_id", F.sha2("t", 256).alias("h"), words(F.col("t")).alias("w"), "hits", "brief").dropDuplicates(["doc_id", "h"]), "license-candidates")
    # Starts of the windows around the hits, once each, before any words are sliced: a hit's pivot tells the sizes tried.
    near = rows.select("doc_id", "h", F.explode(F.transform("hits", lambda i: F.struct(i.alias("i"), F.array_join(F.slice(F.col("w"), i + 1, WORDS), " ").alias("pivot")))).alias("x"))
    near = near.select("doc_id", "h", "x.*").join(F.broadcast(pivots), "pivot")
    starts = near.select("doc_id", "h", "n", F.explode(F.sequence(F.greatest(F.col("i") - F.col("n") + 1, F.lit(0)), F.col("i"))).alias("start"))
    starts = starts.groupBy("doc_id", "h").agg(F.collect_set(F.struct("n", "start")).alias("starts"))
    # A place's words are cut out within the row, so that a text is never copied for each of its windows.
    part = lambda x: F.struct(x.n.alias("n"), x.start.alias("start"), F.slice(F.col("w"), x.start + 1, x.n + WORDS - 1).alias("part"))
    windows = rows.select("doc_id", "h", "w").join(starts, ["doc_id", "h"]).select("doc_id", "h", F.explode(F.transform("starts", part)).alias("x")).select("doc_id", "h", "x.*")
    windows = windows.select("doc_id", "h", "n", "start", F.array_distinct(shingles(F.col("part"))).alias("held")).filter(F.size("held") > 0)
    keyed = table.select("license", "own", "n", F.explode(bands(F.col("own"))).alias("b")).select("license", "own", F.col("n"), "b.band", "b.key")
    met = windows.select("*", F.explode(bands(F.col("held"))).alias("b")).select("doc_id", "h", "n", "start", "held", "b.band", "b.key")
    met = met.join(F.broadcast(keyed), ["n", "band", "key"]).dropDuplicates(["doc_id", "h", "start", "license"])
    exact = met.withColumn("containment", F.size(F.array_intersect("own", "held")) / F.col("n")).filter(F.col("containment") >= contained)
    best = F.min(F.struct(-F.col("containment"), "start")).alias("best")
    out = exact.groupBy("doc_id", "h", "license").agg(best, F.count("*").alias("n_windows"))
    out = out.select("doc_id", "license", (-F.col("best.col1")).alias("containment"), F.col("best.start").alias("start_word"), "n_windows")
    told = rows.select("doc_id", "h", F.explode("brief").alias("x")).select("doc_id", "h", "x.start", "x.phrase").join(F.broadcast(brief), "phrase")
    told = told.groupBy("doc_id", "h", "license").agg(F.lit(1.0).alias("containment"), F.min("start").alias("start_word"), F.count("*").alias("n_windows"))
    return out.unionByName(told.drop("h"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: licence notices of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
