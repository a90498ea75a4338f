"""Licence scans: sparse TF-IDF cosine of headers, notices and licence texts to templates, then inheritance from the nearest directory above.

All of it is DataFrame operations. Texts with a licence word are taken once each, however many rows hold them; their terms are exploded and joined to the templates' sparse weights, so
that the work is linear in the terms. Inheritance joins directories, not files, to the directories above them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequarry.llm import shared

# Notices and opening sentences by which licences are known.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("proprietary", "All rights reserved"),
    ("proprietary", "Copyright. All rights reserved"),
)
# A text with a notice has one of these, in lower case; and the names licence files go by.
ANCHORS = ("licen", "copyright", "rights reserved", "public domain", "redistribut", "hereby granted", "spdx", "mpl", "software is provided")
SPDX = r"(?i)spdx-license-identifier:[ \t]*(\(?[a-z0-9][a-z0-9.+-]*\)?(?:[ \t]+(?:and|or|with)[ \t]+\(?[a-z0-9][a-z0-9.+-]*\)?)*)"
FILE_NAME = r"(?i)^(un)?licen[cs]e([._-].*)?$|^copying([._-].*)?$|^notice(\.(txt|md))?$"
#: Directories under a licence file, or windows near a template, that are broadcast at most.
DIRECTORIES = 1 << 16
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def idf(docs: DataFrame, vocabulary: list[str], text_column: str = "text") -> tuple[dict[str, float], float]:
    """Smoothed inverse document frequencies of the templates' terms over all documents (a row per term reaches the driver), and that of a term no document has.

    Terms foreign to all templates weigh as the rarest: they only lengthen a notice's vector."""
    words = F.array(*map(F.lit, vocabulary))
    hits = docs.select(F.explode(F.array_intersect(_terms(F.col(text_column)), words)).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    n, df = docs.count(), {r["term"]: r["n"] for r in hits}
    weigh = lambda k: math.log((1 + n) / (1 + k)) + 1
    return {t: weigh(df.get(t, 0)) for t in vocabulary}, weigh(0)


def vectors(weights: dict[str, float], templates: tuple[tuple[str, str], ...]) -> list[tuple[str, dict[str, float]]]:
    """Unit TF-IDF vectors of the templates."""
    out = []
    for name, text in templates:
        v = {t: c * weights[t] for t, c in Counter(terms_of(text)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append((name, {t: x / size for t, x in v.items()}))
    return out


def _anchored(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(reduce(or_, (low.contains(a) for a in ANCHORS)), F.lit(False))


def nearest(texts: DataFrame, weights: dict[str, float], rare: float, templates: tuple[tuple[str, str], ...], least: float) -> DataFrame:
    """id, score, license: of each distinct text (id, terms), the licence of the nearest template, where its cosine is `least` or more.

    A template can be near only to a text whose terms carry enough of its weight; others are left out first. It then meets the windows that begin at one of its terms and reach as far
    as it is long, or half as far again, up to its last term in them. Every window gets the bound that its cosine would have if no term came twice, by sums over the
    window; the window of the highest bound (the first of these) is the template's, and its cosine is counted term by term. Licences go before "proprietary", then the score, the
    longer template and the last name. The work is linear in the terms times the length of the longest template; a text's terms meet in one task, row by row."""
    spark = texts.sparkSession
    size = [len(terms_of(x)) for _, x in templates]
    laws = F.broadcast(spark.createDataFrame([(k, name, n) for k, ((name, _), n) in enumerate(zip(templates, size))], "law int, license string, size int"))  # a row per template
    posted = [(t, k, x) for k, (_, v) in enumerate(vectors(weights, templates)) for t, x in v.items()]
    postings = F.broadcast(spark.createDataFrame(posted, "term string, law int, share double"))  # a row per term of a template
    known = F.broadcast(spark.createDataFrame(sorted(weights.items()), "term string, weight double"))  # a row per term
    # terms that no template has all weigh alike, so only the others need rows
    each = texts.select("id", F.posexplode("terms").alias("pos", "term")).join(known, "term")
    more = F.sum(F.col("weight") * F.col("weight") - rare * rare).over(Window.partitionBy("id").orderBy("pos"))
    each = shared.staged(each.withColumn("upto", more + (F.col("pos") + 1) * F.lit(rare * rare)), "license-terms")
    held = texts.select("id", F.explode(F.array_distinct("terms")).alias("term")).join(postings, "term")
    able = held.groupBy("id", "law").agg(F.sum(F.col("share") * F.col("share")).alias("s")).where(F.col("s") >= least * least - 1e-9).select("id", "law")
    able = shared.staged(able, "license-able")
    met = each.join(postings, "term").join(able, ["id", "law"]).join(laws, "law")
    met = met.withColumn("reach", F.explode(F.array(F.col("size"), F.col("size") + F.floor(F.col("size") / 2).cast("int") + 1)))
    over = "OVER (PARTITION BY id, law, reach ORDER BY pos / reach RANGE BETWEEN CURRENT ROW AND 0.9999999D FOLLOWING)"
    windows = met.select("id", "law", "pos", F.expr(f"max(pos) {over}").alias("last"), (F.expr(f"sum(weight * share) {over}") / F.sqrt(F.expr(f"max(upto) {over}") - F.col("upto") + F.col("weight") * F.col("weight"))).alias("bound"))
    windows = windows.where(F.col("bound") >= least - 1e-9).groupBy("id", "law").agg(F.max(F.struct("bound", (-F.col("pos")).alias("at"), "last")).alias("w"))
    windows = shared.staged(windows.select("id", "law", (-F.col("w.at")).alias("pos"), F.col("w.last").alias("last")), "license-windows")
    windows = F.broadcast(windows) if windows.count() <= DIRECTORIES else windows
    inside = texts.join(windows, "id").select("id", "law", F.explode(F.slice("terms", F.col("pos") + 1, F.col("last") - F.col("pos") + 1)).alias("term"))
    counted = inside.groupBy("id", "law", "term").agg(F.count("*").alias("n")).join(known, "term", "left").join(postings, ["law", "term"], "left")
    counted = counted.select("id", "law", (F.col("n") * F.coalesce("weight", F.lit(rare))).alias("x"), F.coalesce("share", F.lit(0.0)).alias("share"))
    scored = counted.groupBy("id", "law").agg(F.least(F.lit(1.0), F.sum(F.col("x") * F.col("share")) / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("score")).where(F.col("score") >= least)
    best = scored.join(laws, "law").groupBy("id").agg(F.max(F.struct((F.col("license") != "proprietary").alias("named"), "score", "size", "license")).alias("b"))
    return best.select("id", "b.score", "b.license")


def scan(files: DataFrame, path_column: str = "path", text_column: str = "text", least: float = 0.75, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """All rows and columns of files with license, license_score, license_basis and license_from.

    The first SPDX identifier of a text names its licence as it is written, with score 1. Otherwise the nearest template of cosine `least` or more to a window of its words, across lines and
    within long ones, names the licence (see nearest; "file" where the file has a licence file's name, else "notice"); texts without any of ANCHORS have none. A row without one takes that of the
    nearest directory at or above its own that holds a licence file ("inherited", license_from is the directory); several such files in one directory: the highest score, then the last name.
    All else, null texts and null paths among it, has null in these columns. Paths are parted by "/". Rows alike are scored alike. Columns of these names are
    replaced. An empty table gives an empty result."""
    files = files.drop("license", "license_score", "license_basis", "license_from")
    vocabulary = sorted({t for _, text in templates for t in terms_of(text)})
    weights, rare = idf(files, vocabulary, text_column)
    text, path = F.coalesce(F.col(text_column), F.lit("")), F.col(path_column)
    key = F.when(_anchored(text), F.md5(text))
    texts = files.select(key.alias("key"), text.alias("text")).where("key is not null").groupBy("key").agg(F.first("text").alias("text"))
    texts = shared.staged(texts.select("key", F.monotonically_increasing_id().alias("id"), _terms(F.col("text")).alias("terms"), F.regexp_extract("text", SPDX, 1).alias("spdx")), "license-texts")
    near = nearest(texts.where("spdx = ''").select("id", "terms"), weights, rare, templates, least)
    near = near.join(texts.select("id", "key"), "id").select("key", "score", "license")
    best = shared.staged(near.union(texts.where("spdx != ''").select("key", F.lit(1.0).alias("score"), F.col("spdx").alias("license"))), "license-best")
    best = best.select(F.col("key").alias("lq_at"), F.struct("score", "license").alias("lq_best"))
    is_file = F.coalesce(F.element_at(F.split(path, "/"), -1).rlike(FILE_NAME), F.lit(False))
    named = files.withColumns({"lq_file": is_file, "lq_dir": F.regexp_extract(path, "^(.*)/[^/]*$", 1), "lq_key": key})
    scored = named.join(best, F.col("lq_key") == F.col("lq_at"), "left").withColumn("lq_own", F.col("lq_best").isNotNull())
    from_files = scored.where("lq_own and lq_file").groupBy("lq_dir").agg(F.max(F.struct("lq_best.score", "lq_best.license")).alias("lq_law")).select(F.col("lq_dir").alias("above"), "lq_law")
    from_files = shared.staged(from_files, "license-files")
    dirs = named.where(path.isNotNull()).select("lq_dir").distinct()
    parts = F.split("lq_dir", "/")
    ups = dirs.select("lq_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("above")).distinct()
    found = ups.join(from_files, "above").groupBy("lq_dir").agg(F.max_by(F.struct("lq_law", "above"), F.length("above")).alias("lq_near")).withColumnRenamed("lq_dir", "lq_of")
    found = shared.staged(found, "license-dirs")  # few enough for every task, or joined by an exchange whose hot directories Spark can split
    found = F.broadcast(found) if found.count() <= DIRECTORIES else found
    out = scored.join(found, ~F.col("lq_own") & path.isNotNull() & (F.col("lq_dir") == F.col("lq_of")), "left")
    pick = lambda a, b: F.when(F.col("lq_own"), a).otherwise(b)
    return out.select(
        *files.columns,
        pick(F.col("lq_best.license"), F.col("lq_near.lq_law.license")).alias("license"),
        pick(F.col("lq_best.score"), F.col("lq_near.lq_law.score")).alias("license_score"),
        F.when(F.col("lq_own"), F.when(F.col("lq_file"), "file").otherwise("notice")).when(F.col("lq_near").isNotNull(), "inherited").alias("license_basis"),
        pick(F.lit(None).cast("string"), F.col("lq_near.above")).alias("license_from"),
    )
