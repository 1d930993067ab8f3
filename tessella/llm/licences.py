"""Operator 1: licence scan by sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor folder.

Notices are lines that mention licensing, and the whole text of a file that is named like a licence file. Equal notices are
compared once. Vectors are sparse (notice, term, weight) rows, the product with the templates is a join on terms; the
template table is a constant of this module, so its terms are broadcast. Notices that a bound of their length rules out are not weighed. A folder has the licence of its licence files; a file without a notice of its own
gets that of the nearest folder above it: distinct folders are joined with their ancestors' paths, files with their folder.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.storage import staged

# Usual short notices of public licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under the MIT license. See LICENSE file in the project root for full license information."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GPL version 2."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "Licensed under the GPL version 3."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Creative Commons Zero CC0 1.0 Universal Public Domain Dedication"),
]
#: What a notice of a licence has to name, whatever its cosine: a usual wording with another licence's name is not a match.
NAMES = {
    "MIT": r"\bmit\b|permission is hereby granted, free of charge", "Apache-2.0": r"apache", "GPL-2.0": r"^(?!.*(lesser|affero)).*(general public|\bgpl).*2", "GPL-3.0": r"^(?!.*(lesser|affero)).*(general public|\bgpl).*3",
    "LGPL-2.1": r"(lesser|lgpl).*2\.1", "LGPL-3.0": r"(lesser|lgpl).*3", "AGPL-3.0": r"affero|agpl", "MPL-2.0": r"mozilla|\bmpl", "BSD-3-Clause": r"\bbsd|redistribution and use", "BSD-2-Clause": r"\bbsd|redistribution and use",
    "ISC": r"\bisc\b|permission to use, copy, modify", "CC-BY-4.0": r"^(?!.*(-nc|-sa|-nd|commercial|sharealike|deriv)).*(\bcc.by|attribution)", "CC-BY-SA-4.0": r"^(?!.*(-nc|commercial)).*(by-sa|sharealike)", "CC-BY-NC-4.0": r"^(?!.*(-sa|sharealike|-nd|deriv)).*(by-nc|noncommercial)",
    "CC0-1.0": r"cc0|creative commons zero", "Unlicense": r"unencumbered|unlicense", "all-rights-reserved": r"all rights reserved",
}
SPDX = r"(?i)SPDX-License-Identifier:\s*\(?([a-z0-9.+-]*[a-z0-9+](?: +(?:OR|AND|WITH) +[a-z0-9.+-]*[a-z0-9+])*)"
#: A line that does no more than point to the licence file of the tree: such a file inherits.
POINTER = r"(?i)^\W*(please )?(see|refer to) (the )?(accompanying |top-level |root )?(licen[cs]e|copying)\b[^,;:]*$"
TRIGGER = r"(?i)licen[cs]e|rights reserved|public domain|permission is hereby|redistribution and use|SPDX"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([._-][^/]*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def _terms(col: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(col)), F.lit(TERM), F.lit(0))


def _weights(units: DataFrame, idf: DataFrame, unseen: float, key: str) -> DataFrame:
    """key, term, w: term counts times inverse frequencies."""
    tf = units.select(key, F.explode(_terms("notice")).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return tf.join(idf, "term", "left").select(key, "term", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("w"))


def _norms(w: DataFrame, key: str) -> DataFrame:
    return w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def _template_terms(spark: SparkSession, idf: DataFrame, unseen: float) -> tuple[DataFrame, DataFrame]:
    """(template, licence) and (template, term, tw): each term's weight in a template of length one, times the term's inverse frequency."""
    templates = spark.createDataFrame([(i, lic, t) for i, (lic, t) in enumerate(TEMPLATES)], "template int, licence string, notice string")
    vocabulary = templates.select(F.explode(_terms("notice")).alias("term")).distinct()
    idf = F.broadcast(idf.join(F.broadcast(vocabulary), "term", "left_semi"))  # a row for each word of the templates at most
    w = _weights(templates, idf, unseen, "template")
    unit = w.join(_norms(w, "template"), "template").join(idf, "term", "left")
    return templates.select("template", "licence"), unit.select("template", "term", (F.col("w") / F.col("norm") * F.coalesce("idf", F.lit(unseen))).alias("tw"))


def _best(units: DataFrame, threshold: float) -> DataFrame:
    """unit, licence, minus (the negative score) of the notices (unit, notice, n) whose cosine to a template that they name is at threshold or above.

    Products with the templates need no counts of terms, as they are sums over occurrences, and only the templates' words, which are
    broadcast. A vector's length is at least occurrences / sqrt(distinct terms), as no inverse frequency is below 1: the exact length is
    computed for the notices only that this bound leaves, so long texts' terms aren't shuffled.
    """
    spark = units.sparkSession
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    unseen = math.log(1.0 + total) + 1.0
    seen = units.where("n > 0").select("n", F.explode(F.array_distinct(_terms("notice"))).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    idf = staged(seen.select("term", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "idf")
    templates, t = _template_terms(spark, idf, unseen)
    each = units.select("unit", F.explode(_terms("notice")).alias("term"))
    raw = each.join(F.broadcast(t), "term").groupBy("unit", "template").agg(F.sum("tw").alias("raw")).join(F.broadcast(templates), "template")
    least = units.select("unit", (F.size(_terms("notice")) / F.sqrt(F.greatest(F.size(F.array_distinct(_terms("notice"))), F.lit(1)))).alias("least"))
    left = staged(raw.join(least, "unit").where(F.col("raw") >= (threshold - 1e-6) * F.col("least")).select("unit", "licence", "raw"), "compared")
    norm = _norms(_weights(units.join(left, "unit", "left_semi"), idf, unseen, "unit"), "unit")
    near = staged(left.join(norm, "unit").withColumn("score", F.round(F.col("raw") / F.col("norm"), 9)).where(F.col("score") >= threshold), "near_templates")
    lower = F.regexp_replace(F.lower("notice"), r"\s+", " ")
    names = F.explode(F.array_compact(F.array(*(F.when(F.regexp_like(lower, F.lit(r)), F.lit(name)) for name, r in NAMES.items()))))
    scored = near.join(units.join(near, "unit", "left_semi").select("unit", names.alias("licence")), ["unit", "licence"], "left_semi")
    return scored.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("b")).select("unit", "b.licence", "b.minus")


def licence_scan(files: DataFrame, threshold: float = 0.45, file_share: float = 0.25) -> DataFrame:
    """One row per row of files (file_id, path, text): file_id, path, licence, origin (header, inherited, none), score, source_path.

    A file's own licence is that of its notice with the highest cosine, at threshold or above (ties: by licence name), among the licences that
    the notice names (NAMES). Notices are lines, and paragraphs of several lines without their comment marks; inverse frequencies come from lines
    and licence files. An SPDX tag states its licence, with score 1, whether there are templates of it or not. A file with a notice of its own
    that matches nothing inherits nothing, unless all its notices only point to a licence file.
    Licence files, which give their folder its licence, are files named like one and files whose matching notices hold at least file_share of
    their words; of several in a folder the highest score counts, then the smaller licence, then the smaller path. Null
    and empty texts have no notice; a null path has no folder and inherits nothing. Repeated rows stay and count once; rows that share
    id and path but not the text are files of their own; other columns are ignored; an empty table gives an empty one.
    """
    spark = files.sparkSession
    docs = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("version", F.xxhash64("text"))
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    hit = docs.where(F.col("text").rlike(TRIGGER) | (named & (F.col("text") != "")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(TRIGGER))
    # a paragraph ends at a blank line, one of comment marks only, and where a comment ends
    parted = F.regexp_replace("text", r"(?m)^([ \t]*(?://|#|\*|--|;|%).*)\n(?=[ \t]*[^ \t\n/#*;%-])", "$1\n\n")
    joined_ = F.transform(F.split(parted, r"\n[ \t\r/*#;!%<>-]*(?=\n)"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s*\n[ \t/*#;!%>-]*", "\n")))
    blocks = F.transform(F.filter(joined_, lambda x: x.rlike(TRIGGER) & x.contains("\n")), lambda x: F.regexp_replace(x, r"\n", " "))
    notices = F.when(named, F.array_union(lines, F.array("text"))).otherwise(lines)
    kinds = F.concat(F.transform(notices, lambda x: F.struct(F.lit(0).alias("kind"), x.alias("notice"))), F.transform(blocks, lambda x: F.struct(F.lit(1).alias("kind"), x.alias("notice"))))
    notice = F.col("x.notice")
    tag = F.regexp_replace(F.regexp_extract(notice, SPDX, 1), r"(?i)(-only|-or-later|\+)(?= |$)", "")
    found = staged(
        hit.select("file_id", "path", "version", named.alias("named"), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("n_words"), F.posexplode(kinds).alias("at", "x"))
        .select("file_id", "path", "version", "named", "n_words", "at", "x.kind", notice.alias("notice"), F.unhex(F.md5(notice)).alias("unit"), F.size(_terms("x.notice")).alias("n_terms"),
                ((F.col("x.kind") == 0) & ~notice.rlike(POINTER)).alias("states"), tag.alias("tag"), notice.rlike("(?i)SPDX-License-Identifier").alias("tagged")), "notices")
    units = staged(found.groupBy("unit", "notice").agg(F.sum(1 - F.col("kind")).alias("n")), "units")
    best = _best(units, threshold).withColumnsRenamed({"licence": "near", "minus": "near_minus"})
    known = found.drop("notice").dropDuplicates(["file_id", "path", "version", "at"]).join(best, "unit", "left").withColumns({
        "licence": F.when(F.col("tag") != "", F.col("tag")).otherwise(F.when(~F.col("tagged"), F.col("near"))),
        "minus": F.when(F.col("tag") != "", -1.0).otherwise(F.col("near_minus")),
    })
    matched = lambda kind: F.sum(F.when(F.col("licence").isNotNull() & (F.col("kind") == kind), F.col("n_terms")).otherwise(0))
    own = (
        known.groupBy("file_id", "path", "version").agg(
            F.min(F.when(F.col("licence").isNotNull(), F.struct("minus", "licence"))).alias("b"), F.max("named").alias("named"),
            F.greatest(matched(0), matched(1)).alias("n_terms"), F.max("n_words").alias("n_words"), F.max("states").alias("stated"))
        .select("file_id", "path", "version", F.col("b.licence").alias("own"), (-F.col("b.minus")).alias("own_score"), "stated",
                (F.col("b").isNotNull() & (F.col("named") | (F.col("n_terms") >= file_share * F.col("n_words")))).alias("gives"))
    )
    own = staged(own, "own")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    given = (
        own.where("gives AND path IS NOT NULL").withColumn("folder", folder)
        .groupBy("folder").agg(F.min(F.struct((-F.col("own_score")).alias("minus"), F.col("own").alias("licence"), F.col("path"))).alias("g"))
    )
    folders = docs.where("path IS NOT NULL").select(folder.alias("folder")).distinct()
    depth = F.size(F.split("folder", "/"))
    up = folders.select("folder", F.explode(F.concat(F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(F.split("folder", "/"), 1, i), "/")), F.array(F.lit("")))).alias("ancestor"))
    near = staged(
        up.distinct().join(given.withColumnRenamed("folder", "ancestor"), "ancestor")
        .groupBy("folder").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "g")).alias("x")).select("folder", "x.g"), "near"
    )  # written, so that the join below has plain sides: a hot folder's files can be split among tasks
    ids = F.col("path").eqNullSafe(F.col("own_path")) & F.col("file_id").eqNullSafe(F.col("own_id")) & (F.col("version") == F.col("own_version"))
    joined = (
        docs.select("file_id", "path", "version", folder.alias("folder"))
        .join(own.select(F.col("file_id").alias("own_id"), F.col("path").alias("own_path"), F.col("version").alias("own_version"), "own", "own_score", "stated"), ids, "left").join(near, "folder", "left")
        .withColumn("g", F.when(F.col("own").isNotNull() | ~F.coalesce("stated", F.lit(False)), F.col("g")))
    )
    return joined.select(
        "file_id", "path", F.coalesce("own", "g.licence").alias("licence"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("g").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.coalesce("own_score", -F.col("g.minus")).alias("score"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("g.path")).alias("source_path"),
    )
