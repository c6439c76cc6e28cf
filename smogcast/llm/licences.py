"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables

#: A header or licence file has the licence of its best template from this cosine.
SIMILAR = 0.5

# Licence ids, the notices they are recognised by, and the words that a notice must
# hold to be that licence's (a notice may be near a template and still name another licence or version).
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3", "affero 3"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only", "agpl-3.0-only"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later", "agpl-3.0-or-later"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause", "bsd-2-clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license", "bsd-style"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License", "creative attribution 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", "cc by 4.0"),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     "creative attribution-noncommercial 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", "cc by-nc 4.0"),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
     "creative attribution-sharealike 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", "cc by-sa 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", "general 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", "general 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only", "gpl-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0-or-later"),
    ("ISC", "Released under the ISC License", "isc"),
    ("ISC", "SPDX-License-Identifier: ISC", "isc"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1", "lesser 2.1"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only", "lgpl-2.1-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3", "lesser 3"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only", "lgpl-3.0-only"),
    ("MIT", "Released under the MIT License", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
     "granted charge person obtaining"),
    ("MIT", "SPDX-License-Identifier: MIT", "mit"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense", "unlicense"),
]

# The titles that licence files open with.
TITLES = [
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", "affero 3"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", "apache 2.0"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991", "general 2"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", "general 3"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999", "lesser 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", "lesser 3"),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla 2.0"),
]
#: Words of a licence file that its title is looked for in.
OPENING = 60

_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License "
        "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} Public License for more "
        "details. You should have received a copy of the GNU {} Public License along with this program.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. {}This software is provided by the copyright holders and contributors "
        "as is and any express or implied warranties, including, but not limited to, the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright {} or "
        "contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages "
        "(including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or "
        "business interruption) however caused and on any theory of liability, whether in contract, strict liability, or "
        "tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of "
        "the possibility of such damage.")

# Whole texts that licence files and header blocks are compared with.
WHOLE = [
    *((licence, _GNU.format(kind, version, kind, kind), f"{kind.lower().split()[0]} {version}") for licence, kind, version in (
        ("AGPL-3.0", "Affero General", "3"), ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"),
        ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"))),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. The software "
            "is provided as is and the author disclaims all warranties with regard to this software including all implied "
            "warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, "
            "indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
            "whether in an action of contract, negligence or other tortious action, arising out of or in connection with the "
            "use or performance of this software.", "fee granted appear"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
                  "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
                  "software to the public domain. We make this dedication for the benefit of the public at large and to the "
                  "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
                  "perpetuity of all present and future rights to this software under copyright law. The software is provided "
                  "as is, without warranty of any kind, express or implied, including but not limited to the warranties of "
                  "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors be "
                  "liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, "
                  "arising from, out of or in connection with the software or the use or other dealings in the software. For "
                  "more information, please refer to unlicense.org", "unencumbered"),
    ("BSD-2-Clause", _BSD.format("", "holder"), "redistributions binary"),
    ("BSD-3-Clause", _BSD.format("Neither the name of the copyright holder nor the names of its contributors may be used "
                                 "to endorse or promote products derived from this software without specific prior "
                                 "written permission. ", "holder"), "redistributions binary neither endorse"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. The Software is provided as is, without warranty of any kind, express "
            "or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose "
            "and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or "
            "other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection "
            "with the Software or the use or other dealings in the Software.", "granted charge person obtaining"),
]

#: A passage as long as a template has its licence from this cosine: it isn't diluted by other words.
PASSAGE = 0.8
#: A word that passages are laid around, each as a template has it, and a comment's line.
_ANCHOR = "^(licen[cs]e[ds]?|spdx-license-identifier|permission)$"
_COMMENT = r"^\s*(#|//|/?\*|--|;|%|<!--|$)"

#: What a line must hold to be a notice.
_NOTICE = "licen[cs]e|permission is hereby granted|copyright"
_SPOKEN = r"licen[cs]e|permission\W+is\W+hereby\W+granted|copyright"
_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"


def templates(spark: SparkSession) -> DataFrame:
    return _table(spark, TEMPLATES)


def _table(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "licence string, notice string, needs string")


def _words(text: Column) -> Column:
    """Lower-cased words of letters and digits, and hyphened or dotted ones as a whole.

    Each run is one class of characters: a repeated group would need a stack as deep as the run is long.
    """
    single = F.regexp_replace(F.lower(text), F.lit("[.-][.-]+"), F.lit(" "))
    runs = F.regexp_extract_all(single, F.lit("[a-z0-9.-]+"), 0)
    return F.filter(F.transform(runs, lambda x: F.trim(x, F.lit(".-"))), lambda x: x != "")


def _weights(parts: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(kind, key, word, w): term counts by idf, each vector at unit length."""
    raw = parts.groupBy("kind", key, "word").agg(F.count("*").alias("tf")).join(idf, ["kind", "word"]).withColumn(
        "w", F.col("tf") * F.col("idf"))
    size = raw.groupBy("kind", key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, ["kind", key]).select("kind", key, "word", (F.col("w") / F.col("size")).alias("w"))


def _header(text: Column) -> Column:
    """The comment that a text starts with."""
    lines = F.split(text, "\n")
    comments = F.array_position(F.transform(lines, lambda x: F.rlike(x, F.lit(_COMMENT))), F.lit(False))
    first = F.when(comments > 1, F.array_join(F.slice(lines, 1, (comments - 1).cast("int")), " ")).when(comments == 0, text)
    return F.when(F.rlike(text, F.lit(r"^\s*/\*")), F.substring_index(text, "*/", 1)).otherwise(first)


def _passages(words: Column, places: list[tuple[int, int]]) -> Column:
    """Runs of words around each anchor: for each (anchor's place, length) of a template."""
    anchors = F.filter(F.transform(words, lambda x, i: F.when(F.rlike(x, F.lit(_ANCHOR)), i)), lambda i: i.isNotNull())
    around = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in places))
    runs = F.transform(anchors, lambda i: F.transform(around, lambda t: F.when(i >= t["p"], F.array_join(
        F.slice(words, i - t["p"] + 1, t["n"]), " "))))
    return F.array_distinct(F.filter(F.flatten(runs), lambda x: x.isNotNull()))


#: Kinds of notices: the turn in which a kind decides a file's licence, and the cosine that counts.
KINDS = {"title": (0, PASSAGE), "line": (1, SIMILAR), "whole": (1, SIMILAR), "passage": (2, PASSAGE)}


def _by_kind(values: dict[str, float], other: float = 0.0) -> Column:
    out = F.lit(other)
    for kind, value in values.items():
        out = F.when(F.col("kind") == kind, F.lit(value)).otherwise(out)
    return out


def nearest_licences(notices: DataFrame, patterns: DataFrame) -> DataFrame:
    """(kind, notice, licence, score): for each distinct notice the most similar template of its kind.

    ``notices`` are (kind, notice, text, n), told by a digest, since a whole text would
    go with each of its words; each kind is a corpus of its own.  A template with
    ``needs`` (words) counts only for notices that hold all of them, another for those
    that hold one of its words; only such pairs are compared.
    """
    parts = notices.select("kind", "notice", "n", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    known = patterns.withColumn("template", F.sha2("notice", 256))
    total = {r["kind"]: float(r["n"]) for r in notices.groupBy("kind").agg(F.sum("n").alias("n")).collect()}   # four rows
    one = known.select("kind", "licence", "template", F.explode(_words(F.col("notice"))).alias("word"))
    idf = parts.groupBy("kind", "word").agg(F.sum("n").alias("df")).join(
        one.select("kind", "word").distinct(), ["kind", "word"], "full_outer").select(
        "kind", "word", (F.log((1.0 + _by_kind(total)) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    need = known.select("kind", "template", F.array_distinct(F.coalesce(F.split("needs", " "), _words(F.col("notice")))).alias("needs"),
                        F.col("needs").isNull().alias("free"))
    need = need.select("kind", "template", F.explode("needs").alias("word"),
                       F.when(F.col("free"), 1).otherwise(F.size("needs")).alias("least"))
    pairs = parts.select("kind", "notice", "word").join(need, ["kind", "word"]).groupBy("kind", "notice", "template").agg(
        F.count("*").alias("held"), F.first("least").alias("least")).where("held >= least").select("kind", "notice", "template")
    theirs = _weights(one, "template", idf).withColumnRenamed("w", "v").join(pairs, ["kind", "template"])
    compared = notices.join(pairs.select("kind", "notice").distinct(), ["kind", "notice"], "left_semi")
    own = _weights(compared.select("kind", "notice", F.explode(_words(F.col("text"))).alias("word")), "notice", idf)
    score = own.join(theirs, ["kind", "notice", "word"]).groupBy("kind", "notice", "template").agg(
        F.round(F.sum(F.col("w") * F.col("v")), 9).alias("score")).join(known.select("kind", "template", "licence"), ["kind", "template"])
    best = score.groupBy("kind", "notice").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best"))
    return best.select("kind", "notice", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score")).where(
        F.col("score") >= _by_kind({kind: least for kind, (_, least) in KINDS.items()}))


def scan(files: DataFrame, id_col: str, text_col: str, path: Column, is_licence_file: Column | None = None,
         patterns: DataFrame | None = None) -> DataFrame:
    """(id, path, licence, score, origin, from_path) for each row of ``files``.

    Each line of a whole text that speaks of a licence is a notice; equal notices
    are compared with the templates once.  So are the words of a licence file, and
    of the comment that another text starts with, with whole licence texts; a
    licence file that opens with a licence's title has that licence.  Another file
    has the licence of its best notice or whole text (ties to the smaller licence
    id), origin ``header``.  Where there is none, that of the best passage as long
    as a template, around a word like licence wherever lines end, so a notice may
    be wrapped or stand in a long line (origin ``header`` too); else that of the
    licence file in its own or the nearest ancestor directory, origin
    ``inherited``; else none.  Of several licence files in a directory the one
    with the best score counts, ties to the smaller licence id, then path.

    A null text has no notices; a null path has no directory and inherits
    nothing; null ids and repeated rows are rows like others.  Licence files are
    those named like one unless ``is_licence_file`` says otherwise.
    """
    spark = files.sparkSession
    tables = Tables(spark, "licences")
    patterns = templates(spark) if patterns is None else patterns
    named = F.rlike(F.col("path"), F.lit(_FILE)) if is_licence_file is None else is_licence_file
    text = F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    found = files.select(F.col(f"`{id_col}`").alias("id"), path.cast("string").alias("path"), *(
        [] if is_licence_file is None else [is_licence_file.alias("named")]), text.alias("text"))
    if is_licence_file is None:
        found = found.withColumn("named", named)
    lines = F.when(F.rlike("text", F.lit(_NOTICE)), F.filter(
        F.split("text", "\n"), lambda x: F.rlike(x, F.lit(_NOTICE))))
    places = sorted({(i, len(words)) for (words,) in patterns.select(_words(F.col("notice"))).collect()   # fixed values
                     for i, x in enumerate(words) if re.match(_ANCHOR, x)})
    spoken_of = F.rlike("text", F.lit(_SPOKEN))
    is_named = F.coalesce("named", F.lit(False))
    # the words of a text that speaks of a licence are a column: what follows reads them many times
    found = found.withColumn("spoken", spoken_of).withColumn("words", F.when(F.col("spoken"), _words(F.col("text"))))
    words = F.col("words")
    titles = sorted({(i, len(w)) for _, title, _ in TITLES for w in [title.lower().replace(",", "").split()]
                     for i, x in enumerate(w) if re.match(_ANCHOR, x)})
    rows = tables.store(found.select(
        "id", "path", is_named.alias("named"),
        F.array_distinct(F.transform(lines, lambda x: F.array_join(_words(x), " "))).alias("notices"),
        F.when(F.col("spoken"), F.when(is_named, F.array_join(words, " ")).otherwise(
            F.array_join(_words(_header(F.col("text"))), " "))).alias("whole"),
        (F.when(F.col("spoken"), _passages(words, places)) if places else F.lit(None).cast("array<string>")).alias("passages"),
        F.when(F.col("spoken") & is_named, _passages(F.slice(words, 1, OPENING), titles)).alias("opening"),
        F.monotonically_increasing_id().alias("row")), "rows")

    lists = {"line": "notices", "passage": "passages", "title": "opening"}
    said = rows.where("whole is not null").select("row", F.lit("whole").alias("kind"), F.col("whole").alias("text"))
    for kind, column in lists.items():
        said = said.union(rows.where(F.size(column) > 0).select("row", F.lit(kind).alias("kind"), F.explode(column).alias("text")))
    said = said.where("text != ''").withColumn("notice", F.sha2("text", 256))
    notices = tables.store(said.groupBy("kind", "notice").agg(F.count("*").alias("n"), F.first("text").alias("text")), "notices")
    if "needs" not in patterns.columns:
        patterns = patterns.withColumn("needs", F.lit(None).cast("string"))
    known = _table(spark, WHOLE).withColumn("kind", F.lit("whole")).union(_table(spark, TITLES).withColumn("kind", F.lit("title")))
    for kind in ("line", "passage"):
        known = known.union(patterns.select("licence", "notice", "needs", F.lit(kind)))
    nearest = tables.store(nearest_licences(notices, known), "nearest")
    turn = _by_kind({kind: float(turn) for kind, (turn, _) in KINDS.items()}).alias("turn")
    own = said.select("row", "kind", "notice").join(nearest, ["kind", "notice"]).select("row", turn, "score", "licence").groupBy("row").agg(
        F.min(F.struct("turn", (-F.col("score")).alias("s"), "licence")).alias("best"))
    marked = tables.store(rows.drop("notices", "whole", "passages", "opening").join(own, "row", "left").select(
        "id", "path", "named", F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("directory"),
        F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score")), "marked")

    # licence files by directory, then each directory's nearest ancestor that has one
    holders = marked.where("named and licence is not null and path is not null").groupBy("directory").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "licence", "path")).alias("file"))
    names = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names) - 1),
                        lambda i: F.struct(i.alias("depth"), F.when(i == 0, F.lit("")).otherwise(
                            F.concat(F.array_join(F.slice(names, 1, i), "/"), F.lit("/"))).alias("directory")))
    steps = marked.select("directory").where("directory is not null").distinct().select(
        F.col("directory").alias("below"), F.explode(above).alias("step")).select("below", "step.depth", "step.directory")
    nearest_file = steps.join(holders, "directory").groupBy("below").agg(
        F.max_by("file", "depth").alias("file")).withColumnRenamed("below", "directory")
    return marked.join(nearest_file, "directory", "left").select(
        "id", "path", F.coalesce("licence", "file.licence").alias("licence"),
        F.coalesce("score", -F.col("file.s")).alias("score"),
        F.when(F.col("licence").isNotNull(), "header").when(F.col("file").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.col("file.path")).alias("from_path"))
