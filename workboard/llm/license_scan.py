"""Licence scan: TF-IDF cosine of notices to templates, inherited from the nearest directory (operator 9).

Only DataFrame functions. Files that mention a licence word are split into lines and sentences, and their paragraphs,
lines joined without comment signs, into sentences; those that hold such a word are notices. So is the comment block at
the head of such a file as a whole, and the whole text of a licence file, with or without a licence word. Notices and templates become sparse TF-IDF vectors over their words, with document frequencies
counted over all notices of the corpus and the templates; a notice's licence is the template with the highest cosine of
at least ``THRESHOLD``, a file's the best of its notices. A licence file (``LICENSE``, ``COPYING``, ...) speaks for its
directory: a file without a notice of its own inherits from the nearest ancestor directory with a licence file.

Words of a notice are joined to the template words, a table of about a thousand constant rows; all other joins are plain,
on directories or file keys, and every aggregation combines before its shuffle, so a directory, source or template with a
third of all rows spreads.

Edge cases: null, empty texts hold no notice. A null path has no directory and inherits nothing. Equal cosines go to
the alphabetically first licence. Several licence files in one directory: the one with the highest cosine, then the
alphabetically first licence. Repeated rows get equal results. An empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.llm.store import cut, small

THRESHOLD = 0.5

# Licence identifiers and the wording of their usual notices.
TEMPLATES = [
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "Copyright All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]

_PERMISSION = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
               "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
               "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
               "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
               "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
               "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
               "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
               "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
               "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
               "DEALINGS IN THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. ")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
            "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
            "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
            "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_FREE = ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
         "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
         "commercial or non-commercial, and by any means.")
# Whole bodies of licences short enough to stand in a file by themselves.
BODIES = [("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END), ("ISC", _ISC), ("MIT", _PERMISSION),
          ("Unlicense", _FREE)]

KEYWORD = "(?i)licen[sc]e|copyright|spdx|public domain|creative commons"
LICENCE_FILE = "(?i)^(un)?(licen[sc]e|copying|copyright|notice)([.-].*)?$"


def words(text: Column) -> Column:
    """Lower-case words of letters, digits, dots, plus and minus signs, without dots at their ends."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9.+-]*"), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.regexp_replace(w, "[.-]+$", "")), lambda w: w != "")


def _terms(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, word, tf)"""
    return df.select(*key, F.explode(words(F.col(text))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("tf"))


def templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("template"), F.lit(n).alias("license"), F.lit(t).alias("text"))
            for i, (n, t) in enumerate(TEMPLATES + BODIES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


#: Signs of a comment around the text of a line.
_COMMENT = "(?m)^[\\x20\\t]*+(?://+|/\\*+|\\*+/?|#+|--+|;+|%+|<!--)?[\\x20\\t]*+|[\\x20\\t]*+(?:\\*/|-->)?[\\x20\\t]*+$"
#: The comment lines at the head of a text, white lines between them included.
_HEAD = "\\A(?:[\\x20\\t]*+(?:(?://|/?\\*|#|--|;|%|<!--)[^\\n]*+)?(?:\\n|\\z))++"


def _sentences(lines: Column) -> Column:
    return F.flatten(F.transform(lines, lambda x: F.when(x.rlike(KEYWORD), F.split(x, "(?<=[.;!?])\\s+"))
                                 .otherwise(F.array().cast("array<string>"))))


def notices(files: DataFrame) -> DataFrame:
    """(file, notice) for files (file, text, speaks): distinct sentences with a licence word, of lines and of paragraphs
    with their lines joined, heads of files with such a word, and whole texts of licence files (``speaks``)."""
    word = F.col("text").rlike(KEYWORD)
    text = F.regexp_replace("text", "\\r\\n?", "\n")
    plain = lambda x: F.regexp_replace(x, _COMMENT, "")
    joined = lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))
    of_lines = _sentences(F.split("text", "[\\r\\n]+"))
    of_paragraphs = _sentences(F.transform(F.split(plain(text), "\\n{2,}"), joined))
    head = joined(plain(F.regexp_extract(text, _HEAD, 0)))
    none = F.array().cast("array<string>")
    # a sentence of a line stays as it is; whole texts need no word
    found = F.concat(F.when(word, F.filter(F.concat(of_lines, of_paragraphs, F.array(head)), lambda x: x.rlike(KEYWORD)))
                     .otherwise(none), F.when(F.col("speaks"), F.array(joined(plain(text)))).otherwise(none))
    return (files.where(F.col("text").isNotNull() & (word | F.col("speaks"))).select("file", F.explode(found).alias("notice"))
            .where("notice <> ''").distinct())


def best_templates(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(notice, license, score): the best template of each distinct notice with a cosine of ``threshold`` and more."""
    spark = found.sparkSession
    texts = cut(found.select("notice").distinct().withColumn("nid", F.xxhash64("notice")), "notices")
    of_notice = cut(_terms(texts, ["nid"], "notice"), "terms")
    known = templates(spark)
    of_template = _terms(known, ["template"], "text")
    df = (of_notice.select("word").unionAll(of_template.select("word")).groupBy("word").agg(F.count("*").alias("df")))
    total = texts.select("nid").unionAll(known.select("template")).agg(F.count("*")).scalar()
    idf = cut(df.select("word", (F.log((total + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")), "idf")

    def weighted(t: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        w = t.join(idf, "word").select(key, "word", (F.col("tf") * F.col("idf")).alias("w"))
        return w, w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    a, a_norm = weighted(of_notice, "nid")
    b, b_norm = weighted(of_template, "template")
    b = b.join(b_norm, "template").select("template", "word", (F.col("w") / F.col("norm")).alias("u"))
    dots = (a.join(F.broadcast(b), "word").groupBy("nid", "template")  # bounded: the words of TEMPLATES and BODIES
            .agg(F.sum(F.col("w") * F.col("u")).alias("dot")))
    scored = (dots.join(a_norm, "nid").withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
              .where(F.col("score") >= threshold).join(F.broadcast(known.select("template", "license")), "template"))
    best = scored.groupBy("nid").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    return (texts.join(best, "nid").select("notice", F.col("best.license").alias("license"),
                                           (-F.col("best.s")).alias("score")))


def _dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan(files: DataFrame, path: Column, text: Column, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, license, score, effective, origin) for every row of ``files``.

    ``license`` and ``score`` come from the file's own notices; ``effective`` is that or the inherited one, ``origin``
    the directory inherited from, or the file's own path.
    """
    rows = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), text.alias("text"))
    speaker = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE), F.lit(False))
    seen = cut(rows.select(F.xxhash64("path", "text").alias("file"), "text", speaker.alias("speaks")).transform(notices),
               "found")
    best = best_templates(seen, threshold)
    of_file = cut(seen.join(best, "notice").groupBy("file")
                  .agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
                  .select("file", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score")), "licenses")
    keyed = rows.select("doc_id", "path", F.xxhash64("path", "text").alias("file"), _dir(F.col("path")).alias("dir"))
    named = cut(keyed.join(small(of_file), "file", "left").drop("file"), "named")
    speaks = (named.where(F.col("license").isNotNull() & speaker)
              .groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
              .select(F.col("dir").alias("ancestor"), F.col("best.license").alias("inherited")))
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    nearest = (named.where("license is null and dir is not null").select("dir").distinct()
               .select("dir", F.explode(ups).alias("ancestor")).join(speaks, "ancestor")
               .groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "inherited")).alias("x"))
               .select("dir", F.col("x.ancestor").alias("ancestor"), F.col("x.inherited").alias("inherited")))
    own = F.col("license").isNotNull()
    return (named.join(small(cut(nearest, "nearest")), "dir", "left")
            .select("doc_id", "path", "license", "score", F.coalesce("license", "inherited").alias("effective"),
                    F.when(own, F.col("path")).otherwise(F.col("ancestor")).alias("origin")))
