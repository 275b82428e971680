"""Operator 10: license scans, in DataFrame functions only.

Every text is lower-cased (A-Z) and cut into words. Base phrases are found where their words stand consecutively.
Beyond these, an exact set-similarity join finds every text block that contains a share of ``threshold`` or more of a
license template's distinct words. A block is any run of consecutive words, wherever lines end, of at most 1 / threshold
times the words of the template and at least as many as it needs (length filter, from both sides). The template words are
ordered by how many documents hold them; a text is a candidate if it holds one of the first |T| - ceil(threshold |T|) + 1
(the rarest) of a template and can still reach the overlap after the place of that first match (prefix and positional
filters). The candidates' blocks are then all compared at once: each occurrence of a word counts for the blocks that start
after the word's occurrence before it, so the overlap of every block follows from where these intervals begin and end, and
every place with blocks that meet the threshold is found, not the best one alone.

Null text counts as empty: no words, no labels, null places. Rows that share id and text share their result; null ids are
an id. An empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.durable import sized_join, written

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and whole texts of well-known licenses, as lower-case words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied",
    "mit-whole": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
        "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software"
    ),
    "isc-whole": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
        "copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the "
        "author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
        "tortious action arising out of or in connection with the use or performance of this software"
    ),
    "bsd-2-whole": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including "
        "but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct "
        "indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however "
        "caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage"
    ),
    "bsd-3-text": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ),
    "lgpl": "under the terms of the gnu lesser general public license",
    "agpl": "under the terms of the gnu affero general public license",
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
        "binary for any purpose commercial or non commercial and by any means"
    ),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license "
        "2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or "
        "implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
        "particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"
    ),
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The letters beyond A-Z whose lower case holds an ASCII letter, and stand-ins without one.
STAND_INS = {"\u0130": "\u0131", "\u212a": "\u0138"}


def measures(text: str, threshold: float) -> tuple[list[str], int, int]:
    """A template's distinct words, how many of them a block needs, and how long a block may be."""
    words = text.split()
    known = sorted(set(words))
    return known, math.ceil(threshold * len(known) - 1e-9), math.ceil(len(words) / threshold - 1e-9)


def _spelled(text: Column) -> Column:
    """The lower-cased words, joined by one blank. Only A-Z change where it matters, for words of ASCII letters."""
    plain = F.coalesce(text, F.lit(""))
    for letter, other in STAND_INS.items():
        plain = F.replace(plain, F.lit(letter), F.lit(other))
    return F.trim(F.regexp_replace(F.lower(plain), SEPARATORS, " "))


def _blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _reduced(rows: DataFrame) -> DataFrame:
    """(id, h, n_words, n_base, first_word, last_word, base, known) of each of rows (id, text): ``known`` are its distinct
    words that any template has."""
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in TEMPLATES.values() for w in t.split()})])
    base = rows.select("id", F.xxhash64("text").alias("h"), _spelled(F.col("text")).alias("t"))
    base = base.select("id", "h", "t", F.concat(F.lit(" "), F.replace("t", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("s"), F.when(F.col("t") == "", 0).otherwise(_blanks(F.col("t")) + 1).alias("n_words"))
    places, firsts, lasts, names = [], [], [], []
    for phrase, label in PHRASES.items():
        pattern = " " + "  ".join(phrase.split()) + " "  # neighbours have two blanks between them
        has, parts = F.contains("s", F.lit(pattern)), F.split("s", pattern)
        places.append(F.when(has, F.size(parts) - 1).otherwise(0))
        firsts.append(F.when(has, F.floor(_blanks(F.element_at(parts, 1)) / 2)))
        lasts.append(F.when(has, F.col("n_words") - len(phrase.split()) - F.floor(_blanks(F.element_at(parts, -1)) / 2)))
        names.append(F.when(has, F.lit(label)))
    return base.select(
        "id", "h", F.col("n_words").cast("long").alias("n_words"), sum(places[1:], places[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*names)).alias("base"), F.array_intersect(F.split("t", " "), vocabulary).alias("known"),
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    reduced = written(_reduced(rows), "reduced")
    matches = template_matches(rows, threshold, reduced)
    best = written(matches.groupBy("id", "h").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment")), "best")
    out = sized_join(reduced, best, ["id", "h"], "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def template_matches(rows: DataFrame, threshold: float = 0.9, reduced: DataFrame | None = None) -> DataFrame:
    """(id, h, label, first_word, last_word, containment) of every maximal place in the texts of ``rows`` (id, text) where blocks meet
    the threshold; h: a hash of the text. Blocks that start at neighbouring words and all meet it are one place, which has the
    words (from 0) and the containment of its best block, the last of equals."""
    spark = rows.sparkSession
    held = reduced if reduced is not None else written(_reduced(rows), "reduced")
    counts = held.select(F.explode("known").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = {r["word"]: r["n"] for r in counts.collect()}  # at most one row per template word
    ranked = sorted({w for t in TEMPLATES.values() for w in t.split()}, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}
    first_words = []
    for label, text in TEMPLATES.items():
        known, need, span = measures(text, threshold)
        words = sorted(known, key=rank.__getitem__)
        first_words += [(word, label, place, len(words), need, span, words) for place, word in enumerate(words[: len(words) - need + 1])]
    shortest = min(x[4] for x in first_words)
    prefixes = spark.createDataFrame(first_words, "word string, label string, place int, size int, need int, span int, template array<string>")
    ordered = F.array(*[F.lit(w) for w in ranked])
    texts = held.where(F.size("known") >= shortest).select("id", "h", F.array_intersect(ordered, "known").alias("words"))
    tokens = texts.select("id", "h", "words", F.posexplode("words").alias("at", "word"))
    candidates = tokens.join(F.broadcast(prefixes.select("word", "label", "place", "size", "need")), "word").where(
        F.least(F.size("words") - F.col("at"), F.col("size") - F.col("place")) >= F.col("need")
    )
    whole = prefixes.where("place = 0").select("label", "span", "template")
    candidates = candidates.select("id", "h", "label", "size", "need", "words", "word").join(F.broadcast(whole), "label")
    shared = F.array_intersect("words", "template")
    candidates = candidates.where((F.size(shared) >= F.col("need")) & (F.element_at(shared, 1) == F.col("word")))  # once a text and template
    candidates = written(candidates.select("id", "h", "label", "size", "need", "span", "template").distinct(), "candidates")
    return _blocks(rows, candidates)


def _blocks(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """The places of the candidates' blocks that reach the overlap. An occurrence at place p of a word that stood last at q
    counts for the blocks that start from max(q, p - span) + 1 to p, so the overlap changes only where such a range begins or ends; a
    text's words are one list in one task, its template words one window."""
    wanted = written(candidates.select("id", "h").distinct(), "wanted")
    texts = sized_join(rows.withColumn("h", F.xxhash64("text")), wanted, ["id", "h"]).dropDuplicates(["id", "h"])
    words = sized_join(texts.select("id", "h", F.split(_spelled(F.col("text")), " ").alias("words")), candidates, ["id", "h"])
    group = ["id", "h", "label", "size", "need", "span", "n_words"]
    found = words.select(*group[:-1], F.size("words").alias("n_words"), "template", F.posexplode("words").alias("at", "word")).where(F.array_contains("template", F.col("word"))).drop("template")
    before = F.lag("at").over(Window.partitionBy("id", "h", "label", "word").orderBy("at"))
    found = found.withColumn("start", F.greatest(F.coalesce(before, F.lit(-1)), F.col("at") - F.col("span")) + 1)
    events = found.select(*group, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct((F.col("at") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = events.groupBy(*group, F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    along = Window.partitionBy("id", "h", "label").orderBy("at")
    held = steps.withColumn("overlap", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.lead("at").over(along) - 1)
    held = held.withColumn("good", F.col("overlap") >= F.col("need")).withColumn("opens", F.col("good") & ~F.coalesce(F.lag("good").over(along), F.lit(False)))
    held = held.withColumn("place", F.sum(F.col("opens").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))).where("good")
    best = held.groupBy(*group, "place").agg(F.max(F.struct("overlap", "last")).alias("best"))
    end = F.least(F.col("best.last") + F.col("span"), F.col("n_words")) - 1
    return best.select("id", "h", "label", F.col("best.last").cast("long").alias("first_word"), end.cast("long").alias("last_word"), (F.col("best.overlap") / F.col("size")).alias("containment"))
