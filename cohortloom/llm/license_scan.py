"""Licence scan by a positional index of the rare words of licence notices; DataFrame functions only.

For each notice the index holds the places of its rarest words, rarest by the documents of this corpus. The rare words
of a file are looked up there; those that agree on where a notice would begin make it a candidate, which is then
verified: the key phrase has to stand, and enough of all the notice's words, weighted, near their places.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import materialize, numbered, whole_text

#: Base phrases and labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: How a file states its licence, and the names of licences with their labels (fixed values).
VERBS = ("licensed", "released", "distributed", "available", "published")
NAMES = (
    ("the mit license", "mit"),
    ("the apache license version 2", "apache-2"),
    ("the gnu general public license version 3", "gpl-3"),
    ("the gnu general public license version 2", "gpl-2"),
    ("the gnu lesser general public license", "lgpl"),
    ("the gnu affero general public license", "agpl"),
    ("the mozilla public license version 2", "mpl-2"),
    ("the mozilla public license v 2", "mpl-2"),
    ("the bsd license", "bsd"),
    ("the isc license", "isc"),
    ("the boost software license version 1", "boost"),
    ("the eclipse public license v 2", "epl-2"),
    ("cc by 4", "cc-by"),
    ("cc by sa 4", "cc-by-sa"),
    ("cc by nc 4", "cc-by-nc"),
    ("the creative commons attribution 4", "cc-by"),
    ("a creative commons attribution 4", "cc-by"),
    ("a creative commons attribution sharealike 4", "cc-by-sa"),
    ("a creative commons attribution noncommercial 4", "cc-by-nc"),
)
#: The notice that the GNU licences ask for, with the words that tell them apart (fixed values).
GNU = ("{thing} is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software "
       "foundation either version {version} of the license or at your option any later version")
GNU_NAMES = (("this program", "gnu general public license", "3", "gpl-3"), ("this program", "gnu general public license", "2", "gpl-2"),
             ("this library", "gnu lesser general public license", "3", "lgpl"), ("this library", "gnu lesser general public license", "2 1", "lgpl"),
             ("this program", "gnu affero general public license", "3", "agpl"))
#: Label, words of the notice, and its key phrase (fixed values).
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
            "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
     "to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                 "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license "
                 "is distributed on an as is basis without warranties or conditions of any kind either express or implied",
     "apache org licenses license 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
              "you can obtain one at", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
            "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
            "documentation and or other materials provided with the distribution",
     "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
            "copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it "
             "freely subject to the following restrictions the origin of this software must not be misrepresented",
     "permission is granted to anyone to use this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
                  "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
     "free and unencumbered software released into the public domain"),
)
#: Label, notice, key phrase. The statements are all key; words that deny one ("not licensed under ..") take it back.
TEMPLATES = (
    *NOTICES,
    *[(label, GNU.format(thing=thing, name=name, version=version), f"the {name} as published by the free software foundation either version {version}")
      for thing, name, version, label in GNU_NAMES],
    *[(label, f"{verb} under {name}", f"{verb} under {name}") for verb in VERBS for name, label in NAMES],
)
DENIALS = ("not", "never", "nor")
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of the weight of a notice's words that has to stand near their places, and how many words near is.
MIN_SHARE, SLACK = 0.6, 3
#: Rare words of a notice that the index holds, and how many of them have to agree on its beginning.
RARE_WORDS, AGREE = 8, 2
#: Score of a file with a base phrase alone.
BASE_SCORE = 0.5

VOCABULARY = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})


def _cut(docs: DataFrame) -> Column:
    return F.regexp_extract_all(F.translate(whole_text(docs), UPPER, LOWER), F.lit(WORD + "+"), F.lit(0))


def _names(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _places(words: Column, phrase: str) -> Column:
    """Starts (from 0) at which the phrase's words stand one after the other; null where a word of it is missing."""
    parts = phrase.split()

    def here(i):
        return F.coalesce(reduce(and_, [F.get(words, i + k) == part for k, part in enumerate(parts)]), F.lit(False))

    present = reduce(and_, [F.array_contains(words, part) for part in parts])
    return F.when(present, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here))


def _marked(places: Column, name: str) -> Column:
    return F.transform(places, lambda i: F.struct(F.lit(name).alias("label"), i.cast("long").alias("pos")))


def word_weights(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each word of the notices over all documents; as many rows as there are such words."""
    n = docs.count()
    seen = docs.select(F.explode(F.array_intersect(_cut(docs), _names(VOCABULARY))).alias("word"))
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: round(math.log((n + 1) / (counts.get(w, 0) + 1)) + 0.01, 6) for w in VOCABULARY}


def rare_words(notice: str, weights: dict[str, float]) -> list[str]:
    """The words of a notice with the highest weights: half of them, at least AGREE and at most RARE_WORDS."""
    words = sorted(set(notice.split()), key=lambda w: (-weights[w], w))
    return words[:min(RARE_WORDS, max(AGREE, (len(words) + 1) // 2))]


def read_words(docs: DataFrame, rare: list[str]) -> DataFrame:
    """One row per document, written once: word count, base places, and the words of files that hold AGREE rare words.

    Files with fewer cannot have a candidate, so their words are not kept.
    """
    cut = numbered(docs, _cut(docs).alias("_words"))
    words = F.col("_words")
    none = F.array().cast("array<struct<label:string,pos:bigint>>")
    base = F.flatten(F.array(*[F.coalesce(_marked(_places(words, phrase), name), none) for phrase, name in BASE]))
    likely = F.size(F.array_intersect(words, _names(rare))) >= AGREE
    return materialize(cut.select("row_id", "doc_id", F.size(words).cast("long").alias("n_words"), base.alias("base"),
                                  F.when(likely, words).alias("words")))


def match_templates(read: DataFrame, weights: dict[str, float]) -> DataFrame:
    """row_id, label, score of the notices that stand in a file.

    The file's rare words are looked up in the postings; a notice whose words agree on the place of its beginning is a
    candidate there, whatever else the file holds. It counts if its key phrase stands at that place and the weight of all
    its words found within SLACK words of their places is MIN_SHARE of the whole.
    """
    spark = read.sparkSession
    split = [notice.split() for _, notice, _ in TEMPLATES]
    rare = [set(rare_words(notice, weights)) for _, notice, _ in TEMPLATES]
    # Both tables are as long as the notices above, whatever the data.
    index = F.broadcast(spark.createDataFrame(
        [(w, t, p) for t, words in enumerate(split) for p, w in enumerate(words) if w in rare[t]], "word string, template int, at int"))
    notices = F.broadcast(spark.createDataFrame(
        [(t, label, f" {key} ", split[t], [weights[w] for w in split[t]], sum(weights[w] for w in split[t]))
         for t, (label, _, key) in enumerate(TEMPLATES)],
        "template int, label string, key string, parts array<string>, weights array<double>, total double"))
    likely = read.filter("words is not null").select("row_id", "words")
    listed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda s: s["word"].isin(*sorted(set().union(*rare))))
    agreed = (likely.select("row_id", F.explode(listed).alias("s")).select("row_id", "s.word", "s.pos").join(index, "word")
              .groupBy("row_id", "template", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") >= AGREE))
    # The place of the notice with SLACK words on both sides; words before the file's first one are blank.
    lead = F.array_repeat(F.lit(""), F.greatest(SLACK - F.col("shift"), F.lit(0)))
    there = F.slice("words", F.greatest(F.col("shift") - SLACK, F.lit(0)) + 1,
                    F.greatest(F.size("parts") + 2 * SLACK - F.size(lead), F.lit(0)))
    placed = (agreed.join(likely, "row_id").join(notices, "template").select("row_id", "label", "key", "parts", "weights", "total", F.concat(lead, there).alias("around")))
    found = F.aggregate(F.sequence(F.lit(1), F.size("parts")), F.lit(0.0), lambda total, i: total + F.when(
        F.array_contains(F.slice("around", i, 2 * SLACK + 1), F.element_at("parts", i)), F.element_at("weights", i)).otherwise(0.0))
    line = F.concat(F.lit(" "), F.array_join("around", " "), F.lit(" "))
    denied = [line.contains(F.concat(F.lit(f" {no}"), F.col("key"))) for no in DENIALS]
    stands = reduce(and_, [~d for d in denied], line.contains(F.col("key")))
    return (placed.filter(stands).select("row_id", "label", F.least(F.round(found / F.col("total"), 6), F.lit(1.0)).alias("score"))
            .filter(F.col("score") >= MIN_SHARE))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Null and empty texts have no words, no labels (empty strings) and score 0. A base phrase alone scores
    BASE_SCORE. Rows that repeat are judged each for itself; other columns are ignored.
    """
    weights = word_weights(docs)
    rare = sorted({w for _, notice, _ in TEMPLATES for w in rare_words(notice, weights)})
    read = read_words(docs, rare)
    found = match_templates(read, weights).groupBy("row_id").agg(F.collect_set("label").alias("more"), F.max("score").alias("top"))
    base = F.col("base")
    names = F.transform(base, lambda s: s["label"])
    none = F.array().cast("array<string>")
    return read.join(found, "row_id", "left").select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["pos"])).alias("first_word"), F.array_max(F.transform(base, lambda s: s["pos"])).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(names)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(names, F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.coalesce("top", F.lit(0.0)), F.when(F.size(base) > 0, BASE_SCORE).otherwise(0.0)).alias("score"))
