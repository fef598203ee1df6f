"""License scans: phrases, and templates by an exact set-similarity join.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. The base finds
places where the words of a phrase stand one after another.

The method adds the labels of templates: a block (paragraph: lines up to one without words, such
as a blank or bare comment line) holds a template if a window of it, up to twice as long as the
template, contains ``CONTAINMENT`` or more of the template's distinct words and ``ORDERED``
or more of its pairs of neighbouring words (so words that a long paragraph has here and there are
no notice), all words that the template ``needs`` and none that it ``bars`` (so licenses that
differ by one word are told apart), and if the passage, from three words before its first pair to
its last, negates no more often than the template does. Windows stand about pairs of the template: half its length before, one and a half behind.
Templates are a table (label, text, needs, bars); ``TEMPLATES`` is the one used where no other is
given. The join finds blocks that could hold a template: words are ordered by the number of
documents that have them, over the whole table, so rare ones come first. Blocks and templates
are joined on the words of their prefixes: a block that holds k of the n words of a template
shares one of the n - k + 1 rarest with it, and it is one of the first m - k + 1 of the m words
of templates that the block has. Length filter: m >= k. Positional filter: the shared word and
what follows it in both orders can still give k. What is left is verified on the whole sets, then in
windows of the words as they stand.

The texts stay where they are: a block is sent on only if a rare word of templates is in it. The templates' prefixes are broadcast up to ``BROADCAST_ROWS`` rows and
shuffled beyond. Null text is empty. Rows that repeat id and text get the same labels. An empty
table gives an empty result. Columns of the input are passed on; those named n_words, places or
held are replaced. Long texts are split once and in one piece.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEYS, key_columns, keyed, lower_ascii, text_of, unpacked

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Paragraphs of public licenses and notices: label, text, words needed, words barred.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "deal", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "sublicense", ""),
    ("mit", "This software is released under the terms of the MIT license", "mit license", ""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "fee provided", ""),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee", "provided"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache", ""),
    ("apache-2", "This project is licensed under the Apache License, Version 2.0", "apache 2", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution", ""),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "bsd", ""),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "held damages", ""),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software", "accompanying transmit", ""),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0", "boost", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered", ""),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "gnu 3", "lesser affero library"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "gnu 3", "lesser affero library"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version", "gnu 2", "lesser affero library 3"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", "gnu 2", "lesser affero library 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version", "gnu lesser", "affero"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3", "gnu lesser", "affero"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "gnu affero", ""),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3", "gnu affero", ""),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla", ""),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse", ""),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived", ""),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License", "attribution commons", "noncommercial sharealike noderivatives noderivs nc nd sa"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "sharealike commons", "noncommercial nc"),
    ("cc-by-nd", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License", "noderivatives commons", "noncommercial nc"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", "noncommercial commons", "sharealike noderivatives noderivs nd sa"),
    ("cc-by-nc-sa", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "noncommercial sharealike commons", ""),
    ("cc-by-nc-nd", "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "noncommercial noderivatives commons", ""),
)
CONTAINMENT, ORDERED, BROADCAST_ROWS = 0.8, 0.5, 20_000
NEGATIONS = ("not", "no", "never", "cannot", "nor", "neither", "nobody", "none", "isn", "aren", "wasn", "weren", "doesn", "didn", "don", "won")
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BLANK = r"\n" + _GAP[:-1] + r"*\n"
HELD = "array<struct<label:string,containment:double>>"
Template = tuple[str, str, str, str]


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), _GAP), "")


def word_list(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def word_set(text: str) -> list[str]:
    return sorted(set(word_list(text)))


def neighbours(words: list[str]) -> list[str]:
    """Pairs of neighbouring words; of a single word the word."""
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or words


def least_shared(n: int) -> int:
    return math.ceil(CONTAINMENT * n - 1e-9)


def _literal(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _frequencies(docs: DataFrame, every: list[str]) -> dict[str, int]:
    """Number of documents that have each word of the templates."""
    found = docs.select(F.explode(F.array_intersect(_literal(every), words(text_of()))).alias("w"))
    return {r.w: r["count"] for r in found.groupBy("w").count().collect()}


def _prefixes(spark: SparkSession, templates: tuple[Template, ...], order: dict[str, int]) -> DataFrame:
    """The templates' prefixes as a table: token, place, template, label, k, n, words, needs, bars, pairs, long, nots."""
    kinds = "template:int,label:string,words:array<string>,needs:array<string>,bars:array<string>,pairs:array<string>,long:int,nots:int"
    rows = [{"template": i, "label": label, "words": sorted(word_set(text), key=order.get), "needs": word_set(needs), "bars": word_set(bars), "pairs": sorted(set(neighbours(word_list(text)))),
             "long": len(word_list(text)), "nots": sum(w in NEGATIONS for w in word_list(text))} for i, (label, text, needs, bars) in enumerate(templates)]
    table = spark.sql(f"SELECT inline(from_json(:rows, 'array<struct<{kinds}>>'))", args={"rows": json.dumps(rows)})
    n = F.size("words")
    table = table.withColumn("n", n).withColumn("k", F.ceil(F.col("n") * CONTAINMENT - 1e-9).cast("int"))
    return table.select("*", F.posexplode(F.slice("words", 1, F.col("n") - F.col("k") + 1)).alias("place", "token"))


def _windows(met: DataFrame, keys: list[str]) -> DataFrame:
    """Of blocks (seq) met with templates the windows that hold them: keys, label, containment."""
    two = F.transform(F.slice("seq", 2, F.size("seq")), lambda w, i: F.concat_ws(" ", F.get("seq", i), w))
    met = met.withColumn("twos", F.when(F.col("long") == 1, F.col("seq")).otherwise(two))
    at = F.array_compact(F.transform("twos", lambda x, i: F.when(F.array_contains("pairs", x), i)))
    size = F.col("long") + F.greatest(F.lit(4), F.floor(F.col("long") / 2).cast("int"))
    first = lambda i, n: F.greatest(i + 1 - n, F.lit(1))
    wide = F.floor(F.col("long") / 2).cast("int") + 1
    start, far = (lambda i: first(i, wide)), (lambda i: first(i, wide + 3))
    cut = F.transform(at, lambda i: F.struct(F.slice("seq", far(i), i + 1 - far(i) + size).alias("far"), (start(i) - far(i)).alias("skip"), F.slice("twos", i + 1, size - 1).alias("behind"),
                                             F.slice("twos", start(i), i + 1 - start(i) + size - 1).alias("twos")))
    rows = met.select(*keys, "label", "n", "k", "words", "needs", "bars", "pairs", "nots", F.explode(cut).alias("x")).select("*", "x.*").withColumn("wide", F.slice("far", F.col("skip") + 1, F.size("far")))
    rows = rows.withColumn("containment", F.size(F.array_intersect("wide", "words")) / F.col("n"))
    rows = rows.filter((F.size(F.array_intersect("wide", "words")) >= F.col("k")) & (F.size(F.array_intersect("behind", "pairs")) >= ORDERED * F.size("pairs"))
                       & (F.size(F.array_except("needs", "wide")) == 0) & ~F.arrays_overlap("bars", "wide"))
    hit = F.array_compact(F.transform("twos", lambda x, i: F.when(F.array_contains("pairs", x), i)))
    begin, end = F.greatest(F.array_min(hit) + F.col("skip") - 2, F.lit(1)), F.array_max(hit) + F.col("skip") + 2
    passage = F.slice("far", begin, end - begin + 1)
    return rows.filter(F.size(F.filter(passage, lambda w: w.isin(*NEGATIONS))) <= F.col("nots")).select(*keys, "label", "containment")


def holdings(docs: DataFrame, keys: list[str], templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Rows keys, held: the templates that blocks of a document hold (label, best containment)."""
    sets = [word_set(t[1]) for t in templates]
    known = sorted({w for s in sets for w in s} | {w for t in templates for w in word_set(f"{t[2]} {t[3]}")})
    counts = _frequencies(docs, known)
    ranked = sorted(known, key=lambda w: (counts.get(w, 0), w))
    order = {w: i for i, w in enumerate(ranked)}
    rare = sorted({w for s in sets for w in sorted(s, key=order.get)[: len(s) - least_shared(len(s)) + 1]})
    least = min(least_shared(len(s)) for s in sets)
    blocks = docs.select(*keys, F.posexplode(F.split(text_of(), _BLANK)).alias("block", "said"))
    blocks = blocks.select(*keys, "block", words(F.col("said")).alias("seq")).select("*", F.array_intersect(_literal(ranked), F.col("seq")).alias("have")).filter((F.size("have") >= least) & F.arrays_overlap("have", _literal(rare)))
    posted = blocks.select("*", F.posexplode(F.slice("have", 1, F.size("have") - least + 1)).alias("at", "token"))
    prefixes = _prefixes(docs.sparkSession, templates, order)
    size = sum(len(s) - least_shared(len(s)) + 1 for s in sets)
    met = posted.join(F.broadcast(prefixes) if size <= BROADCAST_ROWS else prefixes, "token")
    met = met.filter((F.size("have") >= F.col("k")) & (F.least(F.size("have") - F.col("at"), F.col("n") - F.col("place")) >= F.col("k")))
    met = met.withColumn("shared", F.size(F.array_intersect("have", "words"))).filter((F.col("shared") >= F.col("k")) & (F.size(F.array_except("needs", "have")) == 0))
    met = met.dropDuplicates([*keys, "block", "template"])
    best = _windows(met, keys).groupBy(*keys, "label").agg(F.max("containment").alias("containment"))
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("label", "containment"))).cast(HELD).alias("held"))


def phrase_places(text: Column) -> Column:
    """Places of base phrases in the words of a text: start, label."""
    place = "array<struct<start:bigint,label:string>>"

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split()
        hit = lambda i: F.slice("words", i + 1, len(parts)) == _literal(parts)
        loose = text.rlike("(?i)" + _GAP.join(parts)) & (F.size("words") >= len(parts))
        at = F.filter(F.array_compact(F.transform("words", lambda w, i: F.when(w == parts[0], i))), hit)
        return F.when(loose, F.transform(at, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))).cast(place)).otherwise(F.array().cast(place))

    return F.flatten(F.array(*(of(p, label) for p, label in PHRASES.items())))


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The columns of ``df`` and n_words, places (of base phrases: start, label), held (templates: label, containment)."""
    docs, keys = keyed(df), key_columns(df)
    held = holdings(docs, keys, templates)
    whole = docs.select("row", "text", *KEYS, words(text_of()).alias("words"))
    whole = whole.select("row", "text", *keys, F.size("words").cast("long").alias("n_words"), phrase_places(text_of()).alias("places"))
    return whole.join(held, keys, "left").select(*unpacked(df.columns, n_words="n_words", places="places", held=F.coalesce("held", F.array().cast(HELD))))


def digest(df: DataFrame) -> DataFrame:
    """Counts and labels for each document; score is 1 with a base phrase, else the largest containment (0: none)."""
    out = scan(df.select("doc_id", "text")).drop("text")
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_union(base, F.transform("held", lambda h: h["label"])))
    best = F.coalesce(F.array_max(F.transform("held", lambda h: h["containment"])), F.lit(0.0))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                      F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"))
