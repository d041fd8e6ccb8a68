"""License scans [native]: word-bigram Dice of text units against templates.

A unit is a line, a block between blank lines that has several lines, or a window
of a template's length anywhere in the text, for notices inside longer lines and
comments. Units and templates are normalised alike; a pair is compared only if
their bigram counts allow the wanted Dice coefficient.

A unit that reaches it shares so many bigrams with the template that it must have
one of any n - needed + 1 chosen ones, the template's anchors. So a text without
an anchor has no license and is dropped before it is cut into units, and windows
are laid where an anchor stands, as the template has it. A long text's words are
cut into chunks first, so no row holds more than a chunk's windows.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text that are searched for notices together.
CHUNK_WORDS = 2048

# The public notices by which works name their license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
)


def normal_words(text: Column) -> Column:
    """Lower-case ASCII words and numbers; other characters separate them."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...], least_dice: float) -> DataFrame:
    """A row for each template and each unit size that can reach ``least_dice``."""
    table = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template_id int, license string, template string")
    table = table.select("template_id", "license", bigrams(normal_words(F.col("template"))).alias("grams"))
    reach = least_dice / (2 - least_dice)
    sizes = F.sequence(F.ceil(F.size("grams") * F.lit(reach)), F.floor(F.size("grams") / F.lit(reach)))
    return table.where(F.size("grams") > 0).withColumn("n", F.explode(sizes.cast("array<int>")))


def anchors(templates: tuple[tuple[str, str], ...], least_dice: float) -> list[tuple[str, int, str, int, int]]:
    """(bigram, template_id, license, words before it, words of the template): the
    longest n - needed + 1 bigrams of each template, at each of their places."""
    out = []
    for i, (name, text) in enumerate(templates):
        words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        found = sorted(set(pairs), key=lambda p: (-len(p), p))
        needed = ceil(len(found) * least_dice / (2 - least_dice) - 1e-9)
        chosen = set(found[: len(found) - needed + 1])
        out += [(pair, i, name, at, len(words)) for at, pair in enumerate(pairs) if pair in chosen]
    return out


def license_scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    least_dice: float = 0.8,
) -> DataFrame:
    """One row per document and license found: id, license, dice, n_units.

    ``dice`` is the best over the document's units and the license's templates,
    ``n_units`` the number of its lines and blocks of lines that reach
    ``least_dice`` (0 where only a window within one does). Null, empty and
    one-word texts have no bigrams and give no row; a repeated line counts each
    time; very long texts are searched in chunks; no other column is read. Templates are a parameter of fixed size (the
    default 16), so their broadcast doesn't grow with the corpus.
    """
    spark, places = docs.sparkSession, anchors(templates, least_dice)
    if not places:
        places = [("", -1, "", 0, 0)]
    table = F.broadcast(template_table(spark, templates, least_dice))
    pairs = sorted({p[0] for p in places})
    first = sorted({p.split(" ")[0] for p in pairs})
    # exploding one-element arrays has words and anchors computed once, not for each use
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.explode(F.array(normal_words(F.col(text_col)))).alias("words")).where(F.size("words") > 1)

    def anchored(i: Column) -> Column:
        word = F.element_at("words", i)
        return word.isin(*first) & F.concat(word, F.lit(" "), F.element_at("words", i + 1)).isin(*pairs)

    at = F.filter(F.sequence(F.lit(1), F.size("words") - 1), anchored)
    rows = rows.select("*", F.explode(F.array(at)).alias("at")).where(F.size("at") > 0)

    lines = F.split("text", "\n")
    blocks = F.filter(F.split("text", r"\n[\x20\t\r]*\n"), lambda b: F.contains(b, F.lit("\n")))
    units = rows.select("id", F.explode(F.concat(lines, blocks)).alias("unit")).select("id", normal_words(F.col("unit")).alias("words")).where(F.size("words") > 1)
    units = units.select("id", F.monotonically_increasing_id().alias("unit_id"), bigrams(F.col("words")).alias("found"))

    # the words in chunks of bounded size, with a template's length of words around them
    span = max(p[4] for p in places)
    begins = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / CHUNK_WORDS).cast("int"))
    cut = F.transform(begins, lambda k: F.struct(k.alias("k"), F.slice("words", F.greatest(k * CHUNK_WORDS + 1 - span, F.lit(1)), CHUNK_WORDS + 2 * span).alias("words")))
    chunks = rows.select("id", F.explode(cut).alias("c")).select("id", "c.k", "c.words")
    skipped = F.least(F.col("k") * CHUNK_WORDS, F.lit(span))  # words of a chunk that lie before its own ones
    own = F.filter(F.sequence(skipped + 1, F.least(skipped + CHUNK_WORDS, F.size("words"))), lambda i: (i < F.size("words")) & anchored(i))
    laid = F.create_map(*[x for pair in pairs for x in (F.lit(pair), F.array(*[F.struct(F.lit(p[1]).alias("place_id"), F.lit(p[3]).alias("before"), F.lit(p[4]).alias("n")) for p in places if p[0] == pair]))])
    windows = F.flatten(F.transform(own, lambda i: F.transform(F.element_at(laid, F.concat(F.element_at("words", i), F.lit(" "), F.element_at("words", i + 1))), lambda p: F.struct(p["place_id"].alias("place_id"), F.greatest(i - p["before"], F.lit(1)).alias("a"), p["n"].alias("n")))))
    cut = F.transform(F.array_distinct(windows), lambda w: F.struct(w["place_id"].alias("place_id"), F.slice("words", w["a"], w["n"]).alias("words")))
    windows = chunks.select("id", F.explode(cut).alias("w")).select("id", "w.place_id", bigrams(F.col("w.words")).alias("found"))

    dice = 2.0 * F.size(F.array_intersect("found", "grams")) / (F.size("found") + F.size("grams"))
    whole = units.join(table, F.size("found") == F.col("n")).select("id", "license", "unit_id", dice.alias("dice"))
    inside = windows.join(table, (F.size("found") == F.col("n")) & (F.col("place_id") == F.col("template_id")))
    found = whole.unionByName(inside.select("id", "license", F.lit(None).cast("long").alias("unit_id"), dice.alias("dice"))).where(F.col("dice") >= least_dice)
    return found.groupBy(F.col("id").alias(id_col), "license").agg(F.round(F.max("dice"), 6).alias("dice"), F.count_distinct("unit_id").alias("n_units"))
