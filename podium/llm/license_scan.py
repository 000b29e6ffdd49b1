"""License scan: lines, whole texts and runs of words against license templates, by Dice over word bigrams.

A text is lower-cased, what is no letter or digit becomes a blank, and each line and the whole text
(where it has more than one line) is a unit. A unit with b distinct word bigrams can only reach Dice
t with a template of B bigrams if t / (2 - t) * B <= b <= (2 - t) / t * B, so only units and templates
of fitting sizes are compared.

A notice that is wrapped over lines, or that is part of a line, is found as a run of words. Dice t with
a template of B bigrams takes at least t / (2 - t) * B shared ones, so of any B minus that plus one of
its bigrams, the anchors, one at least must be there; the longest are taken, which are the rarest. At
each place of an anchor the run of as many words as the template has, laid so that the anchor stands
where it does in the template (and beginning with the text at the earliest), is a unit for that template.

Defined results: null and empty texts and units of fewer than two words match nothing; a unit that
reaches the threshold with several templates gives one row for each license, with its best template;
an id that occurs more than once gets the best of its rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (license, template): fixed values, the wording of common notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]


def in_order(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bigrams_of(text: str) -> list[str]:
    return sorted(set(in_order(text)))


def anchors(templates: list[tuple[str, str]], threshold: float) -> list[tuple[str, int, int, int]]:
    """(bigram, template's place in the list, words before it there, words of the template)."""
    out = []
    for t, (_, text) in enumerate(templates):
        every, grams = in_order(text), bigrams_of(text)
        shared = math.ceil(threshold * len(grams) / (2 - threshold) - 1e-9)
        chosen = set(sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - shared + 1])
        out += [(g, t, i, len(every) + 1) for i, g in enumerate(every) if g in chosen]
    return out


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams that a unit may have."""
    fits = [b for b in range(1, int(size * (2 - threshold) / threshold) + 2) if 2 * min(b, size) >= threshold * (b + size)]
    return fits[0], fits[-1]


def scan(docs: DataFrame, *, id_col: str = "doc_id", threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """id, line_no (from 0; -1: the whole text; -2: a run of words anywhere in it), license, dice."""
    made = [(name, b, *bounds(len(b), threshold)) for name, t in templates if (b := bigrams_of(t))]
    least, most = min(m[2] for m in made), max(m[3] for m in made)
    known = F.array(*(F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, b)).alias("grams"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, b, lo, hi in made))
    whole = F.when(F.instr("text", "\n") > 0, F.array(F.struct(F.lit(-1).alias("line_no"), F.col("text").alias("unit"))))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("unit")))
    units = (
        docs.where("text is not null")
        .select(F.col(id_col).alias("id"), F.explode(F.concat(lines, F.coalesce(whole, F.array().cast("array<struct<line_no:int,unit:string>>")))).alias("u"))
        .where(F.length("u.unit") >= 2 * least + 1)  # so many words take so many characters
        .select("id", "u.line_no", F.trim(F.regexp_replace(F.lower("u.unit"), r"[^\p{L}\p{N}]+", " ")).alias("unit"))
    )
    # a lambda's variable is worked out once, where a column might be put in for each reference to it
    words = F.filter(F.array(F.split("unit", " ")), lambda w: (F.size(w) > least) & (F.size(F.array_distinct(w)) <= most + 1))
    grams = F.transform(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))))
    fitting = units.select("id", "line_no", F.explode(grams).alias("g")).where(F.size("g").between(least, most))
    # as many rows as a unit has fitting templates; most have none
    pairs = fitting.select("id", "line_no", "g", F.explode(F.filter(known, lambda t: (F.size("g") >= t["lo"]) & (F.size("g") <= t["hi"]))).alias("t"))
    dice = 2.0 * F.size(F.array_intersect("g", "t.grams")) / (F.size("g") + F.size("t.grams"))
    hits = pairs.select("id", "line_no", F.col("t.license").alias("license"), dice.alias("dice")).where(F.col("dice") >= threshold)
    hits = hits.unionByName(runs(docs, id_col, threshold, templates))
    return hits.groupBy(F.col("id").alias(id_col), "line_no", "license").agg(F.round(F.max("dice"), 9).alias("dice"))


def runs(docs: DataFrame, id_col: str, threshold: float, templates: list[tuple[str, str]]) -> DataFrame:
    """id, line_no (-2), license, dice of every run laid at an anchor that reaches the threshold."""
    known = F.array(*(F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, bigrams_of(t))).alias("grams")) for n, t in templates))
    places = anchors(templates, threshold)
    table = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(t).alias("t"), F.lit(at).alias("at"), F.lit(n).alias("n")) for g, t, at, n in places))
    grams, firsts = sorted({p[0] for p in places}), sorted({p[0].split()[0] for p in places})
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    # generated columns are worked out once; a projection's might be put in for each reference
    texts = docs.where("text is not null").select(F.col(id_col).alias("id"), F.explode(F.array(F.split(plain, " "))).alias("w")).where(F.size("w") > 1)
    gram = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))
    spots = F.filter(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.get("w", i).isin(firsts) & gram("w", i).isin(grams))
    laid = F.flatten(F.transform(spots, lambda i: F.transform(F.filter(table, lambda a: a["g"] == gram("w", i)), lambda a: F.struct(a["t"].alias("t"), F.greatest(i - a["at"], F.lit(0)).alias("start"), a["n"].alias("n")))))
    cut = F.transform(F.array_distinct(laid), lambda x: F.struct(x["t"].alias("t"), F.slice("w", x["start"] + 1, x["n"]).alias("w")))
    found = texts.select("id", F.explode(cut).alias("x")).select("id", F.element_at(known, F.col("x.t") + 1).alias("t"), F.explode(F.transform(F.array("x.w"), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: gram(w, i))))).alias("g"))
    dice = 2.0 * F.size(F.array_intersect("g", "t.grams")) / (F.size("g") + F.size("t.grams"))
    return found.select("id", F.lit(-2).alias("line_no"), F.col("t.license").alias("license"), dice.alias("dice")).where(F.col("dice") >= threshold)


def oracle(threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same in DuckDB, over the view documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, [{', '.join(map(quote, bigrams_of(t)))}])" for n, t in templates)
    places = ", ".join(f"({quote(g)}, {t}, {at}, {n})" for g, t, at, n in anchors(templates, threshold))
    order = ", ".join(f"({i}, {quote(n)}, [{', '.join(map(quote, bigrams_of(t)))}])" for i, (n, t) in enumerate(templates))
    return f"""
        WITH templates(license, grams) AS (VALUES {rows}),
        numbered(t, license, grams) AS (VALUES {order}),
        anchors(g, t, lead, n) AS (VALUES {places}),
        texts AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
        spots AS (
            SELECT r, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM texts),
        laid AS (SELECT DISTINCT r, t, greatest(i - lead, 1) AS start, n FROM spots JOIN anchors USING (g)),
        cut AS (SELECT doc_id, t, w[start:start + n - 1] AS w FROM laid JOIN texts USING (r)),
        run AS (
            SELECT doc_id, license, grams, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM cut JOIN numbered USING (t)),
        units AS (
            SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS unit FROM documents
            UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10))),
        words AS (
            SELECT doc_id, line_no, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
        grams_of AS (
            SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) >= 2)
        SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, license, max(round(2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)), 9)) AS dice
        FROM grams_of JOIN templates ON 2 * least(len(g), len(grams)) >= {threshold} * (len(g) + len(grams))
        WHERE 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) >= {threshold}
        GROUP BY ALL
        UNION ALL
        SELECT doc_id, -2, license, max(round(2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)), 9))
        FROM run WHERE 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) >= {threshold}
        GROUP BY ALL"""
