"""License scan: lines, whole texts and windows of texts compared with license notices and texts, in built-in functions only.

A unit is a line of a text, a whole text, or a window of it: as many words as a notice has, from where an
anchor of the notice, one of its longest words with the next, says that it begins. So a notice is found that is wrapped over lines, or stands
in a longer line or file. A unit is normalised to lower-case words of
letters and digits, and compared with each notice by the Dice coefficient of the two sets of word
bigrams. A coefficient of at least ``threshold`` needs set sizes within a factor of
``threshold / (2 - threshold)`` of each other, so units outside the sizes of all notices are set aside
before their bigrams are made, and a unit meets only notices of fitting size.

Null and empty texts have no unit. Repeated rows and null ids give rows of their own. Extra columns are
dropped first, so none can clash. A unit that ties between notices takes the first name in order. A notice
that has been changed has a window for each place that its anchors give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.llm.license_texts import TEXTS

THRESHOLD = 0.75

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Opening or reference notices of public licenses.
NOTICES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-2-Clause": "Released under the 2-Clause BSD License.",
    "BSD-3-Clause": "Released under the 3-Clause BSD License.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
} | TEXTS

#: Words of a notice that its windows are found by, at most.
ANCHORS = 4


def notice_words(text: str) -> list[str]:
    """Words of a notice: runs of a-z and 0-9 once A-Z are lower-cased."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()


def notice_bigrams(text: str) -> list[str]:
    words = notice_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def anchors(notices: dict[str, str]) -> list[tuple[str, int, int]]:
    """(bigram, place in the notice, words of the notice): the longest words of each notice, where they first stand, with the next word."""
    out = set()
    for text in notices.values():
        words = notice_words(text)
        for word in sorted(dict.fromkeys(words[:-1]), key=lambda w: (-len(w), words.index(w)))[:ANCHORS]:
            at = words.index(word)
            out.add((f"{word} {words[at + 1]}", at, len(words)))
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(id, unit int, license, dice, n_bigrams): the best notice of each unit that reaches ``threshold``.

    ``unit`` is the number of the line from 1, 0 for a whole text of two lines or more, or for a window the number of its
    first word from 1, negative.
    """
    grams = {name: notice_bigrams(text) for name, text in sorted(notices.items())}
    ratio = threshold / (2 - threshold)
    least = min(len(g) for g in grams.values()) * ratio
    most = max(len(g) for g in grams.values()) / ratio
    text = F.col(text_col).cast("string")
    lines = F.split(text, "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array(text), lines)).otherwise(F.concat(F.array(F.lit(None).cast("string")), lines))
    rows = docs.filter(text.isNotNull()).select(F.col(id_col).alias("__id"), F.size(lines).alias("__lines"), F.posexplode(units).alias("unit", "__unit"))
    words = F.filter(F.split(F.translate("__unit", _UPPER, _UPPER.lower()), "[^a-z0-9]+"), lambda w: w != "")
    # each explode of a one-element array keeps later filters above it, so that nothing is computed twice
    whole = (F.col("unit") == 0) | (F.col("__lines") == 1)
    worded = rows.filter(F.length("__unit") > 2 * least).select("__id", "unit", whole.alias("__whole"), F.explode(F.array(words)).alias("__words"))
    # few texts have an anchor, and only in those are places looked for
    found = anchors(notices)
    known = F.array(*map(F.lit, sorted({w.split(" ")[0] for w, _, _ in found})))
    bigrams = F.array(*map(F.lit, sorted({w for w, _, _ in found})))
    entries = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(at).alias("at"), F.lit(n).alias("n")) for w, at, n in found))
    following = F.transform("__words", lambda w, i: F.struct(F.concat_ws(" ", w, F.get("__words", i + 1)).alias("w"), i.alias("i")))
    hits = F.filter(following, lambda x: F.array_contains(bigrams, x["w"]))
    begins = lambda x: F.transform(F.filter(entries, lambda e: e["w"] == x["w"]), lambda e: F.struct(F.greatest(x["i"] - e["at"], F.lit(0)).alias("lo"), e["n"].alias("n")))
    spans = F.array_distinct(F.flatten(F.transform(hits, begins)))
    parts = F.filter(spans, lambda x: (x["lo"] > 0) | (x["n"] < F.size("__words")))
    own = F.array(F.struct(F.col("unit"), F.col("__words").alias("words")))
    cut = F.transform(parts, lambda x: F.struct((-x["lo"] - 1).alias("unit"), F.slice("__words", x["lo"] + 1, x["n"]).alias("words")))
    each = F.when(F.col("__whole") & F.arrays_overlap("__words", known), F.concat(own, cut)).otherwise(own)
    worded = worded.select("__id", F.explode(each).alias("__u")).select("__id", F.col("__u.unit").alias("unit"), F.col("__u.words").alias("__words"))
    # a bigram of a notice has two of its words; short of `least` shared words there are not enough bigrams
    vocabulary = F.array(*map(F.lit, sorted({w for g in grams.values() for b in g for w in b.split(" ")})))
    near = worded.filter((F.size("__words") > least) & (F.size(F.array_intersect("__words", vocabulary)) >= 2))
    pairs = F.zip_with(F.slice("__words", 1, F.size("__words") - 1), F.slice("__words", 2, F.size("__words") - 1), lambda a, b: F.concat_ws(" ", a, b))
    sized = near.select("__id", "unit", F.explode(F.array(F.array_distinct(pairs))).alias("__grams"))
    indexed = F.array(*map(F.lit, sorted({b for g in grams.values() for b in g})))
    sized = sized.filter(F.size("__grams").between(least, most) & (F.size(F.array_intersect("__grams", indexed)) >= least))
    size = F.size("__grams")
    scores = [
        F.when(
            size.between(len(g) * ratio, len(g) / ratio),
            F.struct((2 * F.size(F.array_intersect("__grams", F.array(*map(F.lit, g)))) / (size + len(g))).alias("dice"), F.lit(name).alias("license")),
        )
        for name, g in grams.items()
    ]
    best = F.reduce(
        F.array(*scores),
        F.struct(F.lit(-1.0).alias("dice"), F.lit("").alias("license")),
        lambda a, x: F.when(x.isNotNull() & (x["dice"] > a["dice"]), x).otherwise(a),
    )
    judged = sized.select("__id", "unit", size.cast("long").alias("n_bigrams"), F.explode(F.array(best)).alias("__best"))
    return judged.filter(F.col("__best.dice") >= threshold).select(
        F.col("__id").alias(id_col), "unit", F.col("__best.license").alias("license"), F.col("__best.dice").alias("dice"), "n_bigrams"
    )


def scan_sql(table: str = "documents", threshold: float = THRESHOLD, notices: dict[str, str] = NOTICES) -> str:
    """The same as DuckDB SQL, every unit against every notice."""
    rows = ", ".join(f"('{name}', [{', '.join(repr(b) for b in notice_bigrams(text))}])" for name, text in sorted(notices.items()))
    places = ", ".join(map(repr, anchors(notices)))
    return f"""
WITH notices(license, g) AS (VALUES {rows}),
anchors(bigram, place, n) AS (VALUES {places}),
split AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM {table} WHERE text IS NOT NULL),
units AS (
  SELECT r, doc_id, i AS unit, len(ls) = 1 AS whole, ls[i] AS u FROM split, unnest(generate_series(1, len(ls))) AS t(i)
  UNION ALL SELECT r, doc_id, 0, TRUE, text FROM split WHERE len(ls) > 1),
worded AS (
  SELECT r, doc_id, unit, whole, regexp_extract_all(translate(u, '{_UPPER}', '{_UPPER.lower()}'), '[a-z0-9]+') AS w FROM units),
windows AS (
  SELECT DISTINCT r, doc_id, w, greatest(i - 1 - place, 0) AS lo, n
  FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM worded WHERE whole) q JOIN anchors a ON a.bigram = q.w[q.i] || ' ' || q.w[q.i + 1]),
every AS (
  SELECT r, doc_id, unit, 0 AS n, w FROM worded
  UNION ALL SELECT r, doc_id, -lo - 1, n, w[lo + 1 : lo + n] FROM windows WHERE lo > 0 OR n < len(w)),
paired AS (
  SELECT r, doc_id, unit, n, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM every WHERE len(w) >= 2),
scored AS (
  SELECT r, doc_id, unit, n, license, 2 * len(list_intersect(b, g)) / (len(b) + len(g)) AS dice, CAST(len(b) AS BIGINT) AS n_bigrams
  FROM paired, notices),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r, unit, n ORDER BY dice DESC, license) AS k FROM scored WHERE dice >= {threshold})
SELECT doc_id, CAST(unit AS INTEGER) AS unit, license, dice, n_bigrams FROM ranked WHERE k = 1"""
