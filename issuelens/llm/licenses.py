"""License scan: lines, whole texts and windows of words against license templates by the Dice coefficient of word bigrams.

Native: one projection per document, no shuffle and no Python. A text is
normalised to lower-case ASCII words. Its lines (and, if it has several, the
text as a whole, as line -1) are units; a unit and a template are compared by
their sets of word bigrams. ``2 * common >= threshold * (a + b)`` bounds the
size of a unit's set from both sides, so templates of another size are never
compared. It also bounds the common bigrams from below, so that every unit has
one of a few rare bigrams; texts without any of them leave first, without loss.

A notice wrapped over several lines, or inside a longer line, is found as a
window of neighbouring words, whatever the line ends. Of windows that overlap
the best one counts, with the line it starts on; it is left out where a line
or the whole text that it is part of has the same license already.

Defined results: a null or empty text has no match; a unit or template with a
single word has no bigram and matches nothing; of several templates the one
with the best coefficient is reported, ties to the first id; rows that repeat
are each reported; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.functions.vectors import bind

THRESHOLD_PERCENT = 80

#: Short license notices.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
                         "except in compliance with the License.",
    "bsd-header": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                      "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                      "the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  'associated documentation files (the "Software"), to deal in the Software without restriction.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(text: str) -> list[str]:
    """The sorted distinct bigrams of a template, normalised as texts are."""
    low = text.translate(str.maketrans(UPPER, LOWER))
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in low).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def normalised(text: Column) -> Column:
    """Lower-case ASCII words parted by single blanks; line feeds stay."""
    return F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9\n]+", " ")


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbours of an array of words."""
    count = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), count), F.slice(words, F.lit(2), count),
                                       lambda a, b: F.concat(a, F.lit(" "), b)))


def least_common(size: int, percent: int) -> int:
    """So many bigrams of a template of ``size`` are in every unit that reaches the threshold."""
    return -(-percent * size // (200 - percent))


def anchors(known: dict[str, list[str]], percent: int) -> list[str]:
    """Bigrams of which every unit that reaches the threshold has one: all but so few of a template that the rest are
    not enough. The longest ones are taken, as they are rare in other texts."""
    found = set()
    for v in known.values():
        found.update(sorted(v, key=lambda b: (-len(b), b))[:len(v) - max(least_common(len(v), percent), 1) + 1])
    return sorted(found)


def near(size: Column, common: Column, license_id: str, n: int, percent: int) -> Column:
    """The result of a unit of ``size`` bigrams of which ``common`` are in a template of ``n``, or null."""
    return F.when(200 * common >= percent * (size + n),
                  F.struct((2.0 * common / (size + n)).alias("dice"), F.lit(license_id).alias("license_id")))


def best_template(pairs: Column, known: dict[str, list[str]], every: Column, percent: int) -> Column:
    """The best template of a unit, or null: ``struct<dice, license_id>``."""
    sizes = [len(v) for v in known.values()]
    least, most = percent * min(sizes) / (200 - percent), (200 - percent) * max(sizes) / percent
    n, found = F.size(pairs), []
    for k, v in known.items():
        fits = (n * (200 - percent) >= percent * len(v)) & (percent * n <= (200 - percent) * len(v))
        common = F.size(F.array_intersect(pairs, F.array(*map(F.lit, v))))
        found.append(F.when(fits, near(n, common, k, len(v), percent)))
    best = F.aggregate(F.filter(F.array(*found), lambda x: x.isNotNull()), F.lit(None).cast("struct<dice:double,license_id:string>"),
                       lambda a, x: F.when(a.isNull() | (x["dice"] > a["dice"]), x).otherwise(a))
    return F.when(n.between(int(least), int(most) + 1) & F.arrays_overlap(pairs, every), best)


def windows(pairs: Column, known: dict[str, list[str]], percent: int) -> Column:
    """The best windows of a text's neighbours ``struct<line, end_line, pair>``, none of which overlap.

    A window starts and ends at a bigram of its template (to leave out another one at an end never lowers the
    coefficient) and has at most as many bigrams as the threshold allows for a set. Of each template and start the best
    window counts, then the windows are taken best first, longer ones first among equals.
    """
    marked = F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("at"), p["pair"].alias("pair"))),
                      lambda x: x["pair"].isin(sorted({b for v in known.values() for b in v})))

    def of_template(hits: Column, license_id: str, v: list[str]) -> Column:
        most, enough = (200 - percent) * len(v) // percent, max(least_common(len(v), percent), 1)

        def of_start(run: Column) -> Column:
            first = run[0]["at"]

            def ending(x: Column, j: Column) -> Column:
                common = F.size(F.array_distinct(F.slice(run, F.lit(1), j + 1)["pair"]))
                size = F.size(F.array_distinct(F.slice(pairs, first + 1, x["at"] - first + 1)["pair"]))
                return F.when(common >= enough, bind(near(size, common, license_id, len(v), percent), lambda r: F.when(
                    r.isNotNull(), F.struct((-r["dice"]).alias("minus"), (first - x["at"]).alias("shorter"), first.alias("at"),
                                            r["license_id"].alias("license_id"), x["at"].alias("end")))))

            return F.when(F.size(F.array_distinct(run["pair"])) >= enough, F.array_min(F.transform(run, ending)))

        def of_hits(own: Column) -> Column:
            return F.transform(own, lambda x, i: bind(
                F.filter(F.slice(own, i + 1, F.lit(most)), lambda y: y["at"] < x["at"] + most), of_start))

        return F.when(F.size(F.array_intersect(hits["pair"], F.array(*map(F.lit, v)))) >= enough,
                      F.filter(bind(F.filter(hits, lambda x: x["pair"].isin(v)), of_hits), lambda x: x.isNotNull()))

    kind = "array<struct<minus:double,shorter:int,at:int,license_id:string,end:int>>"
    every = bind(marked, lambda hits: F.flatten(F.filter(F.array(*(of_template(hits, k, v).cast(kind) for k, v in known.items())),
                                                          lambda x: x.isNotNull())))
    taken = F.aggregate(F.array_sort(every), F.array().cast(kind), lambda kept, x: F.when(
        F.exists(kept, lambda y: (y["at"] <= x["end"]) & (x["at"] <= y["end"])), kept).otherwise(F.concat(kept, F.array(x))))
    return F.transform(taken, lambda x: F.struct(
        pairs[x["at"]]["line"].alias("line"), pairs[x["end"]]["end_line"].alias("end_line"),
        x["license_id"].alias("license_id"), (-x["minus"]).alias("dice")))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``(doc_id, line, license_id, dice)`` of every unit that reaches the threshold."""
    known = {k: template_bigrams(v) for k, v in sorted(templates.items())}
    known = {k: v for k, v in known.items() if v}
    schema = "doc_id long, line int, license_id string, dice double"
    if not known:
        return docs.sparkSession.createDataFrame([], schema)
    every = F.array(*(F.lit(b) for b in sorted({b for v in known.values() for b in v})))
    flat = F.regexp_replace(F.translate(F.col("text"), UPPER, LOWER), "[^a-z0-9]+", " ")
    texts = docs.where(F.exists(F.array(flat), lambda t: functools.reduce(Column.__or__, (
        t.contains(a) for a in anchors(known, percent))))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def of_lines(lines: Column) -> Column:
        """The results of a text's lines, each an array of words."""
        words = F.flatten(F.transform(lines, lambda x, i: F.transform(
            F.filter(x, lambda w: w != ""), lambda w: F.struct(i.alias("line"), w.alias("word")))))
        pairs = bind(words, lambda w: bind(F.greatest(F.size(w) - 1, F.lit(0)), lambda n: F.zip_with(
            F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.struct(
                a["line"].alias("line"), b["line"].alias("end_line"), F.concat(a["word"], F.lit(" "), b["word"]).alias("pair")))))

        def of_pairs(p: Column) -> Column:
            units = F.concat(F.transform(lines, lambda x, i: F.struct(i.alias("line"), bigrams(x).alias("pairs"))), F.when(
                F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("line"), F.array_distinct(p["pair"]).alias("pairs")))).otherwise(
                F.array().cast("array<struct<line:int,pairs:array<string>>>")))
            matched = F.filter(F.transform(units, lambda u: bind(best_template(u["pairs"], known, every, percent), lambda b: F.struct(
                u["line"].alias("line"), u["line"].alias("end_line"), b["license_id"].alias("license_id"), b["dice"].alias("dice")))),
                lambda x: x["license_id"].isNotNull())
            return bind(matched, lambda m: F.concat(m, F.filter(windows(p, known, percent), lambda w: ~F.exists(
                m, lambda x: (x["license_id"] == w["license_id"])
                & ((x["line"] == -1) | x["line"].between(w["line"], w["end_line"]))))))

        return bind(pairs, of_pairs)

    lines = F.transform(F.split(normalised(F.col("text")), "\n"), lambda x: F.split(F.trim(x), " "))
    return (texts.select("doc_id", F.explode(bind(lines, of_lines)).alias("found"))
            .select("doc_id", F.col("found.line").cast("int").alias("line"), "found.license_id", "found.dice"))


def scan_sql(templates: dict[str, str] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> str:
    """The scan in DuckDB SQL, as joins of bigram rows."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))

    def pairs(source: str, *keys: str) -> str:
        """Bigram rows of a table with an array of words."""
        cols = ", ".join(keys)
        return (f"SELECT DISTINCT {cols}, unnest(list_transform(generate_series(1, len(words) - 1), "
                f"lambda i: words[i] || ' ' || words[i + 1])) AS pair FROM {source}")

    norm = f"regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g')"
    return f"""
WITH templates(license_id, text) AS (VALUES {rows}),
known AS ({pairs(f"(SELECT license_id, string_split(trim({norm}), ' ') AS words FROM templates)", "license_id")}),
known_size AS (SELECT license_id, count(*) AS n FROM known GROUP BY license_id),
texts AS (SELECT doc_id, row_number() OVER () AS row_id, {norm} AS norm FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, row_id, CAST(generate_subscripts(string_split(norm, chr(10)), 1) - 1 AS INTEGER) AS line,
         string_split(trim(unnest(string_split(norm, chr(10)))), ' ') AS words FROM texts
  UNION ALL
  SELECT doc_id, row_id, -1, string_split(trim(regexp_replace(norm, '[ \\n]+', ' ', 'g')), ' ') FROM texts
  WHERE contains(norm, chr(10))),
unit_pairs AS ({pairs("units", "doc_id", "row_id", "line")}),
unit_size AS (SELECT doc_id, row_id, line, count(*) AS n FROM unit_pairs GROUP BY ALL),
common AS (SELECT u.doc_id, u.row_id, u.line, k.license_id, count(*) AS c FROM unit_pairs u JOIN known k USING (pair) GROUP BY ALL),
scored AS (
  SELECT c.doc_id, c.row_id, c.line, c.license_id, 2.0 * c.c / (u.n + k.n) AS dice
  FROM common c JOIN unit_size u USING (doc_id, row_id, line) JOIN known_size k USING (license_id)
  WHERE 200 * c.c >= {percent} * (u.n + k.n))
SELECT doc_id, line, license_id, CAST(dice AS DOUBLE) AS dice FROM scored
QUALIFY row_number() OVER (PARTITION BY row_id, line ORDER BY dice DESC, license_id) = 1
"""
