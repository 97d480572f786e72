"""License scans: TF-IDF cosine of notices to templates, and inheritance from the nearest directory with a licence file.

Everything is DataFrame and SQL functions. A template is a notice, a licence's whole text where it is short, or the opening of a
long one. The weight of a token is its count times its inverse document frequency over all the files scanned.

A text's units are its lines, its paragraphs of several lines, and its windows: as many tokens as a template has, around each
anchor of it. Anchors are a few of the template's telling tokens; where one stands in a text, the window begins so that the
anchor has the place that it has in the template. So a notice is found within a long line, and a licence's opening within a
whole licence file, whatever stands around them. Lines and paragraphs are compared however long they are.

Two exact bounds spare most of them: a unit reaches the threshold only if what it shares with a template has a norm of the
threshold or more. So it has one of the template's heaviest tokens, those without which the rest's norm is too small
(``needed``), which is asked of each unit where it's made; and what it shares is added up for the others. Each distinct unit that is
left is scored once, however many files carry it.

A file without a notice of its own inherits from the deepest directory above it that has a licence file: each distinct
directory's ancestors are joined to the directories of licence files by path.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame, functions as F

from plinth.functions.signals import let
from plinth.session import staged

#: Notices, texts of short licences, and openings of long ones.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
THRESHOLD = 0.75
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([._-].*)?$"
PARAGRAPH = r"\n[ \t\r]*\n"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Anchors of a template, at which windows begin, and words that are none, as all texts have them.
ANCHORS = 3
PLAIN = set("a above all an and any appear as at author be binary but by can code copies copy file following for form free from holder if in is it law law list made may means met must name names not notice of on or other owns person program public related rights source software subject that the this to under use used version with without work you".split())


def template_tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def anchors(templates: list[tuple[str, str]]) -> list[tuple[str, int, int]]:
    """(token, place, length): for each template, of its tokens that aren't plain words, the first and the longest (of equally
    long ones those that come first), ``ANCHORS`` in all, where each stands first, and how many tokens the template has."""
    out = set()
    for _, body in templates:
        own = template_tokens(body)
        telling = [t for t in dict.fromkeys(own) if t not in PLAIN]
        found = telling[:1] + sorted(telling[1:], key=lambda t: (-len(t), own.index(t)))[: ANCHORS - 1]
        out |= {(t, own.index(t), len(own)) for t in found}
    return sorted(out)


class Weights:
    """The templates' unit vectors, given the number of files and in how many each of their tokens stands."""

    def __init__(self, templates: list[tuple[str, str]], files: int, seen: dict[str, int]):
        self.files = files
        self.vectors = []
        for _, text in templates:
            counts = Counter(template_tokens(text))
            weights = {t: n * (log((1 + files) / (1 + seen.get(t, 0))) + 1) for t, n in counts.items()}
            norm = sqrt(sum(w * w for w in weights.values()))
            self.vectors.append({t: w / norm for t, w in weights.items()})


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(f"({TOKEN})"), F.lit(1))


def needed(vectors: list[dict[str, float]], seen: dict[str, int], threshold: float) -> list[str]:
    """Tokens of which a unit that reaches the threshold has at least one: of each template the heaviest that any file has, until what
    is left of them has a norm below the threshold. (The cosine with a unit that has none of them is at most that norm.)"""
    out: set[str] = set()
    for vector in vectors:
        known = {t: w for t, w in vector.items() if seen.get(t)}
        left = sum(w * w for w in known.values())
        for token, weight in sorted(known.items(), key=lambda x: (-x[1], x[0])):
            if left < threshold * threshold - 1e-6:
                break
            out.add(token)
            left -= weight * weight
    return sorted(out)


#: A span of tokens as one number: where it begins, times this, and its length.
SPAN = 1 << 20


def units(text: Column, tokens: Column, at: list[tuple[str, int, int]], names: list[str]) -> Column:
    """The distinct units of a text as strings of tokens: lines and paragraphs of several lines with one of the named tokens, and
    windows at anchors. Spans are numbers and units strings, which Spark tells apart by hash."""
    some = F.array(*(F.lit(t) for t in names)).cast("array<string>")
    places: dict[str, list[Column]] = {}
    for t, place, size in at:
        places.setdefault(t, []).append(F.struct(F.lit(place).alias("place"), F.lit(size).alias("size")))
    table = F.map_from_arrays(F.array(*map(F.lit, places)), F.array(*(F.array(*x) for x in places.values())))
    found = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), F.try_element_at(table, t).alias("own"))), lambda x: x["own"].isNotNull())
    spans = F.flatten(F.transform(found, lambda x: F.transform(x["own"], lambda y: F.greatest(x["i"] - y["place"], F.lit(0)).cast("long") * SPAN + y["size"])))
    windows = F.transform(F.array_distinct(spans), lambda x: F.array_join(F.slice(tokens, (x / SPAN).cast("int") + 1, (x % SPAN).cast("int")), " "))
    parts = F.concat(F.split(text, "\n"), F.filter(F.split(text, PARAGRAPH), lambda p: p.contains("\n")))
    parts = F.transform(F.filter(F.transform(parts, _tokens), lambda x: F.arrays_overlap(x, some)), lambda x: F.array_join(x, " "))
    return F.array_distinct(F.concat(parts, windows))


def directory(path: Column) -> Column:
    """All before the last slash; empty where there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(df: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``df``: its id, path, own_license and similarity (of its best notice at the threshold or
    above, to 6 decimals; equal ones: the first licence by name), license (its own, else the inherited one), origin (own,
    inherited or null) and license_file (the path it's inherited from).

    A null or empty text has no notice. A null path has no directory: nothing is inherited from it or by it. Rows that share
    id and path are one file; each counts for document frequencies. A directory with several licence files passes on the most similar notice, then the first path.
    No rows give no rows; columns that aren't named play no part.
    """
    spark, at = df.sparkSession, anchors(templates)
    files = df.select(df[id_col].alias("id"), df[path_col].cast("string").alias("path"), df[text_col].cast("string").alias("text"))
    seen = files.select(F.explode(F.array_distinct(_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    seen = staged(seen, "license-frequencies")
    vocabulary = sorted({t for _, body in templates for t in template_tokens(body)})
    known = spark.createDataFrame([(t,) for t in vocabulary], "token string")  # as large as the templates, as all that is broadcast here
    held = {r["token"]: r["n"] for r in seen.join(F.broadcast(known), "token").collect()}
    weights = Weights(templates, files.count(), held)

    names = needed(weights.vectors, held, threshold)
    every = F.array(*(F.lit(t) for t in sorted({*names, *(t for t, *_ in at)}))).cast("array<string>")
    words = _tokens(F.col("text"))
    # A text's tokens are made once: the optimizer would put their expression into every window's.
    found = files.filter(F.arrays_overlap(words, every)).select("id", "path", F.explode(let(words, lambda tokens: units(F.col("text"), tokens, at, names))).alias("unit"))
    found = staged(found.withColumn("key", F.unhex(F.sha2("unit", 256))), "license-units")

    idf = lambda n: F.log((1.0 + F.lit(weights.files)) / (1.0 + n)) + 1.0
    sides = spark.createDataFrame([(t, i, templates[i][0], w) for i, v in enumerate(weights.vectors) for t, w in v.items()], "token string, template int, license string, w double")
    # The cosine is at most the norm of a template's part that a unit shares, whatever else the unit holds.
    parts = sides.select("token", "template", (F.col("w") * F.col("w")).alias("m"))
    distinct = staged(found.groupBy("key").agg(F.first("unit").alias("unit")), "license-distinct").withColumn("unit", F.split("unit", " "))
    mass = distinct.select("key", F.explode(F.array_distinct("unit")).alias("token")).join(F.broadcast(parts), "token").groupBy("key", "template").agg(F.sum("m").alias("m"))
    distinct = distinct.join(mass.filter(F.col("m") >= threshold**2 - 1e-6).select("key").distinct(), "key", "left_semi")
    counts = distinct.select("key", F.explode("unit").alias("token")).groupBy("key", "token").agg(F.count("*").alias("m"))
    own = counts.join(seen, "token").select("key", "token", (F.col("m") * idf(F.col("n"))).alias("u"))
    own = staged(own, "license-weights")
    norms = own.groupBy("key").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("norm"))
    dots = own.join(F.broadcast(sides), "token").groupBy("key", "template", "license").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    scored = dots.join(norms, "key").select("key", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("s")).filter(F.col("s") >= threshold)
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("s")).alias("minus"), "license")).alias("b"))
    per_file = found.select("id", "path", "key").join(best, "key").groupBy("id", "path").agg(F.min("b").alias("b"))
    per_file = staged(per_file.select("id", "path", F.col("b.license").alias("own_license"), (-F.col("b.minus")).alias("similarity")), "license-files")

    holders = per_file.filter(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_FILE)).withColumn("dir", directory(F.col("path")))
    holders = holders.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "path", "own_license")).alias("h")).select("dir", F.col("h.path").alias("license_file"), F.col("h.own_license").alias("passed"))
    dirs = files.filter("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))).alias("a")).select("dir", "a.*")
    above = above.union(dirs.filter("dir != ''").select("dir", F.lit(0).alias("depth"), F.lit("").alias("up")))
    nearest = above.join(holders, above["up"] == holders["dir"]).groupBy(above["dir"]).agg(F.max_by(F.struct("license_file", "passed"), "depth").alias("n"))
    rows = files.select("id", "path", directory(F.col("path")).alias("dir"))
    mine = per_file.select(F.col("id").alias("_i"), F.col("path").alias("_p"), "own_license", "similarity")
    rows = rows.join(mine, F.col("id").eqNullSafe(F.col("_i")) & F.col("path").eqNullSafe(F.col("_p")), "left").join(nearest, "dir", "left")
    inherited = F.col("own_license").isNull() & F.col("n").isNotNull()
    return rows.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), "own_license", "similarity",
        F.coalesce("own_license", "n.passed").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(inherited, "inherited").alias("origin"),
        F.when(inherited, F.col("n.license_file")).alias("license_file"),
    )


def document_paths(documents: DataFrame) -> DataFrame:
    """``documents`` with a path: a tree for each source, 50 documents a folder and 20 folders a level, where the first
    document of each folder, level and ten levels is its licence file."""
    top = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")))
    level = F.concat(top, F.lit("/d"), F.expr("cast(doc_id div 1000 as string)"))
    folder = F.concat(level, F.lit("/"), F.expr("cast(doc_id div 50 % 20 as string)"))
    name = F.when(F.expr("doc_id % 10000 = 0"), F.concat(top, F.lit("/LICENSE"))).when(F.expr("doc_id % 1000 = 0"), F.concat(level, F.lit("/LICENSE")))
    name = name.when(F.expr("doc_id % 50 = 0"), F.concat(folder, F.lit("/LICENSE"))).otherwise(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return documents.select("doc_id", "text", name.alias("path"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of ``scan(document_paths(documents))``, without the shortcuts."""
    quoted = lambda x: x.replace("'", "''")
    values = ", ".join(f"({i}, '{name}', '{quoted(text)}')" for i, (name, text) in enumerate(templates))
    at = ", ".join(f"('{t}', {place}, {size})" for t, place, size in anchors(templates))
    upper = f"'{UPPER}', '{UPPER.lower()}'"
    split = lambda x: f"regexp_extract_all(translate({x}, {upper}), '{TOKEN}')"
    return f"""
WITH templates(template, license, body) AS (VALUES {values}),
anchors(token, place, size) AS (VALUES {at}),
files AS (
    SELECT doc_id, text, {split("text")} AS tokens, CASE WHEN doc_id % 10000 = 0 THEN top || '/LICENSE' WHEN doc_id % 1000 = 0 THEN lev || '/LICENSE'
        WHEN doc_id % 50 = 0 THEN folder || '/LICENSE' ELSE folder || '/' || doc_id || '.txt' END AS path
    FROM (SELECT *, lev || '/' || ((doc_id // 50) % 20) AS folder FROM (SELECT *, top || '/d' || (doc_id // 1000) AS lev
        FROM (SELECT *, '/' || coalesce(source, 'none') AS top FROM documents)))
),
total AS (SELECT count(*) AS m FROM files),
idf AS (SELECT token, ln((1.0 + m) / (1.0 + count(*))) + 1 AS idf FROM (SELECT DISTINCT doc_id, path, unnest(tokens) AS token FROM files), total GROUP BY token, m),
tt AS (SELECT template, license, unnest({split("body")}) AS token FROM templates),
tc AS (SELECT template, license, token, count(*) AS n FROM tt GROUP BY ALL),
tw AS (SELECT template, license, token, n * coalesce(idf, ln(1.0 + m) + 1) AS w FROM tc LEFT JOIN idf USING (token), total),
tv AS (SELECT template, license, token, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS w FROM tw),
parts AS (
    SELECT doc_id, path, {split("part")} AS unit FROM (
        SELECT doc_id, path, unnest(string_split(text, chr(10))) AS part FROM files
        UNION ALL SELECT * FROM (SELECT doc_id, path, unnest(regexp_split_to_array(text, '{PARAGRAPH}')) AS part FROM files) WHERE contains(part, chr(10)))
),
words AS (SELECT doc_id, path, tokens, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS i FROM files),
units AS (
    SELECT DISTINCT doc_id, path, array_to_string(unit, ' ') AS unit FROM (
        SELECT doc_id, path, unit FROM parts WHERE len(unit) > 0
        UNION ALL SELECT doc_id, path, tokens[greatest(i - place, 0) + 1 : greatest(i - place, 0) + size] FROM words JOIN anchors USING (token))
),
distinct_units AS (SELECT DISTINCT unit FROM units),
ut AS (SELECT unit, token, count(*) AS n FROM (SELECT unit, unnest(string_split(unit, ' ')) AS token FROM distinct_units) GROUP BY ALL),
uw AS (SELECT unit, token, n * idf AS u FROM ut JOIN idf USING (token)),
norms AS (SELECT unit, sqrt(sum(u * u)) AS norm FROM uw GROUP BY unit),
dots AS (SELECT unit, license, sum(u * w) AS dot FROM uw JOIN tv USING (token) GROUP BY unit, template, license),
scored AS (SELECT unit, license, round(dot / norm, 6) AS s FROM dots JOIN norms USING (unit) WHERE round(dot / norm, 6) >= {threshold}),
own AS (
    SELECT doc_id, path, license AS own_license, s AS similarity FROM units JOIN scored USING (unit)
    QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY s DESC, license) = 1
),
holders AS (
    SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS up, path AS license_file, own_license AS passed FROM own WHERE path LIKE '%/LICENSE'
    QUALIFY row_number() OVER (PARTITION BY up ORDER BY similarity DESC, path) = 1
),
dirs AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files WHERE path IS NOT NULL),
nearest AS (
    SELECT dir, license_file, passed FROM dirs JOIN holders ON dir = up OR starts_with(dir, up || '/')
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1
)
SELECT f.doc_id, f.path, own_license, similarity, coalesce(own_license, passed) AS license,
    CASE WHEN own_license IS NOT NULL THEN 'own' WHEN passed IS NOT NULL THEN 'inherited' END AS origin,
    CASE WHEN own_license IS NULL THEN license_file END AS license_file
FROM files f LEFT JOIN own ON f.doc_id = own.doc_id AND f.path = own.path LEFT JOIN nearest ON regexp_extract(f.path, '^(.*)/[^/]*$', 1) = dir
"""
