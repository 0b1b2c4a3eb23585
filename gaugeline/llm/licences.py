"""Licences of files: TF-IDF cosine of their statements, paragraphs and licence texts to templates, then
inheritance along paths.

A text is cut into units at line ends and after ``.``, ``;``, ``!`` and ``?``. Every stretch of one to
``WINDOW`` units, every paragraph and the whole text of a licence file are compared with the
templates, in DataFrame functions only: statements inside a line, wrapped over lines, title lines and
whole notices. A term is a lower-case word of a template; its weight is
ln((1 + files) / (1 + files with the term)) + 1, counted over all files. Every word of a stretch that the
template at hand has not is a dimension of its own of weight 1, like a term that all files have: words
around a full statement lower its cosine only a little. A template counts only where all its naming terms are held, since
without them the words name another licence. The heaviest naming term of each template is looked for
in the text first; no template can count without it, so that filter loses nothing. The order of words is
not compared: all words of a statement, scattered over one stretch, count as the statement.

A file takes its best stretch: its own header. A reservation of rights counts only where no licence is
named. A file whose name says so is the licence file of its directory. Files without a header take the
licence of the nearest directory above them that has a licence file.

Defined results: null, empty and blank texts have no header; ties go to the smaller licence name, in
a directory to the higher cosine and then the smaller path; a null path has neither directory nor
inheritance; rows that share a path are files of their own; columns with the name of a result are
replaced, all others kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.joins import join_ids
from gaugeline.session import cut_lineage

#: Licence, its naming terms, and a statement, title or notice by which files name it.
TEMPLATES = [
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "identifier apache 2", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "bsd redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License."),
    ("BSD-3-Clause", "neither endorse promote", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "identifier bsd 3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "cc by 4", "This work is licensed under CC BY 4.0."),
    ("CC-BY-4.0", "creative attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "cc nc 4", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "creative noncommercial 4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "general public 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gnu general public 3", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "general public redistribute 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "identifier gpl 3", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "lesser general public 3", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "lesser general public 3", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "identifier lgpl 3", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("MIT", "mit license", "Released under the MIT License."),
    ("MIT", "mit license", "The MIT License (MIT)"),
    ("MIT", "identifier mit", "SPDX-License-Identifier: MIT"),
    ("MIT", "permission granted deal", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "identifier mpl 2", "SPDX-License-Identifier: MPL-2.0"),
    ("Proprietary", "rights reserved", "All rights reserved."),
]
#: Counts only where no other licence is named: the line stands above many licence texts.
RESERVED = "Proprietary"
#: Units in the longest stretch that is compared; longer notices are met as paragraphs.
WINDOW = 3
UNIT_ENDS = "([.;!?])[ \\t\\r\\n]"
PARAGRAPH_ENDS = "\\n[ \\t\\r]*\\n"
Template = tuple[str, str, str]
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
WORD_ENDS = "[^a-z0-9]+"


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits of A-Z and 0-9."""
    return F.array_remove(F.split(F.lower(text), WORD_ENDS), "")


def terms_of(text: str) -> list[str]:
    out, word = [], ""
    for char in text.lower() + " ":
        if char in "abcdefghijklmnopqrstuvwxyz0123456789":
            word += char
        elif word:
            out.append(word)
            word = ""
    return out


def vocabulary(templates: list[Template]) -> list[str]:
    return sorted({t for _, naming, text in templates for t in terms_of(f"{naming} {text}")})


def term_weights(files: DataFrame, templates: list[Template]) -> dict[str, float]:
    """Weight of each template term. As many values as the templates have terms."""
    known = F.array(*map(F.lit, vocabulary(templates)))
    held = F.array_intersect(F.coalesce(terms(F.col("text")), F.array().cast("array<string>")), known)
    counted = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").count()
    found = {r["term"]: r["count"] for r in counted.collect()}
    n = found.pop("", 0)
    return {t: math.log((1 + n) / (1 + found.get(t, 0))) + 1 for t in vocabulary(templates)}


def template_vector(text: str, weights: dict[str, float]) -> dict[str, float]:
    """Unit vector of a template."""
    words = terms_of(text)
    raw = {t: words.count(t) * weights[t] for t in sorted(set(words))}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {t: v / norm for t, v in raw.items()}


def key_terms(templates: list[Template], weights: dict[str, float]) -> list[str]:
    """The heaviest naming term of each template: a stretch without any of them can count for none."""
    return sorted({max(naming.split(), key=lambda t: (weights[t], t)) for _, naming, _ in templates})


def stretches(text: Column, units: Column, whole: Column) -> Column:
    """Array of struct(text, at, size) of a text: ``size`` units from unit ``at``, paragraphs (size 0), where ``whole`` the text (size -1)."""
    piece = lambda x, at, size: F.struct(x.alias("text"), at.alias("at"), F.lit(size).alias("size"))
    windows = [F.filter(F.transform(units, lambda _, i: piece(F.concat_ws(" ", F.slice(units, i + 1, k)), i, k)), lambda p: p["at"] + k <= F.size(units)) for k in range(1, WINDOW + 1)]  # noqa: B023
    paragraphs = F.transform(F.split(text, PARAGRAPH_ENDS), lambda x, i: piece(x, i, 0))
    return F.concat(*windows, paragraphs, F.filter(F.array(piece(text, F.lit(0), -1)), lambda _: whole))


def headers(files: DataFrame, least: float = 0.7, templates: list[Template] | None = None, path: str | None = None) -> DataFrame:
    """``files`` with ``header``: struct(licence, cosine, at, size) of the best stretch, null below ``least``.
    Where ``path`` names a column, licence files by that path are also compared as a whole."""
    templates = templates or TEMPLATES
    weights = term_weights(files, templates)
    keys = "(?<![a-z0-9])(?:" + "|".join(key_terms(templates, weights)) + ")(?![a-z0-9])"
    known = F.array(*map(F.lit, sorted(weights)))
    weight = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
    vectors = F.array(*[
        F.struct(F.lit(licence).alias("licence"), F.array(*map(F.lit, naming.split())).alias("naming"),
                 F.create_map(*[F.lit(v) for pair in template_vector(text, weights).items() for v in pair]).alias("vector")) for licence, naming, text in templates])

    kept = F.struct(*[F.col(f"`{c}`") for c in files.columns if c != "header"])
    whole = F.coalesce(F.col(path).rlike(LICENCE_FILE), F.lit(False)) if path else F.lit(False)
    rows = files.select(kept.alias("_row"), whole.alias("_whole"), F.when(F.lower("text").rlike(keys), F.lower("text")).otherwise("").alias("_text"))
    rows = rows.withColumn("_units", F.filter(F.split(F.regexp_replace("_text", UNIT_ENDS, "$1\n"), "\n"), lambda u: u.rlike("[a-z0-9]")))
    found = F.filter(stretches(F.col("_text"), F.col("_units"), F.col("_whole")), lambda p: p["text"].rlike(keys))
    place = lambda x: (x["at"].alias("at"), x["size"].alias("size"))
    worded = F.transform(found, lambda p: F.struct(*place(p), terms(p["text"]).alias("terms")))
    held = F.transform(worded, lambda x: F.struct(*place(x), F.size(x["terms"]).alias("n"), F.filter(x["terms"], lambda t: F.array_contains(known, t)).alias("held")))
    counted = F.transform(held, lambda x: F.struct(
        *place(x), x["n"].cast("double").alias("n"), F.transform(F.array_sort(F.array_distinct(x["held"])), lambda t: F.struct(t.alias("term"), F.size(F.filter(x["held"], lambda y: y == t)).alias("tf"))).alias("parts")))
    counted = F.transform(counted, lambda x: F.struct(*place(x), x["n"].alias("n"), F.transform(x["parts"], lambda c: F.struct(c["term"].alias("term"), c["tf"].alias("tf"), (c["tf"] * F.element_at(weight, c["term"])).alias("value"))).alias("parts")))

    def compared(x: Column) -> Column:
        shared = lambda q: F.filter(x["parts"], lambda c: F.map_contains_key(q["vector"], c["term"]))
        norm = lambda q: F.sqrt(F.aggregate(shared(q), x["n"], lambda s, c: s + c["value"] * c["value"] - c["tf"]))
        product = lambda q: F.aggregate(shared(q), F.lit(0.0), lambda s, c: s + c["value"] * F.element_at(q["vector"], c["term"]))
        named = F.filter(vectors, lambda q: F.forall(q["naming"], lambda t: F.exists(x["parts"], lambda c: c["term"] == t)))
        return F.transform(named, lambda q: F.struct(F.round(product(q) / norm(q), 9).alias("cosine"), q["licence"].alias("licence"), *place(x)))

    scores = F.filter(F.flatten(F.transform(counted, compared)), lambda s: s["cosine"] >= least)
    best = F.array_min(F.transform(scores, lambda s: F.struct(
        (s["licence"] == RESERVED).alias("reserved"), (-s["cosine"]).alias("below"), s["licence"].alias("licence"), *place(s))))
    rows = rows.withColumn("_best", best)
    header = F.when(F.col("_best").isNotNull(), F.struct(F.col("_best.licence").alias("licence"), (-F.col("_best.below")).alias("cosine"), *place(F.col("_best"))))
    return rows.select("_row.*", header.alias("header"))


def folder(path: Column) -> Column:
    """The directory of a path, "" at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def licensed(files: DataFrame, header: str = "header", path: str = "path") -> DataFrame:
    """``files`` (path, header) with ``licence``, ``origin`` (header, inherited or null) and ``inherited_from``.
    ``files`` is read twice, so store it first."""
    kept = [F.col(f"`{c}`") for c in files.columns if c not in ("licence", "origin", "inherited_from")]
    files = files.select(F.struct(*kept).alias("_row"), F.col(path).alias("_path"), F.col(header).alias("_header"), folder(F.col(path)).alias("_folder"))
    named = files.where(F.col("_path").rlike(LICENCE_FILE) & F.col("_header").isNotNull())
    best = F.min_by(F.struct(F.col("_header.licence").alias("licence"), F.col("_path").alias("from")), F.struct(-F.col("_header.cosine"), F.col("_path"), F.col("_header.licence")))
    granted = named.groupBy(F.col("_folder").alias("_above")).agg(best.alias("_grant"))
    folders = files.where("_path is not null").select("_folder").distinct()
    parts = F.split("_folder", "/")
    above = folders.select("_folder", F.posexplode(F.concat(F.array(F.lit("")), F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))).alias("_depth", "_above"))
    nearest = above.join(granted, "_above").groupBy("_folder").agg(F.max_by("_grant", "_depth").alias("_grant"))
    out = join_ids(files, cut_lineage(nearest), "_folder", "left")
    own = F.col("_header.licence")
    return out.select(
        "_row.*", F.coalesce(own, F.col("_grant.licence")).alias("licence"),
        F.when(own.isNotNull(), "header").when(F.col("_grant").isNotNull(), "inherited").alias("origin"), F.when(own.isNull(), F.col("_grant.from")).alias("inherited_from"))
