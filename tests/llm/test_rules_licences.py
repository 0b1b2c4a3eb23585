import math

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import licences, rules
from gaugeline.session import cut_lineage


def test_statistics_of_odd_rows(odd):
    got = {(r.doc_id, r.text): r for r in rules.base_statistics(odd).collect()}
    assert len(got) == odd.distinct().count() and rules.base_statistics(odd).count() == odd.count()
    by_id = {k[0]: r for k, r in got.items()}
    for i in (4, 5, 6):
        assert (by_id[i].n_words, by_id[i].word_chars, by_id[i].n_lines, by_id[i].n_repeat_words) == (0, 0, 0, 0)
    # a a a a a a b b b b: windows aaa (4 times) and bbb (2 times) cover all ten words
    assert by_id[13].n_repeat_words == 10 and by_id[13]["size"] == "big"
    for r in got.values():
        words = (r.text or "").split()
        spots = {}
        for i in range(len(words) - 2):
            spots.setdefault(tuple(words[i : i + 3]), []).append(i)
        assert r.n_repeat_words == len({j for s in spots.values() if len(s) > 1 for i in s for j in (i, i + 1, i + 2)})


def test_result_names_replace_columns(odd):
    assert rules.base_statistics(odd.withColumn("n_words", F.lit("x"))).columns.count("n_words") == 1


@pytest.mark.parametrize("k,n,p", [(0, 50, 0.1), (3, 500, 0.01), (40, 5000, 0.01), (200, 100_000, 0.0025)])
def test_binomial_cdf(spark, k, n, p):
    got = spark.range(1).select(rules.binomial_cdf(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), p).alias("c")).first().c
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-8)


def test_thresholds_hold_their_guarantee(spark):
    """4 % of the good documents have a symbol ratio of 0.3: cutoffs above it are certified, none below."""
    n = 6000
    stats = spark.range(n).selectExpr("id as doc_id", "if(id % 2 = 0, 'en', null) as lang", "100L as n_words", "500L as word_chars", "if(id % 25 = 0, 30L, 1L) as n_symbols", "0L as n_dup_lines", "0L as n_repeat_words", "1L as n_lines", "0L as n_shouts")
    stats = cut_lineage(stats)
    good = stats.selectExpr("doc_id", "1 as quality")
    cuts = {r.stratum: r for r in rules.certify(stats, "lang").collect()}
    assert set(cuts) == {"en", None} and all(c.cut_symbols == 0.35 and c.cut_shouting == 0.1 for c in cuts.values())
    assert rules.judge(stats, good).where("not kept").count() == 0
    assert rules.judge(stats.withColumn("n_symbols", F.lit(60)), good.limit(0)).where("kept").count() == n  # no labels: no cutoffs


def test_small_strata_are_tested_together(spark):
    """1 495 good documents certify a cutoff that rejects none of them at two strata or fewer tests, 700 alone do not."""
    row = ["100L as n_words", "500L as word_chars", "if(id % 25 = 0 and lang = 'en', 30L, 1L) as n_symbols", "0L as n_dup_lines", "0L as n_repeat_words", "1L as n_lines", "0L as n_shouts"]
    base = spark.range(6000 + 3 * 700).selectExpr("id", "case when id < 6000 then 'en' when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' end as lang")
    stats = cut_lineage(base.selectExpr("id as doc_id", "lang", *row))
    cuts = {r.stratum: r for r in rules.certify(stats, "lang").collect()}
    assert {k: c.pooled for k, c in cuts.items()} == {"en": False, "a": True, "b": True, None: True}
    assert cuts["en"].cut_symbols == 0.35 and all(cuts[k].cut_symbols == 0.1 for k in ("a", "b", None))
    few = {r.stratum: r for r in rules.certify(stats.where("lang = 'a'"), "lang").collect()}
    assert few["a"].pooled and few["a"].cut_symbols is None


def test_judging_odd_and_empty_tables(odd, labels, empty):
    stats = cut_lineage(rules.base_statistics(odd))
    rows = rules.judge(stats, labels).collect()
    assert len(rows) == odd.count() and all(r.kept is not None for r in rows)
    assert not any(r.kept for r in rows if not (r.text or "").strip())
    assert rules.judge(cut_lineage(rules.base_statistics(empty)), labels.limit(0)).count() == 0


def files(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    return cut_lineage(spark.createDataFrame(
        [("a/LICENSE", mit, 1), ("a/b/c/x.txt", "plain words\nof nobody", 2), ("a/b/COPYING", apache, 3), ("a/b/c/y.txt", f"text first\n{mit}\nmore", 4), ("z/q.txt", "nothing", 5),
         (None, apache, 6), ("a/n.txt", None, 7), ("a/e.txt", "", 8), ("LICENSE", "All rights reserved.", 9), ("a/n.txt", None, 7), ("a/long.txt", "word " * 50_000 + "\n" + apache, 10)],
        "path string, text string, _lines int"))


def test_headers_and_inheritance(spark):
    found = licences.headers(files(spark))
    assert "_lines" in found.columns
    got = [(r._lines, r.licence, r.origin, r.inherited_from) for r in licences.licensed(cut_lineage(found)).collect()]
    assert sorted(got) == [
        (1, "MIT", "header", None), (2, "Apache-2.0", "inherited", "a/b/COPYING"), (3, "Apache-2.0", "header", None), (4, "MIT", "header", None), (5, "Proprietary", "inherited", "LICENSE"),
        (6, "Apache-2.0", "header", None), (7, "MIT", "inherited", "a/LICENSE"), (7, "MIT", "inherited", "a/LICENSE"), (8, "MIT", "inherited", "a/LICENSE"), (9, "Proprietary", "header", None), (10, "Apache-2.0", "header", None)]


def test_the_filter_before_the_cosine_loses_nothing(spark):
    weights = licences.term_weights(files(spark), licences.TEMPLATES)
    keys = set(licences.key_terms(licences.TEMPLATES, weights))
    for _, naming, text in licences.TEMPLATES:
        assert set(naming.split()) <= set(licences.terms_of(text)) and keys & set(naming.split())


MIT_TEXT = """The title of nothing

Copyright (c) 2020 Foo Inc. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""


@pytest.mark.parametrize("text,licence", [
    ("Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0; see the LICENSE file for details.", "Apache-2.0"),
    ("This file is part of Foo. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Foo and all of its parts are licensed to you under the Apache License, Version 2.0 and come without any warranty", "Apache-2.0"),
    ("// Licensed under the\n// Apache License,\n// Version 2.0", "Apache-2.0"),
    ("# SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: ISC", None), ("/* _MIT_ License */", "MIT"), (MIT_TEXT, "MIT"),
    ("        GNU GENERAL PUBLIC LICENSE\n          Version 3, 29 June 2007\n\n Copyright", "GPL-3.0"), ("GNU LESSER GENERAL PUBLIC LICENSE\n\nVersion 3, 29 June 2007", "LGPL-3.0"),
    ("GNU General Public License, version 2", None), ("Copyright 2020 Foo Inc. All rights reserved.", "Proprietary"), ("We went with the crowd under the bridge to get a license.", None),
    ("All seats are taken, a version of the work is under way for the apache helicopters of source 2.", None)])
def test_statements_in_their_surroundings(spark, text, licence):
    """Beside a thousand files of prose, as weights are of the corpus."""
    prose = spark.range(1000).selectExpr("concat('the work of all in this place is under the version of a source, with code ', id) as text", "cast(null as string) as path")
    table = cut_lineage(prose.union(spark.createDataFrame([(text, "x")], "text string, path string")))
    got = licences.headers(table, path="path").where("path = 'x'").first().header
    assert (got and got.licence) == licence


def test_whole_licence_files(spark):
    text = "\n".join(f"{w}." for w in "Released under the MIT one two License".split())  # one word a unit, no stretch of three holds both naming terms
    table = cut_lineage(spark.createDataFrame([("a/LICENSE", text.replace("\n", "\n\n")), ("a/x.txt", text.replace("\n", "\n\n"))], "path string, text string"))
    got = {r.path: r.header for r in licences.headers(table, path="path").collect()}
    assert got["a/LICENSE"].licence == "MIT" and got["a/LICENSE"].size == -1 and got["a/x.txt"] is None


def test_licences_of_no_files(spark):
    none = files(spark).limit(0)
    assert licences.licensed(cut_lineage(licences.headers(none))).count() == 0
