import re
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cdrlens.llm import licenses


def test_variants_match(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    texts = {
        1: mit, 2: "Copyright (c) 2020 Someone\n\n" + mit.upper(), 3: mit.replace("license", "licence").replace("sublicense", "sublicence").replace('"', "“"), 4: "  " + mit.replace(",", " ").replace("\n", "\r\n"),
        5: mit + " Extra.", 6: None, 7: "", 8: "!!!", 9: "(C) 1999 X\nAll rights reserved.\nLICENSED UNDER THE APACHE LICENCE, VERSION 2.0", 10: "licensed under cc by-nc 4.0",
    }
    rows = [(k, t, "x") for k, t in texts.items()] + [(10, texts[10], "x"), (None, mit, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = licenses.matched(df)
    ids = sorted(str((r.doc_id, r.license_id)) for r in got.collect())
    want = [(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "MIT"), (5, None), (6, None), (7, None), (8, None), (9, "Apache-2.0"), (10, "CC-BY-NC-4.0"), (10, "CC-BY-NC-4.0"), (None, "MIT")]
    assert ids == sorted(map(str, want))
    assert {r.n_words for r in got.filter("doc_id in (6, 7, 8)").collect()} == {0}
    assert licenses.matched(df.limit(0)).count() == 0


def test_only_dataframe_functions(spark):
    plan = licenses.matched(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_own_licences_and_ties(spark):
    known = spark.createDataFrame([("B", "Some terms"), ("A", "some, TERMS"), (None, "others"), ("C", "..."), ("D", None)], "license_id string, text string")
    df = spark.createDataFrame([(1, "Some terms!"), (2, "others"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.matched(df, known).collect()}
    assert got == {1: "A", 2: None, 3: None}


def test_known_forms_differ(spark):
    rows = licenses.known_licenses(spark).select("license_id", licenses.digest(F.col("text")).alias("d")).collect()
    assert len({r.d for r in rows}) == len(rows)


def test_known_texts_at_wrap_widths(spark):
    rows = []
    for k, (name, text) in enumerate(licenses.KNOWN):
        for width in (20, 30, 40, 50, 60, 66, 70, 72, 76, 78, 80, 100, 120):
            lines = [w for part in text.split("\n") for w in textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False) or [""]]
            for mark in ("", "# ", " * ", "// "):
                head = [f"{mark}Copyright (c) 2020 Someone", f"{mark}All rights reserved.", ""]
                rows.append((f"{k} {width} {mark}", name, "\n".join(head + [mark + x for x in lines])))
    df = spark.createDataFrame(rows, "doc_id string, want string, text string")
    got = {r.doc_id: r.license_id for r in licenses.matched(df).collect()}
    assert [(d, got[d]) for d, want, _ in rows if got[d] != want] == []


def test_copyright_lines(spark):
    held = ["Copyright 2020 X", "copyright (c) X", "Copyright © X", "(c) 2020 X", "© X", "(C) Copyright X", "All Rights Reserved.", "# Copyright (c) 2020", " * Copyright: 2020 X", "/* Copyright (C) 2020 */", "Copyright [year] [name]"]
    terms = ["copyright notice and this", "Copyright holder be liable", "(c) You must retain", "all rights reserved to others", "copyright law", "copyrighted 2020"]
    df = spark.createDataFrame([(x, f"{x}\r\nterms") for x in held + terms], "doc_id string, text string")
    got = {r.doc_id: r.n_words for r in licenses.matched(df).collect()}
    assert [x for x in held if got[x] != 1] == [] and [x for x in terms if got[x] == 1] == []


def spans(df, known=None):
    return sorted((r.doc_id, r.start_word, r.n_words, r.license_id) for r in licenses.noticed(df, known).collect())


def test_runs_of_lines(spark):
    mit = licenses.KNOWN[1][1]
    wrapped = "\r\n".join("# " + x for part in mit.split("\n") for x in textwrap.wrap(part, 50) or [""])
    texts = {
        1: "Some words first.\nReleased under the MIT licence.", 2: f"def f():\n\n{wrapped}\n\nand more", 3: "Released under the MIT License. Not a whole line.", 4: None, 5: "", 6: "\n\n",
        7: "Licensed under\nCC BY-NC 4.0.\nReleased under the MIT License.", 8: "MIT License\n" + mit,
    }
    df = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    n = len(re.findall(r"\w+", mit))
    assert spans(df) == [(1, 3, 5, "MIT"), (1, 3, 5, "MIT"), (2, 2, n, "MIT"), (7, 0, 7, "CC-BY-NC-4.0"), (7, 7, 5, "MIT"), (8, 0, n + 2, "MIT"), (8, 2, n, "MIT")]
    known = spark.createDataFrame([("B", "noncommercial use"), ("A", "Non-commercial\nuse"), (None, "x"), ("C", "...")], "license_id string, text string")
    rows = spark.createDataFrame([(1, "x\nnoncommercial\nuse")], "doc_id long, text string")
    assert spans(rows, known) == [(1, 1, 3, "A")] and spans(rows, known.limit(0)) == [] and spans(df.limit(0)) == []
    plan = licenses.noticed(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_given_notices(spark):
    """The lines of the documents that equal a known text, found by splitting them here."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    short = {" ".join(t.lower().split()): i for i, t in licenses.KNOWN if "\n" not in t and len(t) < 100}
    want = sorted((r.doc_id, short[x]) for r in docs.collect() for x in (" ".join(y.lower().split()) for y in (r.text or "").split("\n")) if x in short)
    assert len(want) == 39 and [(s[0], s[3]) for s in spans(docs)] == want


@pytest.mark.parametrize("name,file", [("Apache-2.0", "Apache-2.0"), ("GPL-3.0-only", "GPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("LGPL-2.1-only", "LGPL-2.1")])
def test_whole_licences(spark, name, file):
    path = Path("/usr/share/common-licenses", file)
    if not path.exists():
        pytest.skip("no licence texts on this machine")
    df = spark.createDataFrame([(1, "Terms:\n" + path.read_text(errors="replace"))], "doc_id long, text string")
    assert (1, 1, {w[0]: w[1] for w in licenses.WHOLE}[name], name) in spans(df)
