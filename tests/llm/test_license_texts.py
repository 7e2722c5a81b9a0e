"""Known licences in several wrappings, and which lines are copyright statements."""

import re
import textwrap

from pyspark.sql import functions as F

from foldwright.llm import licenses

STATED = re.compile(r"(?im)^\W*(copyright \(c\)|copyright \[|all rights reserved\W*$).*$")
ISC = licenses._ISC.replace("copyright notice and", "\ncopyright notice and")


def ids(spark, rows):
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"]: r["license_id"] for r in found.collect()}


def test_wrappings(spark):
    rows, want = [], {}
    for key, text in [("ISC", licenses._ISC), ("MIT", licenses._MIT), ("Zlib", licenses._ZLIB), *licenses.full_texts()]:
        flat = " ".join(STATED.sub("", text).split())
        forms = [textwrap.fill(flat, w, break_long_words=False, break_on_hyphens=False) for w in (30, 47, 60, 72, 80, 100)]
        forms += [re.sub(r" (?=\W*(copyright|\(c\)))", "\n", flat, flags=re.I), re.sub(r"(?i)(copyright) ", "\\1\n", flat), "Copyright 2019 Some Body\n\n" + flat.upper()]
        if re.search(r"(?i)copyright \(c\)|copyright 19", flat):
            forms = []  # an example of a statement within a sentence, which a wrapped line may begin with
        for form in forms:
            want[len(rows)] = key
            rows.append((len(rows), form))
        want[len(rows)] = key
        rows.append((len(rows), text))
    want[len(rows)] = "ISC"
    rows.append((len(rows), "Copyright (c) 2004 Some Body\n\n" + ISC))
    got = ids(spark, rows)
    assert len(rows) > 150
    assert [(want[i], i, rows[i][1][:60]) for i in want if got[i] != want[i]] == []


def test_statements(spark):
    gone = ["Copyright (c) 2001 A B", "  * Copyright 2001-2003, A", "# © Some Body", "(c) 2010 Some Body", "(C) Copyright Some Body", "Copyright Some Body", "copyright some body 2011", "Copyright by Some Body", "Copyright [yyyy] [name of copyright owner]", "All rights reserved.", "Copyright the Project Authors", "Copyright: Some Body"]
    stay = ["copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "(c) You must retain, in the Source form", "copyright law: that is to say", "All rights reserved by nobody are void", "Copyright Notice", "copyrighted by the foundation"]
    lines = spark.createDataFrame([(t,) for t in gone + stay], "text string").select("text", F.trim(licenses.canonical_lines(F.col("text"))).alias("left")).collect()
    assert {r["text"] for r in lines if not r["left"]} == set(gone)
