from __future__ import annotations

from pyspark.sql import functions as F

from glucoframe.llm import licenses

DOCS = "doc_id long, text string"


def test_spelling_layout_and_copyright_do_not_matter(spark):
    mit = licenses.KNOWN["MIT"][0]
    shouted = mit.upper().replace("COPYRIGHT (C) 2000 HOLDER", "Copyright (C) 1999-2024, Some One <a@b.c>\nCopyright 2001 Other\n(c) 2003 Third. All rights reserved.\nAll rights reserved.")
    wrapped = "\n".join(mit.split(" ")).replace("\nLicense", " Licence").replace("(c)\n2000\nHolder", "(c) 2000 Holder").replace("Copyright\n(c)", "Copyright (c)")
    rows = [
        (1, mit), (2, shouted), (3, wrapped), (4, mit + " And more."), (5, mit.replace("free of charge", "for a fee")), (6, "Some words.\nReleased under the MIT Licence!\nmore"),
        (7, "licensed under the apache license - version 2.0"), (8, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (9, licenses.KNOWN["BSD-3-Clause"][0].replace("holder nor", "HOLDER  nor")),
    ]
    found = {r.doc_id: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[1] == ("MIT", []) and found[2][0] == "MIT" and found[3][0] == "MIT" and found[9][0] == "BSD-3-Clause"
    assert found[4] == (None, []) and found[5] == (None, [])
    assert found[6] == (None, ["MIT"]) and found[7] == ("Apache-2.0", ["Apache-2.0"]) and found[8] == (None, ["CC-BY-NC-4.0", "MIT"])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = licenses.scan(odd_docs.withColumn("license", F.lit("x")).withColumn("known", F.lit("y"))).collect()
    assert len(rows) == 12 and all(r.license is None and r.notices == [] for r in rows)
    assert len({r.text_digest for r in rows if r.doc_id in (2, 3, 5)}) == 1
    assert licenses.scan(no_docs).count() == 0
    punctuation = spark.createDataFrame([(1, "--- !!! ---"), (1, "--- !!! ---")], DOCS)
    assert [r.license for r in licenses.scan(punctuation).collect()] == [None, None]


def test_whole_texts_of_the_long_licences(spark):
    from pathlib import Path

    paths = sorted((Path(licenses.__file__).parent / "license_texts").glob("*.txt"))
    texts = {path.stem: path.read_text(encoding="utf-8") for path in paths}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    rows = list(enumerate([*texts.values(), *[" ".join(t.upper().split()) if "opyright" not in t else t.upper() for t in texts.values()]]))
    rows += [(100, texts["Apache-2.0"].partition("APPENDIX")[0]), (101, texts["GPL-2.0"][:-2000])]
    found = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert [found[k] for k in range(2 * len(texts))] == 2 * list(texts)
    assert found[100] == "Apache-2.0" and found[101] is None


def test_a_million_marks_in_a_line(spark):
    """Runs of punctuation, signs and half copyright lines take neither stack nor more than linear time."""
    import time

    size = 1_000_000
    texts = ["copyright " + "-" * size + " x", "©" * size, "(c)" * size, "copyright " * (size // 10), "- " * size + "copyright 2000 x", "\n" * size, "licen" * (size // 5), "all rights " * (size // 10)]
    frame = spark.createDataFrame([(k, text) for k, text in enumerate(texts)], DOCS).cache()
    frame.count()
    licenses.scan(spark.createDataFrame([(0, "warm")], DOCS)).collect()
    started = time.time()
    assert all(r.license is None and r.notices == [] for r in licenses.scan(frame).collect())
    assert time.time() - started < 2 * len(texts)


def test_copyright_lines(spark):
    rows = ["a\nCopyright (c) 2000 x", "a\n(C) 2001 - x\n", "a\n © 1999, x", "a\n* Copyright © 2000", "a\n-- (c) Copyright 2000 x", "a\nAll rights reserved.", "a\ncopyright holders", "a (c) 2000", "a © 2000", "a\n(c) the third"]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], DOCS).select("doc_id", licenses.canonical(licenses.canonical_lines(F.col("text"))).alias("t")).collect()
    got = {r.doc_id: r.t for r in found}
    assert [got[k] for k in range(6)] == ["a"] * 6
    assert [got[k] for k in range(6, 10)] == ["a copyright holders", "a c 2000", "a c 2000", "a c the third"]
