import pytest

from siltstone.llm import origin as og

TOLD = [
    "// This file was generated by protogen; changes will be lost.", "# @generated by x from item.schema", "// Code generated by tool. DO NOT EDIT.", "# <auto-generated> built by x </auto-generated>",
    "// Diese Datei wird vom Werkzeug mestasugen erzeugt. Nicht von Hand ändern.", "// Ce fichier est produit par x, ne pas modifier.", "// Generated from key.idl by brubetrongen v8.11; do not modify by hand.",
    "/* source: path.proto  tool: protox 3.2  (machine output) */", "// AUTO-GENERATED FILE - run `make item` to rebuild",
    "// kotiter 4.19.7\n// Licensed under the Apache License, Version 2.0\n// Imported unchanged from https://kotiter.example/releases", "/*! gegla v5.0.6 | (c) the gegla authors | MIT License */", "# x 1.2.3 -- bundled copy, see upstream for changes", "// Local copy, keep in sync.", "# Copyright the Gavo contributors",
]
QUIET = [
    '// Writes the "DO NOT EDIT" line at the top of each output file.', "# The report is generated by the nightly job, see the runbook.", "// Copyright the Lumen Index authors. MIT License.", "# The vendor list comes from the purchase desk.",
    "// Copies the licence text of every dependency.", "// Minified size is checked in the bundle report.", "x = 'generated by hand'", "", "// Get new value from cache.", "# Generate the index from the cache.",
]


@pytest.mark.parametrize("head", TOLD)
def test_notice(head):
    text = head + "\nconst a = 1;\n"
    assert any(og.notice(text))
    assert "const a = 1" in og.without_notice(text, True) and not any(og.notice(og.without_notice(text, True)))


@pytest.mark.parametrize("head", QUIET)
def test_no_notice(head):
    made, copied, who = og.notice(head + "\nconst a = 1;\n")
    assert not made and not copied and who in (None, "lumen index")


def test_headers_of_any_length():
    text = "#!/bin/sh\n/*\n" + "words of a licence\n" * 400 + "*/\n\n// Code generated by tool. DO NOT EDIT.\nlet a\nlet b\nlet c\n// @generated"
    lines = text.split("\n")
    n = og.header_lines(lines)
    assert lines[n] == "let c" and og.notice("\n".join(lines[:n]))[0]
    assert og.header_lines(["a", "// x", "", "b", "c", "d"]) == 4 and og.header_lines([]) == 0 and og.header_lines(["# x"] * 900) == 900


def test_the_owner_is_named_most_often(spark):
    of = lambda *names: og.owner_of(spark.createDataFrame([(n,) for n in names], "holder string"))
    assert of("a", "b", "a", None) == "a" and of("a", "b") is None and of() is None and of(None) is None and of("b") == "b"
    assert og.holder("// Copyright 2024 the Gavo Authors. All rights reserved") == "gavo" and og.holder("// nothing") is None
    df = spark.createDataFrame([("a.ts", False, False, "own"), ("b.ts", False, True, "own"), ("c.ts", False, False, "other"), ("d.ts", True, False, "own"), ("e.ts", False, True, None)], "file_path string, made boolean, copied boolean, holder string")
    assert {r["file_path"]: r["told"] for r in og.with_labels(df, "own").collect()} == {"a.ts": 0, "b.ts": 0, "c.ts": 2, "d.ts": 1, "e.ts": 2}


def test_measures_of_odd_texts():
    for t in ("", " ", "\n\n", "x", "é" * 1000, "\udcff", "a b " * 50_000):
        assert len(og.measures(t)) == len(og.SUMS)


def test_labels_by_convention(spark):
    names = ["vendor/a.js", "src/vendors/a.js", "a/node_modules/b/c.js", "lib/third_party_billing/a.go", "x.min.js", "x_pb2.py", "dist/a.ts", "src/dist_fit/a.ts", "src/a.ts", "tools/minify/a.js", "x.pb.go", "src/mins.js"]
    df = spark.createDataFrame([(n, False, False, None) for n in names], "file_path string, made boolean, copied boolean, holder string")
    got = {r["file_path"] for r in og.with_labels(df).where("label = 1").collect()}
    assert got == {"vendor/a.js", "a/node_modules/b/c.js", "x.min.js", "x_pb2.py", "dist/a.ts", "x.pb.go"}


def test_held_out_files(spark):
    """A forest trained on half of the files tells tools' files from hand-written ones in the other half."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    files = og.with_labels(og.file_measures(spark.read.parquet("/root/testdata/sf0.01/chunks.parquet"))).cache()
    half = F.xxhash64("file_path") % 2 == 0
    model, last = og.train(files.where(half))
    copied = (F.col("told") == 2) | og._in_folder(F.col("file_path"), og.VENDOR_FOLDERS)
    # a header notice may stand over code that looks written by hand; names and folders of output don't
    sure = files.where(~half & ~copied & (F.col("told") == 0))
    got = model.transform(sure).select("label", vector_to_array("probability")[1].alias("p")).toPandas()
    plain = got[got.label == 0]
    made = got[got.label == 1]
    assert len(made) >= 5 and (made.p >= og.THRESHOLD).mean() >= 0.8
    assert (plain.p >= og.THRESHOLD).mean() <= 0.15  # some files without any label are tools' files
    copies = last.transform(files.where(~half & (F.col("in_copies") + F.col("tool_name") > 0))).select(vector_to_array("probability")[1].alias("p")).toPandas()
    assert len(copies) >= 5 and (copies.p >= og.THRESHOLD).mean() >= 0.7  # told by name and folder, which the last forest sees
    files.unpersist()


def test_table(spark):
    rows = [("vendor/a.js", 0, 0, "x", "c"), ("a.ts", None, None, None, "c"), (None, 0, 0, "x", "c"), ("b.ts", 0, 0, "", "c"), ("vendor/a.js", 0, 0, "x", "c")]
    df = spark.createDataFrame(rows, "file_path string, chunk_index int, start_line int, chunk_text string, label string")
    assert {r["file_path"] for r in og.unwritten_files(df).collect()} == {"vendor/a.js"}
    assert og.unwritten_files(df.limit(0)).count() == 0
    only = df.where("file_path = 'a.ts'")
    assert og.unwritten_files(only).count() == 0
