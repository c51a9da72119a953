"""Folders of manuals with faults, records of several documents, the manifest's stream over a restart, exact rounding."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from stepgraph.functions.fields import rounded
from stepgraph.operators import extraction, pages
from stepgraph.sources.folder import BROKEN, UNREADABLE, read_manuals, write_manuals
from stepgraph.streaming import manifest


def test_a_broken_file_costs_its_pages_only(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one é\fzwei\f".encode() + b"\xff\xfe" + b"\fvier\f")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.v2.txt").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"\f\fx")
    (tmp_path / "d.md").write_bytes(b"no")
    got = {(r.doc_id, r.page): (r.raw_text, r.error) for r in read_manuals(spark, str(tmp_path)).collect()}
    assert got == {("a", 1): ("one é", None), ("a", 2): ("zwei", None), ("a", 3): ("", BROKEN), ("a", 4): ("vier", None), ("b.v2", 1): ("", UNREADABLE), ("c", 1): ("", None), ("c", 2): ("", None), ("c", 3): ("x", None)}
    found = read_manuals(spark, str(tmp_path)).withColumns({"ocr_text": F.lit("o"), "ocr_confidence": F.lit(80.0), "vision_text": F.lit("v")})
    assert {(r.text, r.tier) for r in pages.cascaded(found).where("doc_id = 'a' AND page > 2").collect()} == {("", None), ("o", 2)}


def test_a_file_that_goes_away(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text(n)
    found = read_manuals(spark, str(tmp_path))
    os.remove(tmp_path / "b.txt")
    assert {(r.doc_id, r.raw_text, r.error) for r in found.collect()} == {("a", "a", None), ("b", "", UNREADABLE)}


def test_manuals_round_trip(spark, tmp_path):
    rows = [("m", 1, "a\nb"), ("m", 2, None), ("m", 3, "\f"), ("n", 1, "")]
    write_manuals(spark.createDataFrame(rows, "doc_id string, page int, text string"), str(tmp_path / "x"))
    got = sorted((r.doc_id, r.page, r.raw_text) for r in read_manuals(spark, str(tmp_path / "x"), r"doc_id=([^/]+)/").collect())
    assert got == [("m", 1, "a\nb"), ("m", 2, ""), ("m", 3, " "), ("n", 1, "")]


def test_writing_one_document_leaves_the_others(spark, tmp_path):
    for names in (["a-p001", "b"], ["b"], ["c"]):
        rows = spark.createDataFrame([(n, f"t{len(names)}") for n in names], "proc_id string, title string")
        pages.write_assemblies(rows, str(tmp_path / "out"))
    got = {(r.proc_id, r.title) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {("a-p001", "t2"), ("b", "t1"), ("c", "t1")}


def test_manifest_over_a_restart(spark, tmp_path):
    at = [datetime.datetime(2024, 1, n) for n in range(1, 9)]
    schema = "id string, document string, ingested_at timestamp, ok boolean"
    batches = [
        [("m-p001", "m", at[2], True), ("m-p002", "m", at[2], False), ("x", None, at[0], True)],
        [("m-p001", "m", at[1], False), ("y", None, at[3], True), ("y", None, at[3], True)],
        [("m", None, at[5], True), ("x", None, at[4], False), (None, None, None, None)],
        [("n-p001", "n", at[6], True)],
    ]
    run = lambda: manifest.kept(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/lib", f"{tmp_path}/ck")
    assert manifest.read_snapshot(spark, f"{tmp_path}/lib", schema).count() == 0
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        if n != 1:  # two files come before the second run
            q = run()
            q.awaitTermination(120)
            assert q.exception() is None
    want = manifest.newest(spark.createDataFrame([r for b in batches for r in b], schema)).orderBy(F.desc("ingested_at"), F.desc("id")).collect()
    got = manifest.read_snapshot(spark, f"{tmp_path}/lib", schema).collect()
    assert got == want and [r.id for r in got] == ["n-p001", "m", "x", "y", None] and len(manifest.snapshots(spark, f"{tmp_path}/lib")) == manifest.KEPT
    # a batch that runs again, and one that stopped before its end, change nothing
    manifest.committed(spark.createDataFrame(batches[3], schema), 3, f"{tmp_path}/lib")
    os.makedirs(f"{tmp_path}/lib/v=9")
    assert manifest.read_snapshot(spark, f"{tmp_path}/lib", schema).collect() == want


@pytest.mark.parametrize("given", [[2.25, 2.45, 0.15, 0.25, 0.35, 2.2, 0.0, 88.12829999999999, 900.05, 0.05, 1e9 + 0.25, 24.0]])
def test_rounding_by_binary_digits(spark, given):
    given += [n / 100 + 0.05 for n in range(0, 2000, 7)] + [n * 1.35582 for n in range(300)] + [n / 8 for n in range(80)]
    rows = spark.createDataFrame([(x,) for x in given] + [(None,)], "x double").select("x", rounded(F.col("x")).alias("r")).collect()
    assert [r.r for r in rows] == [round(x, 1) for x in given] + [None]


def test_boxes(spark):
    words = [("d", 1, n, t, float(n), 10.0 * n, n + 5.0, 12.0) for n, t in enumerate(["Fit", "the", "Rod,", "the", "rod", "the", "rod", "(cap)", "--"])] + [("d", 2, 0, None, 0.0, 0.0, 0.0, 0.0)]
    quotes = [("d", 1, "the rod the rod cap"), ("d", 1, "fit THE rod"), ("d", 1, "rod"), ("d", 1, "cap rod"), ("d", 1, ""), ("d", 1, None), ("d", 2, "rod"), ("e", 1, "rod"), ("d", 1, "rod"), ("d", 1, "cap --")]
    w = spark.createDataFrame(words, "doc_id string, page int, ord long, text string, x0 double, top double, x1 double, bottom double").withColumn("at", F.lit("x"))
    got = {(r.doc_id, r.page, r.quote): r.bbox for r in extraction.boxes(spark.createDataFrame(quotes, "doc_id string, page int, quote string"), w).collect()}
    want = {("d", 1, "the rod the rod cap"): [3.0, 30.0, 12.0, 12.0], ("d", 1, "fit THE rod"): [0.0, 0.0, 7.0, 12.0], ("d", 1, "rod"): [2.0, 20.0, 7.0, 12.0], ("d", 1, "cap --"): [7.0, 70.0, 13.0, 12.0]}
    assert {k: v for k, v in got.items() if v} == want and len(got) == 9 and extraction.boxes(spark.createDataFrame(quotes, "doc_id string, page int, quote string").where("false"), w).count() == 0
