"""From pages and words to stored records and entries, and records that come in odd forms."""

import datetime
import json

import manual
import pytest
from pyspark.sql import functions as F

from stepgraph.operators import decode as d
from stepgraph.operators import ingest, pages, viewer, vocabulary


def test_records_of_a_manual(spark, tmp_path):
    text = list(manual.pages())
    own = spark.createDataFrame([("m", p, t) for p, t in text], "doc_id string, page int, text string")
    found = d.decode(own, spark.createDataFrame(manual.SEED, vocabulary.SEED), manual.TOOLS, F.lit("test manual"))
    words = [("m", p, n, w, 10.0 * k, 12.0 * i, 10.0 * k + 8, 12.0 * i + 10, 595.0, 842.0) for p, t in text for n, (i, k, w) in enumerate((i, k, w) for i, line in enumerate(t.split("\n")) for k, w in enumerate(line.split()))]
    placed = spark.createDataFrame(words, "doc_id string, page int, ord long, text string, x0 double, top double, x1 double, bottom double, width double, height double")
    rows = ingest.assemblies(found, F.lit("manual.pdf"), placed)
    pages.write_assemblies(rows, str(tmp_path / "lib"))
    back = pages.read_assemblies(spark, str(tmp_path / "lib"))
    row, want = back.first(), rows.first()
    assert back.count() == 1 and row.proc_id == "m" and row.error is None and row.title == "test manual" and row.source_document == "manual.pdf"
    assert len(row.parts) == 20 and len(row.steps) == 18 and row.steps == want.steps and row.parts == want.parts
    assert row.steps[0].provenance.verified and row.steps[0].provenance.bbox and row.steps[0].provenance.page_size == [595.0, 842.0]
    entry = ingest.entries(found, own, d.reported(found), F.lit(datetime.datetime(2024, 1, 2)), F.lit("manual.pdf")).first()
    assert tuple(entry) == ("m", "test manual", "manual.pdf", 4, 20, 18, 4, 38, 38, True, datetime.datetime(2024, 1, 2), None)
    lines = {r.idx: r for r in viewer.step_list(found.steps).collect()}
    assert lines[6].num == "07" and lines[6].tags == ["12 N·m", "torque wrench", "p.2"] and lines[0].tags == ["p.1"]
    detail = {r.idx: r for r in viewer.step_detail(found.steps, found.parts).collect()}
    assert detail[6].counter == "7 / 18" and detail[6].tags == ["Connecting rod bolt", "verified · page 2"] and detail[13].warning.startswith("CAUTION")
    assert back.select(pages.part_of(F.col("parts"), F.lit("piston")).alias("p"), pages.part_of(F.col("steps"), F.lit("s99")).alias("s")).first()[0].name == "Piston"


def test_text_of_a_page(spark):
    own = spark.createDataFrame([("m", 1, "tier"), ("m", 2, "ocr"), ("m", 3, "")], "doc_id string, page int, text string").withColumn("layout", F.lit("x"))
    words = spark.createDataFrame([("m", 1, 0, "read", 10.0, 30.0, 300.0, 310.0), ("m", 1, 1, "order", 40.0, 60.0, 300.0, 310.0), ("m", 2, 0, "folio", 10.0, 30.0, 835.0, 840.0)], "doc_id string, page int, ord long, text string, x0 double, x1 double, top double, bottom double").withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})
    assert {r.page: r.text for r in ingest.texted(own, words).collect()} == {1: "read order", 2: "ocr", 3: ""}


@pytest.mark.parametrize(("given", "want"), [(3, 3.0), (3.0, 3.0), ("3", 3.0), ("x", None), (None, None), (..., None)])
def test_odd_figures(spark, tmp_path, given, want):
    step = {"id": "s01", "index": given} | ({"torque_nm": given, "source_number": given} if given is not ... else {})
    part = {"id": "p", "name": "P"} | ({"qty": given} if given is not ... else {})
    step = {k: v for k, v in step.items() if v is not ...}
    (tmp_path / "ir.json").write_text(json.dumps({"title": "T", "parts": [part], "steps": [step | {"text": None, "provenance": {"page": given if given is not ... else 1, "bbox": [1, "2", 3.5, 4]}}, {"id": "s02"}]}, indent=1))
    (tmp_path / "bad.json").write_text("{no")
    (tmp_path / "list.json").write_text("[1]")
    rows = {r.file.rsplit("/", 1)[1]: r for r in pages.read_assemblies(spark, str(tmp_path)).collect()}
    row = rows["ir.json"]
    assert (row.steps[0].torque_nm, row.steps[0].source_number) == (want, None if want is None else 3) and row.parts[0].qty == (1 if want is None else 3)
    assert row.steps[1].text == "" and row.steps[0].text is None and row.steps[1].installs == [] and row.steps[1].provenance is None
    assert (rows["bad.json"].error, rows["list.json"].error, row.error) == ("no JSON object", "no JSON object", None) and rows["bad.json"].steps == []
