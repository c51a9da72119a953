"""Steps, vocabulary, spans and the viewer's questions on rows small enough to read."""

import pytest
from pyspark.sql import functions as F

from stepgraph.operators import extraction, library, viewer, vocabulary

PAGE = "doc_id long, page int, text string"


def test_steps(spark):
    text = "1. Fit the new gasket, dry,\nto the block.\n2) do the other side of it\n9.1 Rocker gear\n4 - No step has this mark\nStep 5: Yes, tighten all the bolts. NOTE: never use old bolts here.\nTorque reference\n(3) Go on and fit the cover\n7. Short one\n"
    got = extraction.steps_of(spark.createDataFrame([(1, 1, text), (1, 2, None), (1, 3, "")], PAGE)).orderBy("ord").collect()
    assert [(r.number, r.text) for r in got] == [(1, "Fit the new gasket, dry, to the block."), (2, "do the other side of it"), (5, "Yes, tighten all the bolts. NOTE: never use old bolts here.")]  # the third is a short line without marks
    assert next(r.action for r in got if r.number == 5) == "Yes, tighten all the bolts."


def test_furniture_goes(spark):
    pages = spark.createDataFrame([(1, k, f"Series manual {k}\nText of page {'abc'[k]}\n\nend") for k in range(3)] + [(2, 0, "Alone")], PAGE)
    got = {(r.doc_id, r.page): r.text for r in extraction.without_furniture(pages).collect()}
    assert got == {(1, 0): "Text of page a\n\nend", (1, 1): "Text of page b\n\nend", (1, 2): "Text of page c\n\nend", (2, 0): "Alone"}


def test_spans(spark):
    pages = spark.createDataFrame([(1, 1, "a  first\nline and more")], PAGE)
    quotes = spark.createDataFrame([(1, 1, "first line"), (1, 1, "absent"), (1, 2, "first"), (1, 1, "x" * 241)], "doc_id long, page int, quote string")
    got = {r.quote[:8]: (r.verified, r.char_start, r.char_end, len(r.quote)) for r in extraction.located(quotes, pages).where("page = 1").collect()}
    assert got == {"first li": (True, 2, 12, 10), "absent": (False, None, None, 6), "x" * 8: (False, None, None, 240)}
    words = spark.createDataFrame([(1, 1, k, w, float(k), 1.0, k + 0.5, 2.0) for k, w in enumerate(["a", "First,", "line", "and"])], "doc_id long, page int, ord long, text string, x0 double, top double, x1 double, bottom double")
    box = {r.quote[:8]: r.bbox for r in extraction.boxes(quotes, words).where("page = 1").collect()}
    assert box == {"first li": [1.0, 1.0, 2.5, 2.0], "absent": None, "x" * 8: None}


@pytest.mark.parametrize(("text", "want"), [("the two connecting rods onto", "connecting rod"), ("a new gasket set on it", "gasket set"), ("assembly", None), ("it squarely", None), ("the same", None), ("bus bodies", "bus body"), ("a torque wrench", None), ("", None), ("on the", None)])
def test_phrase(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(vocabulary.phrase(F.col("t")).alias("x")).first().x == want


def test_lexicon(spark):
    text = "Fit the connecting rod and compress the rings and slide the piston home.\nFit the rod.\n 12  GX16-1220  PISTON  1\n"
    seed = spark.createDataFrame([("ring", "Piston ring", ["ring", "piston ring"], ["piston"])], vocabulary.SEED)
    got = {r.part_id: (r.name, r.forms, r.attaches_to, r.part_number, r.discovered) for r in vocabulary.lexicon(spark.createDataFrame([(1, 1, text), (2, 1, None)], PAGE), seed).collect()}
    assert got["ring"] == ("Piston ring", ["piston ring", "ring"], ["piston"], None, False)
    assert got["connecting_rod"] == ("Connecting rod", ["connecting rod", "rod"], [], None, True)
    assert any(v[3] == "GX16-1220" for v in got.values())


def test_mentions(spark):
    forms = spark.createDataFrame([(1, f, f) for f in ("connecting rod", "connecting rod cap", "rod", "camshaft", "Case")], "doc_id long, form string, part_id string")
    steps = spark.createDataFrame([(1, "Fit the connecting rod caps onto the rod"), (1, "facing the camshaft side of the case"), (1, "rodeo"), (1, None), (2, "rod")], "doc_id long, text string")
    got = {r.text: r.parts for r in vocabulary.mentions(steps, forms).collect()}
    assert got == {"Fit the connecting rod caps onto the rod": ["connecting rod cap", "rod"], "facing the camshaft side of the case": ["Case"], "rodeo": [], None: [], "rod": []}


def test_library(spark):
    old = spark.createDataFrame([("a", None, 1, True), ("b-p001", "b", 2, True), ("b", None, 3, False)], "id string, document string, ingested_at int, ok boolean")
    new = spark.createDataFrame([("b-p002", "b", 5, False), ("b-p003", "b", 5, True)], old.schema)
    got = library.upserted(old, new, "b")
    assert [r.id for r in got.collect()] == ["b-p003", "b-p002", "a"]
    assert [tuple(r) for r in library.manuals(got.selectExpr("*", "-ingested_at AS ord")).collect()] == [(0, -1, "a", 1, 1), (1, -5, "b", 2, 1)]


def test_labels(spark):
    ys = [5.0, 100.0, 101.0, 300.0, 301.0, 790.0, 795.0]
    got = [r.y for r in viewer.labels(spark.createDataFrame([(1, k, y) for k, y in enumerate(ys)], "scene long, id long, y double"), 800.0).orderBy("id").collect()]
    want, cursor = [], 96.0
    for y in ys:
        want.append(max(cursor, min(y, 704.0)))
        cursor = want[-1] + 26
    assert got == want
