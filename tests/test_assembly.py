"""From page text to a checked assembly, and each check on an assembly made to fail it."""

import json

import pytest
from pyspark.sql import functions as F

from stepgraph.operators import assembly, checks, extraction, pages, viewer, vocabulary
from stepgraph.operators import library as lib
from stepgraph.sources.tables import stored

# A one-page job, and the parts of its machine that say what goes onto what. Fixed values.
JOB = """5.1 Valves
1. Lap the intake valve into its seat until a continuous grey band shows
around the full circumference of the face.
2. Lap the exhaust valve into its seat by the same method.
3. Fit the valve springs and retainers, compressing each spring to seat
the keepers squarely.
5.2 Cylinder head
4. Fit the cylinder barrel to the crankcase deck if it was disturbed.
5. Place a new cylinder head gasket on the deck. CAUTION: never reuse a
gasket that has been compressed.
6. Lower the cylinder head onto the gasket, locating it on the dowels.
7. Tighten the cylinder head bolts to 24 N.m in a crossing pattern.
8. Fit the spark plug and tighten to 18 N.m.
"""
SEED = [
    ("crankcase", "Crankcase", ["crankcase", "crank case", "cylinder block"], []),
    ("cylinder_barrel", "Cylinder barrel", ["cylinder barrel", "cylinder bore", "barrel", "bore"], ["crankcase"]),
    ("intake_valve", "Intake valve", ["intake valve", "inlet valve"], []),
    ("exhaust_valve", "Exhaust valve", ["exhaust valve"], []),
    ("valve_spring", "Valve spring", ["valve spring", "spring and retainer"], ["intake_valve", "exhaust_valve"]),
    ("head_gasket", "Cylinder head gasket", ["cylinder head gasket", "head gasket", "gasket"], ["cylinder_barrel"]),
    ("cylinder_head", "Cylinder head", ["cylinder head", "head"], ["head_gasket"]),
    ("head_bolt", "Cylinder head bolt", ["cylinder head bolt", "head bolt"], ["cylinder_head"]),
    ("spark_plug", "Spark plug", ["spark plug", "sparking plug", "plug"], ["cylinder_head"]),
]
STEPS = "proc_id string, idx int, step_id string, number int, installs array<string>, depends_on array<string>, torque_nm double, verified boolean"
PARTS = "proc_id string, ord int, part_id string, verified boolean"


def decoded(spark, text):
    page = spark.createDataFrame([("job", 1, text)], "doc_id string, page int, text string")
    lexicon = stored(vocabulary.lexicon(page, spark.createDataFrame(SEED, vocabulary.SEED)), "lexicon")
    forms = lexicon.select("doc_id", F.explode("forms").alias("form"), "part_id")
    hosts = lexicon.select("doc_id", F.col("part_id").alias("part"), F.explode("attaches_to").alias("host"))
    raw = extraction.steps_of(page).withColumn("pos", F.col("ord").cast("long"))
    steps = stored(assembly.segmented(vocabulary.mentions(raw, forms, "action")), "steps")
    located = extraction.located(raw.select("doc_id", "page", "pos", F.col("text").alias("quote")), page)
    rows, parts = assembly.spans_of(assembly.step_rows(steps, hosts, ["torque wrench"]), assembly.declared(steps, lexicon), located)
    return assembly.named(steps, F.lit("Top end")), rows.withColumn("proc_id", F.col("doc_id")), parts.withColumn("proc_id", F.col("doc_id"))


def test_job_end_to_end(spark):
    names, rows, parts = decoded(spark, JOB)
    assert tuple(names.first())[2:] == ("job", "p.1 - Lap the intake valve into its seat...", "Top end")
    got = {r.step_id: r for r in rows.collect()}
    assert len(got) == 8 and got["s05"].warning.startswith("CAUTION: never reuse a gasket") and got["s07"].torque_nm == 24.0
    assert got["s07"].installs == ["head_bolt"] and got["s06"].installs == [] and got["s03"].depends_on == ["s01", "s02"]
    assert all(got[s].depends_on == ["s05"] for s in ("s06", "s07", "s08"))
    report = checks.reported(checks.checked(parts.select("proc_id").distinct(), rows, parts)).first()
    said = {c.code: (c.status, c.detail) for c in report.checks}
    assert report.ok and report.n_passed == 8 and [c.code for c in report.checks] == list(checks.ORDER)
    assert said["P1"] == ("PASS", "8 steps sorted") and said["P4"] == ("PASS", "3 independent branches, largest 4 steps")
    assert said["P6"] == ("PASS", "2 specs in range") and said["P8"] == ("PASS", "8 steps, 0 numbering restart(s)")
    assert said["P2"] == ("PASS", "12 references resolved") and said["P3"] == ("PASS", "all 7 parts installed")
    assert said["P5"] == ("PASS", "15/15 spans verified verbatim (100%)") and report.text.endswith("ADMISSIBLE: 8/8 checks passed")
    assert assembly.coverage_items(rows, parts).count() == 15


def chain(n, **change):
    """n steps, each needing the one before and installing a part; change replaces fields of steps by index."""
    rows = [{"idx": i, "step_id": f"s{i + 1:02d}", "number": i + 1, "installs": [f"p{i}"], "depends_on": [f"s{i:02d}"] if i else [], "torque_nm": None, "verified": True} for i in range(n)]
    for field, values in change.items():
        for i, v in values.items():
            rows[i][field] = v
    return rows


CASES = {
    "P1": (chain(5, depends_on={0: ["s02"]}), "cycle involving 5 steps", "FAIL"),
    "P2": (chain(5, depends_on={4: ["s04", "s77"]}), "1 dangling: s05->step:s77", "FAIL"),
    "P3": (chain(5, installs={2: []}), "1 never installed: p2", "WARN"),
    "P4": (chain(5, depends_on={i: [] for i in range(5)}), "no ordering recovered - every step isolated", "FAIL"),
    "P5": (chain(5, verified=dict.fromkeys(range(5), False)), "5/10 spans verified verbatim (50%)", "FAIL"),
    "P6": (chain(5, torque_nm={1: 0.4, 3: 900.1, 4: 900.0}), "2 implausible: s02=0.4, s04=900.1", "FAIL"),
    "P7": (chain(5, step_id={4: "s04"}), "duplicates: s04", "FAIL"),
    "P8": (chain(9, number={2: 1, 4: 1, 6: 1}), "3 numbering restarts across 9 steps - this is ~4 procedures concatenated, not one", "FAIL"),
}


def test_each_check_fails_alone(spark):
    steps = [(code, *[r[f] for f in ("idx", "step_id", "number", "installs", "depends_on", "torque_nm", "verified")]) for code, (rows, _, _) in CASES.items() for r in rows]
    steps += [("fine", *[r[f] for f in ("idx", "step_id", "number", "installs", "depends_on", "torque_nm", "verified")]) for r in chain(9, number={2: 1, 4: 1, 5: None})]
    parts = [(code, i, f"p{i}", True) for code, (rows, _, _) in CASES.items() for i in range(len(rows))] + [("fine", i, f"p{i}", True) for i in range(9)]
    s, p = spark.createDataFrame(steps, STEPS), spark.createDataFrame(parts, PARTS)
    procs = spark.createDataFrame([(c,) for c in [*CASES, "fine", "empty"]], "proc_id string")
    got = checks.checked(procs, s, p).collect()
    bad = {}
    for r in got:
        if r.status != "PASS":
            bad.setdefault(r.proc_id, []).append((r.code, r.status, r.detail))
    for code, (_, detail, status) in CASES.items():
        assert (code, status, detail) in bad[code]
        assert len(bad[code]) == (2 if code == "P7" else 1)  # a repeated step id is left over by the order of P1 too
    assert "fine" not in bad and bad["empty"] == [("P5", "FAIL", "empty assembly")]
    ok = {r.proc_id: r.ok for r in checks.reported(checks.checked(procs, s, p)).collect()}
    assert ok["P3"] and ok["fine"] and not any(ok[c] for c in CASES if c != "P3")


def test_fallback_takes_all_steps(spark):
    rows = [(1, p, 1, n, f"{n}. Do it now") for p, n in enumerate((1, 2, 3, 4, 1, 2))] + [(2, p, 1, n, "Go") for p, n in enumerate((1, 2, 3, 4, 1, 2, 3, 4))]
    steps = spark.createDataFrame(rows, "doc_id long, pos long, page int, number int, text string")
    got = {(r.doc_id, r.proc): r["count"] for r in assembly.segmented(steps).groupBy("doc_id", "proc").count().collect()}
    assert got == {(1, 1): 6, (2, 1): 4, (2, 2): 4}
    whole = {(r.doc_id, r.proc): r["count"] for r in assembly.segmented(steps, whole=True).groupBy("doc_id", "proc").count().collect()}
    assert whole == {(1, 1): 6, (2, 1): 8}
    assert {r.proc_id for r in assembly.named(assembly.segmented(steps)).collect()} == {"1", "2-p001", "2-p002"}


def test_records(spark, tmp_path):
    (tmp_path / "lex.json").write_text(json.dumps({"_comment": "x", "parts": {"rod": {"name": "Rod", "forms": ["rod"]}, "pin": {"name": "Pin", "forms": ["pin"], "attaches_to": ["rod"]}}, "tools": ["hammer"]}))
    parts, tools = pages.read_lexicon(spark, str(tmp_path / "lex.json"))
    assert {r.part_id: r.attaches_to for r in parts.collect()} == {"rod": [], "pin": ["rod"]} and tools.first().tool == "hammer"
    (tmp_path / "ir.json").write_text(json.dumps({"title": "T", "source_document": "d", "parts": [{"id": "rod", "name": "Rod"}], "steps": [{"id": "s01", "index": 0, "text": "Fit", "installs": ["rod"], "torque_nm": 24}]}))
    ir = pages.read_assemblies(spark, str(tmp_path / "ir.json"))
    row = ir.first()
    assert row.parts[0].qty == 1 and row.steps[0].depends_on == [] and row.steps[0].torque_nm == 24.0
    pages.write_assemblies(ir.drop("file").withColumn("proc_id", F.lit("d-p001")), str(tmp_path / "out"))
    again = pages.read_assemblies(spark, str(tmp_path / "out" / "proc_id=d-p001")).first()
    assert again.steps == row.steps and again.parts == row.parts
    assert pages.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert pages.read_manifest(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "index.json").write_text(json.dumps([{"id": "a", "title": "t", "ok": True}, {"id": "b", "ok": False}]))
    assert {(r.id, r.ok) for r in pages.read_manifest(spark, str(tmp_path / "index.json")).collect()} == {("a", True), ("b", False)}


@pytest.mark.parametrize(("text", "want"), [("a/b\\My  Manual (v2).PDF", "My_Manual_v2_.PDF"), ("..", "document.pdf"), (None, "document.pdf"), ("x" * 90, "x" * 80 + ".pdf")])
def test_file_name(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(pages.file_name(F.col("t"))).first()[0] == want


def test_small_columns(spark):
    row = spark.createDataFrame([("x" * 60, "<b> & 'c'", 125.9, "Vol 1 - Part - 2")], "a string, b string, c double, d string")
    got = row.select(viewer.truncated(F.col("a")), viewer.escaped(F.col("b")), lib.minutes(F.col("c")), lib.short_title(F.col("d")), lib.card_percent(F.lit(1), F.lit(8)), viewer.percent_box(F.expr("array(10D, 20D, 60D, 30D)"), F.expr("array(200D, 100D)"))).first()
    assert tuple(got)[:5] == ("x" * 57 + "…", "&lt;b&gt; &amp; &#39;c&#39;", "2:05", "Part - 2", 13) and tuple(got[5]) == (5.0, 20.0, 25.0, 10.0)
    when = spark.createDataFrame([("2024-01-02 00:00:00", n) for n in (30, 90, 7200, 90_000, 400_000)], "t string, s int").select(lib.ago(F.col("t").cast("timestamp"), F.timestamp_seconds(F.unix_timestamp("t") + F.col("s"))).alias("w"))
    assert [r.w for r in when.collect()] == ["just now", "1 min ago", "2 hr ago", "yesterday", "4 days ago"]
    spans = spark.createDataFrame([("p", "a", 0, 1, "q", False), ("p", "a", 1, 2, "r", True), ("p", "b", 0, 3, "s", False)], "proc_id string, part_id string, ord int, page int, quote string, verified boolean")
    assert {r.part_id: r.quote for r in viewer.primary(spans).collect()} == {"a": "r", "b": "s"}
    names = spark.createDataFrame([("1", "nut"), ("2", "Arm"), ("3", "bolt")], "part_id string, name string")
    assert [r.name for r in viewer.tray(names, spark.createDataFrame([("3",)], "part_id string")).collect()] == ["Arm", "nut"]
