"""Plans on tables that grow: what the driver gathers, and what is sent between tasks."""

import contextlib
import io

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepgraph.operators import assembly, checks, decode, extraction, graph, procedures, viewer, vocabulary
from stepgraph.sources import tables
from stepgraph.sources.tables import stored


def _plan(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


def test_small_files_of_many_rows_are_not_gathered_on_the_driver(spark):
    links = stored(spark.range(2_000_000).select(F.floor(F.col("id") / 1000).alias("by"), (F.col("id") % 1000).alias("id")), "links")
    steps = spark.range(3_000_000).select(F.floor(F.col("id") / 1000).alias("by"), (F.col("id") % 1000).alias("id"))
    assert "BroadcastHashJoin" not in _plan(steps.join(links, ["by", "id"], "left"))


def test_tokens_of_mentions_stay_where_their_document_is(spark):
    steps = spark.createDataFrame([(1, 1, "Fit the cold bolt.")], "doc_id long, pos long, text string")
    forms = spark.createDataFrame([(1, "cold bolt", "b")], "doc_id long, form string, part_id string")
    plan = _plan(vocabulary.mentions(steps, forms))
    assert "ShuffledHashJoin" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "key" in x]
    assert [r.parts for r in vocabulary.mentions(steps, forms).collect()] == [["b"]]


def test_a_text_list_is_worked_out_once(spark):
    pages = spark.createDataFrame([(1, 1, "1. Fit the cold bolt to 9 N.m.")], "doc_id long, page long, text string")
    plan = _plan(vocabulary.lexicon(pages, spark.createDataFrame([], vocabulary.SEED)))
    assert "regexp_extract_all" not in plan


def test_known_ids_are_not_gathered_on_the_driver(spark):
    ids = stored(spark.range(200_000), "known")
    known = ids.select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("proc_id"), "id")
    refs = spark.range(100).select(F.lit(1).alias("proc_id"), F.col("id").alias("ref"))
    assert "BroadcastHashJoin" not in _plan(procedures.dangling(refs, known))


def test_known_ids_are_not_gathered_whatever_the_session_allows(spark):
    """An explode's rows are not in Spark's sizes, so ids that look small may be many."""
    known = spark.range(1000).select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("proc_id"), "id")
    refs = spark.range(0, 1200, 100).select(F.lit(1).alias("proc_id"), F.col("id").alias("ref"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = procedures.dangling(refs, known)
        assert sorted(map(tuple, found.collect())) == [(1, 1000), (1, 1100)]
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_boxes_read_words_once(spark):
    words = spark.createDataFrame([(1, 1, i, w, float(i), 0.0, i + 1.0, 2.0) for i, w in enumerate("a b a c a b c a b".split())], "doc_id long, page long, ord long, text string, x0 double, top double, x1 double, bottom double")
    quotes = spark.createDataFrame([(1, 1, q) for q in ("a b c", "(C)", "b a b", "a  B, a", "", None, "a b")], "doc_id long, page long, quote string")
    found = extraction.boxes(quotes, words)
    assert _plan(found).count("Scan ExistingRDD") == 2
    assert {r.quote: r.bbox and [r.bbox[0], r.bbox[2]] for r in found.collect()} == {"a b c": [4, 7], "(C)": [3, 4], "b a b": None, "a  B, a": [0, 3], "": None, None: None, "a b": [0, 2]}


def test_checks_and_graph_rounds_send_nothing(spark):
    steps = spark.range(1000).select(F.floor(F.col("id") / 10).alias("proc_id"), (F.col("id") % 10).cast("int").alias("idx"), F.concat(F.lit("s"), F.col("id") % 10).alias("step_id"), F.lit(1).alias("number"), F.array(F.lit("p")).alias("installs"), F.array(F.lit("s0")).alias("depends_on"), F.lit(1.0).alias("torque_nm"), F.lit(True).alias("verified"))
    parts = spark.range(100).select(F.col("id").alias("proc_id"), F.lit(0).alias("ord"), F.lit("p").alias("part_id"), F.lit(True).alias("verified"))
    found = checks.checked(steps.select("proc_id"), steps, parts)
    assert "Exchange hashpartitioning" not in _plan(found)
    said = {r.code: (r.n, r.details) for r in found.groupBy("code").agg(F.count("*").alias("n"), F.collect_set("detail").alias("details")).collect()}
    assert said["P2"] == (100, ["20 references resolved"]) and said["P1"] == (100, ["cycle involving 10 steps"]) and said["P4"] == (100, ["1 independent branches, largest 10 steps"])


def test_large_graphs_are_dealt_by_node(spark, monkeypatch):
    steps = spark.range(60).select(F.floor(F.col("id") / 20).alias("proc_id"), (F.col("id") % 20).alias("id"))
    edges = steps.where("id > 0").select("proc_id", F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    want = graph.branches(steps, edges).orderBy("proc_id").collect()
    monkeypatch.setattr(graph, "TOGETHER", 5)
    assert graph.branches(steps, edges).orderBy("proc_id").collect() == want and [tuple(r)[1:] for r in want] == [(20, 1, 20, 0)] * 3


def test_step_detail_counts_without_another_read(spark):
    steps = spark.createDataFrame([(1, i, "Fit it.", 3, True, ["b"], None) for i in range(2)], "proc_id long, idx long, text string, page long, verified boolean, installs array<string>, warning string")
    found = viewer.step_detail(steps, spark.createDataFrame([(1, "b", "Bolt")], "proc_id long, part_id string, name string"))
    assert _plan(found).count("Scan ExistingRDD") == 3
    assert [(r.counter, r.tags) for r in found.orderBy("idx").collect()] == [("1 / 2", ["Bolt", "verified · page 3"]), ("2 / 2", ["Bolt", "verified · page 3"])]


def test_procedures_are_named_in_one_pass(spark):
    steps = spark.createDataFrame([(1, i, 1, i % 4 + 1, "Refer to it." if i > 3 else "Fit it to 9 N.m.") for i in range(12)], "doc_id long, pos long, page int, number int, text string")
    found = assembly.named(assembly.segmented(steps))
    assert _plan(found).count("Scan ExistingRDD") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 1, "1", "p.1 - Fit it to 9 N.m", "1")]


def test_decoding_works_out_each_step_once(spark, monkeypatch):
    plans = {}

    def stored(df, name, by=None):
        plans[name] = _plan(df)
        return tables.stored(df, name, by)

    for module in (decode, extraction, vocabulary):
        monkeypatch.setattr(module, "stored", stored)
    pages = spark.createDataFrame([(1, k, f"1. Fit the gear to the frame {'ab'[k - 1]}.\n2. Tighten the gear to 9 N.m.") for k in (1, 2)], "doc_id long, page int, text string")
    found = decode.decode(pages, spark.createDataFrame([], vocabulary.SEED))
    spans = found.parts.where("part_id = 'gear'").orderBy("page").collect()
    assert [(r.page, r.verified, r.quote) for r in spans] == [(1, True, "Fit the gear to the frame a."), (2, True, "Fit the gear to the frame b.")]
    assert "instr" in plans["rows"] and "instr" not in plans["parts"]  # spans are looked up once
    assert "regexp_extract_all" in plans["objects"] and "regexp_extract_all" not in plans["phrases"]  # texts are searched once
    kept = plans["pages"]
    assert kept.count("LeftSemi") == 1 and kept.count("LeftAnti") == 1  # only documents with recurring lines are taken to lines


def test_a_vocabulary_reads_pages_once_and_collects_only_absorbed_names(spark, monkeypatch):
    plans = {}

    def stored(df, name, by=None):
        plans[name] = _plan(df)
        return tables.stored(df, name, by)

    monkeypatch.setattr(vocabulary, "stored", stored)
    text = "Fit the connecting rod and\nfit the bolt.\n 12  GX16-1220  PISTON  1\n 13  GX16-1221  PISTONS  1"
    rows = [(1, 1, text), (1, 1, text), (1, 2, "Fit the rod. Fit the long connecting rod."), (2, 1, "Fit the Rod."), (2, 2, None), (None, 1, "Fit the rod. Fit the connecting rod."), (3, 1, "")]
    pages = spark.createDataFrame(rows, "doc_id long, page long, text string")
    found = vocabulary.lexicon(pages, spark.createDataFrame([("b", "Bolt", ["bolt", "screw"], ["frame"])], vocabulary.SEED))
    assert sum(plan.count("ExistingRDD") for plan in plans.values()) == 1  # the seed is read in the last plan
    last = _plan(found)
    assert "collect_set" in last and "LeftAnti" in last and last.count("max_by") == 2 and last.index("max_by") < last.index("REPARTITION_BY_COL")
    got = {(r.doc_id, r.part_id): (r.name, r.forms, r.attaches_to, r.part_number, r.discovered) for r in found.collect()}
    assert got == {
        (1, "long_connecting_rod"): ("Long connecting rod", ["long connecting rod", "connecting rod", "rod"], [], None, True),
        (1, "b"): ("Bolt", ["screw", "bolt"], ["frame"], None, False),
        (1, "piston"): ("Piston", ["piston"], [], "GX16-1220", True),
        (2, "rod"): ("Rod", ["rod"], [], None, True),
        (None, "rod"): ("Rod", ["rod"], [], None, True),
        (None, "connecting_rod"): ("Connecting rod", ["connecting rod"], [], None, True),
    }


def test_steps_of_mentions_are_read_and_sent_once(spark, monkeypatch):
    plans = []

    def stored_as_laid(df, name, by):
        plans.append(_plan(df))
        return tables.stored_as_laid(df, name, by)

    monkeypatch.setattr(vocabulary, "stored_as_laid", stored_as_laid, raising=False)
    said = [(1, "Fit the rod."), (1, "Fit the rod."), (1, None), (1, ""), (1, "Lift the cap side"), (None, "Fit the rod."), (None, None), (2, "Fit the rods."), (3, "Fit the rod.")]
    steps = spark.createDataFrame([(d, k, t) for k, (d, t) in enumerate(said)], "doc_id long, at long, text string").withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("at")))
    forms = spark.createDataFrame([(1, "rod", "r"), (1, "cap", "c"), (2, "Rod", "s"), (2, "Rod", "s"), (None, "rod", "n"), (3, None, "x"), (3, "rod", None)], "doc_id long, form string, part_id string")
    found = vocabulary.mentions(steps, forms)
    assert [(p.count("Scan ExistingRDD"), p.count("Exchange")) for p in plans] == [(1, 1)]  # the exchange is that of pos
    last = _plan(found)
    assert last.count("Scan ExistingRDD") == 1 and last.count("Exchange") == 1  # of the forms
    assert last.count("regexp_extract_all") == 1  # a text is cut into tokens once
    got = sorted(((r.doc_id, r.at, r.text, r.parts) for r in found.collect()), key=lambda r: r[1])
    assert got == [(d, k, t, {(1, "Fit the rod."): ["r"], (2, "Fit the rods."): ["s"]}.get((d, t), [])) for k, (d, t) in enumerate(said)]
    assert found.columns == [*steps.columns, "parts"]


def test_rows_stored_as_laid_are_right_however_they_lie(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("by"), "id").repartition(5)
    found = tables.stored_as_laid(rows, "any", "by")
    assert found.groupBy("by").agg(F.count("*").alias("n"), F.sum("id").alias("s")).orderBy("by").collect() == rows.groupBy("by").agg(F.count("*").alias("n"), F.sum("id").alias("s")).orderBy("by").collect()
    assert "Exchange" not in _plan(found.groupBy("by").count())


def test_checks_read_steps_and_parts_once_for_their_identifiers(spark):
    steps = spark.createDataFrame([
        ("a", 0, "s01", 1, ["p", "q"], [], 5.0, True), ("a", 1, "s02", None, ["p", None], ["s01", "s09", "s09"], 0.1, None), ("a", 2, "s02", 1, None, ["s01"], 901.0, False),
        ("a", 3, None, 2, ["x"], None, None, True), ("a", 4, "s05", 1, [], [None], None, True), ("a", 4, "s05", 1, [], [None], None, True),
        ("b", 0, "s01", 3, ["u"], [], None, True), (None, 0, "s01", 1, ["z"], ["s07"], None, True),
    ], "proc_id string, idx int, step_id string, number int, installs array<string>, depends_on array<string>, torque_nm double, verified boolean")
    parts = spark.createDataFrame([("a", 0, "p", True), ("a", 1, "p", True), ("a", 2, "r", False), ("a", 3, None, None), ("a", 4, None, True), ("a", 5, "r", True), ("b", 0, "u", True), ("c", 0, "v", True), (None, 0, "z", True)], "proc_id string, ord int, part_id string, verified boolean")
    found = checks.checked(spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), (None,)], "proc_id string"), steps, parts)
    plan = _plan(found)
    assert [plan.count(f"FileScan parquet spark_catalog.default.{name}_") for name in ("steps", "parts", "graph", "procs")] == [2, 1, 1, 1]
    assert "Exchange hashpartitioning" not in plan
    said = {}
    for r in found.orderBy("ord").collect():
        said.setdefault(r.proc_id, []).append(f"{r.code} {r.status} {r.detail}")
    nothing = ["P8 PASS too few steps to judge", "P1 PASS 0 steps sorted", "P2 PASS 0 references resolved", "P3 PASS all 0 parts installed", "P4 PASS trivial", "P5 FAIL empty assembly", "P6 PASS no torque specs to check", "P7 PASS 0 unique ids"]
    assert said == {
        "a": [
            "P8 FAIL 3 numbering restarts across 5 steps - this is ~4 procedures concatenated, not one",
            "P1 FAIL cycle involving 2 steps",
            "P2 FAIL 7 dangling: s01->part:q, s02->step:s09",
            "P3 WARN 4 never installed: r",
            "P4 PASS 3 independent branches, largest 2 steps",
            "P5 PASS 8/12 spans verified verbatim (67%)",
            "P6 FAIL 2 implausible: s02=0.1, s02=901.0",
            "P7 FAIL duplicates: p, r, s02, s05",
        ],
        "b": [
            "P8 PASS too few steps to judge",
            "P1 PASS 1 steps sorted",
            "P2 PASS 1 references resolved",
            "P3 PASS all 1 parts installed",
            "P4 PASS trivial",
            "P5 PASS 2/2 spans verified verbatim (100%)",
            "P6 PASS no torque specs to check",
            "P7 PASS 2 unique ids",
        ],
        "c": [
            "P8 PASS too few steps to judge",
            "P1 PASS 0 steps sorted",
            "P2 PASS 0 references resolved",
            "P3 WARN 1 never installed: v",
            "P4 PASS trivial",
            "P5 PASS 1/1 spans verified verbatim (100%)",
            "P6 PASS no torque specs to check",
            "P7 PASS 1 unique ids",
        ],
        "d": nothing,
        None: nothing,
    }


def test_objects_are_counted_where_they_are_sent(spark, monkeypatch):
    """Else a task holds counts of as many objects as a small file has."""
    plans = {}

    def stored(df, name, by=None):
        plans[name] = _plan(df)
        return tables.stored(df, name, by)

    monkeypatch.setattr(vocabulary, "stored", stored)
    pages = spark.createDataFrame([(1, 1, "Fit the rod. Fit the\n ROD."), (None, 1, "Fit the rod."), (2, 1, None)], "doc_id long, page long, text string")
    found = vocabulary.mined(vocabulary.searched(pages))
    assert plans["counts"].count("Exchange") == 1 and plans["counts"].index("partial_count") < plans["counts"].index("Exchange")
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "rod", 2), (None, "rod", 1)]
