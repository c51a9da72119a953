"""Queries of the document operators on the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import assembly, checks, extraction, graph, layout, library, pages, procedures, viewer, vocabulary
from ..sources.adapters import PAGE_STEPS_SQL, RAW_SQL, manual_pages, raw_steps, table
from ..sources.tables import stored
from . import decoding, faults, library_files, sessions, viewing

RAW, RAW3 = RAW_SQL.format(number="l_linenumber"), RAW_SQL.format(number="3 * l_linenumber")
_RUN = "marked AS (SELECT *, lag(number) OVER w AS a, lag(page) OVER w AS p FROM raw WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), runs AS (SELECT doc_id, pos, page, number, text, CAST(sum(CASE WHEN a IS NULL OR number IS NULL THEN 0 WHEN number <= a OR number - a > 8 OR page - p > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS run FROM marked)"
_T = "round(CAST(nullif(regexp_extract(text, '([0-9]{1,3})\\s*N\\.m', 1), '') AS DOUBLE), 1)"
_WORDS = """w AS (SELECT l_orderkey // 16 AS page, l_partkey * 1000 + l_suppkey AS ord, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS text, CASE WHEN l_orderkey % 3 > 0 AND l_quantity BETWEEN 23 AND 26 THEN l_quantity * 10 - 150 ELSE l_quantity * 10 END AS x0,
  x0 + CASE WHEN l_linenumber = 6 AND l_tax > 0.06 THEN 230.0 ELSE l_linenumber * 2.0 END AS x1, l_linenumber * 30.0 + l_suppkey % 4 AS top, l_linenumber * 30.0 + 10 AS bottom FROM lineitem)"""
_GUTTER = """g AS (SELECT page, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, x0 AS hi FROM n),
  m AS (SELECT page, lo, hi, (lo + hi) / 2 AS c FROM g WHERE hi > lo AND hi - lo >= 10.4 AND (lo + hi) / 2 > 156 AND (lo + hi) / 2 < 364 QUALIFY row_number() OVER (PARTITION BY page ORDER BY hi - lo DESC, lo) = 1)"""
_LINES = f"""{_WORDS}, b AS (SELECT * FROM w WHERE top > 16.5 AND bottom < 203.5), n AS (SELECT * FROM b WHERE x1 - x0 < 208), {_GUTTER},
  sides AS (SELECT page, any_value(c) AS c, count(*) AS k, count(*) FILTER (WHERE x1 <= c) AS l FROM n JOIN m USING (page) GROUP BY page), cols AS (SELECT page, c FROM sides WHERE k >= 20 AND least(l, k - l) >= 0.2 * k),
  placed AS (SELECT b.*, CASE WHEN c IS NULL OR x1 - x0 >= 208 OR (x0 < c AND c < x1) THEN 0 WHEN x1 <= c THEN 1 ELSE 2 END AS region, CAST(floor(top / 3.0) AS BIGINT) AS line FROM b LEFT JOIN cols USING (page)),
  lines AS (SELECT page, region, line, string_agg(text, ' ' ORDER BY x0, ord, text) AS text FROM placed GROUP BY ALL)"""
# segmented steps with the step that installs their part, and what each needs
_SEG = f"""{RAW}, {_RUN}, sub AS (SELECT doc_id, run FROM runs GROUP BY doc_id, run HAVING count(*) >= 4 OR (count(*) >= 2 AND count({_T}) > 0)),
  pr AS (SELECT doc_id, run, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS proc, count(*) OVER (PARTITION BY doc_id) AS k FROM sub), many AS (SELECT DISTINCT doc_id FROM pr WHERE k > 1),
  seg AS (SELECT r.doc_id, r.pos, r.page, r.number, r.text, w.part, CASE WHEN m.doc_id IS NULL THEN 1 ELSE pr.proc END AS proc FROM runs r JOIN raw w USING (doc_id, pos) LEFT JOIN pr ON r.doc_id = pr.doc_id AND r.run = pr.run LEFT JOIN many m ON r.doc_id = m.doc_id WHERE m.doc_id IS NULL OR pr.proc IS NOT NULL),
  s AS (SELECT *, min(idx) OVER (PARTITION BY doc_id, proc, part) AS first FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, proc ORDER BY pos) - 1 AS idx FROM seg)),
  needs AS (SELECT doc_id, proc, idx, first AS dep FROM s WHERE idx > first UNION SELECT a.doc_id, a.proc, a.idx, h.idx FROM s a JOIN s h ON a.doc_id = h.doc_id AND a.proc = h.proc AND a.idx = a.first AND h.idx = h.first AND h.part = 'cold ' || split_part(a.part, ' ', -1) AND h.part <> a.part AND h.idx < a.idx)"""
_CHECKS = f"""{_SEG}, p AS (SELECT doc_id || '-' || proc AS proc_id, * FROM s), q AS (SELECT doc_id || '-' || proc AS proc_id, idx, dep FROM needs),
  parts AS (SELECT DISTINCT proc_id, part, first FROM p), np AS (SELECT proc_id, count(*) AS n, count(*) FILTER (WHERE first % 5 > 1) AS v FROM parts GROUP BY 1), nd AS (SELECT proc_id, count(*) AS n FROM q GROUP BY 1),
  ways AS (SELECT proc_id, idx AS a, dep AS b FROM q UNION SELECT proc_id, dep, idx FROM q), near_(proc_id, a, b) AS (SELECT proc_id, idx, idx FROM p UNION SELECT n.proc_id, n.a, w.b FROM near_ n JOIN ways w ON n.proc_id = w.proc_id AND n.b = w.a),
  comp AS (SELECT proc_id, r, count(*) AS k FROM (SELECT proc_id, a, min(b) AS r FROM near_ GROUP BY ALL) GROUP BY ALL), br AS (SELECT proc_id, count(*) AS c, max(k) AS most FROM comp GROUP BY 1),
  back AS (SELECT proc_id, sum(CASE WHEN number <= l THEN 1 ELSE 0 END) AS k FROM (SELECT proc_id, number, lag(number) OVER (PARTITION BY proc_id ORDER BY idx) AS l FROM p) GROUP BY 1),
  st AS (SELECT proc_id, count(*) AS n, count({_T}) AS t, count(*) FILTER (WHERE idx % 5 > 1) AS v FROM p GROUP BY 1),
  a AS (SELECT st.proc_id, st.n, st.t, st.v + np.v AS v, np.n AS parts, coalesce(nd.n, 0) AS deps, br.c, br.most, back.k FROM st JOIN np USING (proc_id) LEFT JOIN nd USING (proc_id) JOIN br USING (proc_id) JOIN back USING (proc_id)),
  checks AS (SELECT proc_id, 'P1' AS code, 'PASS' AS status, n || ' steps sorted' AS detail FROM a UNION ALL SELECT proc_id, 'P2', 'PASS', (parts + deps) || ' references resolved' FROM a UNION ALL SELECT proc_id, 'P3', 'PASS', 'all ' || parts || ' parts installed' FROM a
  UNION ALL SELECT proc_id, 'P4', CASE WHEN c = n AND n > 3 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN n <= 1 THEN 'trivial' WHEN c = n AND n > 3 THEN 'no ordering recovered - every step isolated' ELSE c || ' independent branches, largest ' || most || ' steps' END FROM a
  UNION ALL SELECT proc_id, 'P5', CASE WHEN v / (n + parts) >= 0.6 THEN 'PASS' ELSE 'FAIL' END, v || '/' || (n + parts) || ' spans verified verbatim (' || CAST(round_even(v / (n + parts) * 100, 0) AS INTEGER) || '%)' FROM a
  UNION ALL SELECT proc_id, 'P6', 'PASS', CASE WHEN t = 0 THEN 'no torque specs to check' ELSE t || ' specs in range' END FROM a UNION ALL SELECT proc_id, 'P7', 'PASS', (n + parts) || ' unique ids' FROM a
  UNION ALL SELECT proc_id, 'P8', CASE WHEN n < 2 OR k <= 2 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN n < 2 THEN 'too few steps to judge' WHEN k <= 2 THEN n || ' steps, ' || k || ' numbering restart(s)' ELSE k || ' numbering restarts across ' || n || ' steps - this is ~' || (k + 1) || ' procedures concatenated, not one' END FROM a)"""


def _pages(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")


def _actions(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("kind"))


def _words(spark, d):
    """An order as a page: words in two columns on some pages, over the whole width on others, some across both."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    two = F.col("l_orderkey") % 3 > 0
    x0 = F.when(two & q.between(23, 26), q * 10 - 150).otherwise(q * 10)
    rows = table(spark, d, "lineitem").select((F.floor(F.col("l_orderkey") / 16)).alias("page"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"), F.col("l_shipdate").cast("date").cast("string").alias("text"), x0.alias("x0"), (x0 + F.when((n == 6) & (F.col("l_tax") > 0.06), 230.0).otherwise(n * 2.0)).alias("x1"), (n * 30.0 + F.col("l_suppkey") % 4).alias("top"), (n * 30.0 + 10).alias("bottom"), F.lit(520.0).alias("width"), F.lit(220.0).alias("height"))
    return rows


def _graph_steps(spark, d):
    """Steps of 16 neighbouring orders; each depends on the first step with its part, and in some the first on it."""
    steps = stored(raw_steps(spark, d, orders=16).select(F.col("doc_id").alias("proc_id"), "pos", "part"), "graph_steps")
    back = procedures.depends(steps.withColumnRenamed("proc_id", "doc_id")).select(F.col("doc_id").alias("proc_id"), F.col("pos").alias("src"), F.col("depends_on").alias("dst"))
    turned = back.where("proc_id % 7 = 0 AND src % 11 = 0").select("proc_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return steps, back.unionByName(turned)


def _graph(spark, d):
    steps, edges = _graph_steps(spark, d)
    return graph.branches(steps.select("proc_id", F.col("pos").alias("id")), edges)


def _segmented(spark, d):
    return stored(assembly.segmented(raw_steps(spark, d)).withColumn("parts", F.array("part")), "segmented", "doc_id")


def _hosts(steps):
    """A part goes with the cold part of its kind."""
    names = steps.select("doc_id", "part").distinct()
    return names.select("doc_id", "part", F.concat(F.lit("cold "), F.substring_index("part", " ", -1)).alias("host")).where("part <> host")


def _assembly(spark, d):
    steps = _segmented(spark, d)
    rows = assembly.step_rows(steps, _hosts(steps), ["washer", "new washer"])
    return rows.select("doc_id", "proc", "idx", "step_id", F.array_join("installs", ",").alias("installs"), F.array_join("depends_on", ",").alias("depends_on"), "tool", "torque_nm")


def _decoded(spark, d):
    steps = _segmented(spark, d)
    key = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("proc").cast("string")).alias("proc_id")
    rows, parts = assembly.step_rows(steps, _hosts(steps)), assembly.declared(steps)
    sure = (F.col("idx") % 5 > 1).alias("verified")
    return steps.select(key).distinct(), rows.select("*", key, sure), parts.select("*", key, sure)


def _checks(spark, d):
    return checks.checked(*_decoded(spark, d)).select("proc_id", "code", "status", "detail")


def _report(spark, d):
    return checks.reported(checks.checked(*_decoded(spark, d))).select("proc_id", "ok", "n_passed", "n_checks")


def _ocr(spark, d):
    words = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 16).alias("doc_id"), F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_linenumber") % 4 == 0, "  ").otherwise(F.col("l_partkey").cast("string")).alias("text"), F.when(F.col("l_discount") > 0.07, -1.0).otherwise(F.col("l_quantity") * 2).alias("conf"))
    return pages.recognised(words)


def _cascade(spark, d):
    p = F.col("o_totalprice")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.repeat(F.lit("word "), (F.col("o_orderkey") % 20).cast("int")).alias("raw_text"), F.col("o_orderpriority").alias("ocr_text"), F.floor(p % 100).cast("double").alias("ocr_confidence"), F.when(F.col("o_custkey") % 2 == 0, "seen").alias("vision_text"), F.when(F.col("o_custkey") % 17 == 0, "broken").alias("error"))
    return pages.cascaded(rows).select("page", "text", "tier", "confidence")


def _attempts(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("value").alias("duration_sec"), F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("errors"))


def _manuals(spark, d):
    return library.manuals(table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("m"), (F.col("o_custkey") % 97).cast("string"))).alias("document"), (F.col("o_orderstatus") != "F").alias("ok")))


def _parts_of_supply(spark, d):
    return table(spark, d, "part").select((F.col("p_partkey") % 50).alias("proc_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("part_id"), F.col("p_name").alias("name"))


def _unmodelled(spark, d):
    models = table(spark, d, "part").where(F.col("p_name").startswith("cold ")).select(F.col("p_name").alias("part_id"))
    return viewer.unmodelled(_parts_of_supply(spark, d), models)


def _provenance(spark, d):
    pages = manual_pages(spark, d)
    quotes = extraction.steps_of(pages).select("doc_id", "page", F.col("ord").cast("long").alias("ord"), F.col("text").alias("quote"))
    return extraction.located(quotes, pages).select("doc_id", "page", "ord", "verified", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


def _lexicon(spark, d):
    seed = spark.createDataFrame([("bolt", "Bolt", ["large bolt"], ["frame"])], vocabulary.SEED)
    return vocabulary.lexicon(manual_pages(spark, d), seed).select("doc_id", "part_id", "name", F.size("forms").cast("long").alias("n_forms"), "discovered")


def _mentions(spark, d):
    steps = raw_steps(spark, d)
    cold, last = F.col("part").startswith("cold "), F.substring_index("part", " ", -1)
    names = steps.select("doc_id", "part").distinct()
    forms = names.where(cold).select("doc_id", F.col("part").alias("form"), F.col("part").alias("part_id")).union(names.select("doc_id", last, last).distinct())
    return vocabulary.mentions(steps, forms).select("doc_id", "pos", F.array_join("parts", ",").alias("parts"))


def _present(spark, d):
    steps = raw_steps(spark, d).select(F.col("doc_id").alias("proc_id"), F.col("pos").alias("step"), "part")
    return viewer.present(steps, steps)


def _manifest(spark, d):
    steps = raw_steps(spark, d)
    rows = steps.select(F.col("doc_id").alias("proc_id"), fields.torque_nm(F.col("text")).alias("torque_nm"), F.contains("text", F.lit("WARNING")).alias("verified"))
    parts = procedures.first_use(steps).select(F.col("doc_id").alias("proc_id"), F.when(F.col("first_pos") % 3 > 0, F.col("first_pos") % 3 == 1).alias("verified"))
    return library.manifest(rows, parts)


def _inside(spark, d):
    seats = table(spark, d, "customer").select(F.col("c_nationkey").alias("scene"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).alias("y"), F.lit(0).alias("z"))
    shells = table(spark, d, "supplier").select(F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("shell"), F.col("s_acctbal").alias("x0"), (F.col("s_acctbal") + 300).alias("x1"), F.lit(10).alias("y0"), F.lit(60).alias("y1"), F.lit(0).alias("z0"), F.lit(0).alias("z1"))
    return viewer.inside(seats, shells)


QUERIES = {
    "text_steps": lambda s, d: extraction.steps_of(manual_pages(s, d)).withColumn("ord", F.col("ord").cast("long")),
    "provenance": _provenance,
    "lexicon": _lexicon,
    "mentions": _mentions,
    "presence": _present,
    "manifest": _manifest,
    "containment": _inside,
    "label_packing": lambda s, d: viewer.labels(table(s, d, "supplier").select(F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("id"), F.floor("s_acctbal").cast("double").alias("y")), 800.0),
    "segment_runs": lambda s, d: procedures.runs(raw_steps(s, d)).select("doc_id", "pos", "run"),
    "segment_runs_gap": lambda s, d: procedures.runs(raw_steps(s, d, "3 * l_linenumber")).select("doc_id", "pos", "run"),
    "procedures": lambda s, d: procedures.procedures(raw_steps(s, d)),
    "torque_nm": lambda s, d: raw_steps(s, d).select("doc_id", "pos", fields.torque_nm(F.col("text")).alias("torque")),
    "warning": lambda s, d: raw_steps(s, d).select("doc_id", "pos", fields.warning(F.col("text")).alias("warning")),
    "installs": lambda s, d: procedures.first_use(raw_steps(s, d)),
    "depends": lambda s, d: procedures.depends(raw_steps(s, d)),
    "p8_single": lambda s, d: procedures.restarts(raw_steps(s, d)),
    "p6_torque_range": lambda s, d: procedures.torque_range(raw_steps(s, d)),
    "p3_orphans": lambda s, d: procedures.orphans(table(s, d, "supplier").select(F.col("s_nationkey").alias("proc_id"), F.col("s_suppkey").alias("part")), table(s, d, "supplier").join(table(s, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("proc_id"), F.expr("CASE WHEN l_quantity >= 49 AND l_linenumber = 7 THEN s_suppkey ELSE -s_suppkey - 1 END").alias("part"))),
    "p2_dangling": lambda s, d: procedures.dangling(table(s, d, "orders").select((F.col("o_orderkey") % 10).alias("proc_id"), F.col("o_custkey").alias("ref")), table(s, d, "customer").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("proc_id"), F.expr("CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey - 1 END").alias("id"))),
    "p7_repeated_ids": lambda s, d: procedures.repeated_ids(table(s, d, "lineitem").select(F.col("l_orderkey").alias("proc_id"), F.col("l_linenumber").alias("id"))),
    "p1_p4_graph": _graph,
    "block_dedup": lambda s, d: table(s, d, "documents").select("doc_id", pages.without_copies(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text")),
    "assembly_steps": _assembly,
    "part_decl": lambda s, d: assembly.declared(_segmented(s, d)).select("doc_id", "proc", "ord", "part_id", "qty", "idx"),
    "procedure_names": lambda s, d: assembly.named(assembly.segmented(raw_steps(s, d))).select("doc_id", "proc", "proc_id", "name", "title"),
    "checks": _checks,
    "check_report": _report,
    "layout_lines": lambda s, d: layout.lines(_words(s, d)),
    "layout_text": lambda s, d: layout.page_text(_words(s, d)),
    "ocr_text": _ocr,
    "tier_cascade": _cascade,
    "history_summary": lambda s, d: library.history_summary(_attempts(s, d)),
    "library_groups": _manuals,
    "card_percent": lambda s, d: table(s, d, "orders").select("o_orderkey", library.card_percent(F.col("o_custkey") % 7, F.col("o_orderkey") % 9).alias("percent")),
    "generic_shape": lambda s, d: table(s, d, "part").select("p_partkey", viewer.shape(F.col("p_name")).alias("shape")),
    "unmodelled": _unmodelled,
    "bench_places": lambda s, d: viewer.on_bench(table(s, d, "part").select((F.col("p_partkey") % 50).alias("proc_id"), F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("part_id"))),
    "file_names": lambda s, d: table(s, d, "supplier").select("s_suppkey", pages.file_name(F.concat(F.lit("up/load/"), F.replace("s_name", F.lit("#"), F.lit(" # ")))).alias("name")),
    "tool": lambda s, d: raw_steps(s, d).select("doc_id", "pos", fields.tool(F.col("text"), ["washer", "old washer", "bolt"]).alias("tool")),
    "furniture": lambda s, d: library.furniture(_pages(s, d), 0.1),
    "tier_summary": lambda s, d: pages.tier_counts(_pages(s, d).select(F.when(F.length(F.trim("text")) > 50, 1).when(F.col("page") % 2 == 0, 2).alias("tier"))),
    "attempt_topk": lambda s, d: library.history(_actions(s, d).select(F.col("user").alias("doc_id"), "id", F.col("ts").alias("at"))).select("doc_id", "id"),
    "hesitation": lambda s, d: library.hesitation(_actions(s, d)),
    "competency": lambda s, d: library.competency(_actions(s, d), ("error", "click")),
    "alias_absorb": lambda s, d: library.absorbed(table(s, d, "part").select(F.col("p_name").alias("name")).union(table(s, d, "part").select(F.substring_index("p_name", " ", -1))).distinct()),
    "singular": lambda s, d: table(s, d, "part").select("p_partkey", fields.singular(F.concat(F.substring_index("p_name", " ", -1), F.lit("es"))).alias("word")),
    "slug": lambda s, d: table(s, d, "supplier").select("s_suppkey", fields.slug(F.col("s_name")).alias("slug")),
    "gutter": lambda s, d: layout.gutter(_words(s, d)),
    **sessions.QUERIES,
    **decoding.QUERIES,
    **faults.QUERIES,
    **library_files.QUERIES,
    **viewing.QUERIES,
}

ORACLE_SQL = {
    "text_steps": f"WITH {PAGE_STEPS_SQL} SELECT doc_id, page, ord, number, action || washer AS text, action FROM lines",
    "provenance": f"WITH {PAGE_STEPS_SQL}, whole AS (SELECT page, string_agg(number || '. ' || action || washer || CASE WHEN number = 3 THEN ' Torque reference' ELSE '' END, ' ' ORDER BY ord) AS said FROM lines GROUP BY page) SELECT doc_id, page, ord, true AS verified, instr(said, action || washer) - 1 AS char_start, instr(said, action || washer) - 1 + length(action || washer) AS char_end FROM lines JOIN whole USING (page)",
    "lexicon": f"WITH {PAGE_STEPS_SQL}, names AS (SELECT DISTINCT doc_id, regexp_replace(part, '^(new|old) ', '') AS name FROM lines), own AS (SELECT a.doc_id, coalesce(min(b.name), a.name) AS name FROM names a LEFT JOIN names b ON a.doc_id = b.doc_id AND ends_with(b.name, ' ' || a.name) GROUP BY a.doc_id, a.name) SELECT doc_id, CASE WHEN name = 'large bolt' THEN 'bolt' ELSE replace(name, ' ', '_') END AS part_id, CASE WHEN name = 'large bolt' THEN 'Bolt' ELSE upper(name[1]) || name[2:] END AS name, count(*) AS n_forms, name <> 'large bolt' AS discovered FROM own GROUP BY doc_id, own.name",
    "mentions": f"WITH {RAW} SELECT doc_id, pos, CASE WHEN part LIKE 'cold %' THEN part ELSE split_part(part, ' ', -1) END AS parts FROM raw",
    "presence": f"WITH {RAW}, f AS (SELECT doc_id, pos, CASE WHEN pos = min(pos) OVER (PARTITION BY doc_id, part) THEN 1 ELSE 0 END AS k FROM raw) SELECT doc_id AS proc_id, pos AS step, CAST(sum(k) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS n_present FROM f",
    "manifest": f"WITH {RAW}, r AS (SELECT doc_id, 1 AS s, 0 AS p, {_T} AS t, contains(text, 'WARNING') AS v FROM raw UNION ALL SELECT doc_id, 0, 1, NULL, CASE WHEN min(pos) % 3 > 0 THEN min(pos) % 3 = 1 END FROM raw GROUP BY doc_id, part) SELECT doc_id AS proc_id, CAST(sum(p) AS BIGINT) AS parts, CAST(sum(s) AS BIGINT) AS steps, count(t) AS torque_specs, count(*) FILTER (WHERE v) AS verified_spans, count(v) AS total_spans FROM r GROUP BY doc_id",
    "containment": "SELECT DISTINCT s_nationkey AS scene, s_suppkey AS shell FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_acctbal BETWEEN s_acctbal AND s_acctbal + 300 AND c_custkey % 100 BETWEEN 10 AND 60",
    "label_packing": "WITH r AS (SELECT s_nationkey AS scene, s_suppkey AS id, floor(s_acctbal) AS y, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal), s_suppkey) - 1 AS n FROM supplier) SELECT scene, id, 26 * n + greatest(96.0::DOUBLE, max(least(y, 704.0::DOUBLE) - 26 * n) OVER (PARTITION BY scene ORDER BY n)) AS y FROM r",
    "segment_runs": f"WITH {RAW}, {_RUN} SELECT doc_id, pos, run FROM runs",
    "segment_runs_gap": f"WITH {RAW3}, {_RUN} SELECT doc_id, pos, run FROM runs",
    "procedures": f"WITH {RAW}, {_RUN} SELECT doc_id, run, count(*) AS n_steps, count({_T}) AS n_torque, min(page) AS first_page FROM runs GROUP BY doc_id, run HAVING count(*) >= 4 OR (count(*) >= 2 AND count({_T}) > 0)",
    "torque_nm": f"WITH {RAW} SELECT doc_id, pos, {_T} AS torque FROM raw",
    "warning": f"WITH {RAW} SELECT doc_id, pos, nullif(regexp_extract(text, 'WARNING: do not reuse the old washer\\.', 0), '') AS warning FROM raw",
    "installs": f"WITH {RAW} SELECT doc_id, part, min(pos) AS first_pos FROM raw GROUP BY doc_id, part",
    "depends": f"WITH {RAW}, f AS (SELECT doc_id, part, min(pos) AS first_pos FROM raw GROUP BY doc_id, part) SELECT DISTINCT r.doc_id, r.pos, f.first_pos AS depends_on FROM raw r JOIN f ON r.doc_id = f.doc_id AND r.part = f.part WHERE r.pos > f.first_pos",
    "p8_single": f"WITH {RAW}, m AS (SELECT doc_id, CASE WHEN number <= lag(number) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS back FROM raw) SELECT doc_id, CAST(sum(back) AS BIGINT) AS n_restarts, CASE WHEN sum(back) <= 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM m GROUP BY doc_id",
    "p6_torque_range": f"WITH {RAW}, t AS (SELECT doc_id, {_T} AS t FROM raw) SELECT doc_id, count(t) AS n_specs, count(*) FILTER (WHERE t < 0.5 OR t > 900) AS n_outside, CASE WHEN count(*) FILTER (WHERE t < 0.5 OR t > 900) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM t GROUP BY doc_id",
    "p3_orphans": "SELECT s_nationkey AS proc_id, s_suppkey AS part FROM supplier WHERE s_suppkey NOT IN (SELECT CASE WHEN l_quantity >= 49 AND l_linenumber = 7 THEN l_suppkey ELSE -l_suppkey - 1 END FROM lineitem)",
    "p2_dangling": "SELECT DISTINCT o_orderkey % 10 AS proc_id, o_custkey AS ref FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey - 1 END FROM customer)",
    "p7_repeated_ids": "SELECT l_orderkey AS proc_id, l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "furniture": "WITH l AS (SELECT source AS doc_id, doc_id AS page, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT DISTINCT doc_id, page, lower(regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '[0-9]+', '#', 'g')) AS key FROM l), n AS (SELECT doc_id, key, count(*) AS n_pages FROM k WHERE length(key) >= 4 GROUP BY doc_id, key), t AS (SELECT source AS doc_id, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source) SELECT n.doc_id, key, n_pages FROM n JOIN t USING (doc_id) WHERE pages >= 3 AND n_pages >= greatest(2, floor(pages * 0.1::DOUBLE))",
    "tier_summary": "SELECT CASE WHEN length(trim(text)) > 50 THEN '1' WHEN doc_id % 2 = 0 THEN '2' ELSE 'None' END AS tier, count(*) AS n_pages FROM documents GROUP BY 1",
    "attempt_topk": "SELECT user_id AS doc_id, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50",
    "hesitation": "SELECT user_id AS user, event_id AS id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS micros FROM events",
    "competency": """WITH h AS (SELECT user_id, event_id, event_type, event_type IN ('error', 'click') AS bad, epoch_us(ts) AS at_us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS micros FROM events),
      e AS (SELECT *, row_number() OVER (PARTITION BY user_id, bad ORDER BY at_us, event_id) AS r FROM h), k AS (SELECT user_id, event_type, count(*) AS n FROM h WHERE bad GROUP BY ALL), b AS (SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_reason FROM k GROUP BY user_id)
      SELECT user_id AS user, count(*) AS n_actions, count(*) FILTER (WHERE bad) AS n_errors, count(DISTINCT event_type) FILTER (WHERE bad) AS n_reasons, max(micros) AS longest, arg_min(event_id, (-micros, at_us, event_id)) FILTER (WHERE micros > 0) AS longest_id, max(at_us) - min(at_us) AS micros,
      coalesce(any_value(by_reason), '') AS by_reason, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY at_us, event_id) FILTER (WHERE bad AND r <= 4), '') AS first_errors FROM e LEFT JOIN b USING (user_id) GROUP BY user_id""",
    "alias_absorb": "WITH n AS (SELECT p_name AS name FROM part UNION SELECT split_part(p_name, ' ', -1) FROM part) SELECT a.name, min(b.name) AS alias_of FROM n a JOIN n b ON ends_with(b.name, ' ' || a.name) GROUP BY a.name",
    "singular": "SELECT p_partkey, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(sses|shes|ches)$') THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN left(w, -1) ELSE w END AS word FROM (SELECT p_partkey, split_part(p_name, ' ', -1) || 'es' AS w FROM part)",
    "slug": "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier",
    "gutter": f"WITH {_WORDS}, {_GUTTER.replace('FROM n', 'FROM w')} SELECT page, lo, hi FROM m",
    "layout_lines": f"WITH {_LINES} SELECT * FROM lines",
    "layout_text": f"WITH {_LINES} SELECT page, string_agg(text, chr(10) ORDER BY region, line) AS layout_text FROM lines GROUP BY page",
    "block_dedup": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS block, generate_subscripts(l, 1) AS i FROM l),
      f AS (SELECT doc_id, block, min(i) AS i FROM b WHERE block <> '' GROUP BY ALL), t AS (SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY i) AS text FROM f GROUP BY doc_id)
      SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text FROM documents d LEFT JOIN t USING (doc_id)""",
    "p1_p4_graph": f"""WITH RECURSIVE {RAW.replace('// 64', '// 16')}, f AS (SELECT doc_id, part, min(pos) AS first_pos FROM raw GROUP BY ALL),
      e0 AS (SELECT DISTINCT r.doc_id, r.pos AS src, f.first_pos AS dst FROM raw r JOIN f USING (doc_id, part) WHERE r.pos > f.first_pos),
      e AS (SELECT * FROM e0 UNION ALL SELECT doc_id, dst, src FROM e0 WHERE doc_id % 7 = 0 AND src % 11 = 0), both_ways AS (SELECT doc_id, src, dst FROM e UNION SELECT doc_id, dst, src FROM e),
      near_(doc_id, a, b) AS (SELECT doc_id, pos, pos FROM raw UNION SELECT n.doc_id, n.a, x.dst FROM near_ n JOIN both_ways x ON n.doc_id = x.doc_id AND n.b = x.src),
      down(doc_id, a, b) AS (SELECT doc_id, src, dst FROM e UNION SELECT n.doc_id, n.a, x.dst FROM down n JOIN e x ON n.doc_id = x.doc_id AND n.b = x.src),
      cyc AS (SELECT DISTINCT doc_id, a FROM down WHERE a = b), stuck AS (SELECT n.doc_id, count(DISTINCT n.a) AS k FROM down n JOIN cyc c ON n.doc_id = c.doc_id AND n.b = c.a GROUP BY n.doc_id),
      c AS (SELECT doc_id, a, min(b) AS r FROM near_ GROUP BY ALL), sizes AS (SELECT doc_id, r, count(*) AS k FROM c GROUP BY ALL)
      SELECT z.doc_id AS proc_id, CAST(sum(z.k) AS BIGINT) AS n_steps, count(*) AS n_branches, max(z.k) AS largest, coalesce(any_value(s.k), 0) AS stuck FROM sizes z LEFT JOIN stuck s USING (doc_id) GROUP BY z.doc_id""",
    "assembly_steps": f"""WITH {_SEG}, dep AS (SELECT * FROM needs) SELECT s.doc_id, s.proc, s.idx, printf('s%02d', s.idx + 1) AS step_id, CASE WHEN s.idx = s.first THEN s.part ELSE '' END AS installs,
      coalesce((SELECT string_agg(printf('s%02d', d.dep + 1), ',' ORDER BY printf('s%02d', d.dep + 1)) FROM dep d WHERE d.doc_id = s.doc_id AND d.proc = s.proc AND d.idx = s.idx), '') AS depends_on,
      CASE WHEN contains(lower(text), 'washer') THEN 'washer' END AS tool, {_T} AS torque_nm FROM s""",
    "part_decl": f"WITH {_SEG} SELECT doc_id, proc, row_number() OVER (PARTITION BY doc_id, proc ORDER BY first) - 1 AS ord, part AS part_id, 1 AS qty, first AS idx FROM (SELECT DISTINCT doc_id, proc, part, first FROM s)",
    "procedure_names": f"WITH {_SEG}, t AS (SELECT doc_id, proc, count(*) OVER (PARTITION BY doc_id) AS k, 'p.' || page || ' - ' || array_to_string(string_split(text, ' ')[1:7], ' ') || '...' AS name FROM s WHERE idx = 0) SELECT doc_id, proc, CASE WHEN k > 1 THEN printf('%d-p%03d', doc_id, proc) ELSE CAST(doc_id AS VARCHAR) END AS proc_id, name, CASE WHEN k > 1 THEN doc_id || ' - ' || name ELSE CAST(doc_id AS VARCHAR) END AS title FROM t",
    "checks": f"WITH RECURSIVE {_CHECKS} SELECT * FROM checks",
    "check_report": f"WITH RECURSIVE {_CHECKS} SELECT proc_id, bool_and(status <> 'FAIL') AS ok, count(*) FILTER (WHERE status = 'PASS') AS n_passed, count(*) AS n_checks FROM checks GROUP BY proc_id",
    "ocr_text": "WITH w AS (SELECT l_orderkey // 16 AS doc_id, l_orderkey AS page, l_partkey * 10 + l_linenumber AS ord, CASE WHEN l_linenumber % 4 = 0 THEN '  ' ELSE CAST(l_partkey AS VARCHAR) END AS text, CASE WHEN l_discount > 0.07 THEN -1.0 ELSE l_quantity * 2 END AS conf FROM lineitem) SELECT doc_id, page, coalesce(string_agg(text, ' ' ORDER BY ord, text) FILTER (WHERE conf > 0 AND trim(text) <> ''), '') AS ocr_text, round(coalesce(avg(conf) FILTER (WHERE conf > 0), 0), 1) AS ocr_confidence FROM w GROUP BY doc_id, page",
    "tier_cascade": "WITH o AS (SELECT o_orderkey AS page, trim(repeat('word ', CAST(o_orderkey % 20 AS INTEGER))) AS raw, o_orderpriority AS ocr, floor(o_totalprice % 100) AS conf, CASE WHEN o_custkey % 2 = 0 THEN 'seen' ELSE '' END AS vision, o_custkey % 17 = 0 AS broken FROM orders) SELECT page, CASE WHEN broken THEN '' WHEN length(raw) > 50 THEN raw WHEN conf >= 60 THEN ocr ELSE vision END AS text, CASE WHEN broken THEN NULL WHEN length(raw) > 50 THEN 1 WHEN conf >= 60 THEN 2 ELSE 3 END AS tier, CASE WHEN NOT broken AND length(raw) <= 50 THEN conf END AS confidence FROM o",
    "history_summary": "WITH k AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50) SELECT user_id AS doc_id, count(*) AS attempts, min(value) FILTER (WHERE event_type <> 'error') AS best_clean_sec, max(ts) AS last_at, CAST(arg_max(event_type = 'error', (ts, event_id)) AS BIGINT) AS last_errors FROM k GROUP BY user_id",
    "library_groups": "WITH m AS (SELECT o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_custkey % 5 > 0 THEN 'm' || (o_custkey % 97) END AS document, o_orderstatus <> 'F' AS ok FROM orders) SELECT 0 AS kind, ord, id AS document, CAST(1 AS BIGINT) AS n, CAST(ok AS BIGINT) AS n_ok FROM m WHERE document IS NULL UNION ALL SELECT 1, min(ord), document, count(*), count(*) FILTER (WHERE ok) FROM m WHERE document IS NOT NULL GROUP BY document",
    "card_percent": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN CAST(floor((o_custkey % 7)::DOUBLE / (o_orderkey % 9) * 100 + 0.5) AS BIGINT) ELSE 0 END AS percent FROM orders",
    "generic_shape": "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(p_name), '{words}') THEN '{kind}'" for kind, words in viewer.SHAPES) + " ELSE 'box' END AS shape FROM part",
    "unmodelled": "WITH l AS (SELECT p_partkey % 50 AS proc_id, p_name, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS r FROM part WHERE NOT starts_with(p_name, 'cold ')) SELECT proc_id, count(*) AS n, string_agg(p_name, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS names FROM l GROUP BY proc_id",
    "bench_places": "WITH l AS (SELECT p_partkey % 50 AS proc_id, p_partkey AS part_id, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) - 1 AS n FROM part) SELECT proc_id, part_id, -7.0::DOUBLE + n % 6 * 2.8::DOUBLE AS x, -5.2::DOUBLE AS y, 9.0::DOUBLE + n // 6 * 2.6::DOUBLE AS z FROM l",
    "file_names": "SELECT s_suppkey, regexp_replace(replace(s_name, '#', ' # '), '[^A-Za-z0-9._-]+', '_', 'g') || '.pdf' AS name FROM supplier",
    "tool": f"WITH {RAW} SELECT doc_id, pos, CASE WHEN contains(lower(text), 'old washer') THEN 'old washer' WHEN contains(lower(text), 'washer') THEN 'washer' WHEN contains(lower(text), 'bolt') THEN 'bolt' END AS tool FROM raw",
    **sessions.ORACLE_SQL,
    **decoding.ORACLE_SQL,
    **faults.ORACLE_SQL,
    **library_files.ORACLE_SQL,
    **viewing.ORACLE_SQL,
}
