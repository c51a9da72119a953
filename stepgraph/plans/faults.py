"""The eight checks on procedures with faults of every kind, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import checks
from ..sources.adapters import table


def _faulty(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Four orders as a procedure, a line as a step: some wait for the next step or one that is not there, some repeat the
    id before, some install undeclared parts; some parts are never installed."""
    order = W.partitionBy("proc_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount", "l_returnflag")
    rows = table(spark, d, "lineitem").withColumn("proc_id", F.floor(F.col("l_orderkey") / 4)).withColumn("idx", F.row_number().over(order) - 1)
    name = lambda n: F.concat(F.lit("s"), n.cast("string"))
    back = F.when((F.col("l_discount") >= 0.05) & (F.col("idx") > 0), name(F.col("idx")))
    ahead = F.when(F.col("l_discount").between(0.005, 0.015), name(F.col("idx") + 2))
    twice = F.when((F.col("l_tax") > 0.075) & (F.col("idx") > 0), 0).otherwise(1)
    part = F.concat(F.lit("p"), (F.col("l_suppkey") % 13).cast("string"))
    torque = F.when(F.col("l_quantity") == 50, 950.0).when(F.col("l_partkey") % 2 == 0, F.col("l_quantity").cast("double"))
    steps = rows.select("proc_id", "idx", name(F.col("idx") + twice).alias("step_id"), F.col("l_linenumber").alias("number"), F.array(part).alias("installs"), F.array_compact(F.array(back, ahead)).alias("depends_on"), torque.alias("torque_nm"), (F.col("l_returnflag") != "R").alias("verified"))
    declared = rows.where("l_linenumber <> 3").select("proc_id", part.alias("part_id")).union(rows.where("l_quantity > 47").select("proc_id", F.concat(F.lit("q"), F.col("l_linenumber").cast("string")))).repartition("proc_id").distinct()
    parts = declared.select("proc_id", (F.row_number().over(W.partitionBy("proc_id").orderBy("part_id")) - 1).alias("ord"), "part_id", F.col("part_id").startswith("p").alias("verified"))
    return rows.select("proc_id").distinct(), steps, parts


QUERIES = {"checks_failing": lambda s, d: checks.checked(*_faulty(s, d)).select("proc_id", "code", "status", "detail")}

_FEW = "array_to_string((list({what} ORDER BY {order}) FILTER (WHERE {when}))[1:3], ', ')"
ORACLE_SQL = {
    "checks_failing": f"""WITH RECURSIVE r AS (SELECT l_orderkey // 4 AS proc_id, *, row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_discount, l_returnflag) - 1 AS idx FROM lineitem),
  s AS (SELECT proc_id, idx, 's' || (idx + CASE WHEN l_tax > 0.075 AND idx > 0 THEN 0 ELSE 1 END) AS id, l_linenumber AS number, 'p' || (l_suppkey % 13) AS part, CASE WHEN l_discount >= 0.05 AND idx > 0 THEN 's' || idx END AS back, CASE WHEN l_discount BETWEEN 0.005 AND 0.015 THEN 's' || (idx + 2) END AS ahead,
    CASE WHEN l_quantity = 50 THEN 950.0::DOUBLE WHEN l_partkey % 2 = 0 THEN l_quantity::DOUBLE END AS t, l_returnflag <> 'R' AS sure FROM r),
  p AS (SELECT *, row_number() OVER (PARTITION BY proc_id ORDER BY part) - 1 AS ord FROM (SELECT proc_id, 'p' || (l_suppkey % 13) AS part FROM r WHERE l_linenumber <> 3 UNION SELECT proc_id, 'q' || l_linenumber FROM r WHERE l_quantity > 47)),
  nodes AS (SELECT DISTINCT proc_id, id FROM s),
  refs AS (SELECT proc_id, idx, id, 0 AS side, part AS ref FROM s UNION ALL SELECT proc_id, idx, id, 1, back FROM s WHERE back IS NOT NULL UNION ALL SELECT proc_id, idx, id, 2, ahead FROM s WHERE ahead IS NOT NULL),
  known AS (SELECT f.*, CASE WHEN side = 0 THEN p.part ELSE n.id END AS target FROM refs f LEFT JOIN p ON side = 0 AND p.proc_id = f.proc_id AND p.part = f.ref LEFT JOIN nodes n ON side > 0 AND n.proc_id = f.proc_id AND n.id = f.ref),
  e AS (SELECT DISTINCT proc_id, id AS src, ref AS dst FROM known WHERE side > 0 AND target IS NOT NULL),
  down(proc_id, a, b) AS (SELECT proc_id, src, dst FROM e UNION SELECT d.proc_id, d.a, e.dst FROM down d JOIN e ON e.proc_id = d.proc_id AND e.src = d.b),
  near_(proc_id, a, b) AS (SELECT proc_id, id, id FROM nodes UNION SELECT n.proc_id, n.a, w.b FROM near_ n JOIN (SELECT proc_id, src AS a, dst AS b FROM e UNION SELECT proc_id, dst, src FROM e) w ON w.proc_id = n.proc_id AND w.a = n.b),
  stuck AS (SELECT d.proc_id, count(DISTINCT d.a) AS k FROM down d JOIN (SELECT DISTINCT proc_id, a FROM down WHERE a = b) c ON c.proc_id = d.proc_id AND c.a = d.b GROUP BY d.proc_id),
  br AS (SELECT proc_id, count(*) AS c, max(k) AS most, sum(k) AS n FROM (SELECT proc_id, root, count(*) AS k FROM (SELECT proc_id, a, min(b) AS root FROM near_ GROUP BY ALL) GROUP BY ALL) GROUP BY proc_id),
  st AS (SELECT proc_id, count(*) AS n, count(*) FILTER (WHERE sure) AS sure, count(t) AS t, count(*) FILTER (WHERE t = 950) AS odd, {_FEW.format(what="id || '=' || t", order="idx", when="t = 950")} AS odd_said FROM s GROUP BY proc_id),
  back AS (SELECT proc_id, count(*) FILTER (WHERE number <= l) AS k FROM (SELECT proc_id, number, lag(number) OVER (PARTITION BY proc_id ORDER BY idx) AS l FROM s) GROUP BY proc_id),
  f AS (SELECT proc_id, count(*) AS refs, count(*) FILTER (WHERE target IS NULL) AS loose, {_FEW.format(what="id || CASE WHEN side = 0 THEN '->part:' ELSE '->step:' END || ref", order="(idx, side)", when="target IS NULL")} AS loose_said FROM known GROUP BY proc_id),
  o AS (SELECT proc_id, count(*) AS parts, count(*) FILTER (WHERE part LIKE 'p%') AS sure_parts, count(*) FILTER (WHERE used IS NULL) AS lost, {_FEW.format(what="part", order="ord", when="used IS NULL")} AS lost_said FROM (SELECT p.*, u.part AS used FROM p LEFT JOIN (SELECT DISTINCT proc_id, part FROM s) u ON u.proc_id = p.proc_id AND u.part = p.part) GROUP BY proc_id),
  twice AS (SELECT proc_id, array_to_string(list(id ORDER BY id)[1:4], ', ') AS said FROM (SELECT proc_id, id FROM s GROUP BY ALL HAVING count(*) > 1) GROUP BY proc_id),
  a AS (SELECT st.*, coalesce(parts, 0) AS parts, coalesce(sure_parts, 0) AS sure_parts, coalesce(lost, 0) AS lost, lost_said, refs, loose, loose_said, c, most, st.n - br.n + coalesce(stuck.k, 0) AS stuck, back.k AS back, twice.said AS twice, (st.sure + coalesce(sure_parts, 0)) / (st.n + coalesce(parts, 0)) AS share
    FROM st JOIN br USING (proc_id) JOIN back USING (proc_id) JOIN f USING (proc_id) LEFT JOIN o USING (proc_id) LEFT JOIN stuck USING (proc_id) LEFT JOIN twice USING (proc_id))
  SELECT proc_id, 'P1' AS code, CASE WHEN stuck = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN stuck = 0 THEN n || ' steps sorted' ELSE 'cycle involving ' || stuck || ' steps' END AS detail FROM a
  UNION ALL SELECT proc_id, 'P2', CASE WHEN loose = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN loose = 0 THEN refs || ' references resolved' ELSE loose || ' dangling: ' || loose_said END FROM a
  UNION ALL SELECT proc_id, 'P3', CASE WHEN lost = 0 THEN 'PASS' ELSE 'WARN' END, CASE WHEN lost = 0 THEN 'all ' || parts || ' parts installed' ELSE lost || ' never installed: ' || lost_said END FROM a
  UNION ALL SELECT proc_id, 'P4', CASE WHEN c = n AND n > 3 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN n <= 1 THEN 'trivial' WHEN c = n AND n > 3 THEN 'no ordering recovered - every step isolated' ELSE c || ' independent branches, largest ' || most || ' steps' END FROM a
  UNION ALL SELECT proc_id, 'P5', CASE WHEN share >= 0.6 THEN 'PASS' ELSE 'FAIL' END, (sure + sure_parts) || '/' || (n + parts) || ' spans verified verbatim (' || CAST(round_even(share * 100, 0) AS INTEGER) || '%)' FROM a
  UNION ALL SELECT proc_id, 'P6', CASE WHEN odd = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN t = 0 THEN 'no torque specs to check' WHEN odd = 0 THEN t || ' specs in range' ELSE odd || ' implausible: ' || odd_said END FROM a
  UNION ALL SELECT proc_id, 'P7', CASE WHEN twice IS NULL THEN 'PASS' ELSE 'FAIL' END, CASE WHEN twice IS NULL THEN (n + parts) || ' unique ids' ELSE 'duplicates: ' || twice END FROM a
  UNION ALL SELECT proc_id, 'P8', CASE WHEN back <= 2 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN n < 2 THEN 'too few steps to judge' WHEN back <= 2 THEN n || ' steps, ' || back || ' numbering restart(s)' ELSE back || ' numbering restarts across ' || n || ' steps - this is ~' || (back + 1) || ' procedures concatenated, not one' END FROM a""",
}
