"""Queries of what a viewer lists, of notes among procedures, of cited pages and upload names, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import torque_nm
from ..operators import pages, procedures, viewer
from ..sources.adapters import RAW_SQL, raw_steps, table
from ..sources.tables import stored

RAW = RAW_SQL.format(number="l_linenumber")
_T = "CAST(nullif(regexp_extract(text, '([0-9]{1,3})\\s*N\\.m', 1), '') AS INTEGER)"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of manuals with a tool in every third, every fifth not verified, even ones installing two parts."""
    pos = F.col("pos")
    own = raw_steps(spark, d).select(F.col("doc_id").alias("proc_id"), (pos - 1).alias("idx"), F.concat("text", F.lit(" <i>&")).alias("text"), "page", torque_nm(F.col("text")).alias("torque_nm"), F.when(pos % 3 == 0, "a 'C' wrench").alias("tool"), (pos % 5 > 0).alias("verified"), F.when(pos % 2 == 0, F.array(F.lit("frame"), "part")).otherwise(F.array().cast("array<string>")).alias("installs"))
    return own.withColumn("warning", F.when(F.contains("text", F.lit("WARNING")), "WARNING: old > new"))


def _list(spark: SparkSession, d: str) -> DataFrame:
    return viewer.step_list(_steps(spark, d)).withColumn("tags", F.array_join("tags", "|"))


def _detail(spark: SparkSession, d: str) -> DataFrame:
    steps = stored(_steps(spark, d), "detailed", "proc_id")
    parts = steps.select("proc_id", F.explode("installs").alias("part_id")).where("part_id LIKE 'cold %'").distinct().withColumn("name", F.upper("part_id"))
    return viewer.step_detail(steps, parts).withColumn("tags", F.array_join("tags", "|"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Procedures of manuals in which lines of red parts that are numbered 1 are notes."""
    steps = raw_steps(spark, d)
    note = (F.col("number") == 1) & F.col("part").startswith("red ")
    return procedures.procedures(steps.withColumn("text", F.when(note, F.concat(F.lit("1. Refer to the table of the "), "part")).otherwise(F.col("text"))))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 64).alias("doc_id"), F.when(F.col("l_discount") > 0.02, F.month("l_shipdate")).alias("page"))
    return pages.cited(spans)


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    named = F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, ".PDF").when(F.col("s_suppkey") % 3 == 1, ".pdf.exe"))
    return table(spark, d, "supplier").select("s_suppkey", pages.is_pdf_name(named).alias("accepted"))


QUERIES = {"step_list": _list, "step_detail": _detail, "procedures_notes": _notes, "cited_pages": _cited, "upload_guard": _uploads}

_BODY = "text || ' &lt;i&gt;&amp;' AS body"
_RUNS = "marked AS (SELECT *, lag(number) OVER w AS a, lag(page) OVER w AS b FROM raw WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), runs AS (SELECT *, CAST(sum(CASE WHEN a IS NULL THEN 0 WHEN number <= a OR number - a > 8 OR page - b > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS run FROM marked)"
ORACLE_SQL = {
    "step_list": f"WITH {RAW} SELECT doc_id AS proc_id, pos - 1 AS idx, printf('%02d', pos) AS num, {_BODY}, {_T} || ' N\u00b7m|' || CASE WHEN pos % 3 = 0 THEN 'a &#39;C&#39; wrench|' ELSE '' END || CASE WHEN pos % 5 > 0 THEN 'p.' || page ELSE 'inferred' END AS tags FROM raw",
    "step_detail": f"WITH {RAW} SELECT doc_id AS proc_id, pos - 1 AS idx, pos || ' / ' || count(*) OVER (PARTITION BY doc_id) AS counter, {_BODY}, CASE WHEN pos % 2 = 0 THEN 'frame|' || CASE WHEN part LIKE 'cold %' THEN upper(part) ELSE part END || '|' ELSE '' END || CASE WHEN pos % 5 > 0 THEN 'verified \u00b7 page ' || page ELSE 'not found in source' END AS tags, CASE WHEN contains(text, 'WARNING') THEN 'WARNING: old &gt; new' END AS warning FROM raw",
    "procedures_notes": f"WITH {RAW}, {_RUNS}, n AS (SELECT doc_id, run, count(*) AS n_steps, count(*) FILTER (WHERE NOT (number = 1 AND part LIKE 'red %')) AS n_torque, min(page) AS first_page, arg_min(number = 1 AND part LIKE 'red %', pos) AS note FROM runs GROUP BY doc_id, run) SELECT doc_id, run, n_steps, n_torque, first_page FROM n WHERE NOT note AND (n_steps >= 4 OR (n_steps >= 2 AND n_torque > 0))",
    "cited_pages": "SELECT DISTINCT l_orderkey // 64 AS doc_id, month(l_shipdate) AS page FROM lineitem WHERE l_discount > 0.02",
    "upload_guard": "SELECT s_suppkey, s_suppkey % 3 = 0 AS accepted FROM supplier",
}
