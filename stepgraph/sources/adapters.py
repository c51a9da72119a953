"""Procedure-shaped rows from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import planned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    planned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_steps(spark: SparkSession, sf_dir: str, number: str = "l_linenumber", orders: int = 64) -> DataFrame:
    """doc_id, pos, page, number, part, text: so many neighbouring orders as a manual, a line as a numbered step."""
    columns = ("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_orderkey", "l_quantity", "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(*columns).join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    order = W.partitionBy("doc_id").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_orderkey", "l_quantity")
    rows = rows.select(F.floor(F.col("l_orderkey") / orders).alias("doc_id"), *columns, "p_name").withColumn("pos", F.row_number().over(order).cast("long"))
    # texts are written where a manual's lines have come together, so they are not sent
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit(". Fit the "), "p_name", F.lit(" and tighten to "), F.col("l_quantity").cast("int").cast("string"), F.lit(" N.m."), F.when(F.col("l_returnflag") == "R", F.lit(" WARNING: do not reuse the old washer.")).otherwise(F.lit("")))
    page = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return rows.select("doc_id", "pos", page.cast("int").alias("page"), F.expr(number).cast("int").alias("number"), F.col("p_name").alias("part"), text.alias("text"))


def manual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, text: 64 neighbouring orders as a manual, an order as a page of numbered steps that wrap."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    washer = F.when(F.col("l_returnflag") == "R", F.lit(" WARNING: do not reuse the old washer.")).otherwise(F.lit(""))
    heading = F.when(F.col("l_linenumber") == 3, F.lit("\nTorque reference")).otherwise(F.lit(""))
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(". Fit the "), "p_name", F.lit(" onto the frame and tighten\nto "), F.col("l_quantity").cast("int").cast("string"), F.lit(" N.m."), washer, heading)
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    pages = rows.withColumn("line", line).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("held"))
    return pages.select(F.floor(F.col("l_orderkey") / 64).alias("doc_id"), F.col("l_orderkey").alias("page"), F.array_join("held.line", "\n").alias("text"))


#: The steps that those pages hold.
PAGE_STEPS_SQL = """lines AS (SELECT l_orderkey // 64 AS doc_id, l_orderkey AS page, l_linenumber AS number, p_name AS part,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 AS ord,
  'Fit the ' || p_name || ' onto the frame and tighten to ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' N.m.' AS action,
  CASE WHEN l_returnflag = 'R' THEN ' WARNING: do not reuse the old washer.' ELSE '' END AS washer
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

RAW_SQL = """raw AS (SELECT l_orderkey // 64 AS doc_id, row_number() OVER (PARTITION BY l_orderkey // 64 ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_orderkey, l_quantity) AS pos,
  CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS page, CAST({number} AS INTEGER) AS number, p_name AS part,
  CAST(l_linenumber AS VARCHAR) || '. Fit the ' || p_name || ' and tighten to ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' N.m.' || CASE WHEN l_returnflag = 'R' THEN ' WARNING: do not reuse the old washer.' ELSE '' END AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
