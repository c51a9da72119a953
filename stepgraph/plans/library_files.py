"""Queries over files that Spark derives from the tables: folders of manuals, a manifest from a stream, boxes of quotes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import extraction, pages
from ..sources.adapters import table
from ..sources.folder import read_manuals, with_broken_bytes, write_manuals
from ..sources.tables import shared_folder
from ..streaming import manifest


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _extract(spark: SparkSession, d: str) -> DataFrame:
    """Documents as manuals of up to 50 pages; every 17th page has a broken byte."""
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("doc_id"), (F.col("doc_id") % 50).alias("page"), with_broken_bytes(F.coalesce("text", F.lit("")), F.col("doc_id") % 17 == 0).alias("text"))
    where = _folder(spark, "manuals")
    write_manuals(docs, where)
    found = read_manuals(spark, where, r"doc_id=([^/]+)/")
    none = F.lit(None)
    return pages.cascaded(found.withColumns({"ocr_text": none.cast("string"), "ocr_confidence": none.cast("double"), "vision_text": none.cast("string")})).select("doc_id", "page", "text", "tier", "error")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """Orders as entries that come in files, one a batch."""
    entries = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("m"), (F.col("o_custkey") % 97).cast("string"))).alias("document"), F.col("o_orderdate").alias("ingested_at"), (F.col("o_orderstatus") != "F").alias("ok"))
    files, folder = _folder(spark, "entries"), _folder(spark, "manifest")
    entries.repartition(3, "id").write.parquet(files)
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(files)
    query = manifest.kept(stream, folder, f"{folder}-checkpoint")
    query.awaitTermination()
    return manifest.read_snapshot(spark, folder, entries.schema)


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of 16 orders as the words of a page, and quotes of three words that follow each other, every seventh in
    another order."""
    order = W.partitionBy("page").orderBy("ord")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount").alias("key")
    lines = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 16).alias("page"), key, F.year("l_shipdate").alias("year"))
    lines = lines.withColumn("ord", F.row_number().over(W.partitionBy("page").orderBy("key")).cast("long"))  # figures follow the shuffle, so words and quotes share it
    x, y = F.col("key.l_quantity") * 10, F.col("key.l_linenumber") * 30.0
    words = lines.select(F.lit("d").alias("doc_id"), "page", "ord", F.col("year").cast("string").alias("text"), x.alias("x0"), (x + 8).alias("x1"), y.alias("top"), (y + 10).alias("bottom"))
    second, third = F.lead("text", 1).over(order), F.lead("text", 2).over(order)
    said = words.select("doc_id", "page", "ord", F.concat_ws("  ", F.concat(F.lit("("), "text", F.lit("),")), second, third).alias("straight"), F.concat_ws(" ", third, third, third, third, "text").alias("odd"), third.alias("third")).where("third IS NOT NULL AND ord % 3 = 0")
    quotes = said.select("doc_id", "page", F.when(F.col("ord") % 7 == 0, F.col("odd")).otherwise(F.col("straight")).alias("quote"))
    return extraction.boxes(quotes, words).select("page", "quote", F.array_join(F.transform("bbox", lambda x: x.cast("int").cast("string")), ",").alias("bbox"))


QUERIES = {"batch_extract": _extract, "manifest_stream": _manifest, "boxes": _boxes}

ORACLE_SQL = {
    "batch_extract": r"""WITH p AS (SELECT CAST(doc_id // 50 AS VARCHAR) AS doc, doc_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id % 50) AS page, translate(coalesce(text, ''), chr(12), ' ') AS t, doc_id % 17 = 0 AS bad FROM documents),
      l AS (SELECT doc_id, string_split(t, chr(10) || chr(10)) AS l FROM p), b AS (SELECT doc_id, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS block, generate_subscripts(l, 1) AS i FROM l),
      f AS (SELECT doc_id, block, min(i) AS i FROM b WHERE block <> '' GROUP BY ALL), own AS (SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY i) AS text FROM f GROUP BY doc_id)
      SELECT doc AS doc_id, page, CASE WHEN bad OR length(regexp_replace(t, '^\s+|\s+$', '', 'g')) <= 50 THEN '' ELSE own.text END AS text, CASE WHEN bad THEN NULL WHEN length(regexp_replace(t, '^\s+|\s+$', '', 'g')) > 50 THEN 1 ELSE 3 END AS tier, CASE WHEN bad THEN 'page is not valid UTF-8' END AS error FROM p LEFT JOIN own USING (doc_id)""",
    "manifest_stream": "WITH e AS (SELECT 'o' || o_orderkey AS id, CASE WHEN o_custkey % 5 > 0 THEN 'm' || (o_custkey % 97) END AS document, o_orderdate AS ingested_at, o_orderstatus <> 'F' AS ok FROM orders) SELECT * FROM e QUALIFY ingested_at = max(ingested_at) OVER (PARTITION BY coalesce(document, id))",
    "boxes": """WITH w AS (SELECT l_orderkey // 16 AS page, CAST(year(l_shipdate) AS VARCHAR) AS t, CAST(l_quantity * 10 AS INTEGER) AS x0, CAST(l_quantity * 10 + 8 AS INTEGER) AS x1, l_linenumber * 30 AS top, l_linenumber * 30 + 10 AS bottom,
      row_number() OVER (PARTITION BY l_orderkey // 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_discount) AS ord FROM lineitem),
      r AS (SELECT page, ord, t AS a, lead(t, 1) OVER o AS b, lead(t, 2) OVER o AS c, lead(t, 3) OVER o AS d, lead(t, 4) OVER o AS e,
        least(x0, lead(x0, 1) OVER o, lead(x0, 2) OVER o) AS x0, least(top, lead(top, 1) OVER o, lead(top, 2) OVER o) AS top, greatest(x1, lead(x1, 1) OVER o, lead(x1, 2) OVER o) AS x1, greatest(bottom, lead(bottom, 1) OVER o, lead(bottom, 2) OVER o) AS bottom,
        least(x0, lead(x0, 1) OVER o, lead(x0, 2) OVER o, lead(x0, 3) OVER o, lead(x0, 4) OVER o) AS x0l, least(top, lead(top, 1) OVER o, lead(top, 2) OVER o, lead(top, 3) OVER o, lead(top, 4) OVER o) AS topl,
        greatest(x1, lead(x1, 1) OVER o, lead(x1, 2) OVER o, lead(x1, 3) OVER o, lead(x1, 4) OVER o) AS x1l, greatest(bottom, lead(bottom, 1) OVER o, lead(bottom, 2) OVER o, lead(bottom, 3) OVER o, lead(bottom, 4) OVER o) AS bottoml FROM w WINDOW o AS (PARTITION BY page ORDER BY ord)),
      q AS (SELECT DISTINCT page, a, b, c, ord % 7 = 0 AS odd FROM r WHERE c IS NOT NULL AND ord % 3 = 0)
      SELECT q.page, '(' || q.a || '),  ' || q.b || '  ' || q.c AS quote, arg_min(r.x0 || ',' || r.top || ',' || r.x1 || ',' || r.bottom, r.ord) AS bbox FROM q JOIN r ON r.page = q.page AND r.a = q.a AND r.b = q.b AND r.c = q.c WHERE NOT odd GROUP BY ALL
      UNION ALL SELECT q.page, q.c || ' ' || q.c || ' ' || q.c || ' ' || q.c || ' ' || q.a, arg_min(r.x0l || ',' || r.topl || ',' || r.x1l || ',' || r.bottoml, r.ord) FROM (SELECT DISTINCT page, a, c FROM q WHERE odd) q LEFT JOIN r ON r.page = q.page AND r.a = q.c AND r.b = q.c AND r.c = q.c AND r.d = q.c AND r.e = q.a GROUP BY ALL""",
}
