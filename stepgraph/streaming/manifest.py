"""A library's manifest kept from a stream of entries: a snapshot for each batch, the newest whole one counts.

entries: id, document (null for a single procedure), ingested_at and more columns. A document's entries are those of its
newest ingestion, whatever order ingestions come in, so a batch that runs twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEPT = 2  # snapshots


def newest(entries: DataFrame) -> DataFrame:
    """Of each document (or single procedure) the entries of its newest ingestion, equal rows once. Rows without a time
    give way to any with one; rows without an id and document are a document of their own."""
    key = F.coalesce("document", "id")
    last = F.max("ingested_at").over(W.partitionBy(key))
    return entries.distinct().withColumn("_last", last).where(F.col("ingested_at").eqNullSafe(F.col("_last"))).drop("_last")


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole snapshots of folder, rising: those that a writer has finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def read_snapshot(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The manifest as the newest whole snapshot has it, newest entries first; empty before the first batch."""
    have = snapshots(spark, folder)
    if not have:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/v={have[-1]}").orderBy(F.desc("ingested_at"), F.desc("id"))


def committed(batch: DataFrame, number: int, folder: str) -> None:
    """Writes snapshot `number`: the one before it with the batch's entries taken in. Its finish mark is the pointer, so
    readers see the old manifest or the new one, and a batch that is run again writes the same snapshot again."""
    spark = batch.sparkSession
    before = [n for n in snapshots(spark, folder) if n < number]
    old = spark.read.schema(batch.schema).parquet(f"{folder}/v={before[-1]}") if before else batch.limit(0)
    newest(old.unionByName(batch)).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{folder}/v={number}")
    for n in before[: -(KEPT - 1) or None]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={n}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(entries: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over a streaming DataFrame of entries that takes in all there is and ends; started again with the
    same checkpoint it goes on where it ended."""
    return entries.writeStream.foreachBatch(lambda batch, n: committed(batch, n, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
