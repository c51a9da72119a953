"""Tables written once to the folder that driver and executors share, where a plan is read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset on a local master a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext.master.startswith("local"):
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return where.rstrip("/")


#: A compressed column file holds up to so many times its bytes as rows: millions of dictionary-coded ids fit in a few 100 KB.
COMPRESSED = 100


def planned(spark: SparkSession) -> None:
    """Session settings for tables that grow. Spark takes tables for as large as their rows, not as their files, when it picks
    the side of a join that the driver gathers (a side that turns out to be small when it runs is still sent to all; a larger
    factor that is set stays), and rows that lie together by document are joined there on more columns without a shuffle."""
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) < COMPRESSED:
        spark.conf.set(name, COMPRESSED)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", False)


_written: list[tuple[str, str | None]] = []


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table: its plan is worked out once and a lost executor costs a reread. With by, rows lie together by that
    column in the files (buckets), so what is later joined or grouped by it and more columns isn't sent again."""
    spark = df.sparkSession
    planned(spark)
    if by is not None:
        return stored_as_laid(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by), name, by)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((path, None))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_as_laid(df: DataFrame, name: str, by: str) -> DataFrame:
    """stored() with by, of rows that lie together by that column already (a window or join by it comes last), so they are
    not sent once more. Rows that lie otherwise are stored right too, in more and smaller files."""
    spark = df.sparkSession
    planned(spark)
    own = f"{name}-{uuid.uuid4().hex}"
    path, called = f"{shared_folder(spark)}/{own}", own.replace("-", "_")
    _written.append((path, called))
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(called)
    return spark.table(called)


def dropped(spark: SparkSession) -> int:
    """Deletes the tables stored so far and tells how many there were; for the end of a run, when no result reads them."""
    n = len(_written)
    while _written:
        where, called = _written.pop()
        if called:
            spark.sql(f"DROP TABLE IF EXISTS {called}")
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
