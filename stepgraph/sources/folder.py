"""Folders of extracted manuals: a text file a manual, a form feed after each page. One fault costs its page only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_MARK = "\f"
STEM = r"([^/]+?)(?:\.[^./]*)?$"  # of a file's path: its name without the ending
SCHEME = "^[a-z0-9]+:/*"
UNREADABLE, BROKEN = "file gives no bytes", "page is not valid UTF-8"


def read_manuals(spark: SparkSession, path: str, name: str = STEM, files: str = "*.txt") -> DataFrame:
    """doc_id, page (from 1), raw_text, error of all files under path whose names match; pages.cascaded() takes it.

    doc_id: the first group of `name` in the file's path. A page whose bytes are no UTF-8 is an empty text with an
    error, the others of its file stay; a file that cannot be read or is empty is one such row of page 1. A page mark at
    a file's end opens no page. Files are dealt to tasks by size, and any file system that Spark
    reads will do.
    """
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files)
    held = held.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(path)
    # the names as Spark lists them when it plans the read, files without bytes and those that go away later included
    listed = spark.createDataFrame([(f,) for f in held.inputFiles()], "file string").select(F.regexp_replace(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), SCHEME, "").alias("path"))
    read = held.select(F.regexp_replace("path", SCHEME, "").alias("path"), F.lit(True).alias("read"), "content")
    bytes_ = F.regexp_replace(F.decode("content", "ISO-8859-1"), f"{PAGE_MARK}$", "")  # a character a byte
    pages = listed.join(read, "path", "left").select("path", "read", F.posexplode_outer(F.split(bytes_, PAGE_MARK)).alias("k", "page_bytes"))
    text = F.encode("page_bytes", "ISO-8859-1").cast("string")
    whole = F.is_valid_utf8(text)
    error = F.when(F.col("read").isNull(), UNREADABLE).when(~whole, BROKEN)
    return pages.select(F.regexp_extract("path", name, 1).alias("doc_id"), (F.coalesce("k", F.lit(0)) + 1).alias("page"), F.when(error.isNull(), text).otherwise(F.lit("")).alias("raw_text"), error.alias("error"))


def write_manuals(pages: DataFrame, path: str) -> None:
    """pages (doc_id, page, text) as such files, a folder doc_id=... each; page marks within a text become spaces."""
    text = F.replace("text", F.lit(PAGE_MARK), F.lit(" "))
    ordered = pages.select("doc_id", "page", text.alias("text")).repartition("doc_id").sortWithinPartitions("doc_id", "page")
    ordered.select("doc_id", "text").write.partitionBy("doc_id").option("lineSep", PAGE_MARK).text(path)


def with_broken_bytes(text: Column, when: Column) -> Column:
    """text with a byte behind it that no UTF-8 has, where when holds; for tests of faults."""
    return F.when(when, F.concat(text.cast("binary"), F.lit(b"\xff")).cast("string")).otherwise(text)
