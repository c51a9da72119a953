"""A corpus from raw documents to a mix: five stages, each written and reread before the next.

Each stage takes rows as they are: a null id or text is a row like others, repeated rows stay or go by the stage's own
rule, an empty table stays empty, and further columns of any name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgraph.llm import op4_near, op5_quality, op6_secret, op8_mix, op9_decontaminate
from stepgraph.llm.common import read, stored

LEAST_WEIGHT = 0.1  # of a document in the mix
SHINGLE = 5  # words; the near-duplicate query's contract has 4 for itself alone


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column, of a name that it lacks, that tells rows apart by id and text; and that name."""
    name = "row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = op5_quality.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return op5_quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: a row with its smallest doc_id. Texts without words are linked with nothing and all
    stay, one of rows that are equal in id and text."""
    found = op4_near.near_duplicates(docs, SHINGLE)
    own, row = numbered(docs)
    one = found.where("kept").groupBy("group").agg(F.min("row_id").alias(row)).select(row)
    return own.join(one, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    own, row = numbered(docs)
    found = op9_decontaminate.overlaps(own, read(spark, sf_dir, "benchmark"), key=row)
    return own.join(found.select(row).distinct(), row, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows where there is a text."""
    clean = op6_secret.redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, drawn by the classifier's scores as weights: doc_id, source, size, source_size, target, taken (words the mix
    takes), text, copies (of the whole text) and rest (first words of a cut copy) of each document."""
    model = op5_quality.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    own = op5_quality.with_score(docs.select("doc_id", "source", "text"), model, "weight")
    items = op8_mix.items_of(own, weight=F.greatest("weight", F.lit(LEAST_WEIGHT)), carry=("text",))
    return op8_mix.with_copies(op8_mix.mixed(items, carry=("text",)))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]

ORACLE_SQL = None  # a trained classifier has no SQL; tests/llm holds the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
