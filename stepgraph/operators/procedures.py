"""Steps to procedures: runs, dependencies and checks, each a DataFrame of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fields import torque_nm

NUMBER_GAP, PAGE_GAP = 8, 4
MIN_STEPS, MIN_WITH_TORQUE = 4, 2
TORQUE_RANGE = (0.5, 900.0)
MOST_RESTARTS = 2
# Words that open a numbered note rather than an instruction.
NOTES = ("information", "these", "this manual", "the following", "components and", "specifications", "refer to", "when ordering", "all dimensions", "the illustrations", "note that", "figures in")


def runs(steps: DataFrame) -> DataFrame:
    """steps with run: a new one where the printed number restarts or jumps, or the page does. A null number never starts one."""
    order = W.partitionBy("doc_id").orderBy("pos")
    a, b = F.lag("number").over(order), F.col("number")
    jump = (b <= a) | (b - a > NUMBER_GAP) | (F.col("page") - F.lag("page").over(order) > PAGE_GAP)
    new = F.when(a.isNull() | b.isNull(), 0).otherwise(F.coalesce(jump, F.lit(False)).cast("int"))
    marked = steps.withColumn("_new", new)
    return marked.withColumn("run", F.sum("_new").over(order).cast("long")).drop("_new")


def substantial(n_steps: Column, n_torque: Column, opening: Column) -> Column:
    """Whether a run of so many steps and torques, whose first step is opening, is a procedure and no note."""
    body = F.lower(F.regexp_replace(opening, r"^\d+\. ", ""))
    note = F.coalesce(body.rlike(rf"^(?:{'|'.join(NOTES)})"), F.lit(False))  # one search, not one for each opening
    return ((n_steps >= MIN_STEPS) | ((n_steps >= MIN_WITH_TORQUE) & (n_torque > 0))) & ~note


def procedures(steps: DataFrame) -> DataFrame:
    """doc_id, run, n_steps, n_torque, first_page of the runs that are substantial and no notes."""
    found = runs(steps).withColumn("torque", torque_nm(F.col("text")))
    each = found.groupBy("doc_id", "run").agg(F.count("*").alias("n_steps"), F.count("torque").alias("n_torque"), F.min("page").alias("first_page"), F.min_by("text", "pos").alias("opening"))
    return each.where(substantial(F.col("n_steps"), F.col("n_torque"), F.col("opening"))).drop("opening")


def first_use(steps: DataFrame) -> DataFrame:
    """doc_id, part, first_pos: where each part is installed."""
    return steps.groupBy("doc_id", "part").agg(F.min("pos").alias("first_pos"))


def depends(steps: DataFrame) -> DataFrame:
    """doc_id, pos, depends_on: a step that names an installed part depends on the step that installed it."""
    known = steps.select("doc_id", "pos", "part").withColumn("depends_on", F.min("pos").over(W.partitionBy("doc_id", "part")))
    return known.where("pos > depends_on").select("doc_id", "pos", "depends_on").distinct()


def restarts(steps: DataFrame) -> DataFrame:
    """doc_id, n_restarts, status of the single-procedure check: numbers that do not rise, nulls left out."""
    order = W.partitionBy("doc_id").orderBy("pos")
    back = steps.where("number IS NOT NULL").withColumn("back", (F.col("number") <= F.lag("number").over(order)).cast("int"))
    each = back.groupBy("doc_id").agg(F.coalesce(F.sum("back"), F.lit(0)).alias("n_restarts"))
    return each.withColumn("status", F.when(F.col("n_restarts") <= MOST_RESTARTS, "PASS").otherwise("FAIL"))


def torque_range(steps: DataFrame) -> DataFrame:
    """doc_id, n_specs, n_outside, status of the torque check; no specs pass."""
    t = torque_nm(F.col("text"))
    each = steps.withColumn("t", t).groupBy("doc_id").agg(F.count("t").alias("n_specs"), F.count(F.when(~F.col("t").between(*TORQUE_RANGE), 1)).alias("n_outside"))
    return each.withColumn("status", F.when(F.col("n_outside") == 0, "PASS").otherwise("FAIL"))


def orphans(parts: DataFrame, installs: DataFrame) -> DataFrame:
    """Declared parts (proc_id, part) that nothing installs."""
    return parts.select("proc_id", "part").distinct().join(installs.select("proc_id", "part"), ["proc_id", "part"], "left_anti")


def dangling(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References (proc_id, ref) to what is not there. Known ids are sorted, which spills, and never gathered on the driver:
    Spark doesn't count the rows that an explode makes of them, so a session's sizes and limits can't tell how many there are."""
    return refs.select("proc_id", "ref").distinct().join(known.select("proc_id", F.col("id").alias("ref")).hint("merge"), ["proc_id", "ref"], "left_anti")


def repeated_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("proc_id", "id").agg(F.count("*").alias("n")).where("n > 1")
