"""Reading order of positioned words: running heads dropped, two columns told apart, lines rebuilt.

words has the columns of KEY, ord (the order on the page), text, x0, x1, top, bottom, and the page's width and height.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("page",)
ZONE, MIN_GAP = (0.30, 0.70), 0.02
HEADER, FOOTER = 0.075, 0.925  # of the height; the body lies strictly between
LINE = 3.0  # points that words of a line may differ by
SPANNING = 0.40  # of the width; wider words belong to no column
MIN_WORDS, MIN_SIDE = 20, 0.20


def body(words: DataFrame) -> DataFrame:
    """Words within the body band; none of a page without height."""
    return words.where((F.col("height") > 0) & (F.col("top") > HEADER * F.col("height")) & (F.col("bottom") < FOOTER * F.col("height")))


def gutter(words: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """by, lo, hi of the widest gap of merged word intervals (x0, x1, width) with its centre in the zone; the leftmost on a tie."""
    order = W.partitionBy(*by).orderBy("x0", "x1").rowsBetween(W.unboundedPreceding, -1)
    gaps = words.withColumn("lo", F.max("x1").over(order)).withColumn("hi", F.col("x0")).where("hi > lo")
    centre = (F.col("lo") + F.col("hi")) / 2
    wide = gaps.where((F.col("hi") - F.col("lo") >= MIN_GAP * F.col("width")) & (centre > ZONE[0] * F.col("width")) & (centre < ZONE[1] * F.col("width")))
    return wide.groupBy(*by).agg(F.min(F.struct((F.col("lo") - F.col("hi")).alias("less"), "lo", "hi")).alias("g")).select(*by, "g.lo", "g.hi")


def columns(words: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """by, centre of the gutter of pages of body words that are set in two columns: MIN_WORDS narrow words or more, and
    MIN_SIDE of them at least on either side."""
    narrow = words.where((F.col("width") > 0) & (F.col("x1") - F.col("x0") < SPANNING * F.col("width")))
    middle = gutter(narrow, by).select(*by, ((F.col("lo") + F.col("hi")) / 2).alias("centre"))
    sides = narrow.join(middle, list(by)).groupBy(*by).agg(F.first("centre").alias("centre"), F.count("*").alias("n"), F.count_if(F.col("x1") <= F.col("centre")).alias("left"))
    return sides.where((F.col("n") >= MIN_WORDS) & (F.least("left", F.col("n") - F.col("left")) >= MIN_SIDE * F.col("n"))).select(*by, "centre")


def lines(words: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """by, region (0 across, 1 left, 2 right; 0 for all of a page of one column), line, text: words of the body in
    reading order within a line, equal places in the order they came."""
    held = body(words)
    found = held.join(columns(held, by), list(by), "left")
    across = F.col("centre").isNull() | (F.col("x1") - F.col("x0") >= SPANNING * F.col("width")) | ((F.col("x0") < F.col("centre")) & (F.col("centre") < F.col("x1")))
    region = F.when(across, 0).when(F.col("x1") <= F.col("centre"), 1).otherwise(2)
    placed = found.withColumn("region", region).withColumn("line", (F.col("top") / LINE).cast("long"))
    return placed.groupBy(*by, "region", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", "text"))), lambda w: w["text"]), " ").alias("text"))


def page_text(words: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """by, layout_text: lines across first, then the left column, then the right. A page without body words has no row,
    so its text from elsewhere stays: coalesce(layout_text, text) after a left join."""
    held = lines(words, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("region", "line", "text"))).alias("held"))
    return held.select(*by, F.array_join(F.col("held.text"), "\n").alias("layout_text"))
