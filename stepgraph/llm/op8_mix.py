"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key, -ln(u) / weight, from a hash of its id (so reruns agree) and its quality
weight. A source's target in words is met by complete epochs first; the rest goes to the documents with the
smallest keys until the budget is full. The order within a source is never made in one task: keys are dealt into
buckets, the buckets' sums give each bucket what comes before it, and only within a bucket are rows sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, stored

WEIGHTS = (5, 2, 1)  # of sources by code point, null last, repeating
MOST = 3  # times that any source is repeated at most
BUCKETS = 1024  # of a source's keys; a bucket is what one task sorts
JUNK = "!*#%$&|"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of characters that are no junk marks, 0.1 at least; 0.1 for an empty or null text."""
    kept = F.length(F.translate(text, JUNK, "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.coalesce(kept, F.lit(0.0)), F.lit(0.1))


def uniform(key: Column, seed: int = 0) -> Column:
    """In (0, 1), from the first 13 hexadecimal digits of an MD5 of the key as text; a null key counts as 'null'."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1) / F.lit(float((1 << 52) + 1))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> with target (double): all sizes shared by weight, none above most times its source.

    The fixed point of resharing the excess has a closed form: in order of most * size / weight, sources are full
    until the first whose share of what is left stays within its limit; that share's rate holds for all after it.
    One row for each source; empty input gives no rows. Sizes of 0 give targets of 0.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_full", F.col("source_size") * most).withColumn("_rate", F.col("_full") / F.col("_w"))
    order = W.orderBy("_rate", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    before = F.coalesce(F.sum("_full").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    shared = ranked.withColumn("_share", (total - before) / left)
    rate = F.min(F.when(F.col("_share") <= F.col("_rate"), F.struct("_rate", "source", "_share"))).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    found = shared.withColumn("_found", rate)
    share = F.coalesce(F.col("_found._share"), F.lit(float("inf"))) * F.col("_w")
    return found.select("source", "source_size", F.least(share, F.col("_full").cast("double")).alias("target"))


def mixed(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, buckets: int = BUCKETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """items (doc_id, source, size, key: the sampling key) -> doc_id, source, size, source_size, target, taken, and the
    columns of items named in carry.

    taken counts words: each complete epoch takes the whole document, the last, partial one takes documents in order
    of (key, doc_id, size) until round(target) words are full; the document on the edge gives its first words only.
    So a source takes its target to the word. A null source is a source of its own; size 0 takes 0; repeated rows
    count as documents of their own, and equal ones may swap their results. Empty input gives an empty result.
    """
    held = items.select("doc_id", "source", "size", "key", *carry).withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int"))
    held = stored(held, "mix")
    sums = held.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sizes = sums.groupBy("source").agg(F.sum("n").alias("source_size"))
    place = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(place), F.lit(0)))
    goals = targets(sizes, weights, most).withColumnRenamed("source", "_s")
    starts = starts.join(goals, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "start", "source_size", "target")
    joined = held.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") + 0.5) - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(rest - before, F.lit(0)))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *carry)


def items_of(docs: DataFrame, seed: int = 0, weight: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, source, text) as mixed() takes them. weight: of a document's quality, above 0; quality_weight() of its
    text if none is given."""
    weight = quality_weight(F.col("text")) if weight is None else weight
    return docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("key"), *carry)


def with_copies(mix: DataFrame) -> DataFrame:
    """Rows of mixed() that carry text, as a writer needs them: copies (how many times the whole text is taken), rest (the
    first words of a copy that is cut, with the white space between them; null if none is) and text (null without a whole
    copy). Null and empty texts give 0 copies and no rest."""
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    rest = F.when(part > 0, F.array_join(F.slice(words, F.lit(1), part.cast("int")), ""))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    return mix.withColumns({"copies": copies, "rest": rest}).withColumn("text", F.when(F.col("copies") > 0, F.col("text")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, size, source_size, target, taken."""
    return mixed(items_of(read(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH items AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  -ln((CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 1.0::DOUBLE) / {float((1 << 52) + 1)!r}::DOUBLE)
   / greatest(coalesce(length(translate(text, '{JUNK}', ''))::DOUBLE / greatest(length(text), 1), 0.0), 0.1::DOUBLE) AS key FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM items GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sizes),
rates AS (SELECT *, source_size * 3 AS top, (source_size * 3)::DOUBLE / w AS rate FROM ranked),
shares AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY rate, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER (ORDER BY rate, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share FROM rates),
rated AS (SELECT share FROM shares WHERE share <= rate ORDER BY rate, source NULLS LAST LIMIT 1),
goals AS (SELECT source, source_size, least(coalesce((SELECT share FROM rated), 'inf'::DOUBLE) * w, top::DOUBLE) AS target FROM shares),
placed AS (SELECT i.doc_id, i.size, g.source_size, g.target,
  coalesce(sum(i.size) OVER (PARTITION BY i.source ORDER BY i.key, i.doc_id, i.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs
  FROM items i JOIN goals g ON i.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + least(size, greatest(floor(target + 0.5) - epochs * source_size - before, 0)) AS BIGINT) AS taken FROM placed
"""
