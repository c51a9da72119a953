"""Benchmark decontamination with spaced seeds.

Windows of eight words are hashed under fixed masks that ignore some of the positions, on both sides (items of fewer
words under masks of their own length); equal hashes
join documents with benchmark items, and each hit is verified by comparing all words around it at that alignment,
so substituted words are tolerated. Positions are exploded and hashed inside whole-stage code and probed against
the benchmark's seeds, then hits against the texts again; either is broadcast if its measured size is within
MOST_BROADCAST, else the join shuffles.
Only column functions and joins are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

# Masks over SPAN words; 1 counts, 0 is ignored.
SQL_MASKS = ("11011010", "10110011", "11100101", "10011110")  # the SQL's; they lose some items of 8, 10 and 11 words
MASKS = (*SQL_MASKS, "00101111")  # for 8 to 13 words, any substitutions that SHARE allows leave one of these whole
SPAN = 8
SPACELESS = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
WINDOW = 13  # words of an overlap
SHARE = 0.8  # of a window's words that must be equal
MOST_BROADCAST = 32 << 20  # bytes of benchmark seeds, or of hits
BLOCK = 128  # window starts of a text that are taken together


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashes(text: Column, by_letter: bool = False) -> Column:
    """Of each word; by_letter: letters of scripts without spaces are words of their own."""
    return F.transform(words(F.regexp_replace(text, SPACELESS, " $1 ") if by_letter else text), lambda w: F.xxhash64(w))


def short_masks(n: int) -> tuple[str, ...]:
    """For items of n < SPAN words: one for each word that SHARE lets differ, else one that counts all."""
    return tuple("1" * k + "0" + "1" * (n - 1 - k) for k in range(n)) if n - 1 >= n * SHARE - 1e-9 else ("1" * n,)


def seeds_at(h: Column, i: Column, masks: tuple[str, ...]) -> Column:
    """The masks' hashes of the window that starts at i (from 0). Words outside of the text add nothing to a hash."""
    each = [F.xxhash64(F.lit(m), *[F.get(h, i + k) for k, c in enumerate(m) if c == "1"]) for m in masks]
    return F.array(*each)


def windows(df: DataFrame, masks: tuple[str, ...], over: bool = False) -> DataFrame:
    """df (row and array h) -> row, i, seed: each window's start and mask's hash. over: ignored words may lie outside.

    A text comes as blocks of BLOCK window starts with the words that these reach, so that a row holds a block's words
    and not the whole text's, however long that is.
    """
    before = max(m.index("1") for m in masks) if over else 0
    reach = max(len(m) for m in masks)
    last = F.size("h") - F.lit(min(m.rindex("1") + 1 if over else len(m) for m in masks))
    blocks = F.when(last >= -before, F.sequence(F.lit(-before), last, F.lit(BLOCK)))
    at = df.select("row", "h", F.explode(blocks).alias("s"), last.alias("last")).withColumn("off", F.greatest("s", F.lit(0)))
    at = at.select("row", "s", "last", "off", F.slice("h", F.col("off") + 1, F.lit(BLOCK + reach + before)).alias("h"))
    each = at.select("row", "off", "h", F.explode(F.sequence(F.col("s"), F.least(F.col("s") + BLOCK - 1, "last"))).alias("i"))
    return each.select("row", "i", F.explode(seeds_at(F.col("h"), F.col("i") - F.col("off"), masks)).alias("seed"))


def checked(rows: DataFrame) -> DataFrame:
    """A stored table of whole numbers, to be broadcast if its measured size is within MOST_BROADCAST."""
    return F.broadcast(rows) if rows.count() * 32 <= MOST_BROADCAST else rows


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, item_id, n_equal, start for each document and benchmark item that overlap.

    A document and an item overlap if, at some alignment that a seed proposes, WINDOW neighbouring words of the item
    (all, if it has fewer) have SHARE or more equal words in the document. n_equal is the most equal words of one
    alignment over the whole item, start the first word of such an alignment (from 0; negative if the item's start
    is cut off). For items with letters of a script without spaces, each such letter is a word, on both sides. Null
    and empty texts overlap with nothing; rows with the same key are pooled; repeated items count once for each
    item_id. Rows with a null key or item_id come with null.
    """
    by_letter = F.col("text").rlike(SPACELESS)
    out = found_in(docs, benchmark.where(~by_letter), key, False)
    letters = benchmark.where(by_letter)
    if letters.isEmpty():
        return out
    both = out.unionByName(found_in(docs, letters, key, True))
    top = F.min(F.struct((-F.col("n_equal")).alias("less"), "start"))
    return both.groupBy(key, "item_id").agg(top.alias("top")).select(key, "item_id", (-F.col("top.less")).alias("n_equal"), F.col("top.start").alias("start"))


def found_in(docs: DataFrame, benchmark: DataFrame, key: str, by_letter: bool) -> DataFrame:
    """overlaps() with one way to take words."""
    items = benchmark.select("item_id", hashes(F.col("text"), by_letter).alias("h")).withColumn("row", F.xxhash64("item_id", F.col("item_id").isNull(), "h")).dropDuplicates(["row"])
    lengths = sorted(r["n"] for r in items.select(F.size("h").alias("n")).where(f"n > 0 AND n < {SPAN}").distinct().collect())
    windowed = windows(items, MASKS)
    for n in lengths:
        windowed = windowed.unionByName(windows(items.where(F.size("h") == n), short_masks(n)))
    masks = MASKS + tuple(m for n in lengths for m in short_masks(n))
    seeds = checked(stored(windowed.select("seed", F.col("row").alias("item_row"), F.col("i").alias("q")).distinct(), "seeds"))
    texts = docs.select(F.col(key).alias("key"), hashes(F.col("text"), by_letter).alias("h")).withColumn("row", F.xxhash64("key", F.col("key").isNull(), "h"))
    spots = windows(texts, masks, over=True)
    hits = stored(spots.join(seeds, "seed").select("row", "item_row", (F.col("i") - F.col("q")).alias("start")).distinct(), "hits")
    # the texts and items that were hit, with all their words; equal rows under one key are one row
    held = checked(hits)
    both = texts.join(held, "row").join(items.select(F.col("row").alias("item_row"), "item_id", F.col("h").alias("item")), "item_row")
    # the document's words at this alignment; get() is null outside of the text
    aligned = F.transform(F.sequence(F.lit(0), F.size("item") - 1), lambda j: F.coalesce((F.col("start") + j >= 0) & (F.get("h", F.greatest(F.col("start") + j, F.lit(0))) == F.get("item", j)), F.lit(False)))
    once = both.select("key", "item_id", "start", aligned.alias("equal"))
    width = F.least(F.lit(WINDOW), F.size("equal"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("equal") - width + 1), lambda j: F.size(F.filter(F.slice("equal", j, width), lambda x: x))))
    sure = once.where(best >= F.ceil(width * F.lit(SHARE) - 1e-9)).select("key", "item_id", "start", F.size(F.filter("equal", lambda x: x)).cast("long").alias("n_equal"))
    top = F.min(F.struct((-F.col("n_equal")).alias("less"), "start"))
    return sure.groupBy("key", "item_id").agg(top.alias("top")).select(F.col("key").alias(key), "item_id", (-F.col("top.less")).alias("n_equal"), F.col("top.start").cast("long").alias("start"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all of benchmark: doc_id, item_id, n_equal, start."""
    return overlaps(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


def _seed_sql(array: str) -> str:
    return ", ".join("concat_ws(' ', '" + str(n) + "', " + ", ".join(f"{array}[i + {k + 1}]" for k, c in enumerate(m) if c == "1") + ")" for n, m in enumerate(SQL_MASKS))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS h FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS h FROM benchmark),
dw AS (SELECT doc_id, h, unnest(range(0, len(h) - {SPAN - 1})) AS i FROM d WHERE len(h) >= {SPAN}),
bw AS (SELECT item_id, h, unnest(range(0, len(h) - {SPAN - 1})) AS i FROM b WHERE len(h) >= {SPAN}),
ds AS (SELECT doc_id, i, unnest([{_seed_sql('h')}]) AS seed FROM dw),
bs AS (SELECT item_id, i, unnest([{_seed_sql('h')}]) AS seed FROM bw),
hits AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.i - bs.i AS start FROM ds JOIN bs ON ds.seed = bs.seed),
eq AS (SELECT t.doc_id, t.item_id, t.start, j, t.start + j >= 0 AND coalesce(d.h[t.start + j + 1] = b.h[j + 1], false) AS same, len(b.h) AS n
  FROM hits t JOIN d ON t.doc_id = d.doc_id JOIN b ON t.item_id = b.item_id, unnest(range(0, len(b.h))) AS u(j)),
win AS (SELECT doc_id, item_id, start, j, n, sum(same::INT) OVER (PARTITION BY doc_id, item_id, start ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k,
  sum(same::INT) OVER (PARTITION BY doc_id, item_id, start) AS all_equal FROM eq),
sure AS (SELECT doc_id, item_id, start, any_value(all_equal) AS n_equal FROM win WHERE k >= ceil(least({WINDOW}, n) * {SHARE} - 1e-9) GROUP BY doc_id, item_id, start),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, start) AS r FROM sure)
SELECT doc_id, item_id, CAST(n_equal AS BIGINT) AS n_equal, CAST(start AS BIGINT) AS start FROM ranked WHERE r = 1
"""
