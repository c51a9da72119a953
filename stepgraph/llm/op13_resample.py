"""Resampling towards a target's distribution: weights from hashed features, exact selection by radix digits.

Features of texts (runs of 1 to 2 words) fall into BUCKETS buckets. A bucket's gain is the logarithm of how much more
often the target has it than the source; a document's weight is the mean gain of its features, looked up in one array.
Gumbel noise from a hash of the id makes the k highest scores a weighted draw without replacement. The k-th highest
(score, doc_id) is found by distributed radix selection: a histogram of the keys' highest digit tells which digit the
k-th key has, the next pass looks at keys of that digit only, and so on. Only drawn rows are sorted, by ranges, and
ranked from the ranges' row counts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read, stored

BUCKETS = 10_000
SCALE = 1000
LEAST_WORDS = 20  # of a document that may be drawn
PERCENT = 25  # of those, drawn
SEED = 7
DIGIT = 16  # bits of a radix digit: a pass brings at most 65,536 counts to the driver
IN_PARTITION = (1 << 33) - 1  # part of monotonically_increasing_id that counts rows of a partition

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def buckets_of(text: bytes) -> tuple[int, list[int]]:
    """Number of words, and the bucket of each feature."""
    words = _WORD.findall(text.translate(_LOWER))
    one = [crc32(w) for w in words]
    return len(words), [c % BUCKETS for c in one] + [crc32(b" " + w, c) % BUCKETS for w, c in zip(words[1:], one, strict=False)]


def histogram(texts: DataFrame, text: str = "text") -> list[int]:
    """How many features of all texts fall into each bucket: added up in each task, then over tasks."""
    bounded_batches(texts.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in it:
            for t in batch.column(0):
                if t.is_valid:
                    total += np.bincount(buckets_of(t.as_buffer().to_pybytes())[1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = [0] * BUCKETS
    for r in texts.select(F.col(text).cast("string").cast("binary")).mapInArrow(batches, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int], scale: int = SCALE) -> list[int]:
    """A bucket's gain: floor(scale * ln) of its smoothed share in the target over that in the source."""
    all_source, all_target = sum(source), sum(target)
    return [math.floor(scale * math.log((t + 1) * (all_source + len(source)) / ((s + 1) * (all_target + len(target))))) for s, t in zip(source, target, strict=True)]


def noise(key: object, seed: int = SEED, scale: int = SCALE) -> int:
    """floor of scaled Gumbel noise, from a hash of the key as text; a null key counts as 'null'."""
    h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id (long), n_words, n_features, weight, score of docs. A null or empty text has no features and weight 0, equal rows
    have equal scores, a null id is scored as such; ids are integers. Other columns are not read."""
    bounded_batches(docs.sparkSession)
    table = np.array(gain, np.int64)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0).to_pylist()
            rows = []
            for i, t in zip(ids, batch.column(1), strict=True):
                n_words, found = buckets_of(t.as_buffer().to_pybytes()) if t.is_valid else (0, [])
                weight = int(table[found].sum()) // len(found) if found else 0
                rows.append((n_words, len(found), weight, weight + noise(i, seed)))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_words", "n_features", "weight", "score"])

    ids = docs.select(F.col(key).cast("long"), F.col(text).cast("string").cast("binary"))
    return ids.mapInArrow(batches, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def digits() -> list[Column]:
    """Of the composite key, the highest first: score falling, then doc_id rising, nulls last; each below 2 ** DIGIT."""
    sign = F.lit(-(1 << 63)).cast("long")
    falling, rising = F.bitwise_not("score").bitwiseXOR(sign), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").bitwiseXOR(sign)
    part = lambda c, k: F.shiftrightunsigned(c, 64 - DIGIT * (k + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long"))
    many = range(64 // DIGIT)
    return [*[part(falling, k) for k in many], F.col("doc_id").isNull().cast("long"), *[part(rising, k) for k in many]]


def threshold(rows: DataFrame, k: int) -> tuple[list[int], int]:
    """The first digits of the k-th key of rows (score, doc_id), and how many rows with smaller digits there are.

    Digits end early where all rows that share them are among the first k. k is 1 at least and no more than the rows.
    """
    prefix: list[int] = []
    below, own = 0, rows
    for digit in digits():
        counts = sorted((r.d, r.n) for r in own.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect())
        for d, n in counts:
            if below + n >= k:
                break
            below += n
        prefix.append(d)
        if below + n == k:
            break
        own = own.where(digit == d)
    return prefix, below


def up_to(prefix: list[int]) -> Column:
    """Whether a key's first digits are those or smaller."""
    out = F.lit(True)
    for digit, d in reversed(list(zip(digits(), prefix, strict=False))):
        out = (digit < d) | ((digit == d) & out)
    return out


def drawn(rows: DataFrame, k: int) -> DataFrame:
    """rows (stored; doc_id, score and more) with rank: 1, 2, 3... of the k first by score falling, then doc_id, then further
    columns; null for the others. Rows that are equal in all columns may swap ranks."""
    if k <= 0:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    prefix, _ = threshold(rows, k)
    chosen = up_to(prefix)
    more = [c for c in rows.columns if c not in ("score", "doc_id")]
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), *[F.asc(c) for c in more]]
    # equal rows, however many, are dealt over several ranges by a number of their own
    numbered = rows.where(chosen).withColumn("_n", F.monotonically_increasing_id())
    placed = numbered.repartitionByRange(*order, "_n").sortWithinPartitions(*order, "_n").drop("_n").withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed, "resampled")
    part = F.shiftrightunsigned("_at", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, start = [], 0
    for p, n in sizes:
        starts.append((p, start))
        start += n
    before = rows.sparkSession.createDataFrame(starts, "_part long, _start long")  # one row a range
    ranked = placed.join(F.broadcast(before), part == F.col("_part")).withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND(F.lit(IN_PARTITION)) + 1)
    ranked = ranked.select(*rows.columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return ranked.unionByName(rows.where(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_features, weight, score, rank (null if not drawn), drawn towards target (text).

    Of the N documents with at least least_words words, floor(percent * N / 100) are drawn. Empty tables and targets give
    weights of the smoothed shares; a draw of none gives null ranks.
    """
    found = stored(scored(docs, gains(histogram(docs), histogram(target)), seed), "scores")
    fit = found.where(F.col("n_words") >= least_words)
    ranked = drawn(fit, percent * fit.count() // 100)
    rest = found.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents drawn towards the texts of benchmark."""
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def plain(docs: list[tuple[int | None, str | None]], target: list[str | None]) -> list[tuple]:
    """doc_id, n_features, weight, score, rank by one loop, for tests."""
    import zlib
    from collections import Counter

    def features(text: str | None) -> tuple[int, list[int]]:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        runs = [" ".join(words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for i, n, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[1:4]))
    k = 25 * len(fit) // 100
    out = [(r[0], *r[2:], n if n <= k else None) for n, r in enumerate(fit, 1)]
    return out + [(r[0], *r[2:], None) for r in rows if r[1] < 20]
