"""Phrase collocations by merged count-min sketches and one exact count of what they let through.

First pass: every task counts the cells of its n-grams (1 to MOST_WORDS words) in DEPTH rows of `width` counters and
sends each touched block of counters once; blocks are added up, and what stays is one bit a cell: at least `least` or
not. A sketch never counts too little, so no frequent n-gram is lost; what it counts too much is only let through.
Second pass: texts are read again, n-grams all of whose cells have their bit are counted exactly, as words and not as
hashes. Then candidates are scored by their weakest cut and those that a longer phrase explains are dropped.

Sizes: the bits are DEPTH * width / 8 bytes (32 MB here, whatever the input), the only thing that passes the driver and
the only broadcast. With many more n-grams than width * least / 2, the rows let nearly all through and the second pass
counts nearly all, in time linear in the input as before; give a larger width then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U, bounded_batches, lowered, mix, pieces, read, stored, word_hashes

LEAST = 30  # occurrences of a candidate
MOST_WORDS = 4
TOP = 2000  # of a language, the report's length
SCALE = 2_000_000
SHARE = 80  # of 100: a longer phrase with so many of a phrase's occurrences explains it
UNKNOWN = "und"
WIDTH = 1 << 27  # counters of a sketch's row
DEPTH = 2
BLOCK = 1 << 16  # counters of a block, which one row of a sketch's table holds
FLUSH = 6 << 20  # n-grams that a task counts together
SALTS = 8

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


class Words:
    """The words of a batch of texts: distinct ones as bytes, ids of all in order, and the piece that each stands in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = lowered(data)
        ink = ~_GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(ink & (edge[:-1] | ~np.concatenate([[False], ink[:-1]])[: len(ink)]))
        end = np.flatnonzero(ink & (edge[1:] | ~np.concatenate([ink[1:], [False]])[: len(ink)])) + 1
        self.row = np.searchsorted(offsets, start, "right") - 1
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        self.piece = breaks[start] + self.row * (len(data) + 1)
        size = end - start
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        joined = data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(joined)]).dictionary_encode()
        self.ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = words.dictionary

    def hashes(self) -> np.ndarray:
        """Of the distinct words."""
        if not len(self.distinct):
            return np.zeros(0, U)
        _, _, data, ends = next(pieces(self.distinct, 1 << 62))
        return word_hashes(data, ends[:-1], ends[1:])

    def starts(self, n: int) -> np.ndarray:
        """Positions where n words follow each other in one piece."""
        return np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :]) if len(self.piece) >= n else np.zeros(0, np.int64)


def gram_hashes(words: Words, lang: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, where n-grams start, their hashes) for n from 1; lang: a hash of each word's language."""
    own = words.hashes()[words.ids] if len(words.ids) else np.zeros(0, U)
    upto = mix(own ^ lang)
    for n in range(1, most + 1):
        at = words.starts(n)
        if n > 1:
            longer = np.zeros(len(upto), U)
            longer[at] = mix(upto[at] * U(0xD6E8FEB86659FD93) + own[at + n - 1])
            upto = longer
        yield n, at, upto[at]


def cells_of(hashes: np.ndarray, width: int, row: int) -> np.ndarray:
    """Cells of a row of the sketch."""
    return ((mix(hashes + U(0x9E3779B97F4A7C15)) if row else hashes) & U(width - 1)).astype(np.uint32)


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, np.ndarray, list[str]]]:
    """For pieces of a batch (lang, text): words, each one's language as an index and as a hash, and the languages."""
    langs = batch.column(0).fill_null(UNKNOWN).dictionary_encode()
    names = langs.dictionary.to_pylist()
    index = langs.indices.to_numpy(zero_copy_only=False)
    _, _, data, ends = next(pieces(langs.dictionary, 1 << 62)) if names else (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))
    hashed = word_hashes(data, ends[:-1], ends[1:])
    for a, b, data, offsets in pieces(batch.column(1)):
        words = Words(data, offsets)
        lang = index[a:b][words.row]
        yield words, lang, hashed[lang] if len(lang) else np.zeros(0, U), names


def sketched(texts: DataFrame, width: int, least: int, most: int) -> np.ndarray:
    """Bits (DEPTH x width / 8 bytes) of the cells that counted at least `least`, merged over all of texts (lang, text)."""
    size = "<u1" if least < 1 << 8 else "<u4"

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_held
            for row, parts in enumerate(held):
                cells = np.concatenate([np.zeros(0, np.uint32), *parts])
                parts.clear()
                if not len(cells):
                    continue
                cells.sort()
                first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
                counts = np.minimum(np.diff(np.append(first, len(cells))), least)
                cells = cells[first]
                block = cells // BLOCK
                cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                # a block's row: low bytes of its cells' places, high bytes, counts; alike bytes together, for the shuffle's compression
                low, high, many = (cells & 255).astype(np.uint8), (cells >> 8 & 255).astype(np.uint8), counts.astype(size)
                rows = [low[a:b].tobytes() + high[a:b].tobytes() + many[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(cells)), strict=True)]
                for k in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(block[cut[k : k + 512]].astype(np.int64) + row * (width // BLOCK)), pa.array(rows[k : k + 512], pa.binary())], ["block", "cells"])
            n_held = 0

        for batch in it:
            for words, _, lang, _ in texts_of(batch):
                for _, _, hashes in gram_hashes(words, lang, most):
                    for row in range(DEPTH):
                        held[row].append(cells_of(hashes, width, row))
                    n_held += len(hashes)
                if n_held >= FLUSH:
                    yield from flush()
        yield from flush()

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for batch in it:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now, total = block, np.zeros(BLOCK, np.int64)
                held = cells.as_buffer()
                n = held.size // (2 + np.dtype(size).itemsize)
                place = np.frombuffer(held, np.uint8, n) + np.frombuffer(held, np.uint8, n, n).astype(np.int64) * 256
                total[place] += np.frombuffer(held, size, n, 2 * n).astype(np.int64)  # a cell comes once in a row
        if now is not None:
            yield done()

    parts = texts.mapInArrow(count, "block bigint, cells binary").repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block bigint, bits binary")
    bits = np.zeros((DEPTH * width // BLOCK, BLOCK // 8), np.uint8)
    for r in parts.collect():  # blocks are merged side by side; as many bytes as the bits
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(-1)


def counted(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, width: int = WIDTH) -> DataFrame:
    """lang, n_words, phrase, n of all phrases of docs (lang, text) of up to `most` words with at least `least` occurrences in
    a language, exactly; and for each language a row with n_words 0 and phrase '' with the number of all its words.

    phrase: lower-case words (A-Z only) joined by one space. A null lang counts as 'und', null and empty texts hold no
    words, repeated rows count each, an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    bits = spark.sparkContext.broadcast(sketched(texts, width, least, most).tobytes())

    def passes(hashes: np.ndarray) -> np.ndarray:
        held = np.frombuffer(bits.value, np.uint8)
        keep = np.ones(len(hashes), bool)
        for row in range(DEPTH):
            cell = cells_of(hashes, width, row)
            keep &= held[row * (width // 8) + (cell >> 3)] >> (cell & 7).astype(np.uint8) & 1 == 1
        return keep

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for words, lang, hashed, names in texts_of(batch):
                kinds, totals = np.unique(lang, return_counts=True)
                yield rows_of([names[k] for k in kinds], 0, pa.array([""] * len(kinds)), totals)
                # exact ids of prefixes: pairs (id of n - 1 words, id of the next) numbered anew
                prefix, place = np.zeros(len(words.ids), np.int64), lang.astype(np.int64) * len(words.distinct) + words.ids
                prefix[:] = place
                for n, at, hashes in gram_hashes(words, hashed, most):
                    if n > 1:
                        longer = np.full(len(prefix), -1, np.int64)
                        known = at[prefix[at] >= 0]
                        longer[known] = np.unique(prefix[known] * len(words.distinct) + words.ids[known + n - 1], return_inverse=True)[1]
                        prefix = longer
                    # a phrase that passes has prefixes that pass: they occur as often or more
                    stays = passes(hashes) & (prefix[at] >= 0)
                    gone, at = at[~stays], at[stays]
                    prefix[gone] = -1
                    _, first, totals = np.unique(prefix[at], return_index=True, return_counts=True)
                    first = at[first]
                    columns = [words.distinct.take(pa.array(words.ids[first + k])).cast(pa.large_string()) for k in range(n)]
                    phrase = columns[0] if n == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))
                    yield rows_of(pa.array(names).take(pa.array(lang[first])), n, phrase, totals)

    def rows_of(lang, n: int, phrase: pa.Array, totals: np.ndarray) -> pa.RecordBatch:
        lang = lang if isinstance(lang, pa.Array) else pa.array(lang, pa.string())
        return pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(np.full(len(totals), n, np.int32)), phrase.cast(pa.string()), pa.array(totals.astype(np.int64))], ["lang", "n_words", "phrase", "n"])

    found = texts.mapInArrow(count, "lang string, n_words int, phrase string, n bigint")
    return found.groupBy("lang", "n_words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("n_words") == 0))


def exact(column: str):
    return F.col(column).cast("decimal(20,0)")


def with_counts(cuts: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """cuts with the count of the phrase in column part. One part may be in a third of all cuts, so cuts are salted and
    counts, one row a phrase, repeated for each salt. They are sorted and merged, never gathered on the driver: Spark takes
    them for as large as the compressed file and doesn't count the repeated rows."""
    side = counts.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salt = F.pmod(F.hash("phrase", "k"), F.lit(SALTS))
    return cuts.join(side.hint("merge"), (cuts.lang == side._l) & (cuts[part] == side._p) & (salt == side._s)).drop("_l", "_p", "_s")


def collocations(counts: DataFrame, top: int = TOP, share: int = SHARE) -> DataFrame:
    """counts, as counted() gives them -> lang, rank, phrase, a, l, r, n, score of the first `top` candidates of each language.

    A candidate (two words or more) cut after its k-th word has l and r, the counts of both sides, and the score
    floor(SCALE * a / (l + r)); its lowest cut counts, the first of equal ones. Dropped are candidates inside a longer
    phrase of counts with at least share/100 of their occurrences. Order: score and a falling, phrase by its bytes.
    """
    words = F.split("phrase", " ")
    many = counts.where("n_words > 1")
    cuts = many.select("lang", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.expr("slice(w, k + 1, size(w))"), " ").alias("tail"))
    ones = counts.where("n_words > 0")
    cuts = with_counts(with_counts(cuts, ones, "head", "l"), ones, "tail", "r")
    cuts = cuts.withColumn("score", F.expr(f"CAST((CAST(a AS DECIMAL(20,0)) * {SCALE}) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = many.where("n_words > 2").select("lang", F.col("n").alias("longest"), words.alias("w"), F.explode(F.expr("sequence(2, n_words - 1)")).alias("m"))
    longer = longer.select("lang", "longest", "w", "m", F.explode(F.expr("sequence(1, size(w) - m + 1)")).alias("at"))
    longer = longer.select("lang", F.expr("array_join(slice(w, at, m), ' ')").alias("phrase"), "longest").groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    # merged too: an explode's rows and a file's compression hide how many phrases there are
    kept = scored.join(longer.hint("merge"), ["lang", "phrase"], "left").where(F.col("longest").isNull() | (exact("longest") * 100 < exact("a") * share))

    # first within salts of a language, so that no task sorts a language whole
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = flat.withColumn("_s", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    some = salted.withColumn("_r", F.row_number().over(W.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("n_words = 0").select("lang", "n")
    return ranked.join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of all documents."""
    counts = stored(counted(read(spark, sf_dir, "documents")), "phrases")
    return collocations(counts)


def plain(docs: list[tuple[str | None, str | None]], least: int = LEAST, top: int = TOP) -> list[tuple]:
    """Rows of collocations(counted(docs)) by dictionaries, for tests."""
    import re
    from collections import Counter

    count: Counter = Counter()
    total: Counter = Counter()
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[UNKNOWN if lang is None else lang] += len(words)
            for n in range(1, MOST_WORDS + 1):
                for i in range(len(words) - n + 1):
                    count[UNKNOWN if lang is None else lang, tuple(words[i : i + n])] += 1
    often = {k: v for k, v in count.items() if v >= least and len(k[1]) > 1}
    out = []
    for (lang, words), a in often.items():
        inside = any(100 * f >= SHARE * a and lang == other and len(more) > len(words) and any(more[i : i + len(words)] == words for i in range(len(more))) for (other, more), f in often.items())
        if not inside:
            cut = min((SCALE * a // (count[lang, words[:k]] + count[lang, words[k:]]), k) for k in range(1, len(words)))
            out.append((lang, cut[0], a, " ".join(words), count[lang, words[: cut[1]]], count[lang, words[cut[1] :]]))
    rows = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        rows += [(lang, k, p, a, left, right, total[lang], s) for k, (_, s, a, p, left, right) in enumerate(own[:top], 1)]
    return rows


ORACLE_SQL = """
WITH pieces AS (SELECT row_number() OVER () AS id, lang, w FROM (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')), '[^ \\t]+') AS w FROM documents) WHERE len(w) > 0),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (
  SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM pieces) WHERE len(w) >= m)),
often AS (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, m, f, w, unnest(generate_series(1, m - 1)) AS k FROM often WHERE m > 1),
scored AS (SELECT c.lang, c.phrase, c.m, c.f AS a, c.k, h.f AS l, t.f AS r, CAST((2000000::HUGEINT * c.f) // (h.f + t.f) AS BIGINT) AS score,
  row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (2000000::HUGEINT * c.f) // (h.f + t.f), c.k) AS o
  FROM cuts c JOIN often h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN often t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
kept AS (SELECT * FROM scored s WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM often b WHERE b.lang = s.lang AND b.m > s.m AND 100::HUGEINT * b.f >= 80::HUGEINT * s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
