"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature (or one pair of features) after another and fits a shallow tree of a few bins to
the current gradient; the trees of a feature add up to one lookup table, those of a pair to a two-way table. A score
is the sum of a document's bins in these tables. The model is fitted on a bounded sample of labelled rows
(MOST_ROWS); features and scores are computed for every whole text, vectorised over Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_batches, lowered, pieces, read, word_hashes, words_of

MOST_ROWS = 20_000  # labelled rows that a model is fitted on, those with the smallest hashes
ACCEPT = 0.7  # a score from which a document is accepted
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 8, 120, 60, 6, 0.15

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digits", "marks", "bangs", "bars", "marked_ends", "repeats", "repeats_near", "newlines", "one_letter", "capitalised", "distinct")

_ASCII_MARK = np.zeros(256, bool)
_ASCII_MARK[[ord(c) for c in "#$%&*+/<=>@\\^_{|}~"]] = True


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    rows = len(offsets) - 1
    start, end, row = words_of(data, offsets)
    size = np.diff(offsets)
    count = np.bincount(row, minlength=rows)
    of_text, of_words = 1 / np.maximum(size, 1), 1 / np.maximum(count, 1)
    upper = (data >= 65) & (data <= 90)
    mark = _ASCII_MARK[data]
    key = word_hashes(lowered(data), start, end)
    last, first = data[end - 1], data[start]
    longer = np.bincount(row, weights=(end - start), minlength=rows)

    def share(hit: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=hit, minlength=rows) * of_words

    def again(step: int) -> np.ndarray:
        same = np.zeros(len(key), bool)
        if len(key) > step:
            same[step:] = (key[step:] == key[:-step]) & (row[step:] == row[:-step])
        return same

    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[fresh], minlength=rows)
    columns = (
        np.log1p(size), np.log1p(count), longer * of_words, _per_row(upper, offsets) * of_text, _per_row((data >= 48) & (data <= 57), offsets) * of_text,
        _per_row(mark, offsets) * of_text, _per_row(data == 33, offsets) * of_text, share((end - start == 1) & (first == 124)), share(mark[end - 1] | (last == 33)),
        share(again(1)), share(again(2) | again(3) | again(4)), _per_row(data == 10, offsets) * of_words, share(end - start == 1), share((first >= 65) & (first <= 90)), distinct * of_words,
    )
    return np.stack(columns, 1) if rows else np.zeros((0, len(FEATURES)))


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int) -> np.ndarray:
    """Values of the bins in a tree of so many leaves over neighbouring bins, best split first."""
    cuts = [(0, len(gradient))]

    def best(a: int, b: int) -> tuple[float, int]:
        g, h = np.cumsum(gradient[a:b]), np.cumsum(hessian[a:b])
        if b - a < 2:
            return 0.0, a
        left, right = g[:-1] ** 2 / (h[:-1] + 1), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
        gain = left + right - g[-1] ** 2 / (h[-1] + 1)
        gain[(h[:-1] < 1) | (h[-1] - h[:-1] < 1)] = 0
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    while len(cuts) < leaves:
        found = [(*best(a, b), n) for n, (a, b) in enumerate(cuts)]
        gain, at, n = max(found)
        if gain <= 1e-9:
            break
        a, b = cuts[n]
        cuts[n : n + 1] = [(a, at), (at, b)]
    out = np.zeros(len(gradient))
    for a, b in cuts:
        out[a:b] = gradient[a:b].sum() / (hessian[a:b].sum() + 1)
    return out


@dataclass
class Additive:
    """prior and tables: per feature its bins' edges and values; per pair of features a two-way table."""

    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, f], "right")]
        wide = {f: np.searchsorted(self.pair_edges[f], x[:, f], "right") for a, b, _ in self.pairs for f in (a, b)}
        for a, b, table in self.pairs:
            z += table[wide[a], wide[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of features x and labels y (0 or 1). No rows give 0.5 for every text, one class only its rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Additive(prior=float(np.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return model
    quantile = lambda v, n: np.unique(np.quantile(v, np.arange(1, n) / n))
    model.edges = [quantile(x[:, f], BINS) for f in range(x.shape[1])]
    model.pair_edges = [quantile(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.prior)
    for _ in range(ROUNDS):
        for f, at in enumerate(bins):
            p = 1 / (1 + np.exp(-z))
            n = len(model.tables[f])
            step = RATE * _tree(np.bincount(at, y - p, n), np.bincount(at, p * (1 - p), n), 3)
            model.tables[f] += step
            z += step[at]
    wide = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    p = 1 / (1 + np.exp(-z))
    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            at = wide[a] * PAIR_BINS + wide[b]
            g, h = np.bincount(at, y - p, PAIR_BINS**2), np.bincount(at, p * (1 - p), PAIR_BINS**2)
            gains.append((float((g**2 / (h + 1)).sum()), a, b))
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for a, b in chosen]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            p = 1 / (1 + np.exp(-z))
            at = wide[a] * PAIR_BINS + wide[b]
            g = np.bincount(at, y - p, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
            h = np.bincount(at, p * (1 - p), PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
            # a shallow tree: rows split in two, then each part's columns
            side = _tree(g.sum(1), h.sum(1), 2)
            step = np.zeros_like(table)
            for value in np.unique(side):
                step[side == value] = RATE * _tree(g[side == value].sum(0), h[side == value].sum(0), 2)
            table += step
            z += step[wide[a], wide[b]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, text and y of at most `most` labels whose documents are not held out; rows with a null id or label are
    left out. A repeated id comes with each of its texts."""
    sure = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    sample = sure.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y", "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> Additive:
    """Fitted on features alone: of texts that share an id and a label, the one with the least features counts."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, data, offsets in pieces(batch.column(0)):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)[a:b], batch.column(2)[a:b]], ["x", "y", "doc_id"])

    found = labelled(docs, labels, "quality").mapInArrow(batches, f"x array<double>, y int, doc_id {kind}")
    rows = found.groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort([*x.T, rows["y"].to_numpy()]) if len(rows) else np.zeros(0, int)  # the order of arrival counts for nothing
    return fitted(x[order], rows["y"].to_numpy()[order].astype(float))


def with_score(docs: DataFrame, model: Additive, name: str, text: str = "text") -> DataFrame:
    """docs with all their columns and the score (0 to 1) as the last one; a column of its name is replaced (letter case
    as the session has it), but the text's own name is an error. Names of columns must have no dots. A null text counts as empty;
    repeated rows give repeated scores; other columns are never read; an empty table stays empty."""
    if name.lower() == text.lower():
        raise ValueError(f"the score can't take the place of the text {text}")
    bounded_batches(docs.sparkSession)
    docs = docs.drop(name)
    where = docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, data, offsets in pieces(batch.column(where)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(features(data, offsets)))], [*part.schema.names, name])

    return docs.mapInArrow(batches, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def scored(docs: DataFrame, model: Additive, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of each row. A null text counts as empty; repeated rows give repeated scores; ids,
    labels and other columns are never read."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, data, offsets in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(model.score(features(data, offsets)))], ["key", "score"])

    return docs.select(key, text).mapInArrow(batches, f"key {kind}, score double").withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: Additive, least: float = ACCEPT) -> DataFrame:
    """The rows of docs, with all their columns, whose score is `least` or more. A null text is scored as an empty one
    and stays null; repeated rows stay or go together; an empty table stays empty."""
    bounded_batches(docs.sparkSession)
    where = docs.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, data, offsets in pieces(batch.column(where)):
                yield batch.slice(a, b - a).filter(pa.array(model.score(features(data, offsets)) >= least))

    return docs.mapInArrow(batches, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document: doc_id, held_out, score, predicted."""
    docs = read(spark, sf_dir, "documents")
    scores = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
