"""Toxicity: a support vector machine on a subsequence string kernel, with Nystroem landmarks.

The kernel of two words is the inner product of their letter triples in order, not necessarily adjacent, each
occurrence weighing DECAY to the power of the span that it takes in its word (SPAN letters at most); so a gap or an
inserted character lowers the likeness but does not end it. Landmarks are words of the training sentences; a word's
Nystroem features are its kernels with them times the inverse root of theirs, and a linear machine is trained on
these. As kernel, features and machine are all linear in a word's triples, a trained machine folds into one weight
for each triple, which is looked up at every position of every whole text.

A run of marks within a word is one gap, however long. Neighbouring pieces of one or two letters, parted by spaces or
marks, are also looked at as one word, so letters that stand apart are read together.

Labels are those of whole documents: a sentence of a toxic document need not be toxic. So training takes turns: the
words that weigh most in each toxic document are its positive examples, words of other documents are negative ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, bounded_batches, lowered, pieces, read, word_hashes, words_of
from .op5_quality import held_out, labelled

#: a-z, five for the last bytes of other letters, one for a word's beginning, and one for all else, which is a gap only.
LETTERS, BEGIN, GAP = 33, 31, 32
SPAN, DECAY = 6, 0.7
LANDMARKS, ROUNDS, MOST_WORDS = 128, 3, 12_000
LEVELS = (-0.5, 0.0, 0.5)  # words above each are counted
TOXIC = 0.3

_LETTER = np.full(256, GAP, np.int32)
_LETTER[97:123] = np.arange(26)
_LETTER[128:192] = 26 + np.arange(64) % 5
_MARK = re.compile(rb"\xc2[\x80-\xbf]|[\xe2\xe3]\x80[\x80-\xbf]")  # Latin-1, general and CJK punctuation
_MARKS = re.compile(rb"([^a-z\x80-\xbf\x20\x09-\x0d])[^a-z\x80-\xbf\x20\x09-\x0d]+")
JOINED = (8, 16)  # letters of the parts, overlapping by half, that longer runs of short words are looked at in
_STEPS = [(i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]  # places of a triple's second and third letter


def triples(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, triple, weight) of all words of lower-case bytes, each after a mark of its beginning, for each pair of gaps."""
    size = end - start + 1
    word = np.repeat(np.arange(len(start)), size)
    first = np.cumsum(size) - size
    at = np.arange(len(word)) - np.repeat(first, size) + np.repeat(start, size) - 1
    code = _LETTER[data[np.maximum(at, 0)]]
    code[first] = BEGIN
    left = np.repeat(end, size) - at  # letters from here to the word's end
    for i, j in _STEPS:
        ok = np.flatnonzero(left > j)
        if len(ok):
            a, b, c = code[ok], code[ok + i], code[ok + j]
            real = (a < GAP) & (b < GAP) & (c < GAP)
            ok = ok[real]
            yield word[ok], ((a[real] * LETTERS + b[real]) * LETTERS + c[real]), DECAY ** (j + 1)


def compact(text: bytes) -> bytes:
    """Lower-case bytes with each run of marks as one byte."""
    return _MARKS.sub(rb"\1", _MARK.sub(b"-", text))


def compacted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """compact() of each text of lower-case bytes."""
    data = data.copy()
    after, second = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    after[:-1], second[:-2] = data[1:], data[2:]
    two = np.flatnonzero((data == 0xC2) & (after >= 128) & (after < 192))
    three = np.flatnonzero(((data == 0xE2) | (data == 0xE3)) & (after == 0x80) & (second >= 128) & (second < 192))
    for at in (two, two + 1, three, three + 1, three + 2):
        data[at] = 45
    mark = (_LETTER[data] == GAP) & ~_SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(mark[1:] & mark[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row) of runs of pieces of one or two letters, their letters as one word; long runs in parts.

    Pieces are parted by spaces and marks alike; a letter's first byte is no mark.
    """
    letter = _LETTER[data] < BEGIN
    ink = letter | (data >= 192)
    # words_of() on texts with a space for every mark
    start, end, row = words_of(np.where(ink, data, np.uint8(32)), offsets)
    until = np.concatenate([[0], np.cumsum(letter)])
    size = until[end] - until[start]
    short = size <= 2
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | ~short[1:] | ~short[:-1]
    run = np.cumsum(new) - 1
    at = np.flatnonzero(letter)
    word = np.searchsorted(start, at, "right") - 1
    at, word = at[short[word]], word[short[word]]
    ids, first, length = np.unique(run[word], return_index=True, return_counts=True)
    n_words = np.bincount(run, short & (size > 0))[ids] if len(ids) else np.zeros(0)
    fine = (length >= 3) & (n_words >= 2)
    first, length, of = first[fine], length[fine], row[np.flatnonzero(new)][ids[fine]]
    whole = length <= JOINED[-1]
    starts, sizes, rows = [first[whole]], [length[whole]], [of[whole]]
    for part in JOINED:
        long = length > part
        k = -(-(length[long] - part) // (part // 2)) + 1
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        starts.append(np.repeat(first[long], k) + np.minimum(step * (part // 2), np.repeat(length[long] - part, k)))
        sizes.append(np.full(k.sum(), part))
        rows.append(np.repeat(of[long], k))
    begin = np.concatenate(starts)
    return data[at], begin, begin + np.concatenate(sizes), np.concatenate(rows)


def explicit(words: list[bytes]) -> np.ndarray:
    """The words' scaled vectors over all triples; a word that has none is a zero vector.

    The scale is the root of the occurrences' squared weights, as in Machine.different: a word's own kernel, but for
    triples that it holds more than once.
    """
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    out, norm = np.zeros((len(words), LETTERS**3), np.float32), np.zeros(len(words))
    for word, triple, weight in triples(data, ends - [len(w) for w in words], ends):
        np.add.at(out, (word, triple), weight)
        norm += np.bincount(word, minlength=len(words)) * weight * weight
    return out / np.sqrt(np.maximum(norm, 1e-9))[:, None].astype(np.float32)


@dataclass
class Machine:
    """weights: of each triple; bias; fit: logistic weights of 1 and of what texts() gives."""

    weights: np.ndarray
    bias: float
    fit: np.ndarray

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Decision values of words; each different word is worked out once."""
        if not len(start):
            return np.zeros(0)
        _, first, back = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        return self.different(data, start[first], end[first])[back]

    def different(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(start)
        value, norm = np.zeros(n), np.zeros(n)
        for word, triple, weight in triples(data, start, end):
            value += np.bincount(word, weight * self.weights[triple], n)
            norm += np.bincount(word, minlength=n) * weight * weight
        return value / np.sqrt(np.maximum(norm, 1e-9)) + self.bias

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text: its largest value (-1 without words), logs of the words above each level and of all words."""
        rows = len(offsets) - 1
        data, offsets = compacted(lowered(data), offsets)
        start, end, row = words_of(data, offsets)
        n_words = np.log1p(np.bincount(row, minlength=rows))
        apart = joined(data, offsets)
        value = np.clip(np.concatenate([self.words(data, start, end), self.words(*apart[:3])]), -3, 3)
        row = np.concatenate([row, apart[3]])
        most = np.full(rows, -1.0)
        np.maximum.at(most, row, value)
        counts = [np.log1p(np.bincount(row[value > at], minlength=rows)) for at in LEVELS]
        return np.stack([most, *counts, n_words], 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.fit[0] + self.texts(data, offsets) @ self.fit[1:], -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the least squared hinge, by Newton steps on the rows within the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        inside = y * (x1 @ w) < 1
        xs = x1[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + cost * xs.T @ x1[inside], cost * xs.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x1 = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x1.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + 0.1 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x1.T @ (y - p) - 0.1 * w), -5, 5)
    return w


def fitted(texts: list[bytes], y: np.ndarray) -> Machine:
    """The machine of labelled texts. No texts or one class only: every text scores the (smoothed) rate of label 1."""
    rate = float((y.sum() + 1) / (len(y) + 2))
    flat = Machine(np.zeros(LETTERS**3), -1.0, np.array([np.log(rate / (1 - rate)), *[0.0] * (len(LEVELS) + 2)]))
    if not len(y) or y.min() == y.max():
        return flat
    # toxic documents that hold each word, and all documents; copies of a text count once
    # Words are held once; what only one document has, and that no toxic one, is dropped before counting goes on.
    once = {t: v for t, v in zip(texts, y, strict=True)}
    n_docs, n_toxic = Counter(), Counter()
    for text, toxic in once.items():
        bag = {w for w in compact(text.lower()).split() if 3 <= len(w) <= 40}
        n_docs.update(bag)
        if toxic:
            n_toxic.update(bag)
    counts = {w: (n_toxic.get(w, 0), k) for w, k in n_docs.items() if k > 1 or w in n_toxic}
    del n_docs
    held = {w: w for w in counts}
    bags = [({held[w] for w in compact(text.lower()).split() if w in held} if v else frozenset(), v) for text, v in once.items()]
    share = sum(v for _, v in bags) / len(bags)
    excess = {w: (c[0] - c[1] * share) / np.sqrt(c[1] * share + 1) for w, c in counts.items()}
    by_excess = sorted((w for w in excess if counts[w][0] >= 3), key=lambda w: (-excess[w], w))
    suspects = [w for w in by_excess[: LANDMARKS // 2] if excess[w] > 2]
    clean = sorted((w for w in excess if excess[w] <= 0.5), key=lambda w: (-counts[w][1], w))
    if not suspects or not clean:
        return flat
    landmarks = [*suspects, *clean[:: max(1, 2 * len(clean) // LANDMARKS)][: LANDMARKS // 2]]
    z = explicit(landmarks)
    value, vectors = np.linalg.eigh((z @ z.T).astype(float))
    root = vectors / np.sqrt(np.maximum(value, 1e-3)) @ vectors.T
    fold = z.T.astype(float) @ root  # from triples to Nystroem features

    negatives = clean[:MOST_WORDS]
    common = np.array([min(20.0, counts[w][1]) / 4 for w in negatives])
    seen = sorted(set().union(*[bag for bag, toxic in bags if toxic]) & excess.keys())
    data, ends = np.frombuffer(b"".join(seen), np.uint8), np.cumsum([len(w) for w in seen])
    worth, least = excess, 2.0
    for _ in range(ROUNDS):
        chosen: dict[bytes, int] = {}
        for bag, toxic in bags:
            some = [w for w in bag if toxic and excess.get(w, 0) > 0.5 and worth[w] > least]
            for w in sorted(some, key=lambda w: (-worth[w], w))[:3]:
                chosen[w] = chosen.get(w, 0) + 1
        positives = sorted(chosen, key=lambda w: (-chosen[w], w))[:MOST_WORDS]
        if not positives:
            break
        rows = positives + negatives
        x = np.vstack([explicit(rows[k : k + 250]) @ fold for k in range(0, len(rows), 250)])
        sign = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        weight = np.concatenate([[min(20.0, chosen[w]) for w in positives], common])
        w, b = _svm(x, sign, weight)
        machine = Machine(fold @ w, b, flat.fit)
        worth, least = dict(zip(seen, machine.different(data, ends - [len(v) for v in seen], ends), strict=True)), -0.5
    else:
        x = machine.texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *[len(t) for t in texts]]))
        machine.fit = _logistic(x, y)
        return machine
    return flat


def train(docs: DataFrame, labels: DataFrame, most: int = 3000) -> Machine:
    """From `most` labelled documents at most; their texts are what the driver holds."""
    rows = labelled(docs, labels, "toxic", most).select("text", "y").toPandas()
    texts = [(t or "").encode() for t in rows["text"]]
    order = sorted(range(len(texts)), key=lambda k: (texts[k], rows["y"][k]))  # the order of arrival counts for nothing
    return fitted([texts[k] for k in order], np.array([rows["y"][k] for k in order], float))


def scored(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of each row. A null text counts as empty; repeated rows give repeated scores; other
    columns are never read."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, data, offsets in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(machine.score(data, offsets))], ["key", "score"])

    return docs.select(key, text).mapInArrow(batches, f"key {kind}, score double").withColumnRenamed("key", key)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document: doc_id, held_out, score, predicted."""
    docs = read(spark, sf_dir, "documents")
    scores = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
