"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct word shingles; equal sets are one node. A node's signature is SYMBOLS b-bit minhashes
(16 bits each). Two sets of likeness SIMILAR or more differ in at most ERRORS symbols, but for a chance of about one
in a million at exactly that likeness. The signature is split into CHUNKS chunks, so by pigeonhole two signatures
within ERRORS differ in at most one symbol of some chunk: each node enumerates, for each chunk, the chunk with each one
symbol left out, and nodes that meet at such a key are candidates. That finds all pairs within the distance.

Candidates are confirmed on full sets. No bucket emits all its pairs: in each round, a bucket that still holds several
components has one pivot, of its largest component the node that meets most others, and each other node is held against
one pivot of its buckets, so a round makes no more pairs than there are nodes. When rounds join little more, the members
of buckets that still hold several components are paired across components only, and only where they share one of
their rarest shingles early enough: an exact filter that passages which many documents share don't get through.

Before sets are compared, a parity sketch rules pairs out: each shingle flips one of SKETCH bits, so two sketches differ
in no more bits than the sets in shingles, and alike sets differ in at most a ninth of both sizes. That filter is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U, bounded_batches, lowered, mix, pieces, read, stored, word_hashes, words_of
from .graph import components

SIMILAR = 80  # per cent
SYMBOLS, ERRORS, CHUNKS = 64, 29, 15  # ERRORS // CHUNKS is 1: one error in some chunk at most
_EDGES = np.linspace(0, SYMBOLS, CHUNKS + 1).round().astype(int)
_SEED = mix(np.arange(1, 2 * SYMBOLS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEED[:SYMBOLS], _SEED[SYMBOLS:] | U(1)
SKETCH = 512  # bits
WORTH = 0.05  # rounds go on while more than this share of their pairs are links
SLICE = 1 << 15  # hashes that are minhashed at once


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct shingles of k words as sorted hashes; with fewer words all of them are one shingle."""
    start, end, row = words_of(data, offsets)
    word = word_hashes(lowered(data), start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    many = max(0, len(word) - k + 1)
    run = np.zeros(many, U)
    for j in range(k):
        run = run * U(0xD6E8FEB86659FD93) + word[j : j + many]
    run = mix(run)
    out = []
    for n, at in zip(count, first, strict=True):
        if n >= k:
            out.append(np.unique(run[at : at + n - k + 1]))
        elif n:
            h = U(n)
            with np.errstate(over="ignore"):
                for w in word[at : at + n]:
                    h = h * U(0xD6E8FEB86659FD93) + w
            out.append(mix(np.array([h], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SYMBOLS 16-bit minhashes of each set; zeros for an empty one."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    full = [n for n, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        stop, size = at, 0
        while stop < len(full) and (stop == at or size + len(sets[full[stop]]) <= SLICE):
            size += len(sets[full[stop]])
            stop += 1
        part = [sets[n] for n in full[at:stop]]
        flat = np.concatenate(part)
        begin = np.cumsum([0, *[len(s) for s in part[:-1]]])
        for j in range(SYMBOLS):
            least = np.minimum.reduceat((flat ^ _XOR[j]) * _MUL[j], begin)
            out[full[at:stop], j] = (mix(least) >> U(48)).astype(np.uint16)
        at = stop
    return out


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row_id (of id and text), n_shingles, node (hash of the set), signature, sketch."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, data, offsets in pieces(batch.column(2)):
                sets = shingle_sets(data, offsets, k)
                each = np.array([np.bitwise_xor.reduce(mix(s + U(7))) for s in sets], U)
                node = mix(each + np.array([len(s) for s in sets], U) * U(3))
                signature = pa.array([x.tobytes() for x in signatures(sets)], pa.binary())
                bits = np.array([np.bincount((s & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1 for s in sets], np.uint8)
                sketch = pa.array(list(np.packbits(bits, axis=1).view(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(node.view(np.int64)), signature, sketch], ["doc_id", "row_id", "n_shingles", "node", "signature", "sketch"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_id"), "text").mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_id long, n_shingles long, node long, signature binary, sketch array<long>")


def keyed(nodes: DataFrame) -> DataFrame:
    """key, node: for each chunk and each place in it, a hash of the chunk without that place."""
    keys = []
    for c in range(CHUNKS):
        chunk = range(_EDGES[c], _EDGES[c + 1])
        keys += [F.xxhash64(F.lit(place), *[F.substring("signature", 2 * j + 1, 2) for j in chunk if j != place]) for place in chunk]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "node")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and its set (array of hashes) for wanted (row_id, node)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, data, offsets in pieces(batch.column(1), 1 << 20):
                sets = [s.view(np.int64) for s in shingle_sets(data, offsets, k)]
                ends = np.cumsum([0, *[len(s) for s in sets]])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["node", "held"])

    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_id"), "text").join(wanted, "row_id").dropDuplicates(["node"])
    return texts.select("node", "text").mapInArrow(batches, "node long, held array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Those pairs (a, b) whose sets are alike enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= similar * (F.size("x") + F.size("y") - shared)).select("a", "b")


def in_components(buckets: DataFrame, found: DataFrame | None) -> DataFrame:
    """buckets (key, node, ...) with component and size (its nodes); a node that found (node, component) lacks is its
    own component."""
    if found is None:
        return buckets.select("*", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    sized = found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component")
    own = buckets.join(sized, "node", "left")
    return own.select(*buckets.columns, F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))


def pivot_pairs(placed: DataFrame) -> DataFrame:
    """Distinct pairs (a > b) of placed (key, node, met, component, size): each node of a bucket that holds another
    component's pivot against one such pivot. A bucket's pivot is a node of its largest component, the one met most."""
    order = F.struct(-F.col("size"), -F.col("met"), "component", "node")
    pivots = placed.groupBy("key").agg(F.min(order).alias("p"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key", "p")
    asked = placed.join(pivots, "key").where("component <> p.component").groupBy("node").agg(F.min("p").alias("p"))
    return asked.select(F.greatest("node", "p.node").alias("a"), F.least("node", "p.node").alias("b")).distinct()


def can_be_alike(m: str, n: str, x: str, y: str, similar: int) -> Column:
    """False if sizes m and n or sketches x and y tell that two sets aren't alike."""
    sizes = 100 * F.least(m, n) >= similar * F.greatest(m, n)
    apart = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    return sizes & ((100 + similar) * apart <= (100 - similar) * (F.col(m) + F.col(n)))


def looked_at(pairs: DataFrame, nodes: DataFrame, similar: int) -> DataFrame:
    """pairs (a, b) with maybe: whether they can be alike."""
    first = nodes.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x"))
    both = pairs.join(first, "a").join(nodes.select(F.col("node").alias("b"), "n", F.col("sketch").alias("y")), "b")
    return both.select("a", "b", can_be_alike("m", "n", "x", "y", similar).alias("maybe"))


def near_duplicates(docs: DataFrame, k: int = 4, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text); also row_id (of id and text) and
    group, which tells components apart where ids are null.

    Sets are linked if 100 * intersection >= similar * union; a component's id is its smallest doc_id. A null text or
    one without words has an empty set, is linked with nothing and is its own component. Rows with equal sets are
    linked whatever their ids, repeated rows too; a null doc_id is never a component's id unless it stands alone.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    held = stored(profiles(docs, k), "profiles")
    nodes = stored(held.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.min("row_id").alias("row_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")), "nodes")
    keys = keyed(nodes)
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    many = keys.join(shared, "key")
    met = many.groupBy("node").agg(F.sum("members").alias("met"))
    many = stored(many.select("key", "node").join(met, "node"), "buckets")
    sizes = nodes.select("node", "n", "sketch")
    sets = stored(full_sets(docs, nodes.join(many.select("node").distinct(), "node", "left_semi").select("row_id", "node"), k), "sets")

    tried, links, found = None, None, None
    while True:
        pairs = pivot_pairs(in_components(many, found))
        pairs = stored(looked_at(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), sizes, similar), "pairs")
        more = stored(confirmed(pairs.where("maybe").select("a", "b"), sets, similar), "links")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        links = more if links is None else links.unionByName(more)
        n, asked = more.count(), pairs.count()
        if n:
            found = stored(components(links), "components")
        if n <= WORTH * asked:
            break

    placed = in_components(many, found)
    open_ = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    placed = placed.join(open_, "key", "left_semi").select("node", "component").distinct().join(sizes, "node")
    across = rare_partners(stored(placed, "open"), sets, similar).join(tried, ["a", "b"], "left_anti")
    found = components(stored(links.unionByName(confirmed(across, sets, similar)), "links"))

    lows = nodes.select("node", "low").join(found, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    named = lows.join(lows.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("node", "component_id", F.col("component").alias("group"))
    out = held.drop("signature", "sketch").join(named, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "row_id", F.when(F.col("n_shingles") > 0, F.col("group")).otherwise(F.col("row_id")).alias("group"), "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def rare_partners(placed: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs (a > b) of nodes of different components that can be alike: placed is (node, component, n, sketch).

    In any one order of all shingles, two alike sets share one of their first n - ceil(n * similar / 100) + 1. The order
    is from rare to frequent, so what many documents share (a passage, a licence) comes last and proposes no pairs.
    Nothing before the first shingle that two sets share is shared, so from its ranks on both must still hold as many
    shingles as alike sets have in common. Rows of a shingle's largest component are never joined with each other.
    """
    shingles = placed.join(sets, "node").select("node", F.explode("held").alias("shingle"))
    often = shingles.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    known = shingles.join(often, "shingle").join(placed, "node")
    of_node = W.partitionBy("node")
    single = F.col("n") - F.count("*").over(of_node)  # shingles that no other node has come first
    rank = single + F.row_number().over(of_node.orderBy("df", "shingle"))
    first = known.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similar / 100) + 1)
    first = stored(first.select("shingle", "node", "component", "n", "sketch", (F.col("n") - F.col("rank") + 1).alias("rest")), "rare")
    largest = first.groupBy("shingle", "component").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.count("*").alias("kinds")).where("kinds > 1")
    left = first.join(largest, "shingle").where("component <> largest").select("shingle", F.col("node").alias("a"), F.col("component").alias("p"), F.col("n").alias("m"), F.col("rest").alias("rest_a"), F.col("sketch").alias("x"))
    right = first.select("shingle", F.col("node").alias("b"), F.col("component").alias("q"), "n", F.col("rest").alias("rest_b"), F.col("sketch").alias("y"))
    late = (100 + similar) * F.least("rest_a", "rest_b") >= similar * (F.col("m") + F.col("n"))
    pairs = left.join(right, "shingle").where((F.col("p") != F.col("q")) & late & can_be_alike("m", "n", "x", "y", similar))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def plain(rows: list[tuple[int, str | None]], k: int = 4, similar: int = SIMILAR) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id) by holding every document against every other; for tests."""
    import re

    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * min(len(s), len(t)) >= similar * max(len(s), len(t)):
                shared = len(s & t)
                if 100 * shared >= similar * (len(s) + len(t) - shared):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}
