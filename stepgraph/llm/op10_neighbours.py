"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. The neighbour graph starts from blocks of nodes that share a near pivot, then iterations
join each node's neighbours, forward and backward, with each other: a node's group is its bounded sample of
neighbours with their vectors, and what is nearer than a member's farthest neighbour joins that member's list. They go
on until less than DELTA of the edges are new; edges only get nearer, so that comes. A query
starts at its own node; each round joins the nodes that it has not opened yet with their neighbours, until its list
holds nothing unopened. The graph compares inner products in a space with one more coordinate that makes all lengths
equal, so a long vector is no neighbour of all; lengths count up to that of all but the longest thousandth, so an outlier
doesn't make all others alike, and every search starts from the LONGEST vectors too. The search compares exact inner
products of the vectors as they are.

Every table is rows of (node, neighbour); groups have a bounded size (NEIGHBOURS, SAMPLE, BLOCK). The pivots are a
sample that grows with the vectors, so cells keep their size; above FLAT pivots a node looks for its own beneath its
nearest TOPS of a sample of them. Every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, stored

TOP = 20
NEIGHBOURS = 24  # of a node in the graph
SAMPLE = 24  # neighbours of each direction that an iteration joins
DELTA = 0.02  # iterations end when a smaller share of the graph's edges is new
NEAR_PIVOTS, BLOCK = 6, 512
LONGEST = 32  # vectors of the greatest length, from which each search starts beside its own node
FLAT, TOPS = 1024, 8
BEAM, OPENED = 256, 64  # of a search: nodes kept, nodes opened a round


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id and its vector as doubles, a repeated row once; null, zero and partly null or non-finite vectors are left
    out, and those of another length than most have (on a tie the longer)."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", v.alias("v"), fine.alias("fine")).where("fine").select("vec_id", "v")
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy(F.col("k").desc(), F.col("n").desc()).first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).distinct()


def best_edges(edges: DataFrame, most: int) -> DataFrame:
    """node, to, score, new of edges (the same columns): the best `most` (by score, then id) of each node. Copies count once,
    with the best score, as new only if all are. Rows come sorted by node and a node's are cut as they come, so none is held whole."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool)]
        for batch in it:
            node, to, score, new = (np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, batch.columns, strict=True))
            if not len(node):
                continue
            order = np.lexsort([to, node])
            node, to, score, new = node[order], to[order], score[order], new[order]
            one = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (to[1:] != to[:-1])]))
            node, to, score, new = node[one], to[one], np.maximum.reduceat(score, one), np.logical_and.reduceat(new, one)
            order = np.lexsort([to, -score, node])
            node, to, score, new = node[order], to[order], score[order], new[order]
            fine = np.arange(len(node)) - np.searchsorted(node, node) < most
            end = np.searchsorted(node, batch.column(0)[-1].as_py())  # the last node's rows may go on
            yield edge_rows(*(c[:end][fine[:end]] for c in (node, to, score, new)))
            kept = [c[end:][fine[end:]] for c in (node, to, score, new)]
        yield edge_rows(*kept)

    return edges.select("node", "to", "score", "new").repartition("node").sortWithinPartitions("node").mapInArrow(cut, EDGE)


EDGE = "node long, to long, score float, new boolean"


def edge_rows(node: np.ndarray, to: np.ndarray, score: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(to), pa.array(score.astype(np.float32)), pa.array(new)], ["node", "to", "score", "new"])


def whole_groups(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows, sorted by their first column, in batches that part no group, and where each group starts. Groups are bounded."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        end = int(np.searchsorted(key, key[-1]))
        if held and held[0].column(0)[0].as_py() != key[-1]:
            yield _joined([*held, batch.slice(0, end)])
            held = []
        elif end:
            yield _joined([batch.slice(0, end)])
        held.append(batch.slice(end))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    key = whole.column(0).to_numpy()
    return whole, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def pivots_of(count: int) -> int:
    """One for half a block of nodes."""
    return max(1, count // (BLOCK // 2))


class Cells:
    """The NEAR_PIVOTS nearest pivots of nodes (half of them, if there are fewer)."""

    def __init__(self, pivots: np.ndarray, flat: int = FLAT):
        self.pivots, self.near, self.tops = pivots, min(NEAR_PIVOTS, -(-len(pivots) // 2)), None
        if len(pivots) > flat:
            head = np.arange(0, len(pivots), int(np.sqrt(len(pivots))))
            self.tops = pivots[head]
            owner = np.concatenate([np.argmax(pivots[k : k + 4096] @ self.tops.T, axis=1) for k in range(0, len(pivots), 4096)])
            self.under = [np.union1d(np.flatnonzero(owner == t), head[t : t + 1]) for t in range(len(head))]

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of rows of x."""
        if self.tops is None:
            best = np.argpartition(-(x @ self.pivots.T), self.near - 1, axis=1)[:, : self.near]
            return np.repeat(np.arange(len(x)), self.near), best.ravel()
        few = min(TOPS, len(self.tops))
        open_ = np.argpartition(-(x @ self.tops.T), few - 1, axis=1)[:, :few]
        row, cell, score = [], [], []
        for t in np.unique(open_):
            rows = np.flatnonzero((open_ == t).any(axis=1))
            s = x[rows] @ self.pivots[self.under[t]].T
            k = min(self.near, s.shape[1])
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            row.append(np.repeat(rows, k))
            cell.append(self.under[t][best].ravel())
            score.append(np.take_along_axis(s, best, 1).ravel())
        row, cell, score = np.concatenate(row), np.concatenate(cell), np.concatenate(score)
        once = np.unique(np.stack([row, cell]), axis=1, return_index=True)[1]
        row, cell, score = row[once], cell[once], score[once]
        order = np.lexsort([cell, -score, row])
        row, cell = row[order], cell[order]
        fine = np.arange(len(row)) - np.searchsorted(row, row) < self.near
        return row[fine], cell[fine]


def first_graph(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """node, to, score within blocks of nodes that share one of their nearest pivots."""
    of_pivots = Cells(pivots) if len(pivots) else None

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _matrix(batch.column(1))
            if len(x):
                pick, cell = of_pivots.of(x)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), batch.column(0).take(pa.array(pick)), batch.column(1).take(pa.array(pick))], ["cell", "node", "a"])

    cells = nodes.select("node", "a").mapInArrow(assign, "cell long, node long, a array<float>")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    dealt = cells.join(F.broadcast(sizes), "cell").select(F.xxhash64("cell", F.pmod(F.xxhash64("node", "cell"), F.col("blocks"))).alias("block"), "node", "a")

    def within(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, start in whole_groups(it):
            every, all_ids = _matrix(rows.column(2)), rows.column(1).to_numpy()
            for x, ids in zip(np.split(every, start[1:]), np.split(all_ids, start[1:]), strict=True):
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                k = min(NEIGHBOURS, len(ids) - 1)
                if k > 0:
                    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    yield edge_rows(np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel(), np.ones(len(ids) * k, bool))

    return best_edges(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(within, EDGE), NEIGHBOURS)


def improved(graph: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """One iteration: neighbours of neighbours, met at the node between them. new: whether graph lacks the edge."""
    farthest = graph.groupBy("node").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("score")).otherwise(F.lit(-3.0)).cast("float").alias("farthest"))
    ahead = graph.select(F.col("node").alias("mid"), F.col("to").alias("node"))
    back = graph.select(F.col("to").alias("mid"), "node")
    chance = F.xxhash64("mid", "node", F.lit(turn))
    # a node has no more than NEIGHBOURS ahead, so only those behind are sampled
    some = [x.withColumn("r", F.row_number().over(W.partitionBy("mid").orderBy(chance))).where(F.col("r") <= SAMPLE).select("mid", "node") if most > SAMPLE else x for x, most in ((ahead, NEIGHBOURS), (back, float("inf")))]
    carried = nodes.select("node", F.col("half").alias("a")).join(farthest, "node", "left")
    groups = some[0].unionByName(some[1]).join(carried, "node").select("mid", "node", F.coalesce("farthest", F.lit(-3.0).cast("float")).alias("farthest"), "a")

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in whole_groups(it):
            mid, node = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            own = np.lexsort([node, mid])  # a node that is both ahead and back comes once
            own = own[np.concatenate([[True], (mid[own][1:] != mid[own][:-1]) | (node[own][1:] != node[own][:-1])])]
            mid, node, least = mid[own], node[own], rows.column(2).to_numpy()[own]
            x = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.float16).reshape(rows.num_rows, -1)[own].astype(np.float32)
            start = np.flatnonzero(np.concatenate([[True], mid[1:] != mid[:-1]]))
            size = np.diff(np.append(start, len(mid)))
            for most in range(int(size.max()), 0, -8):  # groups of like sizes are one product of matrices
                of = np.flatnonzero((size <= most) & (size > most - 8))
                for k in range(0, len(of), 256):
                    place = start[of[k : k + 256], None] + np.arange(most)
                    held = np.arange(most) < size[of[k : k + 256], None]
                    place = np.where(held, place, 0)
                    s = np.matmul(x[place], x[place].transpose(0, 2, 1))
                    s[:, np.arange(most), np.arange(most)] = -9
                    g, i, j = np.nonzero((s > np.where(held, least[place], 9)[:, :, None]) & held[:, None, :])
                    yield edge_rows(node[place[g, i]], node[place[g, j]], s[g, i, j], np.ones(len(g), bool))

    found = groups.repartition("mid").sortWithinPartitions("mid").mapInArrow(meet, EDGE)
    return best_edges(graph.select("node", "to", "score", F.lit(False).alias("new")).unionByName(found), NEIGHBOURS)


def neighbour_graph(nodes: DataFrame, pivots: np.ndarray, delta: float = DELTA) -> DataFrame:
    """node, to, score of stored nodes (node, a: unit vector in floats, half: the same in half precision, as bytes)."""
    graph = stored(first_graph(nodes, pivots), "graph")
    turn, share = 0, 1.0
    while share > delta:
        graph = stored(improved(graph, nodes, turn), "graph")
        share = graph.agg(F.avg(F.col("new").cast("int")).alias("share")).first()["share"] or 0.0
        turn += 1
    return graph


def searched(queries: DataFrame, graph: DataFrame, nodes: DataFrame, longest: int = LONGEST) -> DataFrame:
    """query, to, score: the best BEAM nodes that a greedy search finds for each query (query, node, v)."""
    # the query's own node opens first
    ahead = graph.select(F.col("node").alias("at"), F.col("to"), F.lit(0).alias("back"))
    both = ahead.unionByName(ahead.select(F.col("to").alias("at"), F.col("at").alias("to"), F.lit(1).alias("back")))
    links = stored(top_links(both.groupBy("at", "to").agg(F.min("back").alias("back"))).groupBy("at").agg(F.collect_list("to").alias("to")), "links")
    vectors = nodes.select(F.col("node").alias("to"), "v")
    asked = queries.select("query", F.col("v").alias("q"))

    def dots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                s = np.einsum("ij,ij->i", _matrix(part.column(2)), _matrix(part.column(3)))
                kept = np.flatnonzero(~(s < part.column(4).to_numpy(zero_copy_only=False)))  # no least is NaN
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), part.column(1).take(pa.array(kept)), pa.array(s[kept])], ["query", "to", "score"])

    def scored(pairs: DataFrame, beam: DataFrame | None = None) -> DataFrame:
        """Pairs with scores; where a query's beam is full, those below all of it are left out."""
        least = asked.withColumn("least", F.lit(None).cast("double"))
        if beam is not None:
            full = beam.groupBy("query").agg(F.when(F.count("*") >= BEAM, F.min("score")).alias("least"))
            least = asked.join(full, "query", "left")
        full = pairs.join(least, "query").join(vectors, "to").select("query", "to", "q", "v", "least")
        return full.mapInArrow(dots, "query long, to long, score double")

    def unseen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in whole_groups(it):
            lists, sizes = rows.column(1), rows.column(1).value_lengths().to_numpy()
            query, to, held = np.repeat(rows.column(0).to_numpy(), sizes), lists.flatten().to_numpy(), np.repeat(rows.column(2).to_numpy(zero_copy_only=False), sizes)
            order = np.lexsort([~held, to, query])  # what the beam holds comes first among equals
            query, to, held = query[order], to[order], held[order]
            fresh = ~held & np.concatenate([[True], (query[1:] != query[:-1]) | (to[1:] != to[:-1])])[: len(query)]
            yield pa.RecordBatch.from_arrays([pa.array(query[fresh]), pa.array(to[fresh])], ["query", "to"])

    long = [r["node"] for r in nodes.select("node", "length").orderBy(F.col("length").desc(), "node").limit(longest).collect()]
    starts = queries.select("query", F.explode(F.array_distinct(F.array("node", *[F.lit(n) for n in long]))).alias("to"))
    beam = stored(scored(starts).withColumn("opened", F.lit(False)), "beam")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "to")
    while True:  # what leaves a beam never comes back, so no node opens twice and the rounds end
        turn = beam.where("NOT opened").withColumn("r", F.row_number().over(order)).where(F.col("r") <= OPENED).select("query", F.col("to").alias("at"))
        turn = stored(turn, "turn")
        if turn.isEmpty():
            break
        ahead = turn.join(links, "at").select("query", "to", F.lit(False).alias("held"))
        known = beam.groupBy("query").agg(F.collect_list("to").alias("to")).withColumn("held", F.lit(True))
        fresh = ahead.unionByName(known).repartition("query").sortWithinPartitions("query").mapInArrow(unseen, "query long, to long")
        opened = beam.join(turn.select("query", F.col("at").alias("to"), F.lit(True).alias("now")), ["query", "to"], "left").select("query", "to", "score", (F.col("opened") | F.coalesce("now", F.lit(False))).alias("opened"))
        both = opened.unionByName(scored(fresh, beam).withColumn("opened", F.lit(False)))
        beam = stored(both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= BEAM).drop("r"), "beam")
    return beam.select("query", "to", "score")


def top_links(links: DataFrame, most: int = 2 * NEIGHBOURS) -> DataFrame:
    """Links (at, to, back), `most` of a node at most: its own neighbours all, then of those whose neighbour it is some by
    a hash, so a hub opens few; each of these still has it as its own neighbour."""
    order = W.partitionBy("at").orderBy("back", F.xxhash64("at", "to"))
    return links.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("at", "to")


def nearest(table: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest that the search finds for rows of table (vec_id, embedding)
    for which is_query(vec_id) holds, among all rows but the query's own.

    Nearness is the inner product in double precision; ties go to the smaller vec_id. Null, zero and partly null or
    non-finite vectors, null ids and vectors of another length than most take no part; an empty table gives no rows.
    Equal vectors under several ids are found together. A repeated row counts once; an id with several vectors comes
    with the best of them, and asks with the least (as an array).
    """
    rows = stored(valid_vectors(table).withColumn("node", F.xxhash64("v")), "vectors")
    # of ids with equal vectors the first top + 1 can matter; Spark drops others before it shuffles
    ids = rows.select("node", "vec_id").withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= top + 1).drop("r")
    one = rows.groupBy("node").agg(F.first("v").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    scale = float(rows.agg(F.percentile_approx(length, 0.999, 10_000).alias("m")).first()["m"] or 1.0)

    def unit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            v = _matrix(batch.column(1))
            if len(v):
                n = np.linalg.norm(v, axis=1)
                x = v / np.maximum(n, scale)[:, None]
                x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel()), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), pa.array(n)], ["node", "v", "a", "half", "length"])

    nodes = stored(one.mapInArrow(unit, "node long, v array<double>, a array<float>, half binary, length double"), "nodes")
    count = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node")).select("a").limit(pivots_of(count)).collect()
    pivots = np.array([r["a"] for r in sample], np.float32)
    graph = neighbour_graph(nodes, pivots)
    asks = rows.where(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query")).agg(F.min("v").alias("v"))
    queries = stored(asks.select("query", F.xxhash64("v").alias("node"), "v"), "queries")
    found = searched(queries, graph, nodes)
    named = found.join(ids.select(F.col("node").alias("to"), "vec_id"), "to").where("vec_id <> query").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 20 against all rows: query_id, rank, vec_id, score."""
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0)
