"""Removal of long repeated passages by longest-previous-factor arrays.

A byte is removed if a string of `length` bytes over it has an earlier match (and, unless the first copy is to stay, a later
one). Earlier matches come from suffix order: of the suffixes before and after one in that order, the nearest with smaller
positions share the longest previous factor with it. Suffixes are compared up to `length` bytes, by bytes.

The order is made within buckets, since suffixes that agree on `length` bytes must meet and others need not:

1. Every window of `length` bytes has an anchor, its GRAM-byte string of least hash. Neighbouring windows mostly share
   one, so a text becomes a row for each run of windows with the same anchor. The anchor's hash is the bucket: equal
   windows have equal anchors at the same place, so a window whose anchor stands nowhere else repeats nowhere.
2. Runs whose whole stretch of text and anchor are equal form a class; two or more are copies, and one of them, the first,
   stands for all in the bucket.
3. A bucket of at most BUCKET_BYTES goes to one task as the stretches of its classes. They are joined to one text, its
   suffixes ordered by names of growing prefixes (each three times as long as the last), and previous and next smaller
   positions tell which windows have an earlier match of `length` bytes.
4. A larger bucket is dealt again: its runs are cut into blocks of BLOCK windows, then of one, by their offset from the anchor,
   and a block's bucket is the string that all its windows share. A bucket of single windows has one class, so this ends.
   Few such runs go to where the texts are read, so all texts are not sent for them.

No unbounded group is gathered: classes are counts and smallest positions with map-side combining, joined back to their rows.
Counts are stored before such a join: beside a grouping in its own stage, Spark can't split the bucket of a very common passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, U, bounded_batches, mix, pieces, read, stored

LENGTH = 400
GRAM = 100
BLOCK = 16  # windows of a large bucket's runs that are dealt together
BUCKET_BYTES = 1 << 20  # whose suffixes are ordered in one task
PIECE = 2 << 20  # longer texts are cut into pieces that overlap by length - 1 bytes
MOST_BROADCAST = 32 << 20  # bytes of the runs that are dealt again, counted as RUN_BYTES each; more are joined by a shuffle
RUN_BYTES = 128
_BITS = 24  # of an anchor's place within a piece


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first byte, bytes, offsets): the input, or the overlapping pieces of one long text."""
    if len(data) <= 4 * PIECE:
        yield 0, data, offsets
    else:
        for at in range(0, len(data), PIECE):
            part = data[at : at + PIECE + length - 1]
            if len(part) >= length:
                yield at, part, np.array([0, len(part)])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """row, first and last window start and anchor within the row, anchor's hash, hash of anchor and whole stretch."""
    n = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, empty.astype(U), empty.astype(U)
    mark = np.zeros(n + 1, np.int64)
    long = np.diff(offsets) >= length
    np.add.at(mark, offsets[:-1][long], 1)
    np.add.at(mark, offsets[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(mark[:-1]))
    if not len(start):
        return empty, empty, empty, empty, empty.astype(U), empty.astype(U)
    roll = Rolling(data)
    place = np.arange(len(data) - gram + 1)
    grams = roll.of(place, place + gram)
    least = sliding_least(grams >> U(_BITS) << U(_BITS) | place.astype(U), length - gram + 1)
    anchor = (least[start] & U((1 << _BITS) - 1)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 1) | (np.diff(anchor) != 0)
    first = start[new]
    last = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
    anchor = anchor[new]
    key = grams[anchor]
    whole = mix(roll.of(first, last + length) ^ mix(key + (anchor - first).astype(U) * U(0x9E3779B97F4A7C15)))
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first - offsets[row], last - offsets[row], anchor - offsets[row], key, whole


def blocks_of(first: int, last: int, anchor: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(low, high, core's start, label) of a run's windows: those whose offset from the anchor has the same quotient by
    width. The core, length - width + 1 bytes, lies in each window that such a block can have."""
    for label in range((anchor - last) // width, (anchor - first) // width + 1):
        b = anchor - label * width
        yield max(first, b - width + 1), min(last, b), b, label


def halves(roll: Rolling, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of substrings, other than roll's own: of both halves, one mixed into the other."""
    middle = (start + end) // 2
    return mix(roll.of(start, middle) ^ mix(roll.of(middle, end) + U(0x2545F4914F6CDD1D)))


def names(key: np.ndarray) -> np.ndarray:
    """The number of smaller values, each counted once."""
    order = np.argsort(key)
    held = key[order]
    new = np.zeros(len(key), np.int64)
    new[1:] = held[1:] != held[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_order(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the starts by their first `length` bytes, a name of these bytes for each start). data holds `length` bytes
    from each start on."""
    width = min(8, length)
    padded = np.concatenate([data, np.zeros(width, np.uint8)]).astype(U)
    key = np.zeros(len(data), U)
    for k in range(width):
        key = key << U(8) | padded[k : k + len(data)]
    name = names(key)
    times = 3 if len(data) < 1 << 21 else 2  # names of so many positions fit into 63 bits
    bits = 63 // times
    while width * times <= length:
        key = name
        for k in range(1, times):
            after = np.zeros(len(name), np.int64)
            after[: max(0, len(name) - k * width)] = name[k * width :]
            key = key << bits | after
        name, width = names(key), width * times
    # the last step's prefixes overlap until the whole is `length` bytes
    whole = np.zeros(len(start), np.int64)
    for at in [*range(0, length - width, width), length - width]:
        whole = names(whole << 31 | name[start + at])
    return np.argsort(whole), whole


def previous_smaller(value: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1: strides double while all that they pass is
    larger, then halve."""
    n = len(value)
    place, level = np.arange(n) - 1, np.zeros(n, np.int64)
    least = [value]  # of the 2**k values that end at a place
    open_ = np.flatnonzero(place >= 0)
    k = 0
    while len(open_):
        if k:
            step = least[-1].copy()
            half = 1 << (k - 1)
            step[half:] = np.minimum(step[half:], least[-1][:-half])
            least.append(step)
        fine = least[k][place[open_]] > value[open_]
        level[open_] = k
        open_ = open_[fine]
        place[open_] -= 1 << k
        open_ = open_[place[open_] >= 0]
        k += 1
    for k in range(len(least) - 2, -1, -1):
        some = np.flatnonzero((level > k) & (place >= 0))
        some = some[least[k][place[some]] > value[some]]
        place[some] -= 1 << k
    return np.maximum(place, -1)


def earlier_matches(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """For each of the ascending starts, an earlier one (its number) with the same `length` bytes, or -1: the longest
    previous factor is that with the previous or the next smaller position in suffix order, and it is long enough if the
    names agree."""
    order, name = suffix_order(data, start, length)
    found = np.full(len(start), -1)
    back = order[::-1]
    for line in (order, back):
        near = previous_smaller(line)
        has = np.flatnonzero(near >= 0)
        mine, other = line[has], line[near[has]]
        same = name[mine] == name[other]
        found[mine[same]] = other[same]
    return found


def bucket_groups(it: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows that come in order of their column bucket, in tables of about `limit` bytes that hold whole buckets."""
    held = None
    for batch in it:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if held.nbytes < limit:
            continue
        bucket = held.column("bucket").to_numpy()
        ends = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        size = np.concatenate([[0], np.cumsum(held.column("size").to_numpy())])
        at = 0
        while len(ends) and at < ends[-1]:
            end = max(int(np.searchsorted(size[ends], size[at] + limit, "right")) - 1, int(np.searchsorted(ends, at, "right")))
            yield held.slice(at, ends[end] - at)
            at = int(ends[end])
        held = held.slice(at).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(docs with row_id, spans: row_id, places: array of (start, end)) of docs with doc_id, of any type that has an order,
    and text.

    A byte is in a span if a string of `length` bytes over it also starts elsewhere; with keep_first, only if such a
    string starts earlier (in order of doc_id, a null one first, then row_id, then place), so the first copy stays; rows
    equal in id and text then count as one copy. Spans may overlap. A null or empty text has none; each row is a text of
    its own, so repeated rows repeat each other; an empty table has no spans. Further columns are kept.
    """
    bounded_batches(docs.sparkSession)
    gram = max(1, min(GRAM, length // 4))
    most = max(2, bucket_bytes // (2 * length))  # classes of a bucket; a stretch is shorter than two windows
    own = docs.withColumn("row_id", F.xxhash64("doc_id", "text"))
    # one shape for all joins with texts, so Spark shuffles them once
    texts = own.select("row_id", *docs.columns)
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs_schema = f"row_id long, doc_id {kind}, first int, last int, anchor_at int, bucket long, whole long"
    order = ["doc_id", "row_id"] if keep_first else ["row_id"]  # which copy is the first matters if it stays

    def to_runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, _, data, offsets in pieces(batch.column(2), PIECE):
                for at, part, ends in stretches(data, offsets, length):
                    row, first, last, place, key, whole = runs_of(part, ends, length, gram)
                    pick = pa.array(row + a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), *[pa.array(x + at, pa.int32()) for x in (first, last, place)], _signed(key), _signed(whole)], ["row_id", "doc_id", "first", "last", "anchor_at", "bucket", "whole"])

    def to_blocks(width: int):
        def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                wanted = batch.column(3).to_pylist()
                for a, b, data, offsets in pieces(batch.column(2), PIECE):
                    cuts = [(n, r["anchor_at"], *x) for n in range(a, b) for r in wanted[n] for x in blocks_of(r["first"], r["last"], r["anchor_at"], width)]
                    if not cuts:
                        continue
                    row, anchor, low, high, core, label = np.array(cuts, np.int64).T
                    base = offsets[row - a]
                    roll = Rolling(data)
                    key = mix(roll.of(base + core, base + core + length - width + 1) + label.astype(U) * U(0x9E3779B97F4A7C15))
                    whole = mix(halves(roll, base + low, base + high + length) + (anchor - low).astype(U))
                    pick = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), *[pa.array(x, pa.int32()) for x in (low, high, anchor)], _signed(key), _signed(whole)], ["row_id", "doc_id", "first", "last", "anchor_at", "bucket", "whole"])

        return blocks

    def to_stretches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for n in range(batch.num_rows):
                text, wanted = batch.column(2)[n].as_buffer(), batch.column(3)[n].as_py()
                for k in range(0, len(wanted), 1000):
                    some = wanted[k : k + 1000]
                    data = [text[r["first"] : r["last"] + length].to_pybytes() for r in some]
                    pick = pa.array(np.full(len(some), n))
                    yield pa.RecordBatch.from_arrays([pa.array([r["bucket"] for r in some], pa.int64()), batch.column(1).take(pick), batch.column(0).take(pick), *[pa.array([r[c] for r in some], pa.int64()) for c in ("first", "last")], pa.array([len(x) for x in data], pa.int64()), pa.array(data, pa.binary())], ["bucket", "doc_id", "row_id", "first", "last", "size", "data"])

    def to_places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in the order of positions, so in a joined text smaller places are earlier ones
        for group in bucket_groups(it, bucket_bytes):
            first, last = group.column("first").to_numpy(), group.column("last").to_numpy()
            data = np.frombuffer(b"".join(group.column("data").to_pylist()), np.uint8)
            count = last - first + 1
            shift = np.cumsum(count + length - 1) - (count + length - 1)
            run = np.repeat(np.arange(len(first)), count)
            offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            match = earlier_matches(data, shift[run] + offset, length)
            gone = match >= 0
            if not keep_first:
                gone[match[match >= 0]] = True  # an earlier match itself, too
            at = np.flatnonzero(gone)
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (np.diff(run[at]) != 0)
            low, high = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
            pick = run[low]
            yield pa.RecordBatch.from_arrays([group.column("row_id").combine_chunks().take(pa.array(pick)), pa.array(first[pick] + offset[low]), pa.array(first[pick] + offset[high] + length)], ["row_id", "start", "end"])

    def with_texts(classes: DataFrame, *columns: str, few: bool = False) -> DataFrame:
        """The first run of each class, with its text; texts are shuffled as the caller does, so Spark does it once. Few runs
        are broadcast instead."""
        wanted = classes.groupBy("head.row_id").agg(F.collect_list(F.struct("bucket", *[f"head.{c}" for c in columns])).alias("runs"))
        return texts.select("row_id", "doc_id", "text").join(F.broadcast(wanted) if few else wanted, "row_id")

    runs = stored(own.select("row_id", "doc_id", "text").mapInArrow(to_runs, runs_schema).select(*order, "first", "last", "anchor_at", "bucket", "whole"), "runs")
    found = []
    for width in (BLOCK, 1, 0):
        # most buckets hold one run only; these go before anything else is shuffled
        repeated = stored(runs.groupBy("bucket").agg(F.count("*").alias("total")).where("total > 1").select("bucket"), "repeated-buckets")
        runs = stored(runs.join(repeated, "bucket", "left_semi"), "repeated-runs")
        classes = stored(runs.groupBy("bucket", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*order, "first", "last", "anchor_at")).alias("head")), "classes")
        sizes = stored(classes.groupBy("bucket").agg(F.count("*").alias("kinds")), "bucket-sizes")
        classes = stored(classes.join(sizes, "bucket"), "run-classes")
        copies = runs.join(classes.where("n > 1").select("bucket", "whole", "head"), ["bucket", "whole"])
        if keep_first:
            copies = copies.where((F.col("row_id") != F.col("head.row_id")) | (F.col("first") != F.col("head.first")))
        found.append(copies.select("row_id", F.col("first").alias("start"), (F.col("last") + length).alias("end")))
        small = with_texts(classes.where(F.col("kinds").between(2, most)), "first", "last").mapInArrow(to_stretches, f"bucket long, doc_id {kind}, row_id long, first long, last long, size long, data binary")
        in_order = small.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "row_id", "first")
        found.append(in_order.mapInArrow(to_places, "row_id long, start long, end long"))
        large = classes.where(F.col("kinds") > most)
        again = large.count() if width else 0
        if not again:
            break
        runs = stored(with_texts(large, "first", "last", "anchor_at", few=again * RUN_BYTES <= MOST_BROADCAST).mapInArrow(to_blocks(width), runs_schema).select(*runs.columns), "runs")
    places = found[0]
    for more in found[1:]:
        places = places.unionByName(more)
    return texts, places.groupBy("row_id").agg(F.collect_list(F.struct("start", "end")).alias("places"))


def merged(places: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((p["start"], p["end"]) for p in places):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def removed(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, kept (binary: the bytes left), n_bytes, n_removed and n_spans of each row of docs, as repeats() finds them; a
    null or empty text has 0 bytes and keeps none, an empty table gives no rows, further columns are not read."""
    own, places = repeats(docs.select("doc_id", "text"), length, keep_first, bucket_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, spans = batch.column(1), batch.column(2)
            for a in range(0, batch.num_rows, 500):
                out, counts = [], []
                for n in range(a, min(a + 500, batch.num_rows)):
                    text = (texts[n].as_buffer().to_pybytes() if texts[n].is_valid else b"") or b""
                    runs = merged(spans[n].as_py() or [])
                    ends = [0, *[e for _, e in runs]]
                    out.append(b"".join([text[e:s] for e, (s, _) in zip(ends, runs, strict=False)] + [text[ends[-1] :]]))
                    counts.append((len(text), len(text) - len(out[-1]), len(runs)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + 500], pa.array(out, pa.binary()), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return own.join(places, "row_id", "left").select("doc_id", "text", "places").mapInArrow(cut, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def op2_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def plain(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans and kept_sha256 of each text by plain counting of all windows; for tests."""
    counts: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            counts[t[i : i + length]] = counts.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out
