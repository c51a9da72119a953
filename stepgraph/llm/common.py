"""What several operators share: shared-folder tables, Arrow text access and vectorised 64-bit hashing."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space and words as every word-based operator takes them: ASCII space and \x09-\x0D separate.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

PIECE_BYTES = 1 << 20  # numpy work on texts is done in pieces of about this size; a hash takes some 60 bytes a byte

BATCH_BYTES = 4 << 20  # of an Arrow batch of texts
LONG = 4096  # bytes of words that are hashed all together


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; in tests a local one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = current.get() if current.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table written once to the shared folder, so a lost executor costs a reread only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold BATCH_BYTES at most (or one row), so a Python worker that takes
    whole texts holds as much with long texts as with short ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- texts as one byte array ------------------------------------------------------------------------------------


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes; a longer row comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5  # odd; powers of it have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: its length and its blocks of 8 bytes, each mixed in before the next.

    Up to LONG bytes for all words together, longer words by BLAKE2b: no word costs a pass for each of its blocks.
    """
    size = (end - start).astype(np.int64)
    full = np.zeros(len(data) + 8, np.uint8)
    full[: len(data)] = data
    blocks = np.ndarray((len(data) + 1,), "<u8", full, 0, (1,))
    h = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(todo):
        left = np.minimum(size[todo] - at, 8).astype(U)
        block = blocks[start[todo] + at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - left * U(8)))
        h[todo] = mix((h[todo] ^ block) * U(0xD6E8FEB86659FD93) + U(0x2545F4914F6CDD1D))
        at += 8
        todo = todo[size[todo] > at]
    for n in np.flatnonzero(size > LONG):
        h[n] = int.from_bytes(hashlib.blake2b(data[start[n] : end[n]].tobytes(), digest_size=8).digest(), "little")
    return h


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
_PRIME = (1 << 31) - 1
_BASE2 = 1_234_567_891
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, U)
        x[0] = 1
        have = _powers[kind] = np.cumprod(x)
    return have[:n]


def _power_of_prime(kind: str, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo _PRIME, by doubling."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        x = np.ones(1, U)
        while len(x) < max(n, 1 << 16):
            x = np.concatenate([x, x * U(pow(base, len(x), _PRIME)) % U(_PRIME)])
        have = _powers[kind] = x
    return have[:n]


class Rolling:
    """Hashes of any substrings of a byte array, from prefix sums of two polynomials.

    One is modulo 2**64, where some strings of 1,024 bytes and more (Thue-Morse words) are known to coincide for every
    base; the other is modulo the prime 2**31 - 1, where they don't. Both go into the mixed 64 bits.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data] * _power("base", _BASE, n), out=self.prefix[1:])
        self.inverse = _power("inverse", _INVERSE, n + 1)
        self.second = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * _power_of_prime("base2", _BASE2, n) % U(_PRIME), out=self.second[1:])
        self.inverse2 = _power_of_prime("inverse2", pow(_BASE2, -1, _PRIME), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
        one = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        two = (self.second[end] - self.second[start]) % U(_PRIME) * self.inverse2[start] % U(_PRIME)
        return mix(one + mix(two << U(32) ^ (end - start).astype(U)))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; no word crosses rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, ink[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, ink[1:]
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]
