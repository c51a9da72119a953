"""Byte-level BPE by a monoid tree: halves are encoded apart and joined by encoding only the text around the joint again.

A text's encoding is a fold of its leaves' encodings, and the fold may be done in any order, as a tree. A join keeps the
tokens of both sides outside a window around the joint; the window grows until what is outside provably stays:

* at a certain boundary, two neighbouring characters that no match of the pattern holds together whatever stands around
  (anything and then white space; a letter, digit or mark and then one of another of these classes, but for an apostrophe
  and then a letter). Matches start anew there, so tokens before and after it are those of the whole text;
* inside one long match (a run of one class on both sides of the joint), at tokens: a sequence of tokens is the encoding
  of its bytes if each two neighbours are that of theirs. Where the window's own encoding begins and ends with the token
  that stood there before, all neighbours are old ones or the window's.

If neither comes, the window reaches the next certain boundaries, at worst both ends. Decoding joins bytes up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, read

LEAF = 1024  # characters that are encoded at once
NEAR = 256  # characters from the joint in which a certain boundary is looked for first
FIRST = 4  # tokens on each side of a window inside a long match, doubled as it grows
MARGIN = 3  # characters at a run's ends that belong to no such window: a space, an apostrophe and letters may be matched with others
LEAF_IDS = 4096

_WHITE = frozenset([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


@lru_cache(1 << 16)
def class_of(c: str) -> str:
    """S white space, L letter, N number, O other; '' for characters that this Unicode version doesn't know."""
    if ord(c) in _WHITE:
        return "S"
    kind = unicodedata.category(c)
    return "" if kind == "Cn" else kind[0] if kind[0] in "LN" else "O"


def certain(a: str, b: str) -> bool:
    """No match of the pattern holds a and then b."""
    x, y = class_of(a), class_of(b)
    return bool(x and y) and x != "S" and x != y and not (a == "'" and y == "L")


class Node:
    """An encoded part of a text: its characters and its tokens."""

    __slots__ = ("ids", "text")

    def __init__(self, text: str, ids: list[int]):
        self.text, self.ids = text, ids


class Bpe:
    """ranks: lines of a base64 token and its rank, as in a file of ranks; pattern: what splits text before the merges."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF):
        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        self.leaf = leaf
        self.bytes_of = {rank: token for token, rank in table.items()}
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.name_of = {rank: str(rank) for rank in self.bytes_of}

    def encode(self, text: str) -> list[int]:
        return self.folded(text, 0, len(text)).ids

    def folded(self, text: str, start: int, end: int) -> Node:
        if end - start <= self.leaf:
            part = text[start:end]
            return Node(part, self.encoder.encode_ordinary(part))
        middle = start + (end - start) // 2
        return self.joined(self.folded(text, start, middle), self.folded(text, middle, end))

    def joined(self, a: Node, b: Node) -> Node:
        """The encoding of a's text and b's behind it. Empty nodes change nothing, and the order of joins doesn't matter."""
        if not a.text or not b.text:
            return b if not a.text else a
        left, right = self.last_boundary(a.text, NEAR), self.first_boundary(b.text, NEAR)
        if left is None or right is None:
            ids = self.joined_in_run(a, b)
            if ids is not None:
                return Node(a.text + b.text, ids)
            left, right = self.last_boundary(a.text, len(a.text)) or 0, self.first_boundary(b.text, len(b.text)) or len(b.text)
        tail, head = a.text[left:], b.text[:right]
        i = len(a.ids) - self.tokens_of(reversed(a.ids), len(tail.encode()))
        j = self.tokens_of(b.ids, len(head.encode()))
        return Node(a.text + b.text, [*a.ids[:i], *self.encoder.encode_ordinary(tail + head), *b.ids[j:]])

    def last_boundary(self, text: str, most: int) -> int | None:
        """The last certain boundary among the last `most` characters."""
        for k in range(len(text) - 1, max(0, len(text) - most), -1):
            if certain(text[k - 1], text[k]):
                return k
        return None

    def first_boundary(self, text: str, most: int) -> int | None:
        for k in range(1, min(len(text), most)):
            if certain(text[k - 1], text[k]):
                return k
        return None

    def tokens_of(self, ids, size: int) -> int:
        """How many of the first tokens make up so many bytes."""
        n = 0
        for token in ids:
            if size <= 0:
                break
            size -= len(self.bytes_of[token])
            n += 1
        return n

    def joined_in_run(self, a: Node, b: Node) -> list[int] | None:
        """Tokens of both, joined inside a run of one class that goes over the joint; None if no window settles in it."""
        kind = class_of(a.text[-1])
        if not kind or kind != class_of(b.text[0]):
            return None
        x, y = len(a.text), 0
        while x and class_of(a.text[x - 1]) == kind:
            x -= 1
        while y < len(b.text) and class_of(b.text[y]) == kind:
            y += 1
        room, reach = len(a.text[x + MARGIN :].encode()), len(b.text[: max(0, y - MARGIN)].encode())
        n = FIRST
        while n <= len(a.ids) and n <= len(b.ids):
            left, right = a.ids[len(a.ids) - n :], b.ids[:n]
            before, after = b"".join(map(self.bytes_of.__getitem__, left)), b"".join(map(self.bytes_of.__getitem__, right))
            if len(before) > room or len(after) > reach:
                return None
            found = self.encoder._encode_single_piece(before + after)
            if found[0] == left[0] and found[-1] == right[-1]:
                return [*a.ids[: len(a.ids) - n], *found, *b.ids[n:]]
            n *= 2
        return None

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_held: dict[tuple[str, str, int], Bpe] = {}


def bpe(ranks: bytes, pattern: str, leaf: int = LEAF) -> Bpe:
    """One a Python worker."""
    key = (hashlib.sha256(ranks).hexdigest(), pattern, leaf)
    if key not in _held:
        _held[key] = Bpe(ranks, pattern, leaf)
    return _held[key]


def encoded(docs: DataFrame, ranks: str | Path, pattern: str, text: str = "text", key: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """key of docs and ids: array of the text's tokens, without special ones.

    ranks: the file's path, read by the driver and sent along (its size is the vocabulary's, not the data's). A null or
    empty text has no tokens, repeated rows repeat, an empty table stays empty, other columns are not read; the key may
    be of any type and null.
    """
    bounded_batches(docs.sparkSession)
    held = Path(ranks).read_bytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(held, pattern, leaf)
        for batch in it:
            found = [own.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key], docs[text].cast("string")).mapInArrow(batches, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decoded(tokens: DataFrame, ranks: str | Path, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key of tokens and text_bytes: the bytes that ids stand for (null or empty: none). An id outside the vocabulary ends the job."""
    bounded_batches(tokens.sparkSession)
    held = Path(ranks).read_bytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(held, pattern)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["key", "text_bytes"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(key, ids).mapInArrow(batches, f"key {kind}, text_bytes binary").withColumnRenamed("key", key)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    ranks = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    pattern = public_tokenizers.PATTERN
    bounded_batches(spark)

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(ranks, pattern)
        for batch in it:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                said = " ".join(map(own.name_of.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(digest, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
