"""Secret scans through a trigram index.

Each rule's regular expression is turned into a Boolean query on trigrams that any match must contain. Every Arrow
batch of texts gets its own small inverted index (postings from the queries' trigrams to rows); postings are
intersected and united as the query says, and only the rows left are verified with the expression itself. Rules
without mandatory trigrams scan every row. An index lives as long as its batch, so nothing is shuffled, memory
follows the batch, and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, lowered, pieces, read


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: what matches; flags of re; group, least: a match counts if that group is so long."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0


# The three base rules, then further ones for well-known key formats.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 24),
)
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + FURTHER
MOST_STRINGS = 64  # a run of literals with more readings than this is cut


def literal_runs(tree) -> list[set[str]]:
    """Runs of the expression that every match contains, each as the strings that it may read."""
    runs: list[set[str]] = []
    now = {""}

    def cut() -> None:
        nonlocal now
        if now != {""}:
            runs.append(now)
        now = {""}

    def join(more: set[str]) -> None:
        nonlocal now
        if len(now) * len(more) > MOST_STRINGS:
            cut()
        now = {a + b for a in now for b in more}

    def readings(part) -> set[str] | None:
        """All strings that a part may read, or None if there are too many."""
        out = {""}
        for op, value in part:
            if op is rc.LITERAL:
                more = {chr(value)}
            elif op is rc.IN and all(x[0] is rc.LITERAL for x in value):
                more = {chr(x[1]) for x in value}
            elif op is rc.SUBPATTERN:
                more = readings(value[3])
            elif op is rc.BRANCH:
                each = [readings(x) for x in value[1]]
                more = None if None in each else set().union(*each)
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[1] is not rc.MAXREPEAT and value[1] <= 3:
                one = readings(value[2])
                more = None if one is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in ([("",)] if not n else [tuple([y] * n) for y in one])} if len(one or "") <= 1 else None
            else:
                return None
            if more is None or len(out) * len(more) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    for item in tree:
        more = readings([item])
        if more is not None:
            join(more)
        else:
            cut()
            if item[0] is rc.SUBPATTERN:
                runs.extend(literal_runs(item[1][3]))
    cut()
    return runs


def trigram_query(rule: Rule) -> list[list[frozenset[bytes]]]:
    """And of Ors of Ands of lower-case ASCII trigrams; [] if no trigram is mandatory."""
    query = []
    for run in literal_runs(rp.parse(rule.pattern, rule.flags)):
        if all(len(s) >= 3 and s.isascii() for s in run):
            query.append(sorted({frozenset(s.lower().encode()[i : i + 3] for i in range(len(s) - 2)) for s in run}, key=sorted))
    return query


class Scanner:
    """Compiled rules, their queries and the trigrams that the index holds."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r)) for r in rules]
        self.grams = sorted({g for _, _, q in self.rules for run in q for s in run for g in s})
        if len(self.grams) > 65_000:
            raise ValueError("too many trigrams")
        self.ids = np.zeros(1 << 24, np.uint16)
        for n, g in enumerate(self.grams, 1):
            self.ids[g[0] << 16 | g[1] << 8 | g[2]] = n

    def index(self, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        """Postings: for each trigram that occurs, a mark for each row that holds it."""
        if len(data) < 3:
            return {}
        low = lowered(data).astype(np.uint32)
        found = self.ids[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(found)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) * len(offsets) + row[inside])
        postings = {}
        for n in np.unique(pairs // len(offsets)):
            marks = np.zeros(len(offsets) - 1, bool)
            marks[pairs[(pairs >= n * len(offsets)) & (pairs < (n + 1) * len(offsets))] - n * len(offsets)] = True
            postings[self.grams[n - 1]] = marks
        return postings

    def candidates(self, query, postings: dict[bytes, np.ndarray], rows: int) -> np.ndarray:
        none, keep = np.zeros(rows, bool), np.ones(rows, bool)
        for run in query:
            some = none.copy()
            for grams in run:
                every = np.ones(rows, bool)
                for g in grams:
                    every &= postings.get(g, none)
                some |= every
            keep &= some
        return keep

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each row its (start, number of the rule, end) in code points, in that order."""
        rows = len(offsets) - 1
        postings = self.index(data, offsets)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
        text = [None] * rows
        for n, (rule, pattern, query) in enumerate(self.rules):
            for row in np.flatnonzero(self.candidates(query, postings, rows)):
                if text[row] is None:
                    text[row] = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
                out[row] += [(m.start(), n, m.end()) for m in pattern.finditer(text[row]) if len(m[rule.group]) >= rule.least]
        for x in out:
            x.sort()
        return out


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One a Python worker."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key of docs and spans: array of (kind, start, end), by start, then by the rules' order; code points, end exclusive.

    Matches of a rule are leftmost and do not overlap; those of different rules may. A null or empty text has no
    spans, repeated rows give repeated results, and columns of other names are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules)
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in it:
            for a, b, data, offsets in pieces(batch.column(1)):
                found = [[{"kind": rules[n].kind, "start": s, "end": e} for s, n, e in row] for row in find.spans(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(found, spans_type)], ["key", "spans"])

    return docs.select(key, text).mapInArrow(batches, f"key {kind}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("key", key)


def redacted(docs: DataFrame, mark: str = "[SECRET]", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each span (overlapping ones as one) replaced by mark; all columns stay, a null text
    stays null, repeated rows are changed alike and an empty table stays empty."""
    bounded_batches(docs.sparkSession)
    schema, where = docs.schema, docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules)
        for batch in it:
            for a, b, data, offsets in pieces(batch.column(where)):
                part = batch.slice(a, b - a)
                spans = find.spans(data, offsets)
                if not any(spans):
                    yield part
                    continue
                texts = part.column(where).to_pylist()
                for row, found in enumerate(spans):
                    if found:
                        out, at = [], 0
                        for s, _, e in found:
                            if e > at:
                                if s >= at:
                                    out += [texts[row][at:s], mark]
                                at = max(at, e)
                        texts[row] = "".join([*out, texts[row][at:]])
                columns = [pa.array(texts, part.schema.field(n).type) if n == where else part.column(n) for n in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(batches, schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = [r.kind for r in BASE]

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts, sums, joined = [[], [], []], [], []
            for row in batch.column(1).to_pylist():
                texts = [f"{x['kind']}:{x['start']}:{x['end']}" for x in row]
                for n, k in enumerate(base):
                    counts[n].append(sum(x["kind"] == k for x in row))
                sums.append(hashlib.sha256(",".join(t for t, x in zip(texts, row, strict=True) if x["kind"] in base).encode()).hexdigest())
                joined.append(",".join(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sums, pa.string()), pa.array(joined, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = secrets(read(spark, sf_dir, "documents"))
    return found.mapInArrow(digest, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
