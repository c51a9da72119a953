import random

import numpy as np
import pytest

from stepgraph.llm import op2_repeats as op2


def passages(seed, letters, n):
    """Texts that share passages: in whole, at their edges, within one text, and many with other surroundings."""
    rng = random.Random(seed)
    text = lambda size: "".join(rng.choices(letters, k=size))
    shared = [text(rng.randint(15, 80)) for _ in range(6)]
    out = ["".join(text(rng.randint(0, 30)) + rng.choice(shared) * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 4))) + text(rng.randint(0, 30)) for _ in range(n)]
    return [*out, *out[:5], "", letters[0] * 90, letters[0] * 50]


def test_previous_smaller():
    rng = np.random.default_rng(1)
    for value in [rng.permutation(n) for n in (0, 1, 2, 7, 300)] + [np.arange(300), np.arange(300)[::-1], np.append(np.arange(1, 300), 0)]:
        want = [max((j for j in range(i) if value[j] < value[i]), default=-1) for i in range(len(value))]
        assert op2.previous_smaller(value).tolist() == want


@pytest.mark.parametrize("length", [1, 3, 8, 20, 24, 90, 400])
def test_suffix_order_and_earlier_matches(length):
    rng = random.Random(length)
    for letters in (b"ab", b"abc\0\xff"):
        part = bytes(rng.choices(letters, k=500))
        data = part + bytes(rng.choices(letters, k=100)) + part[:450] + part[3:] + b"a" * 450
        start = np.array([k for k in range(len(data) - length + 1) if rng.random() < 0.8])
        window = [data[s : s + length] for s in start]
        held = np.frombuffer(data, np.uint8)
        order, name = op2.suffix_order(held, start, length)
        assert [window[k] for k in order] == sorted(window)
        assert len(set(zip(name.tolist(), window))) == len(set(window)) == len(set(name.tolist()))
        match = op2.earlier_matches(held, start, length)
        first = {}
        for k, w in enumerate(window):
            assert (match[k] >= 0) == (w in first)
            assert match[k] < 0 or (match[k] < k and window[match[k]] == w)
            first.setdefault(w, k)


@pytest.mark.parametrize(("length", "bucket_bytes"), [(20, 1 << 20), (20, 1), (40, 400), (60, 1)])
def test_buckets_of_every_size(spark, length, bucket_bytes):
    texts = passages(length, "abcd", 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in op2.removed(docs, length, bucket_bytes=bucket_bytes).collect()}
    counts = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            counts[t[k : k + length]] = counts.get(t[k : k + length], 0) + 1
    first, seen = {}, set()
    for n, t in enumerate(texts):
        gone, later = set(), set()
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            gone |= set(range(k, k + length)) if counts[w] > 1 else set()
            later |= set(range(k, k + length)) if w in seen else set()
            seen.add(w)
        assert got[n] == "".join(c for k, c in enumerate(t) if k not in gone).encode()
        first[n] = "".join(c for k, c in enumerate(t) if k not in later).encode()
    # equal rows count as one copy where the first stays, so ids tell copies apart here
    kept = {r.doc_id: bytes(r.kept) for r in op2.removed(docs, length, keep_first=True, bucket_bytes=bucket_bytes).collect()}
    assert kept == first


def test_text_ids_and_columns(spark):
    rows = [("b", "x" * 30, 1), (None, "y" + "x" * 25, 2), ("a", None, 3), ("", "", 4), ("c", "quite another text of its own", 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, bucket long")
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in op2.removed(docs, 20).collect()}
    assert got == {"b": (30, 30, b""), None: (26, 25, b"y"), "a": (0, 0, b""), "": (0, 0, b""), "c": (29, 0, rows[4][1].encode())}
    assert {r.doc_id: r.n_removed for r in op2.removed(docs, 20, keep_first=True).collect()} == {"b": 30, None: 24, "a": 0, "": 0, "c": 0}
    assert op2.removed(docs.limit(0), 20).count() == 0
    whole, places = op2.repeats(docs, 20)
    assert whole.columns == ["row_id", *docs.columns] and places.count() == 2


def test_texts_are_not_sent_for_a_few_runs(spark, monkeypatch):
    """Runs of large buckets go to the texts while they are few; more are joined by a shuffle, with the same result."""
    docs = spark.createDataFrame(list(enumerate(passages(7, "abcd", 40))), "doc_id long, text string")
    plans, put = [], op2.stored

    def stored(df, name):
        if name == "runs":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(df, name)

    monkeypatch.setattr(op2, "stored", stored)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = sorted(map(tuple, op2.removed(docs, 20, bucket_bytes=1).collect()))
        assert len(plans) == 3 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans[1:])
        plans.clear()
        monkeypatch.setattr(op2, "MOST_BROADCAST", 0)
        assert sorted(map(tuple, op2.removed(docs, 20, bucket_bytes=1).collect())) == few
        assert len(plans) == 3 and all("SortMergeJoin" in p for p in plans[1:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_bucket_of_a_very_common_passage_is_split(spark, monkeypatch):
    """Nearly all runs lie in the buckets of one passage; the joins by bucket deal its rows to several tasks."""
    rng = random.Random(3)
    text = lambda size: "".join(rng.choices("abcdefgh", k=size))
    common = text(30)
    texts = [text(rng.randint(20, 40)) + common + text(rng.randint(20, 40)) for _ in range(3000)]
    plans, put = {}, op2.stored

    def stored(df, name):
        if name in ("repeated-runs", "run-classes"):
            df.collect()
            plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return put(df, name)

    monkeypatch.setattr(op2, "stored", stored)
    sql = {"autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "8", "adaptive.advisoryPartitionSizeInBytes": "8k", "adaptive.coalescePartitions.enabled": "false", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in sql}
    try:
        for k, v in sql.items():
            spark.conf.set(f"spark.sql.{k}", v)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in op2.removed(docs, 20).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert got == {n: w[:3] for n, w in enumerate(op2.plain([t.encode() for t in texts], 20))}
    assert len(plans) == 2 and all("skew=true" in p for p in plans.values())
