"""Phrases, byte-level BPE and resampling against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepgraph.llm import op11_phrases, op12_bpe, op13_resample
from stepgraph.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(spark, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*columns).collect()]


# --- phrases


def test_phrases_on_table(spark):
    got = sorted(map(tuple, QUERIES["op11_phrase_collocations"](spark, SF).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got and got == sorted(op11_phrases.plain(documents(spark, "lang", "text")))


@pytest.mark.parametrize("width", [1 << 16, 1 << 20])
def test_phrases_of_odd_rows(spark, width):
    docs = [("a", "One two, one two three. ONE two\x0bthree four\tfive six"), ("a", "one two three four"), (None, "é é é é\x00 é"), ("und", "é é"), ("", "x y x y x y"), ("a", None), (None, ""), ("b", " .,; "), ("b", "w " * 40_000), ("a", "one two three four"), ("a", "one two three four")]
    table = spark.createDataFrame(docs, "lang string, text string").withColumns({"n": F.lit("x"), "phrase": F.lit(1), "score": F.lit(2)})
    for least, top in ((2, 2000), (3, 2)):
        got = op11_phrases.collocations(op11_phrases.counted(table, least, width=width), top).collect()
        assert sorted(map(tuple, got)) == sorted(op11_phrases.plain(docs, least, top))
    none = op11_phrases.counted(table.where("false"), width=width)
    assert none.count() == 0 and op11_phrases.collocations(none).count() == 0


def test_sketch_loses_nothing(spark):
    pick = random.Random(5)
    docs = [("a", " ".join(f"w{int(pick.paretovariate(0.6))}" for _ in range(400))) for _ in range(60)]
    table = spark.createDataFrame(docs, "lang string, text string")
    for width in (1 << 16, 1 << 24):  # crowded and roomy rows of counters give the same phrases
        assert sorted(map(tuple, op11_phrases.collocations(op11_phrases.counted(table, width=width)).collect())) == sorted(op11_phrases.plain(docs))


def test_scores_beyond_64_bits(spark):
    big = 10**16
    counts = spark.createDataFrame([("a", 0, "", 3 * big), ("a", 1, "x", 2 * big), ("a", 1, "y", 2 * big - 1), ("a", 2, "x y", big)], "lang string, n_words int, phrase string, n long")
    assert [tuple(r) for r in op11_phrases.collocations(counts).collect()] == [("a", 1, "x y", big, 2 * big, 2 * big - 1, 3 * big, 2_000_000 * big // (4 * big - 1))]


def test_collocations_gather_no_phrases_on_the_driver(spark, tmp_path):
    held = {"x": 40, "y": 40, "z": 40, "x y": 40, "y z": 50, "x y z": 40}
    counts = spark.createDataFrame([("a", 0, "", 400), *[("a", len(p.split()), p, n) for p, n in held.items()]], "lang string, n_words int, phrase string, n long")
    counts.write.parquet(f"{tmp_path}/counts")
    found = op11_phrases.collocations(spark.read.parquet(f"{tmp_path}/counts"))  # a file's size doesn't tell the rows in it
    assert [tuple(r) for r in found.collect()] == [("a", 1, "x y z", 40, 40, 50, 400, 888_888)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


# --- byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return op12_bpe.Bpe(open(RANKS, "rb").read(), public_tokenizers.PATTERN, leaf=7)


PARTS = ["a", "ab", "the", "'", "'s", "'ll", "'re", "''", " ", "  ", "\n", "\t ", "1", "42", "!", "?!", "é", "ß", "日本", "語", "\U0001f600", "́", " ", "　", "\x1c", "\x00", "١", "²", "\U0001faea", "aaaaaaaa", "======", "        ", "thethethe"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join) | st.text(max_size=60) | st.tuples(st.sampled_from(PARTS), st.integers(0, 60), st.text("ab' !", max_size=20)).map(lambda x: x[0] * x[1] + x[2]))
def test_tree_equals_library(codec, text):
    ids = codec.encode(text)
    assert ids == codec.encoder.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("alphabet", ["ab", "aehilnorst", "'ls ", "=-", "01", "é日", " \n"])
def test_long_runs(alphabet):
    own, pick = op12_bpe.Bpe(open(RANKS, "rb").read(), public_tokenizers.PATTERN, leaf=64), random.Random(3)
    for size in (65, 1000, 20_000):
        text = "".join(pick.choice(alphabet) for _ in range(size))
        assert own.encode(text) == own.encoder.encode_ordinary(text)


def test_any_order_of_joins(codec):
    text, pick = "It's the 3rd   naïve\n\n test,'llama' of thethethethethethethethethethe 12345678901234567890 joins" * 3, random.Random(1)
    for _ in range(20):
        cuts = sorted({0, len(text), *(pick.randrange(len(text)) for _ in range(12))})
        nodes = [op12_bpe.Node(text[a:b], codec.encoder.encode_ordinary(text[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        while len(nodes) > 1:
            k = pick.randrange(len(nodes) - 1)
            nodes[k : k + 2] = [codec.joined(nodes[k], nodes[k + 1])]
        assert nodes[0].ids == codec.encoder.encode_ordinary(text)


def test_bpe_on_table(spark):
    import tiktoken

    own = op12_bpe.Bpe(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    assert isinstance(own.encoder, tiktoken.Encoding)
    want = {}
    for i, t in documents(spark, "doc_id", "text"):
        ids = own.encoder.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op12_byte_bpe"](spark, SF).collect()} == want


def test_bpe_of_odd_rows(spark):
    rows = [("x", None), (None, ""), ("y", "word " * 50_000), ("y", "word " * 50_000), ("z", "z" * 100_000), ("u", "é\x00\U0001f600 ' \t\n")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"ids": F.lit(1), "key": F.lit("k")})
    tokens = op12_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    back = op12_bpe.decoded(tokens, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.text_bytes)) for r in back) == sorted((str(i), (t or "").encode()) for i, t in rows)
    assert op12_bpe.encoded(docs.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


# --- resampling


def test_resample_on_table(spark):
    want = op13_resample.plain(documents(spark, "doc_id", "text"), [t for (t,) in [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]])
    got = [tuple(r) for r in QUERIES["op13_importance_resample"](spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[4] is not None for r in got) > 10


def test_resample_of_odd_rows(spark):
    long = "Alpha beta gamma " * 9
    docs = [(1, None), (2, ""), (3, long), (3, long), (3, long), (None, long), (None, long), (4, "é" * 9 + long), (5, "a1-b2_c3 " * 11), (-6, "word " * 30_000), (7, "few words")] + [(i, long) for i in range(10, 40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit("x"), "score": F.lit(1), "_n": F.lit(2)})
    target = spark.createDataFrame([("gamma gamma words",), (None,), ("",)], "text string")
    got = [tuple(r) for r in op13_resample.resampled(table, target).collect()]
    assert sorted(got, key=str) == sorted(op13_resample.plain(docs, ["gamma gamma words", None, ""]), key=str)
    assert op13_resample.resampled(table.where("false"), target).count() == 0
    assert {r.rank for r in op13_resample.resampled(table.where("doc_id < 3"), target.where("false")).collect()} == {None}


def test_radix_finds_the_kth_key(spark):
    pick = random.Random(2)
    rows = [(pick.choice([None, pick.randrange(-(1 << 62), 1 << 62), pick.randrange(-3, 3)]), pick.choice([0, 1, -1, pick.randrange(-(1 << 61), 1 << 61)])) for _ in range(300)] + [(5, 5)] * 100
    table = spark.createDataFrame(rows, "doc_id long, score long")
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for k in (1, 2, 50, 150, 399, 400):
        got = sorted((r.rank, r.doc_id, r.score) for r in op13_resample.drawn(table, k).collect() if r.rank is not None)
        assert got == [(n, *r) for n, r in enumerate(order[:k], 1)]
