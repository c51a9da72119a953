import numpy as np
import pytest

from stepgraph.llm import op3_preference, op5_quality


def test_preferences_of_text_ids(spark):
    said = [("b", 0, "user", "q"), ("b", 1, "assistant", "long answer"), ("a", 0, "user", "q"), ("a", 1, "assistant", ""), ("", 0, "user", "x"), (None, 0, "user", "x")]
    turns = spark.createDataFrame(said, "conv_id string, turn long, role string, text string")
    got = {(r.pair_id, r.part, r.turn): r.rendered for r in op3_preference.preferences(*op3_preference.alternatives(turns)).collect()}
    mark = "<|im_start|>assistant\n{}<|im_end|>\n".format
    assert {k for k in got if k[1] != "prompt"} == {(i, part, 1) for i in "ab" for part in ("chosen", "rejected")}
    assert got["b", "chosen", 1] == mark("long answer") and got["b", "rejected", 1] == mark("long ")
    assert got["a", "chosen", 1] == mark("") and got["a", "rejected", 1] == mark("...")
    assert {k for k in got if k[1] == "prompt"} == {("a", "prompt", 0), ("b", "prompt", 0), ("", "prompt", 0)}


def test_score_replaces_a_column_of_its_name(spark):
    docs = spark.createDataFrame([(1, "some words here", 9.0, "x"), (2, None, 9.0, None)], "doc_id long, text string, Score double, key string")
    y = np.array([0.0, 1.0] * 10)
    texts = [("good words in a row " * 3 if v else "!!! $$$").encode() for v in y]
    model = op5_quality.train(
        spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string"),
        spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int"),
    )
    out = op5_quality.with_score(docs, model, "score")
    assert out.columns == ["doc_id", "text", "key", "score"]
    assert all(0 <= r.score <= 1 for r in out.collect()) and out.count() == 2
    with pytest.raises(ValueError):
        op5_quality.with_score(docs, model, "text")
