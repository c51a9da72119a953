"""Small fixtures against SQL or plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, further columns."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from compare import oracle, rows
from pyspark.sql import functions as F

from stepgraph.llm import op1_license, op2_repeats, op3_preference, op4_near, op5_quality, op6_secret, op7_toxicity, op8_mix, op9_decontaminate, op10_neighbours
from stepgraph.llm.common import Rolling, word_hashes
from stepgraph.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "a"), (2, "", None), (3, "One two three", "a"), (4, "one TWO three", "b"), (4, "one TWO three", "b"), (5, "word " * 30_000, None), (6, "é x\x00y \U0001f600" * 40, "a"), (None, "a null id here, with password: hunter22 in it", "c")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("spans", F.lit(1)).withColumn("score", F.lit("x")).withColumn("size", F.lit(0))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(oracle(ORACLE_SQL[name], SF))


def test_license(odd, none):
    got = op1_license.scan(odd).collect()
    assert len(got) == len(ODD) and all(r.licenses == [] for r in got) and got[0].n_sentences == 0
    assert op1_license.scan(none).count() == 0
    text = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nAll rights reserved."
    row = op1_license.scan(odd.sparkSession.createDataFrame([(text,)], "text string")).first()
    assert row.sentence_ids == ["BsdGrant", "BsdSource", "Reserved"] and row.licenses == ["All-Rights-Reserved"] and row.n_unmatched == 2


def test_repeats(odd, none):
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in op2_repeats.removed(odd, 20).collect())
    assert got == sorted(op2_repeats.plain([(t or "").encode() for _, t, _ in ODD], 20))
    assert op2_repeats.removed(none, 20).count() == 0
    docs = odd.sparkSession.createDataFrame([(8, "one two three four"), (7, "one two three four five")], "doc_id long, text string")
    first = op2_repeats.removed(docs, 10, keep_first=True).collect()
    assert {r.doc_id: r.n_removed for r in first} == {7: 0, 8: 18}


def test_preference(spark):
    said = [(1, 0, "user", "q"), (1, 1, "assistant", "yes"), (2, 0, "user", "q"), (2, 1, "assistant", "no"), (2, 1, "assistant", "no"), (3, 0, None, None), (None, 0, "user", "x")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    pairs = spark.createDataFrame([(7, 1, 2), (8, 1, 1), (9, 3, 4), (None, 1, 2)], "pair_id long, chosen_id long, rejected_id long")
    got = {(r.pair_id, r.part, r.turn): (r.rendered, r.train, r.n_prompt) for r in op3_preference.preferences(turns, pairs).collect()}
    assert set(got) == {(7, "prompt", 0), (7, "chosen", 1), (7, "rejected", 1), (8, "prompt", 0), (8, "prompt", 1), (9, "chosen", 0)}
    assert got[7, "chosen", 1] == ("<|im_start|>assistant\nyes<|im_end|>\n", True, 1) and not got[8, "prompt", 1][1]


def test_every_pair_has_both_sides(spark):
    said = [(i, t, r, x) for i in (-1, 0, 1, 6) for t, r, x in ((0, "user", "q"), (1, "assistant", f"yes {i}"), (2, "user", "q2"), (3, "assistant", "same" if i < 2 else "odd one"), (4, "user", "bye"))]
    said += [(8, 0, "user", "hello"), (10, 0, "assistant", ""), (12, 0, "user", None), (12, 1, "assistant", "twelve")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = op3_preference.preferences(*op3_preference.alternatives(turns)).collect()
    for i in (-1, 0, 1, 6, 10, 12):
        own = [r for r in got if r.pair_id == i]
        assert {r.part for r in own if r.train} == {"chosen", "rejected"}
        assert [r.rendered for r in sorted(own, key=lambda r: r.turn) if r.part in ("prompt", "chosen")] == [f"<|im_start|>{r}\n{x or ''}<|im_end|>\n" for j, _, r, x in said if j == i]
    assert {(r.part, r.n_prompt) for r in got if r.pair_id == 8} == {("prompt", 1)}
    assert [r.rendered for r in got if r.pair_id == 0 and r.part == "rejected"] == ["<|im_start|>assistant\nsa<|im_end|>\n"]
    empty = op3_preference.alternatives(turns.where("conv_id > 99"))
    assert op3_preference.preferences(*empty).count() == 0


def test_near(odd, none):
    got = op4_near.near_duplicates(odd.where("doc_id IS NOT NULL")).select("doc_id", "n_shingles", "component_id").distinct().collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == op4_near.plain([(i, t) for i, t, _ in ODD if i is not None])
    assert op4_near.near_duplicates(none).count() == 0


def test_repeats_on_table(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op2_repeat_removal"](spark, SF).collect()}
    assert got == {i: w for (i, _), w in zip(docs, op2_repeats.plain([t for _, t in docs]), strict=True)}


def test_near_on_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_near_duplicates"](spark, SF).collect()}
    assert got == op4_near.plain(docs)


def test_near_tells_hard_words_apart(spark):
    word = b"a"
    for _ in range(10):
        word += bytes(195 - c for c in word)  # Thue-Morse: polynomial hashes modulo 2**64 can't tell it from its complement
    other = bytes(195 - c for c in word)
    docs = [(1, f"x y z {word.decode()}"), (2, f"x y z {other.decode()}"), (3, f"x y z {word.decode()}"), (4, "y " * 20_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op4_near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == op4_near.plain(docs) and got[2][1] == 2
    data = np.frombuffer(word + other, np.uint8)
    start, end = np.array([0, len(word)]), np.array([len(word), 2 * len(word)])
    assert len(set(Rolling(data).of(start, end))) == 2 and len(set(word_hashes(data, start, end))) == 2


@pytest.mark.parametrize("name", ["op5_quality", "op7_toxicity"])
def test_classifiers(spark, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    label = {"op5_quality": "quality", "op7_toxicity": "toxic"}[name]
    both = got.merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert got.score.between(0, 1).all() and (held.predicted == held[label]).mean() > 0.9


def test_classifiers_at_the_edges(odd, none):
    flat = op5_quality.fitted(np.zeros((0, len(op5_quality.FEATURES))), np.zeros(0))
    assert {r.score for r in op5_quality.scored(odd, flat).collect()} == {0.5}
    machine = op7_toxicity.fitted([], np.zeros(0))
    assert len(op7_toxicity.scored(odd, machine).collect()) == len(ODD) and op7_toxicity.scored(none, machine).count() == 0


def test_secrets(spark, odd, none):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    patterns = [("assign", re.compile(op6_secret.BASE[0].pattern, re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    want = {}
    for i, t in docs:
        found = sorted((m.start(), n, k, m.end()) for n, (k, p, g, least) in enumerate(patterns) for m in p.finditer(t) if len(m[g]) >= least)
        want[i] = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in found).encode()).hexdigest()
    found = QUERIES["op6_secret_scan"](spark, SF).collect()
    assert {r.doc_id: r.base_sha256 for r in found} == want
    for r in found:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [sum(k == n for k, *_ in spans) for n in ("assign", "access", "hex")] == [r.n_assign, r.n_access, r.n_hex]
    assert {r.doc_id: len(r.spans) for r in op6_secret.secrets(odd).collect()}[None] == 1
    assert op6_secret.redacted(odd).where("text LIKE '%[SECRET]%'").count() == 1 and op6_secret.redacted(none).count() == 0


def test_trigram_queries():
    assert op6_secret.trigram_query(op6_secret.BASE[2]) == []
    assert len(op6_secret.trigram_query(op6_secret.BASE[0])[0]) == 6


def test_mix(odd, none):
    got = op8_mix.mixed(op8_mix.items_of(odd)).toPandas()
    assert len(got) == len(ODD) and (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert g.taken.sum() == np.floor(g.target.iloc[0] + 0.5)
    assert op8_mix.mixed(op8_mix.items_of(none)).count() == 0


def test_decontaminate(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    near = "so then alpha beta GAMMA, changed epsilon zeta eta theta iota kappa other mu nu xi end"
    docs = spark.createDataFrame([(1, near, "s"), (2, item.replace("eta", "x"), "s"), (3, None, "s")], SCHEMA)
    bench = spark.createDataFrame([(9, item), (9, item), (8, "too short"), (7, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_equal, r.start) for r in op9_decontaminate.overlaps(docs, bench).where("doc_id = 1").collect()] == [(1, 9, 12, 2)]
    assert op9_decontaminate.overlaps(odd, bench).count() == 0 and op9_decontaminate.overlaps(none, bench).count() == 0


def test_decontaminate_by_shuffle(spark, monkeypatch):
    """The same rows where the seeds are too many to broadcast."""
    want = {tuple(r) for r in QUERIES["op9_decontaminate"](spark, SF).collect()}
    monkeypatch.setattr(op9_decontaminate, "MOST_BROADCAST", -1)
    monkeypatch.setattr(op9_decontaminate.F, "broadcast", lambda df: pytest.fail("broadcast"))
    assert want and {tuple(r) for r in QUERIES["op9_decontaminate"](spark, SF).collect()} == want
    item = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(1, "x " * 100_000 + item + " y" * 50_000, "s"), (2, "x " * 3 + item, "s")], SCHEMA)
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert sorted(tuple(r) for r in op9_decontaminate.overlaps(docs, bench).collect()) == [(1, 9, 400, 100_000), (2, 9, 400, 3)]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    data = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [1.0] * 8), (204, [1.0] * 8)]
    got = op10_neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).toPandas()
    ids = np.array([i for i, v in data if i not in (200, 201, 202)])
    x = np.array([v for i, v in data if i not in (200, 201, 202)])
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort([ids, -s])[:20]]) & set(g.vec_id))
        assert list(g.sort_values("rank").score) == sorted(g.score, reverse=True)
    assert got.query_id.nunique() == 10 and hit / len(got) > 0.95
    assert op10_neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).count() == 0


def test_neighbours_by_descent(spark):
    """Several cells and iterations, one vector 10,000 times longer, repeated rows and ids, one of another length."""
    x = np.random.default_rng(2).normal(size=(1200, 24))
    x[7] *= 10_000
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (8, x[9].tolist()), (1300, [1.0, 2.0])]
    got = op10_neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")), lambda i: i % 20 == 0).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[8] = max(s[8], x[9] @ x[q])
        s[q] = -np.inf
        assert g.vec_id.is_unique and np.allclose(g.sort_values("rank").score, s[g.sort_values("rank").vec_id])
        hit += len(set(np.lexsort([np.arange(1200), -s])[:20]) & set(g.vec_id))
    assert len(got) == 60 * 20 and hit / len(got) >= 0.95


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 *
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
 *
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
 *
 * THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
 * AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
 * IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
 * DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL = """// This program is free software{} you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation{} either version {} of the License, or
// (at your option) any later version.
//
// This program is distributed in the hope that it will be useful,
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
"""


@pytest.mark.parametrize(("text", "want"), [(MIT, "MIT"), (BSD, "BSD-3-Clause"), (ISC, "ISC"), (APACHE, "Apache-2.0"), (GPL.format(":", ",", 3), "GPL-3.0-or-later"), (GPL.format(";", ";", 2), "GPL-2.0-or-later"), (MPL, "MPL-2.0"), ("Licensed under the MIT License\r\nand a line more", "MIT")])
def test_whole_licences(spark, text, want):
    docs = spark.createDataFrame([(f"some words before\n\n{text}\nint main;",), (text.replace("\n", "\r\n"),), (None,), (text.replace("the", "a").replace("THE", "A"),)], "text string")
    got = [(r.licenses, r.n_unmatched) for r in op1_license.scan(docs, whole=True).collect()]
    assert got[:3] == [([want], 0), ([want], 0), ([], 0)] and (want not in got[3][0])


def test_licence_sql_on_whole_licences(spark, tmp_path):
    """The query and its SQL on wrapped licences, broken words, marks without end and odd rows."""
    texts = [MIT, APACHE, MPL, GPL.format(":", ",", 3), GPL.format(";", ";", 2), f"a\n\n{MIT}\n\n{APACHE}", MIT.replace("\n", "\r\n"), MIT.replace("\n", "\n\n"), MIT.replace(". ", " "), "Licensed under the MIT License. All rights reserved", "1 Licensed under the MIT License; b) all rights reserved...\r\r# - x", None, "", "P L", "." * 200_000 + "x", "\n" * 200_000, ". " * 100_000, "; :\n" * 50_000 + MIT, "all rights reserved\n" * 3]
    docs = spark.createDataFrame([(k if k != 3 else None, t, "s") for k, t in enumerate(texts)] + [(0, MIT, "s")], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = rows(QUERIES["op1_license_scan"](spark, str(tmp_path)).toPandas())
    assert got == rows(con.sql(ORACLE_SQL["op1_license_scan"]).df()) and sum("'MIT'" in r for r in got) == 5



def test_search_goes_on_until_nothing_is_unopened(spark):
    far = 12  # a chain: each node knows the next one only, which is nearer to the query
    nodes = spark.createDataFrame([(i, [float(i + 1), 1.0], float(i)) for i in range(far)], "node long, v array<double>, length double")
    graph = spark.createDataFrame([(i, i + 1, 1.0) for i in range(far - 1)], "node long, to long, score double")
    query = spark.createDataFrame([(0, 0, [1.0, 1.0])], "query long, node long, v array<double>")
    assert {r.to for r in op10_neighbours.searched(query, graph, nodes, longest=0).collect()} == set(range(far))


def test_graph_is_built_without_a_call_for_each_group(spark):
    """An iteration against all pairs by hand, over many small batches: hubs, a node both ahead and behind, groups of one."""
    x = np.random.default_rng(7).normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, bytes(v.astype(np.float16).tobytes())) for i, v in enumerate(x)], "node long, half binary")
    near = {i: {(i + 1) % 300, 0, (i * 7 + 3) % 300} - {i} for i in range(300)}
    half = x.astype(np.float16).astype(np.float32)
    graph = spark.createDataFrame([(i, j, float(half[i] @ half[j])) for i, to in near.items() for j in to], "node long, to long, score float")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = op10_neighbours.improved(graph, nodes, 0)
        got = found.collect()
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    behind = {m: [i for i in range(300) if m in near[i]] for m in range(1, 300)}
    met = {i: set(to) for i, to in near.items()}
    for m, some in behind.items():
        for i in {*some, *near[m]}:
            met[i] |= ({*some, *near[m]} - {i})
    for i in range(300):
        own = {r.to: (r.score, r.new) for r in got if r.node == i}
        assert len(own) == sum(r.node == i for r in got) <= op10_neighbours.NEIGHBOURS and all(abs(s - half[i] @ half[j]) < 1e-4 and new == (j not in near[i]) for j, (s, new) in own.items())
        want = sorted(met[i], key=lambda j: -(half[i] @ half[j]))[: op10_neighbours.NEIGHBOURS]
        assert i == 0 or len(own) >= len(want) and half[i] @ half[want[-1]] <= min(s for s, _ in own.values()) + 1e-4


def test_graph_goes_on_until_few_edges_change(spark, monkeypatch):
    turns = []

    def improved(graph, nodes, turn):
        turns.append(turn)
        return graph.withColumn("new", F.lit(turn < 6))

    graph = spark.createDataFrame([(1, 2, 0.5)], "node long, to long, score float")
    monkeypatch.setattr(op10_neighbours, "first_graph", lambda *_: graph)
    monkeypatch.setattr(op10_neighbours, "improved", improved)
    op10_neighbours.neighbour_graph(None, np.zeros((1, 2)))
    assert turns == list(range(7))


def test_pivots_grow():
    assert op10_neighbours.pivots_of(3_000_000) > 2900
    x = np.random.default_rng(3).normal(size=(3000, 8)).astype(np.float32)
    row, cell = op10_neighbours.Cells(x[:1500]).of(x)
    flat = op10_neighbours.Cells(x[:1500], flat=1500).of(x)
    assert (np.bincount(row) == op10_neighbours.NEAR_PIVOTS).all() and len(set(zip(row, cell))) == len(row)
    assert len(set(zip(row, cell)) & set(zip(*flat))) > 0.7 * len(row)


def _insults():
    rng = np.random.default_rng(5)
    syllables = [a + b for a in "bdfglmnprstv" for b in "aeiou"]
    words = ["".join(rng.choice(syllables, 3)) for _ in range(300)] + ["a", "to", "it", "is", "of", "we", "no"]
    texts = [" ".join(rng.choice(words, rng.integers(20, 120))) for _ in range(400)]
    toxic = [t + f" {rng.choice(['idiotzwack', 'quorkhead', 'jerkyxump'])}" for t in texts[:100]]
    clean = texts[100:]
    return op7_toxicity.fitted([t.encode() for t in toxic + clean], np.array([1.0] * 100 + [0.0] * 300)), clean


def test_gapped_insults():
    machine, clean = _insults()
    bad = "quorkhead"
    forms = [bad, ".".join(bad), " ".join(bad), "--".join(bad), " . ".join(bad), " - ".join(bad), "...".join(bad), "—".join(bad), "qu or kh ea d", " ".join("you are " + bad).replace("   ", " ")]
    rows = [f"{c} {f} end".encode() for c, f in zip(clean, forms)] + [c.encode() for c in clean]
    score = machine.score(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))
    assert [f for f, x in zip(forms, score) if x < op7_toxicity.TOXIC] == []
    assert (score[len(forms) :] >= op7_toxicity.TOXIC).mean() < 0.15


def test_compact():
    texts = ["a--b", "--x", "", "--", "--y ..z", "é——b", "··", "c"]
    raw = [t.encode() for t in texts]
    data, offsets = op7_toxicity.compacted(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [bytes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])] == [op7_toxicity.compact(t) for t in raw]
    texts = [b"see i d - i o t now", b"i.d", b"i--o--t", b"one it two", b"", "привет как дела".encode(), b"a b c d e f g h i j k"]
    data, start, end, row = op7_toxicity.joined(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert sorted((int(r), bytes(data[a:b])) for a, b, r in zip(start, end, row)) == [(0, b"idiot"), (2, b"iot"), (6, b"abcdefgh"), (6, b"abcdefghijk"), (6, b"defghijk")]


def test_decontaminate_short_items(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()
    cases = []  # (item, document, whether they overlap)
    for n, changed in [(8, [0]), (8, [7]), (10, [2, 4]), (10, [3, 5]), (11, [3, 5]), (7, [3]), (6, [0]), (5, [4]), (4, []), (2, []), (1, [])]:
        tag = [f"{w}{len(cases)}" for w in base[:n]]
        cases.append((" ".join(tag), "so then " + " ".join("other" if k in changed else w for k, w in enumerate(tag)) + " end", True))
    cases += [("cut0 cut1 cut2 cut3 cut4 cut5 cut6 cut7", "cut1 cut2 cut3 cut4 cut5 cut6 cut7", True), ("four1 four2 four3 four4", "four1 other four3 four4", False), ("six1 six2 six3 six4 six5 six6", "six1 x six3 y six5 six6", False), ("天地玄黄宇宙洪荒日月盈昃", "前言天地玄黄宇宙洪荒日月盈仄后记", True), ("春夏", "秋春夏冬", True)]
    bench = spark.createDataFrame([(k, i) for k, (i, _, _) in enumerate(cases)], "item_id long, text string")
    docs = spark.createDataFrame([(k, d, "s") for k, (_, d, _) in enumerate(cases)], SCHEMA)
    got = {(r.doc_id, r.item_id) for r in op9_decontaminate.overlaps(docs, bench).collect()}
    assert got == {(k, k) for k, c in enumerate(cases) if c[2]}


def test_decontaminate_same_ids(spark):
    w = [f"w{k}" for k in range(13)]
    near, far = [*w[:8], "x", *w[9:]], [*w[:9], "x", "x", "x", "x"]  # 12 and 9 of 13 equal
    docs = spark.createDataFrame([(1, " ".join(near), "s"), (1, " ".join(far), "s"), (None, " ".join(near), "s"), (None, " ".join(far), "s")], SCHEMA)
    bench = spark.createDataFrame([(None, " ".join(w)), (None, " ".join(w[:8] + [f"y{k}" for k in range(5)])), (5, "other words of an item that stand in no document at all here")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_equal, r.start) for r in op9_decontaminate.overlaps(docs, bench).collect()} == {(1, None, 12, 0), (None, None, 12, 0)}


@pytest.mark.parametrize("length", [20, 400, 700])
def test_pieces_of_long_texts_hold_each_window_once(monkeypatch, length):
    monkeypatch.setattr(op2_repeats, "PIECE", 1000)
    data = np.zeros(4900, np.uint8)
    starts = [at + k for at, part, _ in op2_repeats.stretches(data, np.array([0, len(data)]), length) for k in range(len(part) - length + 1)]
    assert starts == list(range(len(data) - length + 1))
