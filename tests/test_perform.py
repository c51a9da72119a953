import random

import pandas as pd
from pyspark.sql import functions as F

from stepgraph.streaming.perform import finished, one_plan, plans_of, replay, report, traced, traced_stream

STEPS = pd.DataFrame({"id": ["s01", "s02", "s03", "s04"], "installs": [["case"], ["shaft", "pin"], [], ["bolt", "nut", "case"]], "depends": [[], ["s01"], ["s01"], ["s03", "s02"]], "torque": [None, 24.0, None, None]})
#: part or figure, accepted, reason, part in the trace
SAID = [
    ("shaft", False, "out-of-order", "shaft"), ("bolt", False, "out-of-order", "bolt"), ("case", True, None, "case"), ("case", False, "already-placed", "case"), (24.0, None, None, None),
    ("shaft", True, None, "shaft"), ("pin", True, None, "pin"), ("case", False, "torque-outstanding", "case"), (20.0, False, "wrong-torque", "shaft"), (24.0005, True, "torque-ok", "shaft"),
    ("bolt", True, None, "bolt"), ("none", False, "no-step", "none"), ("nut", True, None, "nut"),
]
SCHEMA = "user string, seq long, kind string, part string, value double, ts double"
ACTIONS = [("u", n, "torque", "", x, 10.0 + n * n) if isinstance(x, float) else ("u", n, "attempt", x, None, 10.0 + n * n) for n, (x, *_) in enumerate(SAID)]


def test_batch(spark):
    batch = replay(spark.createDataFrame(ACTIONS, SCHEMA), STEPS).orderBy("seq").collect()
    assert [(r.ok, r.reason, r.part) for r in batch] == [tuple(x[1:]) for x in SAID if x[1] is not None]
    assert [r.hesitation for r in batch][:5] == [0.0, 1.0, 3.0, 5.0, 16.0] and batch[-1]["at"] == 144.0


def test_completion_and_report(spark):
    actions = spark.createDataFrame(ACTIONS, SCHEMA).withColumn("proc_id", F.lit("0"))
    trace, plan = traced(actions, one_plan(spark, STEPS)), one_plan(spark, STEPS)
    assert finished(trace).first()[2:] == (5, True)
    assert finished(traced(actions.where("seq < 9"), plan)).first()[2:] == (3, False)
    got = report(trace, spark.createDataFrame([("0", "nut", "Nut M8"), ("0", "shaft", "Shaft")], "proc_id string, part_id string, name string")).first()
    assert got[2:] == (144.0, 12, 6, "already-placed=1,no-step=1,out-of-order=2,torque-outstanding=1,wrong-torque=1", "Nut M8", 23.0, "Shaft:out-of-order,bolt:out-of-order,case:already-placed,case:torque-outstanding", 5, True)


def test_a_step_that_shares_a_part_waits_for_its_torque(spark):
    # s02 installs bolt and case, case is placed by s01: after the bolt its torque is outstanding, and nothing is complete
    steps = pd.DataFrame({"id": ["s01", "s02"], "installs": [["case"], ["bolt", "case"]], "depends": [[], ["s01"]], "torque": [None, 24.0]})
    said = [("u", 1, "attempt", "case", None, 1.0), ("u", 2, "attempt", "bolt", None, 2.0), ("u", 3, "torque", None, 24.0, 3.0)]
    for n, want in ((2, (2, False)), (3, (2, True))):
        trace = traced(spark.createDataFrame(said[:n], SCHEMA).withColumn("proc_id", F.lit("0")), one_plan(spark, steps))
        assert finished(trace).first()[2:] == want


def test_odd_actions(spark):
    said = [(None, "p", 1, "attempt", "a", None, 1.0), ("u", None, 1, "attempt", "a", None, 1.0), ("u", "q", 1, "attempt", None, None, 1.0), ("u", "p", 1, "attempt", "a", None, 1.0), ("u", "p", 2, "torque", None, None, 2.0), ("u", "p", 1, "attempt", "a", None, 1.0)]
    actions = spark.createDataFrame(said, "user string, proc_id string, seq long, kind string, part string, value double, ts double").withColumns({"turn": F.lit("x"), "plan": F.lit(1)})
    plans = plans_of(spark.createDataFrame([("p", 0, "s01", ["a"], [], 5.0), ("r", 0, "s01", None, None, None)], "proc_id string, idx int, id string, installs array<string>, depends array<string>, torque double"))
    got = {(r.user, r.proc_id, r.seq, r.reason, r.n_placed, r.waits) for r in traced(actions, plans).collect()}
    assert got == {(None, "p", 1, None, 1, "s01"), ("u", None, 1, "no-step", 0, None), ("u", "q", 1, "no-step", 0, None), ("u", "p", 1, None, 1, "s01"), ("u", "p", 1, "torque-outstanding", 1, "s01"), ("u", "p", 2, "wrong-torque", 1, "s01")}
    assert {(r.user, r.proc_id, r.complete) for r in report(traced(actions, plans)).collect()} == {(None, "p", False), ("u", None, True), ("u", "q", True), ("u", "p", False)}
    assert report(traced(actions.where("false"), plans)).count() == 0


def test_stream_takes_batches_in_any_order(spark, tmp_path):
    said = [(u, "0", n, k, p, x, t + d) for u, d in (("u", 0.0), ("v", 3.0)) for _, n, k, p, x, t in ACTIONS]
    schema = "user string, proc_id string, seq long, kind string, part string, value double, ts double"
    want = sorted(map(tuple, traced(spark.createDataFrame(said, schema), one_plan(spark, STEPS)).collect()))
    random.Random(4).shuffle(said)
    batches = [said[:9], said[9:20], said[20:], [("w", "0", 0, "attempt", "case", None, 5000.0)], [("w", "0", 1, "attempt", "shaft", None, 50_000.0)]]
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def run():
        stream = traced_stream(files, one_plan(spark, STEPS), late="200 seconds", idle=1000.0)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    run()
    run()  # a restart adds nothing
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(r for r in rows if r[0] in "uv" and r[2] is not None) == want
    closed = {r[0]: (r[3 + 1], r[-2], r[-1]) for r in rows if r[5] == "closed"}
    assert closed["u"] == closed["v"] == (True, 5, 5)
