"""Replay of users' actions against procedures, in batch and as a stateful stream, and what is told from it.

actions: user string, proc_id string, seq long, kind string ('attempt' or 'torque'), part string, value double, ts double
(seconds). plans: proc_id, n_parts, plan, as plans_of() makes them. A session is one user's actions on one procedure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TOLERANCE = 0.001
TRACE = "user string, seq long, part string, ok boolean, reason string, hesitation double, at double, entered double"
PLAN = "array<struct<id: string, installs: array<string>, depends: array<string>, torque: double>>"
FULL = f"user string, proc_id string, {TRACE.split(', ', 1)[1]}, waits string, n_placed int, n_parts int"
COLUMNS = [c.split()[0] for c in FULL.split(", ")]
FIRST_ERRORS = 4
CLOSED = "closed"


def plans_of(steps: DataFrame) -> DataFrame:
    """proc_id, n_parts, plan (array of PLAN in the order of idx) of steps (proc_id, idx, id, installs, depends, torque); a
    procedure's steps travel together, some dozens. n_parts counts the distinct parts that it installs."""
    held = steps.groupBy("proc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "id", "installs", "depends", F.col("torque").cast("double").alias("torque")))).alias("held"))
    plan = F.transform("held", lambda s: F.struct(s["id"].alias("id"), s["installs"].alias("installs"), s["depends"].alias("depends"), s["torque"].alias("torque")))
    parts = F.size(F.array_distinct(F.flatten(F.transform("held", lambda s: F.coalesce(s["installs"], F.array().cast("array<string>"))))))
    return held.select("proc_id", parts.alias("n_parts"), plan.cast(PLAN).alias("plan"))


class Session:
    """One user at one procedure: what is placed, which step waits for its torque, and when it began and last moved.

    Guards in their order: a torque is outstanding, the part is placed, no step installs it, the first step that is not
    done among those its step depends on. A step is done when all it installs is placed, at once if it installs
    nothing; an unknown step is no hindrance. Of several steps that install a part the first counts. A step with a
    torque waits for that figure once all it installs is placed; a figure that nothing waits for leaves no trace.
    """

    def __init__(self, plan, n_parts: int | None, placed=(), pending: str | None = None, started: float | None = None, last: float | None = None):
        self.of_part, self.by_id, parts = {}, {}, set()
        for s in plan or ():
            own = (s["id"], list(s["installs"] if s["installs"] is not None else ()), list(s["depends"] if s["depends"] is not None else ()), s["torque"])
            self.by_id.setdefault(own[0], own)
            parts.update(own[1])
            for p in own[1]:
                self.of_part.setdefault(p, own)
        self.n_parts = len(parts) if n_parts is None else int(n_parts)
        self.placed, self.pending, self.started, self.last = set(placed), pending, started, last

    def done(self, step) -> bool:
        return all(p in self.placed for p in step[1])

    @property
    def complete(self) -> bool:
        return len(self.placed) == self.n_parts and self.pending is None

    def act(self, seq: int, kind: str, part: str | None, value: float | None, now: float) -> tuple | None:
        """The trace of an action (seq, part, ok, reason, hesitation, at, entered, waits, n_placed, n_parts), or None."""
        if kind == "torque" and self.pending is None:
            return None
        self.started = now if self.started is None else self.started
        slow, self.last = now - (self.started if self.last is None else self.last), now
        entered, ok, reason = None, False, None
        if kind == "torque":
            _, installs, _, torque = self.by_id[self.pending]
            part, entered = installs[0], value
            ok = value is not None and abs(value - torque) <= TOLERANCE
            reason = "torque-ok" if ok else "wrong-torque"
            self.pending = None if ok else self.pending
        else:
            step = self.of_part.get(part)
            if self.pending is not None:
                reason = "torque-outstanding"
            elif part in self.placed:
                reason = "already-placed"
            elif step is None:
                reason = "no-step"
            elif next((d for d in step[2] if d not in self.by_id or not self.done(self.by_id[d])), None) in self.by_id:
                reason = "out-of-order"
            else:
                ok = True
                self.placed.add(part)
                if step[3] is not None and not math.isnan(step[3]) and self.done(step):
                    self.pending = step[0]
        return seq, part, ok, reason, slow, now - self.started, entered, self.pending, len(self.placed), self.n_parts


def traced(actions: DataFrame, plans: DataFrame) -> DataFrame:
    """FULL: the trace of all actions in order of seq (equal ones by ts, kind, part, value), with what holds after each row:
    waits (the step whose torque is outstanding), n_placed and n_parts.

    A session's plan goes once into the sorted rows, before its actions; rows stream through in order, so no session is
    held whole. A procedure without a plan installs nothing. Actions without a user or procedure form sessions too.
    """
    own = actions.select(F.col("user").cast("string"), F.col("proc_id").cast("string"), "seq", "kind", "part", F.col("value").cast("double").alias("value"), F.col("ts").cast("double").alias("ts"))
    known = plans.select(F.col("proc_id").cast("string").alias("proc_id"), "n_parts", "plan")
    sessions = own.select("user", "proc_id").distinct().join(known, "proc_id", "left").withColumn("turn", F.lit(0))
    rows = own.withColumn("turn", F.lit(1)).unionByName(sessions, allowMissingColumns=True)
    ordered = rows.repartition("user", "proc_id").sortWithinPartitions("user", "proc_id", "turn", "seq", "ts", "kind", "part", "value")

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["turn"] == 0:
                    session = Session(r["plan"], r["n_parts"] if r["plan"] is not None else 0)
                    continue
                row = session.act(r["seq"], r["kind"], r["part"], r["value"], r["ts"])
                if row is not None:
                    out.append((r["user"], r["proc_id"], *row))
            yield pa.RecordBatch.from_pylist([dict(zip(COLUMNS, x, strict=True)) for x in out], _ARROW)

    return ordered.select("user", "proc_id", "turn", "seq", "kind", "part", "value", "ts", "n_parts", "plan").mapInArrow(play, FULL)


_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in FULL.split(", ")])


class PerformProcessor(StatefulProcessor):
    """A session in state: actions wait in event-time order until the watermark has passed them, placed parts are a map,
    and a session that rests for `idle` seconds of event time is closed with a last row (reason CLOSED, ok: complete)."""

    def __init__(self, idle: float):
        self.idle_ms = int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts double, seq long, n int", "kind string, part string, value double")
        self.placed = handle.getMapState("placed", "part string", "seq long")
        self.clock = handle.getValueState("clock", "pending string, started double, last double")
        self.plan = handle.getValueState("plan", f"n_parts int, plan {PLAN}")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for r in frame.itertuples(index=False):
                if not self.plan.exists():
                    self.plan.update((None if r.plan is None else int(r.n_parts), [] if r.plan is None else [(s["id"], list(s["installs"]), list(s["depends"]), s["torque"]) for s in r.plan]))
                n = 0
                while self.waiting.containsKey((r.ts, r.seq, n)):
                    n += 1
                self.waiting.updateValue((r.ts, r.seq, n), (r.kind, r.part, None if pd.isna(r.value) else float(r.value)))
                self.handle.registerTimer(int(r.ts * 1000) + 1)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now_ms = timerValues.getCurrentWatermarkInMs()
        due = sorted((k for k in self.waiting.keys() if k[0] * 1000 < now_ms), key=lambda k: (k[1], k[0], k[2]))
        n_parts, plan = self.plan.get() if self.plan.exists() else (0, [])
        names = ("id", "installs", "depends", "torque")
        session = Session([dict(zip(names, s, strict=True)) for s in plan], n_parts, [p[0] for p in self.placed.keys()], *(self.clock.get() if self.clock.exists() else (None, None, None)))
        out = []
        for k in due:
            kind, part, value = self.waiting.getValue(k)
            self.waiting.removeKey(k)
            row = session.act(k[1], kind, part, value, k[0])
            if row is not None:
                out.append((*key, *row))
                if row[2] and row[3] is None:
                    self.placed.updateValue((row[1],), (row[0],))
        if out:
            self.clock.update((session.pending, session.started, session.last))
            self.handle.registerTimer(int(session.last * 1000) + self.idle_ms + 1)
        elif session.last is not None and session.last * 1000 + self.idle_ms < now_ms and next(iter(self.waiting.keys()), None) is None:
            out.append((*key, None, None, session.complete, CLOSED, now_ms / 1000 - session.last, now_ms / 1000 - session.started, None, session.pending, len(session.placed), session.n_parts))
            for state in (self.waiting, self.placed, self.clock, self.plan):
                state.clear()
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=COLUMNS)
        return frame.astype({"seq": "Int64", "ok": "boolean", "hesitation": float, "at": float, "entered": float, "n_placed": "int32", "n_parts": "int32"})

    def close(self) -> None:
        pass


def traced_stream(actions: DataFrame, plans: DataFrame, late: str = "10 minutes", idle: float = 3600.0) -> DataFrame:
    """The same rows for a streaming DataFrame, whatever order its batches come in: an action counts once the watermark,
    `late` behind the newest ts, has passed it; those that come after that are dropped by the watermark. Within what is
    due, seq orders actions as in the batch. After `idle` seconds of rest a session ends with one row more, CLOSED.

    State needs RocksDB, which is set for the session here. Each action carries its procedure's plan to its session.
    """
    spark = actions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = actions.select(F.col("user").cast("string"), F.col("proc_id").cast("string"), "seq", "kind", "part", F.col("value").cast("double").alias("value"), F.col("ts").cast("double").alias("ts"))
    timed = own.withColumn("_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("_time", late)
    joined = timed.join(plans.select(F.col("proc_id").cast("string").alias("proc_id"), "n_parts", "plan"), "proc_id", "left")
    return joined.groupBy("user", "proc_id").transformWithStateInPandas(PerformProcessor(idle), FULL, "append", "EventTime")


def one_plan(spark, steps: pd.DataFrame, proc_id: str = "0") -> DataFrame:
    """plans of a single procedure given as a local frame (id, installs, depends, torque)."""
    rows = [(proc_id, n, s.id, list(s.installs), list(s.depends), None if pd.isna(s.torque) else float(s.torque)) for n, s in enumerate(steps.itertuples())]
    return plans_of(spark.createDataFrame(rows, "proc_id string, idx int, id string, installs array<string>, depends array<string>, torque double"))


def replay(actions: DataFrame, steps: pd.DataFrame) -> DataFrame:
    """TRACE of actions on one procedure, a local frame of some dozen steps."""
    return traced(actions.withColumn("proc_id", F.lit("0")), one_plan(actions.sparkSession, steps)).select(*[c.split()[0] for c in TRACE.split(", ")])


# --- what a trace tells ---------------------------------------------------------------------------------------------


def finished(trace: DataFrame) -> DataFrame:
    """user, proc_id, n_placed, complete: whether every part is placed and no torque is outstanding after the last row."""
    last = F.max(F.struct("seq", "at", "n_placed", "n_parts", F.col("waits").isNull().alias("free")))
    return trace.where("seq IS NOT NULL").groupBy("user", "proc_id").agg(last.alias("l")).select("user", "proc_id", "l.n_placed", ((F.col("l.n_placed") == F.col("l.n_parts")) & F.col("l.free")).alias("complete"))


def report(trace: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A session's record from its trace: user, proc_id, duration (seconds from the first action to the last), actions,
    errors, by_reason (reason=count in order of reason, joined by commas), longest_part and longest (the first longest
    hesitation over 0), first_errors (part:reason of the first FIRST_ERRORS, joined by commas), n_placed, complete.

    names: proc_id, part_id, name of parts; a part without one goes by its id. Only the first errors of a session are
    gathered; all else is aggregated.
    """
    rows = trace.where("seq IS NOT NULL")
    if names is not None:
        known = names.select("proc_id", F.col("part_id").alias("part"), F.col("name").alias("_name"))
        rows = rows.join(known, ["proc_id", "part"], "left").withColumn("part", F.coalesce("_name", "part")).drop("_name")
    key = ["user", "proc_id"]
    slow = F.when(F.col("hesitation") > 0, F.struct((-F.col("hesitation")).alias("less"), "seq", "at", "part"))
    sums = rows.groupBy(*key).agg(F.max("at").alias("duration"), F.count("*").alias("actions"), F.count_if(~F.col("ok")).alias("errors"), F.min(slow).alias("s"))
    wrong = rows.where("NOT ok")
    kinds = wrong.groupBy(*key, "reason").agg(F.count("*").alias("k")).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.concat("reason", F.lit("="), F.col("k").cast("string")))), ",").alias("by_reason"))
    some = wrong.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("seq", "at"))).where(F.col("r") <= FIRST_ERRORS)
    first = some.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.coalesce("part", F.lit("")), F.lit(":"), "reason").alias("t")))), lambda x: x["t"]), ",").alias("first_errors"))
    out = sums
    for more in (kinds, first, finished(rows)):
        own = more.select(F.struct(*key).alias("_k"), *[c for c in more.columns if c not in key])
        out = out.join(own, F.struct(*key).eqNullSafe(F.col("_k")), "left").drop("_k")
    return out.select(*key, "duration", "actions", "errors", F.coalesce("by_reason", F.lit("")).alias("by_reason"), F.col("s.part").alias("longest_part"), (-F.col("s.less")).alias("longest"), F.coalesce("first_errors", F.lit("")).alias("first_errors"), "n_placed", "complete")
