"""Queries on users' sessions at procedures, replayed from the events table, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import table
from ..sources.tables import stored
from ..streaming import perform


def steps() -> pd.DataFrame:
    """A procedure whose parts are kinds of events; its second step waits for 24 N.m."""
    return pd.DataFrame({"id": ["s01", "s02", "s03", "s04"], "installs": [["view"], ["signup", "click"], [], ["purchase"]], "depends": [[], ["s01"], ["s02"], ["s02", "s03"]], "torque": [None, 24.0, None, None]})


def actions(spark: SparkSession, d: str) -> DataFrame:
    """Events as actions; every third enters a figure."""
    e = table(spark, d, "events")
    figure = F.when(F.col("event_id") % 2 == 0, 24.0).otherwise(F.col("value"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").cast("string").alias("user"), F.lit("0").alias("proc_id"), micros.alias("seq"), F.when(F.col("event_id") % 3 == 0, "torque").otherwise("attempt").alias("kind"), F.col("event_type").alias("part"), figure.alias("value"), (micros / 1e6).alias("ts"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    trace = stored(perform.traced(actions(spark, d), perform.one_plan(spark, steps())), "trace")
    names = spark.createDataFrame([("0", p, p.capitalize()) for p in ("view", "signup", "click", "purchase")], "proc_id string, part_id string, name string")
    return perform.report(trace, names).drop("proc_id")


QUERIES = {
    "perform_replay": lambda s, d: perform.replay(actions(s, d).drop("proc_id"), steps()),
    "perform_report": _report,
}

# a session's actions one by one: what is placed so far (view, signup, click, purchase), whether s02 waits, first and last time
_TRACE = """a AS (SELECT CAST(user_id AS VARCHAR) AS user, epoch_us(ts) AS seq, CASE WHEN event_id % 3 = 0 THEN 'torque' ELSE 'attempt' END AS kind, event_type AS part, CASE WHEN event_id % 2 = 0 THEN 24.0 ELSE value END AS value, epoch_us(ts) / 1e6 AS ts FROM events),
  o AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY seq, ts, kind, part NULLS FIRST, value NULLS FIRST) AS n FROM a),
  t(user, n, seq, part, ok, reason, hesitation, at_, entered, v, s, c, p, waits, began, last) AS (
    SELECT user, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BOOLEAN, 'skip', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, false, false, false, false, false, NULL::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT user FROM o)
    UNION ALL
    SELECT user, n, seq, CASE WHEN kind = 'torque' THEN 'signup' ELSE part END, coalesce(reason, 'torque-ok') = 'torque-ok', reason,
      CASE WHEN reason IS DISTINCT FROM 'skip' THEN now - coalesce(last, began, now) END, CASE WHEN reason IS DISTINCT FROM 'skip' THEN now - coalesce(began, now) END, CASE WHEN kind = 'torque' THEN value END,
      v OR (reason IS NULL AND part = 'view'), s OR (reason IS NULL AND part = 'signup'), c OR (reason IS NULL AND part = 'click'), p OR (reason IS NULL AND part = 'purchase'),
      CASE WHEN reason = 'torque-ok' THEN false WHEN reason IS NULL AND part IN ('signup', 'click') AND (s OR part = 'signup') AND (c OR part = 'click') THEN true ELSE waits END,
      CASE WHEN reason IS DISTINCT FROM 'skip' THEN coalesce(began, now) ELSE began END, CASE WHEN reason IS DISTINCT FROM 'skip' THEN now ELSE last END
    FROM (SELECT t.user, o.n, o.seq, o.kind, o.part, o.value, o.ts AS now, t.v, t.s, t.c, t.p, t.waits, t.began, t.last,
      CASE WHEN o.kind = 'torque' AND NOT t.waits THEN 'skip' WHEN o.kind = 'torque' AND abs(o.value - 24.0) <= 0.001 THEN 'torque-ok' WHEN o.kind = 'torque' THEN 'wrong-torque' WHEN t.waits THEN 'torque-outstanding'
        WHEN (o.part = 'view' AND t.v) OR (o.part = 'signup' AND t.s) OR (o.part = 'click' AND t.c) OR (o.part = 'purchase' AND t.p) THEN 'already-placed'
        WHEN o.part IS NULL OR o.part NOT IN ('view', 'signup', 'click', 'purchase') THEN 'no-step'
        WHEN (o.part IN ('signup', 'click') AND NOT t.v) OR (o.part = 'purchase' AND NOT (t.s AND t.c)) THEN 'out-of-order' END AS reason
      FROM t JOIN o ON o.user = t.user AND o.n = t.n + 1) x),
  trace AS (SELECT *, CAST(v AS INTEGER) + CAST(s AS INTEGER) + CAST(c AS INTEGER) + CAST(p AS INTEGER) AS placed, CASE WHEN part IN ('view', 'signup', 'click', 'purchase') THEN upper(part[1]) || part[2:] ELSE part END AS called FROM t WHERE reason IS DISTINCT FROM 'skip')"""

ORACLE_SQL = {
    "perform_replay": f"WITH RECURSIVE {_TRACE} SELECT user, seq, part, ok, reason, hesitation, at_ AS \"at\", entered FROM trace",
    "perform_report": f"""WITH RECURSIVE {_TRACE}, e AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY n) AS r FROM trace WHERE NOT ok),
      k AS (SELECT user, string_agg(reason || '=' || k, ',' ORDER BY reason || '=' || k) AS by_reason FROM (SELECT user, reason, count(*) AS k FROM e GROUP BY ALL) GROUP BY user),
      f AS (SELECT user, string_agg(called || ':' || reason, ',' ORDER BY r) AS first_errors FROM e WHERE r <= 4 GROUP BY user)
      SELECT t.user, max(at_) AS duration, count(*) AS actions, count(*) FILTER (WHERE NOT ok) AS errors, coalesce(any_value(by_reason), '') AS by_reason, arg_min(called, (-hesitation, n)) FILTER (WHERE hesitation > 0) AS longest_part, max(hesitation) FILTER (WHERE hesitation > 0) AS longest,
      coalesce(any_value(first_errors), '') AS first_errors, arg_max(placed, n) AS n_placed, arg_max(placed = 4 AND NOT waits, n) AS complete FROM trace t LEFT JOIN k USING (user) LEFT JOIN f USING (user) GROUP BY t.user""",
}
