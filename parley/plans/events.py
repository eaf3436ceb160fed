"""Queries over the event table: freshness, replays, sessions, the hand-off gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import handoff
from .conversations import unit_sql
from .registry import Tables, query

# an event counts as received a hash of its id after (or before) it was issued
_DELAY_SQL = f"(({unit_sql('event_id', 'delay')} * 900)::INT - 200)"


def received(t: Tables) -> DataFrame:
    from ..functions.hashing import unit32

    delay = F.round(unit32(F.col("event_id").cast("string"), "delay") * 900).cast("int") - 200
    return t.events.withColumn("now", F.timestamp_micros(handoff.micros(F.col("ts")) + delay.cast("long") * 1_000_000))


@query(f"SELECT event_id, CASE WHEN d > 300 THEN 'stale' WHEN d < -60 THEN 'future' ELSE 'fresh' END AS state FROM (SELECT event_id, {_DELAY_SQL} AS d FROM events)")
def event_freshness(t: Tables) -> DataFrame:
    return received(t).select("event_id", handoff.freshness(F.col("ts"), F.col("now")).alias("state"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id, event_type")
def event_dedup(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session""")
def user_sessions(t: Tables) -> DataFrame:
    return handoff.user_sessions(t.events)


@query("""SELECT event_id, CASE WHEN NOT is_scam THEN 'blocked' WHEN s < 0.2 THEN 'blocked' WHEN NOT eligible THEN 'blocked' ELSE 'live' END AS mode,
CASE WHEN NOT is_scam THEN 'detector_did_not_flag_scam' WHEN s < 0.2 THEN 'scam_score_below_minimum' WHEN NOT eligible THEN 'detector_is_research_only' END AS reason
FROM (SELECT event_id, event_id % 3 = 0 AS is_scam, event_id % 100 / 100.0 AS s, event_id % 2 = 0 AS eligible FROM events)""")
def handoff_gate(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", (F.col("event_id") % 3 == 0).alias("is_scam"), (F.col("event_id") % 100 / 100.0).alias("scam_score"),
        (F.col("event_id") % 2 == 0).alias("production_eligible"),
    )
    g = handoff.gate(handoff.Policy(enabled=True, minimum_scam_score=0.2))
    return rows.select("event_id", g["mode"].alias("mode"), g["reason"].alias("reason"))
