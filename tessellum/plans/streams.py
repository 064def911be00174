"""Queries over streams: the events table read as a stream and drained once."""

from __future__ import annotations

from ..streaming import windows as st
from .registry import ORACLES, QUERIES

QUERIES["stream_hourly_feedback"] = lambda spark, d: st.drain(st.hourly(st.events(spark, d)), "complete")
ORACLES["stream_hourly_feedback"] = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2"

QUERIES["stream_session_users"] = lambda spark, d: st.drain(st.sessions(st.events(spark, d)), "complete")
ORACLES["stream_session_users"] = """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS "from", max(ts) + INTERVAL 30 MINUTE AS "to", count(*) AS n FROM s GROUP BY user_id, k"""

QUERIES["stream_dedup_events"] = lambda spark, d: st.drain(st.distinct_events(st.events(spark, d)), "append")
ORACLES["stream_dedup_events"] = "SELECT DISTINCT event_id, ts, event_type FROM events"

# the decisions depend on one another, which SQL can't express; a test holds them against the batch operator and a plain fold
QUERIES["stream_rate_limit_state"] = lambda spark, d: st.drain(st.limited(st.events(spark, d)), "append")
