"""Queues as snapshots: ageing, backoff, expiry, upserts."""

from __future__ import annotations

from .registry import statement
from .scoring import STRENGTH

NOW = 883612800  # 1998-01-01T00:00:00Z, within the orders' dates


@statement("verify_queue_due", "queue")
def due(q):
    """SRT5, FLT19, STR2: due rows by priority + a point for each half hour of age."""
    return f"SELECT claim_id, round(priority + ({NOW} - queued_s) / 1800.0, 6) AS rank FROM {q.table('queue')} WHERE next_s <= {NOW} AND attempts < 3 ORDER BY priority + ({NOW} - queued_s) / 1800.0 DESC, claim_id LIMIT 50"


@statement("retry_backoff", "queue")
def backoff(q):
    """DTM5, MTH8, STR3: the next attempt 5^n minutes on; the third failure ends it."""
    return f"SELECT claim_id, attempts + 1 AS attempts, CAST(queued_s + 60 * power(5, attempts + 1) AS BIGINT) AS next_s, CASE WHEN attempts + 1 >= 3 THEN 'unverified' ELSE 'queued' END AS state FROM {q.table('queue')}"


@statement("drift_candidates", "claim")
def drift(q):
    """FLT18, SRT6, PIP6: verdicts older than 14 days or past their date, the expired first, then what was checked longest ago; certainty would halve."""
    at = 1704067200 + 40 * 86400
    expired = f"coalesce(valid_until_s < {at}, false)"
    return f"""SELECT id, {expired} AS expired, certainty / 2 AS halved FROM {q.table("claim")} WHERE verdict IN ('verified', 'disputed') AND (created_s < {at} - 14 * 86400 OR {expired})
      ORDER BY CASE WHEN {expired} THEN 0 ELSE 1 END, created_s NULLS FIRST, id LIMIT 100"""


@statement("ttl_expire", "feedback")
def ttl(q):
    """SNK14, STR7: reports that waited over a day expire."""
    return f"SELECT id, CASE WHEN event_type = 'view' AND ts_s < (SELECT max(ts_s) FROM {q.table('feedback')}) - 86400 THEN 'expired' ELSE 'awaiting-pull' END AS status FROM {q.table('feedback')}"


@statement("fqa_candidates", "report")
def fqa(q):
    """FLT21, PIP11: weak reports of failure of the last day that wait for more evidence, weakest first."""
    r = q.table("report")
    return f"""SELECT id, strength FROM (SELECT id, outcome, ts_s, CAST({STRENGTH} AS DOUBLE) AS strength FROM {r}) x WHERE strength < 0.8 AND outcome <> 'held' AND ts_s > (SELECT max(ts_s) FROM {r}) - 86400
      ORDER BY strength, id LIMIT 50"""


@statement("unclaimed_entries_anti", "entry", "claim")
def unclaimed(q):
    """FLT13, JON10: entries without a claim."""
    return f"SELECT id FROM {q.table('entry')} e WHERE NOT EXISTS (SELECT 1 FROM {q.table('claim')} c WHERE c.entry_id = e.id)"


@statement("requeue_upsert", "queue", "feedback")
def requeue(q):
    """SNK2, API2: reports of error requeue a claim at priority 100 or more with no attempts, new claims too."""
    return f"""WITH f AS (SELECT DISTINCT entry_id AS claim_id FROM {q.table("feedback")} WHERE signal = 'negative')
      SELECT coalesce(o.claim_id, f.claim_id) AS claim_id, CASE WHEN f.claim_id IS NULL THEN o.priority ELSE greatest(coalesce(o.priority, 0), 100) END AS priority,
      CASE WHEN f.claim_id IS NULL THEN o.attempts ELSE 0 END AS attempts FROM {q.table("queue")} o FULL OUTER JOIN f ON o.claim_id = f.claim_id"""


@statement("enrichment_status", "report")
def enrichment(q):
    """RNK16-17: a report that held or is strong needs nothing; weak failures on claims of authority .5 or more wait for the reporter, the rest is final."""
    return f"""SELECT id, CASE WHEN outcome = 'held' OR s >= 0.8 THEN 'not-needed' WHEN claim_authority >= 0.5 THEN 'awaiting-pull' ELSE 'finalized-inferred' END AS status
      FROM (SELECT id, outcome, claim_authority, CAST({STRENGTH} AS DOUBLE) AS s FROM {q.table("report")}) x"""


@statement("yearly_rollover", "queue")
def rollover(q):
    """SRC3: rows by year of arrival, which partitions the stored table."""
    year = f"CAST(floor((queued_s - {694224000}) / 31557600.0) AS BIGINT) + 1992"
    return f"SELECT {year} AS year, count(*) AS n, min(queued_s) AS first_s, max(queued_s) AS last_s FROM {q.table('queue')} GROUP BY {year}"
