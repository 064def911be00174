"""Claim verification algebra."""

from __future__ import annotations

from .registry import statement


@statement("evidence_log_odds", "evidence")
def log_odds(q):
    """RNK4, AGG18, WIN4, MTH4: damped log-odds over independent groups and the verdict they give."""
    return f"""WITH r AS (SELECT claim_id, (entailment - contradiction) * authority * power(0.4, row_number() OVER (PARTITION BY claim_id, grp ORDER BY authority DESC, id, entailment, contradiction) - 1) * 4 AS x FROM {q.table("evidence")}),
      p AS (SELECT claim_id, 1 / (1 + exp(-round(sum(x), 9))) AS p FROM r GROUP BY claim_id)
      SELECT claim_id, round(p, 6) AS posterior, CASE WHEN p >= 0.7 THEN 'verified' WHEN p <= 0.3 THEN 'disputed' ELSE 'unverified' END AS verdict,
      round(CASE WHEN p >= 0.7 THEN p WHEN p <= 0.3 THEN 1 - p ELSE greatest(p, 1 - p) END, 6) AS certainty FROM p"""


@statement("cove_combine", "evidence")
def cove(q):
    """RNK14, AGG26: a disputed sub-claim disputes the claim with the largest certainty; all verified verify it with the least."""
    return f"""WITH s AS (SELECT claim_id, CASE WHEN entailment > 0.6 THEN 'verified' WHEN entailment < 0.1 THEN 'disputed' ELSE 'verified' END AS v, CAST(authority AS DOUBLE) AS c FROM {q.table("evidence")})
      SELECT claim_id, CASE WHEN count(CASE WHEN v = 'disputed' THEN 1 END) > 0 THEN 'disputed' ELSE 'verified' END AS verdict,
      round(CASE WHEN count(CASE WHEN v = 'disputed' THEN 1 END) > 0 THEN max(CASE WHEN v = 'disputed' THEN c END) ELSE min(c) END, 6) AS certainty FROM s GROUP BY claim_id"""


@statement("escalation_vote", "evidence")
def escalation(q):
    """RNK10: votes move a middling certainty: all agree +.15 up to .95, none halves it, mixed x .85."""
    moved = "CASE WHEN c < 0.4 OR c >= 0.7 THEN c WHEN agree = n THEN least(0.95, c + 0.15) WHEN agree = 0 THEN c * 0.5 ELSE c * 0.85 END"
    return f"""SELECT claim_id, {q.rounded(moved)} AS certainty FROM (
      SELECT claim_id, CAST({q.mean("authority", "authority")} AS DOUBLE) AS c, count(CASE WHEN entailment > contradiction THEN 1 END) AS agree, count(*) AS n FROM {q.in_order("evidence", "claim_id", authority="authority")} GROUP BY claim_id) x"""


@statement("verify_cascade", "evidence", "kg_relation")
def cascade(q):
    """RNK12: cross-reference first, then a conflict in the graph, then the sources' log-odds; the first that decides holds."""
    return f"""WITH e AS (SELECT claim_id, count(CASE WHEN entailment >= 0.8 THEN 1 END) AS pro, count(CASE WHEN contradiction >= 0.4 THEN 1 END) AS con, round(sum((entailment - contradiction) * authority * 4), 9) AS x FROM {q.table("evidence")} GROUP BY claim_id),
      k AS (SELECT claim_id, least(0.95, 0.7 + 0.05 * least(count(*), 5)) AS w FROM {q.table("kg_relation")} WHERE weight >= 0.09 GROUP BY claim_id)
      SELECT e.claim_id, CASE WHEN pro >= 3 AND con = 0 THEN 'verified' WHEN coalesce(k.w, 0) >= 0.7 THEN 'disputed' WHEN 1 / (1 + exp(-x)) >= 0.7 THEN 'verified' WHEN 1 / (1 + exp(-x)) <= 0.3 THEN 'disputed' ELSE 'unverified' END AS verdict
      FROM e LEFT JOIN k ON e.claim_id = k.claim_id"""


@statement("independence_groups_domain", "evidence")
def groups(q):
    """JON17: evidence of one group counts once, with its best authority."""
    return f"SELECT claim_id, count(DISTINCT grp) AS independent, CAST(max(authority) AS DOUBLE) AS best FROM {q.table('evidence')} GROUP BY claim_id"
