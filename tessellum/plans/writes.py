"""Writes as snapshots: what each table holds after an upsert, an append, a cascade or a commit."""

from __future__ import annotations

from ..sources.bindings import AS_OF
from .registry import statement

HALF = 5000  # reports up to this id are what the tables held before


@statement("reporter_counter_upsert", "feedback")
def reporters(q):
    """SNK4: one more report for each reporter known, and trust .5 at first contact."""
    f = q.table("feedback")
    return f"""WITH o AS (SELECT agent_id, count(*) AS reports, 0.6 AS trust FROM {f} WHERE id <= {HALF} AND agent_id % 2 = 0 GROUP BY agent_id),
      n AS (SELECT agent_id, count(*) AS reports FROM {f} WHERE id > {HALF} GROUP BY agent_id)
      SELECT coalesce(o.agent_id, n.agent_id) AS agent_id, coalesce(o.reports, 0) + coalesce(n.reports, 0) AS reports, coalesce(o.trust, 0.5) AS trust FROM o FULL OUTER JOIN n ON o.agent_id = n.agent_id"""


@statement("entry_score_upsert", "claim")
def entry_score(q):
    """SNK5: factuality of the entries whose claims have verdicts; the others keep what they had."""
    c = q.table("claim")
    return f"""WITH o AS (SELECT DISTINCT entry_id, 0.25 AS factuality FROM {c}), n AS (SELECT entry_id, sum(CASE WHEN verdict = 'verified' THEN 1.0 ELSE 0.0 END) / count(*) AS factuality FROM {c}
      WHERE verdict IN ('verified', 'disputed') AND id % 2 = 0 GROUP BY entry_id)
      SELECT o.entry_id, round(coalesce(n.factuality, o.factuality), 6) AS factuality FROM o LEFT JOIN n ON o.entry_id = n.entry_id"""


@statement("retry_upsert", "queue")
def retry(q):
    """SNK6: due rows leave the retry table; those that fail again come back with one attempt more, 5^n minutes on, until the third."""
    w, now = q.table("queue"), 883612800
    return f"""SELECT claim_id, attempts, next_s FROM {w} WHERE next_s > {now} OR attempts >= 3
      UNION ALL SELECT claim_id, attempts + 1, CAST({now} + 60 * power(5, attempts + 1) AS BIGINT) FROM {w} WHERE next_s <= {now} AND attempts < 2 AND claim_id % 2 = 0"""


@statement("kg_insert_ignore", "kg_relation")
def kg_insert(q):
    """SNK8, GRA11: relations by (source, target, type, claim), without those known and without loops."""
    k = q.table("kg_relation")
    return f"""SELECT DISTINCT n.src, n.dst, n.kind, n.claim_id FROM (SELECT src, CASE WHEN claim_id % 11 = 0 THEN src ELSE dst END AS dst, kind, claim_id + claim_id % 2 AS claim_id FROM {k}) n
      LEFT JOIN {k} o ON n.src = o.src AND n.dst = o.dst AND n.kind = o.kind AND n.claim_id = o.claim_id WHERE o.src IS NULL AND n.src <> n.dst"""


@statement("entity_upsert", "entity")
def entity_upsert(q):
    """SNK9, GRA6: a name of a kind that is known, whatever its case, is that entity; of several new writers the least id wins."""
    e = q.table("entity")
    return f"""WITH new AS (SELECT 'x' || id AS id, upper(name) AS name, CASE WHEN length(id) % 2 = 0 THEN kind ELSE 'other' END AS kind FROM {e} UNION ALL SELECT 'y' || id, name, 'other' FROM {e}),
      known AS (SELECT kind, lower(trim(name)) AS key, min(id) AS id FROM {e} GROUP BY kind, lower(trim(name))), first_new AS (SELECT kind, lower(trim(name)) AS key, min(id) AS id FROM new GROUP BY kind, lower(trim(name)))
      SELECT f.kind, f.key, coalesce(k.id, f.id) AS id, k.id IS NULL AS inserted FROM first_new f LEFT JOIN known k ON f.kind = k.kind AND f.key = k.key"""


LOG = "CASE WHEN n_chars < 80 THEN 'rejected' WHEN k > 1 THEN 'duplicate' ELSE 'stored' END"


@statement("ingest_log_append", "documents")
def ingest_log(q):
    """SNK10: a log row for each input: what was done with it and why."""
    return f"""SELECT doc_id, {LOG} AS action, CASE WHEN n_chars < 80 THEN 'too_short' WHEN k > 1 THEN 'similar_to=' || CAST(first_id AS VARCHAR(20)) END AS reason FROM (
      SELECT doc_id, n_chars, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k, min(doc_id) OVER (PARTITION BY text) AS first_id FROM {q.table("documents")}) t"""


def verdicts(q) -> str:
    """The new verdict of each claim with evidence, and its certainty."""
    lead, authority = q.mean("lead", "entailment - contradiction"), q.mean("authority", "authority")
    rows = q.in_order("evidence", "claim_id", lead="entailment - contradiction", authority="authority")
    return f"SELECT claim_id, CASE WHEN {lead} >= 0.2 THEN 'verified' WHEN {lead} <= 0 THEN 'disputed' ELSE 'unverified' END AS verdict, {q.rounded(authority)} AS certainty FROM {rows} GROUP BY claim_id"


@statement("verdict_commit_claims", "claim", "evidence")
def commit_claims(q):
    """SNK11: claims with a new verdict take it, and its certainty as their authority; the others stay."""
    return f"""SELECT c.id, coalesce(n.verdict, c.verdict) AS verdict, coalesce(n.certainty, c.certainty) AS certainty, n.certainty AS authority FROM {q.table("claim")} c
      LEFT JOIN ({verdicts(q)}) n ON n.claim_id = c.id"""


@statement("verdict_commit_log", "claim", "evidence")
def commit_log(q):
    """SNK11, SNK10: a log row with the verdict before and after."""
    return f"""SELECT c.id AS claim_id, c.verdict AS old_verdict, n.verdict AS new_verdict, n.certainty FROM {q.table("claim")} c JOIN ({verdicts(q)}) n ON n.claim_id = c.id"""


@statement("verdict_commit_queue", "queue", "evidence")
def commit_queue(q):
    """SNK11: what got a verdict leaves the queue."""
    return f"SELECT claim_id, priority FROM {q.table('queue')} w WHERE NOT EXISTS (SELECT 1 FROM {q.table('evidence')} e WHERE e.claim_id = w.claim_id AND e.id > 4)"


@statement("metadata_merge", "events")
def metadata(q):
    """SNK12: a key merged into stored JSON."""
    merged = f"to_json(map_concat(from_json(props, 'map<string,bigint>'), map('outdated_at', CAST({AS_OF} + event_id AS BIGINT))))"
    if q.__name__ == "Duck":
        merged = f"CAST(json_merge_patch(props, json_object('outdated_at', {AS_OF} + event_id)) AS VARCHAR)"
    return f"SELECT event_id, {merged} AS props FROM {q.table('events')} WHERE event_type = 'error'"


@statement("delete_cascade", "documents", "entry", "entry_source", "claim")
def cascade(q):
    """SNK13: rows of every table that are left once duplicate entries go, children with them."""
    gone = f"(SELECT doc_id AS gone FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM {q.table('documents')}) t WHERE k > 1)"
    parts = [("entry", "id"), ("entry_source", "entry_id"), ("claim", "entry_id")]
    return " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {q.table(t)} x LEFT JOIN {gone} g ON x.{key} = g.gone WHERE g.gone IS NULL" for t, key in parts)


@statement("finalize_unverified", "queue")
def finalize(q):
    """SNK15: a claim whose third attempt failed is unverified with certainty 0, logged and out of the queue; its authority stays."""
    return f"SELECT claim_id, 'unverified' AS verdict, 0.0 AS certainty, 'exhausted' AS reason FROM {q.table('queue')} WHERE attempts >= 3"


@statement("replace_domains", "entry")
def replace_domains(q):
    """SNK16, PIP5: entries without a good domain get the new ones in place of theirs; others keep theirs."""
    e = q.table("entry")
    return f"""WITH new AS (SELECT id, 'topic-' || CAST(id % 5 AS VARCHAR(5)) AS domain FROM {e} WHERE id % 4 = 0 UNION ALL SELECT id, 'lang-' || language FROM {e} WHERE id % 4 = 0)
      SELECT o.id, o.source AS domain FROM {e} o LEFT JOIN (SELECT DISTINCT id FROM new) n ON n.id = o.id WHERE n.id IS NULL UNION ALL SELECT id, domain FROM new"""


@statement("claim_feedback_fill", "feedback")
def feedback_fill(q):
    """SNK17, API3: a second report fills what the first left null, and never replaces a value."""
    f, part = q.table("feedback"), "CASE WHEN value >= 50 THEN value END AS score, CASE WHEN id % 3 = 0 THEN event_type END AS dimension"
    return f"""WITH o AS (SELECT agent_id, entry_id, score, dimension FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, entry_id ORDER BY id) AS n FROM (SELECT id, agent_id, entry_id, {part} FROM {f}) x) y WHERE n = 1),
      n AS (SELECT agent_id, entry_id, max(score) AS score, max(dimension) AS dimension FROM (SELECT agent_id, entry_id, {part} FROM {f}) x GROUP BY agent_id, entry_id)
      SELECT o.agent_id, o.entry_id, coalesce(o.score, n.score) AS score, coalesce(o.dimension, n.dimension) AS dimension FROM o JOIN n ON o.agent_id = n.agent_id AND o.entry_id = n.entry_id"""


@statement("run_record", "golden")
def run_record(q):
    """SNK19: a run's figures as one JSON text."""
    cells = "kind, count(*) AS n, sum(CASE WHEN expected = predicted THEN 1 ELSE 0 END) AS hits"
    body = "to_json(named_struct('kind', kind, 'n', n, 'hits', hits))" if q.__name__ == "Spark" else "CAST(json_object('kind', kind, 'n', n, 'hits', hits) AS VARCHAR)"
    return f"SELECT kind, {body} AS record FROM (SELECT {cells} FROM {q.table('golden')} GROUP BY kind) g"


@statement("verdict_edges", "evidence", "claim")
def verdict_edges(q):
    """SNK20: an edge to each source that supports or contradicts a claim, with its certainty as weight and the source in its metadata."""
    return f"""SELECT DISTINCT e.claim_id AS src, e.id AS dst, CASE WHEN e.entailment > e.contradiction THEN 'supports' ELSE 'contradicts' END AS kind, round(c.certainty, 6) AS weight,
      {q.json_source()} AS metadata FROM {q.table("evidence")} e JOIN {q.table("claim")} c ON c.id = e.claim_id WHERE c.verdict IN ('verified', 'disputed') AND greatest(e.entailment, e.contradiction) >= 0.6"""


@statement("audit_drain", "feedback")
def drain(q):
    """STR6: which of five passes of 50 takes each waiting report; what is left waits for the next run."""
    return f"SELECT id, CAST(floor((n - 1) / 50.0) AS BIGINT) AS pass FROM (SELECT id, row_number() OVER (ORDER BY ts_s, id) AS n FROM (SELECT id, ts_s FROM {q.table('feedback')} WHERE event_type = 'error' ORDER BY ts_s, id LIMIT 250) w) x"
