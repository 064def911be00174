"""Evaluation, calibration, invariants, audit and training sets."""

from __future__ import annotations

from .registry import statement


@statement("golden_confusion", "golden")
def confusion(q):
    """AGG14: tp, fp, fn and support of each class."""
    g = q.table("golden")
    return f"""SELECT c.class, count(CASE WHEN expected = c.class AND predicted = c.class THEN 1 END) AS tp, count(CASE WHEN expected <> c.class AND predicted = c.class THEN 1 END) AS fp,
      count(CASE WHEN expected = c.class AND predicted <> c.class THEN 1 END) AS fn, count(CASE WHEN expected = c.class THEN 1 END) AS support
      FROM (SELECT DISTINCT expected AS class FROM {g}) c CROSS JOIN {g} g GROUP BY c.class"""


@statement("golden_macro_f1", "golden")
def macro(q):
    """AGG15, PIP9: mean precision, recall and F1 over the classes with support."""
    g = q.table("golden")
    return f"""WITH e AS (SELECT expected AS class, count(*) AS support, count(CASE WHEN expected = predicted THEN 1 END) AS tp FROM {g} GROUP BY expected), p AS (SELECT predicted AS class, count(*) AS said FROM {g} GROUP BY predicted),
      m AS (SELECT tp * 1.0 / coalesce(said, 1) AS pr, tp * 1.0 / support AS re FROM e LEFT JOIN p ON e.class = p.class)
      SELECT round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END), 6) AS macro_f1 FROM m"""


@statement("golden_by_type", "golden")
def by_type(q):
    """AGG16: a type's accuracy."""
    return f"SELECT kind, count(*) AS n, round(avg(CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {q.table('golden')} GROUP BY kind"


@statement("golden_regression_lag", "golden")
def regression(q):
    """WIN9: each run's score against the run before; a fall of over .02 is a regression (runs: blocks of 50 ids)."""
    return f"""WITH r AS (SELECT CAST(floor(id / 50) AS BIGINT) AS run, round(avg(CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END), 6) AS f1 FROM {q.table("golden")} GROUP BY CAST(floor(id / 50) AS BIGINT))
      SELECT run, f1, lag(f1) OVER (ORDER BY run) AS baseline, coalesce(f1 < lag(f1) OVER (ORDER BY run) - 0.02, false) AS regressed FROM r"""


@statement("calibration_sweep", "evidence")
def sweep(q):
    """AGG17, PIP8: F1 at thresholds .5 to .9; the first best."""
    e = q.table("evidence")
    return f"""WITH t AS (SELECT k, 0.5 + k * 0.05 AS threshold FROM (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) x),
      c AS (SELECT k, count(CASE WHEN entailment >= threshold AND authority >= 0.5 THEN 1 END) AS tp, count(CASE WHEN entailment >= threshold AND authority < 0.5 THEN 1 END) AS fp,
      count(CASE WHEN entailment < threshold AND authority >= 0.5 THEN 1 END) AS fn FROM t CROSS JOIN {e} e GROUP BY k)
      SELECT k, tp, fp, fn, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c"""


@statement("smoke_eval_match", "claim")
def smoke(q):
    """AGG23, PIP7: a rotating twentieth of the certain claims, matched and diverged."""
    return f"SELECT count(*) AS sampled, count(CASE WHEN verdict = 'verified' THEN 1 END) AS matched, count(CASE WHEN verdict <> 'verified' THEN 1 END) AS diverged FROM {q.table('claim')} WHERE certainty >= 0.8 AND (id + 7) % 20 IN (0, 1)"


@statement("factuality_by_entry", "claim")
def factuality(q):
    """AGG4, SNK5: the share of an entry's claims that are verified."""
    return f"SELECT entry_id, round(avg(CASE WHEN verdict = 'verified' THEN 1.0 ELSE 0.0 END), 6) AS factuality FROM {q.table('claim')} WHERE verdict <> 'not-applicable' GROUP BY entry_id"


@statement("top_claims_per_entry", "claim")
def top_claims(q):
    """WIN1-2: five claims an entry by certainty, then the newest."""
    return f"SELECT entry_id, id, CAST(place AS BIGINT) AS place FROM (SELECT entry_id, id, row_number() OVER (PARTITION BY entry_id ORDER BY certainty DESC, created_s DESC, id DESC) AS place FROM {q.table('claim')}) x WHERE place <= 5"


@statement("invariant_counts", "entry", "claim", "kg_relation", "entity", "queue", "evidence")
def invariants(q):
    """PIP10, FLT15, JON8: violations of the five invariants, none counted past 1,000."""
    c, k, n = q.table("claim"), q.table("kg_relation"), q.table("entity")
    tags = f"(SELECT id + 3 AS entry_id, created_s + 3 * 3600 AS at FROM {q.table('entry')})"
    checks = {
        "claim_missing_evidence_but_verified": f"SELECT c.id FROM {c} c LEFT JOIN (SELECT DISTINCT claim_id FROM {q.table('evidence')}) v ON v.claim_id = c.id WHERE c.verdict IN ('verified', 'disputed') AND v.claim_id IS NULL",
        "verify_queue_orphaned": f"SELECT w.claim_id FROM {q.table('queue')} w LEFT JOIN {c} c ON c.id = w.claim_id WHERE c.id IS NULL",
        "kg_relation_orphan_entity": f"SELECT r.src FROM {k} r LEFT JOIN {n} s ON s.id = r.src LEFT JOIN {n} t ON t.id = r.dst WHERE s.id IS NULL OR t.id IS NULL",
        "entry_tag_orphan": f"SELECT t.entry_id FROM {tags} t LEFT JOIN {q.table('entry')} e ON e.id = t.entry_id AND e.created_s = t.at WHERE e.id IS NULL",
        "claim_stuck_in_queue_over_24h": f"SELECT claim_id FROM {q.table('queue')} WHERE queued_s < 883612800 - 86400 AND attempts < 3",
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM ({sql} LIMIT 1000) {name}" for name, sql in checks.items())


@statement("audit_summary", "entry", "feedback")
def audit(q):
    """AGG1-2, AGG10, API8: totals, active entries and mean length, latest report."""
    return f"""SELECT (SELECT count(*) FROM {q.table("entry")}) AS entries, (SELECT count(*) FROM {q.table("entry")} WHERE status = 'active') AS active,
      (SELECT round(coalesce(avg(n_chars), 0), 3) FROM {q.table("entry")}) AS mean_chars, (SELECT max(ts_s) FROM {q.table("feedback")}) AS last_report"""


@statement("domain_distribution", "entry")
def domains(q):
    """AGG3: entries by domain, 20 at most."""
    return f"SELECT language, count(*) AS n FROM {q.table('entry')} GROUP BY language ORDER BY n DESC, language LIMIT 20"


@statement("train_sets_union", "claim", "golden", "feedback")
def train_sets(q):
    """PIP12, SET5, AGG24: training rows by task."""
    return f"""SELECT task, count(*) AS n FROM (SELECT 'verdict' AS task, id FROM {q.table("claim")} WHERE verdict IN ('verified', 'disputed') UNION ALL SELECT 'quality', id FROM {q.table("golden")}
      UNION ALL SELECT 'feedback', id FROM {q.table("feedback")} WHERE event_type = 'purchase') x GROUP BY task"""


@statement("golden_leak_guard", "documents", "benchmark")
def leak(q):
    """FLT12: documents whose whole text is no benchmark passage."""
    return f"SELECT doc_id FROM {q.table('documents')} d WHERE NOT EXISTS (SELECT 1 FROM {q.table('benchmark')} b WHERE b.text = d.text)"


@statement("length_summary", "documents")
def lengths(q):
    """AGG28: number, least, median, 95th percentile, most and mean length by language, from counts of each length."""
    at = lambda p: f"min(CASE WHEN upto > floor(n * {p}) THEN n_chars END)"
    return f"""WITH c AS (SELECT lang, n_chars, count(*) AS k FROM {q.table("documents")} GROUP BY lang, n_chars),
      u AS (SELECT lang, n_chars, k, sum(k) OVER (PARTITION BY lang ORDER BY n_chars) AS upto, sum(k) OVER (PARTITION BY lang) AS n FROM c)
      SELECT lang, CAST(max(n) AS BIGINT) AS n, min(n_chars) AS least, {at(0.5)} AS p50, {at(0.95)} AS p95, max(n_chars) AS most, round(sum(k * n_chars) * 1.0 / max(n), 6) AS mean FROM u GROUP BY lang"""


# Upper bounds of the latency buckets, in milliseconds.
BUCKETS = [50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000, 180000]


@statement("latency_histogram", "events")
def histogram(q):
    """AGG29: cumulative counts in fixed buckets, with sum and count, a type."""
    cells = ", ".join(f"count(CASE WHEN value * 400 <= {b} THEN 1 END) AS le_{b}" for b in BUCKETS)
    return f"SELECT event_type, {cells}, count(*) AS n, round(sum(value * 400), 3) AS total FROM {q.table('events')} GROUP BY event_type"


@statement("promotion_gate", "golden")
def promotion(q):
    """RNK19, AGG25, WIN12: a run is promoted at accuracy .6 or more and within .02 of the best run before."""
    run = "CAST(floor(id / 50) AS BIGINT)"
    return f"""WITH r AS (SELECT {run} AS run, round(avg(CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {q.table("golden")} GROUP BY {run}),
      b AS (SELECT run, accuracy, max(accuracy) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM r)
      SELECT run, accuracy, accuracy >= 0.6 AND (baseline IS NULL OR accuracy >= baseline - 0.02) AS promoted FROM b"""


@statement("set_operations", "entry", "claim")
def set_operations(q):
    """SET6: entries with claims and without, by intersection and difference."""
    e, c = q.table("entry"), q.table("claim")
    return f"SELECT 'both' AS part, count(*) AS n FROM (SELECT id FROM {e} INTERSECT SELECT entry_id FROM {c}) x UNION ALL SELECT 'entries-only', count(*) FROM (SELECT id FROM {e} EXCEPT SELECT entry_id FROM {c}) y"
