"""Projections, predicates, joins and histograms that the engine's handlers are made of."""

from __future__ import annotations

from ..sources.bindings import AS_OF, SOURCE_TRUST, START
from .registry import statement


@statement("top_domains", "documents")
def top_domains(q):
    """AGG20: the three commonest sources of a batch."""
    return f"SELECT source, count(*) AS n FROM {q.table('documents')} GROUP BY source ORDER BY n DESC, source LIMIT 3"


@statement("ingest_counts", "documents")
def ingest_counts(q):
    """AGG21: stored, duplicate and rejected rows; rejected are those under 80 characters, duplicates later copies."""
    return f"""SELECT sum(CASE WHEN n_chars < 80 THEN 1 ELSE 0 END) AS rejected, sum(CASE WHEN n_chars >= 80 AND k > 1 THEN 1 ELSE 0 END) AS duplicate,
      sum(CASE WHEN n_chars >= 80 AND k = 1 THEN 1 ELSE 0 END) AS stored FROM (SELECT n_chars, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM {q.table("documents")}) t"""


@statement("skipped_reasons", "queue")
def skipped_reasons(q):
    """AGG22: why rows were skipped, by reason."""
    return f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN attempts >= 3 THEN 'exhausted' WHEN next_s > 883612800 THEN 'not-due' ELSE 'ready' END AS reason FROM {q.table("queue")}) t
      GROUP BY reason"""


@statement("distinct_entry_keys", "claim")
def distinct_keys(q):
    """AGG27: the entries that claims point to, once each."""
    return f"SELECT DISTINCT entry_id, verdict FROM {q.table('claim')}"


@statement("relevance_minmax", "entry")
def relevance(q):
    """AGG11: scores brought to 0..1 by the least and largest of the result; all 1 on a tie."""
    return f"""SELECT id, CASE WHEN hi = lo THEN 1.0 ELSE (n_chars - lo) * 1.0 / (hi - lo) END AS relevance
      FROM {q.table("entry")} CROSS JOIN (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM {q.table("entry")}) m"""


@statement("root_resolution", "entity")
def roots(q):
    """GRA2, FLT10: names to entities whatever their case; two or more are ambiguous; the least id comes along."""
    return f"SELECT lower(name) AS name, count(*) AS n, CASE WHEN count(*) = 1 THEN 'found' ELSE 'ambiguous' END AS state, min(id) AS first_id FROM {q.table('entity')} GROUP BY lower(name)"


@statement("rolling_windows", "claim")
def rolling(q):
    """FLT14: claims of the last 7, 30 and 90 days."""
    parts = ", ".join(f"sum(CASE WHEN created_s > {AS_OF} - {d} * 86400 THEN 1 ELSE 0 END) AS last_{d}" for d in (7, 30, 90))
    return f"SELECT verdict, {parts} FROM {q.table('claim')} GROUP BY verdict"


@statement("prefix_filter", "part")
def prefix(q):
    """FLT16: rows whose label starts with a prefix."""
    return f"SELECT p_partkey, p_type FROM {q.table('part')} WHERE p_type LIKE 'STANDARD%'"


@statement("json_predicate", "events")
def json_predicate(q):
    """FLT17, PRJ3: a number inside JSON as a predicate; a missing one counts as -1."""
    k = q.first("props", r'"k": ?([0-9]+)', 1)
    return f"SELECT event_id, CAST(coalesce(nullif({k}, ''), '-1') AS BIGINT) AS k FROM {q.table('events')} WHERE coalesce(nullif({k}, ''), '-1') <> '1'"


@statement("kg_eligible", "claim")
def eligible(q):
    """FLT20, SRT7: verified or unverified claims certain by half or more, verified first."""
    return f"""SELECT id, verdict, certainty FROM {q.table("claim")} WHERE verdict IN ('verified', 'unverified') AND certainty >= 0.5
      ORDER BY CASE verdict WHEN 'verified' THEN 0 ELSE 1 END, certainty DESC, created_s DESC, id LIMIT 50"""


@statement("composite_key_semi", "entry", "claim")
def composite(q):
    """FLT8: entries by pairs of keys, id and time of creation."""
    pairs = f"SELECT entry_id, CASE WHEN id % 3 = 0 THEN {START} + entry_id * 3600 ELSE created_s END AS at FROM {q.table('claim')}"
    return f"SELECT id, created_s FROM {q.table('entry')} e WHERE EXISTS (SELECT 1 FROM ({pairs}) p WHERE p.entry_id = e.id AND p.at = e.created_s)"


@statement("null_checks", "documents")
def nulls(q):
    """FLT9: rows with and without a value."""
    return f"SELECT sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN text IS NOT NULL THEN 1 ELSE 0 END) AS present FROM {q.table('documents')}"


@statement("edge_weight", "claim")
def edge_weight(q):
    """GRA7: certainty of an edge, halved unless verified, within 0..1."""
    return f"SELECT id, least(1.0, greatest(0.0, certainty * CASE WHEN verdict = 'verified' THEN 1.0 ELSE 0.5 END)) AS weight FROM {q.table('claim')}"


@statement("relation_claims", "kg_relation", "claim")
def relation_claims(q):
    """JON2: relations with the claim that they came from."""
    return f"SELECT r.src, r.dst, r.kind, c.id, c.verdict FROM {q.table('kg_relation')} r JOIN {q.table('claim')} c ON r.claim_id = c.id"


@statement("relation_both_ends", "claim_relation", "claim")
def both_ends(q):
    """JON3: a relation with the claims at both of its ends."""
    return f"""SELECT r.src, r.dst, r.kind, a.verdict AS src_verdict, b.verdict AS dst_verdict FROM {q.table("claim_relation")} r
      JOIN {q.table("claim")} a ON r.src = a.id JOIN {q.table("claim")} b ON r.dst = b.id"""


@statement("feedback_claims", "feedback", "claim")
def feedback_claims(q):
    """JON15: reports with the claims of the entry that they are on."""
    return f"SELECT c.verdict, f.signal, count(*) AS n FROM {q.table('feedback')} f JOIN {q.table('claim')} c ON f.entry_id = c.id GROUP BY c.verdict, f.signal"


@statement("out_and_in_edges", "claim_relation")
def out_and_in(q):
    """SET2: edges of a node both ways."""
    t = q.table("claim_relation")
    return f"SELECT src AS node, dst AS other, kind, 'out' AS way FROM {t} UNION ALL SELECT dst, src, kind, 'in' FROM {t}"


@statement("evidence_best_window", "evidence")
def best_window(q):
    """RNK9: of each claim's evidence that with the widest gap between entailment and contradiction; the first wins."""
    gap = "round(abs(entailment - contradiction), 9)"
    return f"""SELECT claim_id, id, round(entailment, 6) AS entailment, round(contradiction, 6) AS contradiction FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY {gap} DESC, id, entailment, contradiction) AS k FROM {q.table("evidence")}) t WHERE k = 1"""


@statement("decisiveness", "evidence")
def decisiveness(q):
    """RNK18: scores under .6 in every class ask for a second reading."""
    return f"SELECT claim_id, id, greatest(entailment, contradiction) >= 0.6 AS decisive FROM {q.table('evidence')}"


@statement("verdict_gate", "claim")
def verdict_gate(q):
    """RNK11: verdicts under the calibrated threshold fall back to unverified, without a certainty."""
    keep = "verdict IN ('verified', 'disputed') AND certainty >= 0.6"
    return f"SELECT id, CASE WHEN {keep} THEN verdict ELSE 'unverified' END AS gated, CASE WHEN {keep} THEN certainty END AS gated_certainty FROM {q.table('claim')}"


@statement("authority_priority", "entry_source")
def priority(q):
    """RNK15, STX26: a queue's priority from the best trust of a source."""
    return f"SELECT entry_id, CAST(round(max(trust) * 100) AS BIGINT) AS priority, count(*) AS sources FROM {q.table('entry_source')} GROUP BY entry_id"


@statement("retry_due", "queue")
def retry_due(q):
    """SRC17: due rows of fewer than three attempts, the longest waiting first."""
    return f"SELECT claim_id, next_s, attempts FROM {q.table('queue')} WHERE next_s <= 883612800 AND attempts < 3 ORDER BY next_s, claim_id LIMIT 10"


@statement("entity_key", "entity")
def entity_key(q):
    """STX17: kind and name, trimmed and lower-cased."""
    return f"SELECT id, kind || '|' || lower(trim(name)) AS key FROM {q.table('entity')}"


@statement("first_url", "pages")
def first_url(q):
    """STX27: the first address in a text."""
    return f"SELECT page_id, nullif({q.first('html', r'https?://[^\s<>\x22\x27]{8,1000}[^\s<>\x22\x27]{0,1000}')}, '') AS found FROM {q.table('pages')}"


@statement("language_guard", "documents")
def language_guard(q):
    """STX32: two lower-case letters, else English."""
    return f"SELECT doc_id, CASE WHEN {q.matches('lang', '^[a-z]{2}$')} THEN lang ELSE 'en' END AS language FROM {q.table('documents')}"


@statement("script_route", "documents")
def script_route(q):
    """STX33: a letter outside Latin sends the text to the multilingual model."""
    latin = r"\p{IsLatin}" if q.__name__ == "Spark" else r"\p{Latin}"
    return f"SELECT doc_id, CASE WHEN {q.matches('text', rf'[^{latin}\p{{N}}\s\p{{P}}\p{{S}}]')} THEN 'multilingual' ELSE 'latin' END AS route FROM {q.table('documents')}"


@statement("answer_parse", "conversations")
def answer(q):
    """STX35: yes, no or neither at the start of an answer, with the confidence of each."""
    yes, no = (q.matches(f"lower({q.trim('text')})", f"^{word}{q.ENDS}") for word in ("yes", "no"))
    return f"SELECT conv_id, turn, {yes} AS supported, CASE WHEN {yes} OR {no} THEN 0.85 ELSE 0.3 END AS confidence FROM {q.table('conversations')}"


# What texts about code and about papers look like; < stands for a word's edge.
KINDS = {
    "code": ["(?i)<(npm|cargo|pip|composer|gem|go install|bun install|yarn add)<", "(?i)<(function|class|interface|method|API|endpoint|library|framework|runtime|module)<",
             r"(?i)<(github\.com|gitlab|bitbucket)<", r"\.(js|ts|py|rs|go|java|rb|cpp|c|cs)<", "(?i)<(repo|repository|commit|pull request|branch)<"],
    "paper": ["(?i)<(paper|preprint|arxiv|study|research|published|journal)<", "(?i)<(authors? (?:show|demonstrate|find|propose|prove))<", r"(?i)<(et al\.?|doi:|arxiv:)<", r"<[0-9]{4}\.[0-9]{4,5}<"],
}


@statement("topic_kinds", "documents")
def topic_kinds(q):
    """FLT34: texts about code, papers, both or neither."""
    cols = ", ".join("(" + " OR ".join(q.matches("text", p.replace("<", q.EDGE)) for p in patterns) + f") AS {k}" for k, patterns in KINDS.items())
    return f"SELECT doc_id, {cols} FROM {q.table('documents')}"


@statement("trust_of_kinds", "entry_source")
def trust(q):
    """STX26: how far the sources of each kind are trusted; all kinds come from a fixed table."""
    known = ", ".join(f"'{k}'" for k in SOURCE_TRUST)
    return f"SELECT source_type, count(*) AS n, max(trust) AS trust, source_type IN ({known}) AS known FROM {q.table('entry_source')} GROUP BY source_type"
