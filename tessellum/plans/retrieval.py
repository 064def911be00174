"""Ranked retrieval: scans, filters, keyset pages, keyword search, freshness, trust."""

from __future__ import annotations

from ..sources.bindings import AS_OF, load
from .dialect import Duck
from .registry import frame, statement

AUTHORITY = """SELECT entry_id, CASE WHEN count(*) = 1 THEN max(trust) ELSE max(trust) * 0.8 + avg(trust) * 0.2 END AS authority FROM {s} GROUP BY entry_id"""
LEVEL = "CASE WHEN authority >= 0.7 THEN 'high' WHEN authority >= 0.4 THEN 'medium' ELSE 'low' END"
FRESH = f"exp(-decay_rate * ({AS_OF} - created_s) / 86400.0)"


def _explore(q, first: int, last: int) -> str:
    return f"""SELECT id, language, round(authority, 6) AS authority, round(fresh, 6) AS freshness, round(0.4 * authority + 0.6 * fresh, 6) AS final, {LEVEL} AS trust_level FROM (
      SELECT e.id, e.language, a.authority, {FRESH} AS fresh FROM {q.table("entry")} e JOIN ({AUTHORITY.replace("{s}", q.table("entry_source"))}) a ON e.id = a.entry_id
      WHERE e.status = 'active' AND a.authority >= 0.4) x ORDER BY 0.4 * authority + 0.6 * fresh DESC, id DESC LIMIT {last}"""


EXPLORE_SQL = _explore(Duck, 1, 20)


@frame("explore_ranked", EXPLORE_SQL, "entry", "entry_source")
def explore_ranked(spark, sf_dir):
    """RNK2, RNK3, FLT2, SRT2: active entries of at least medium trust, by authority and freshness."""
    from ..operators import retrieval as op

    entries, sources = load(spark, sf_dir, "entry"), load(spark, sf_dir, "entry_source")
    return op.explore(entries, sources, as_of=AS_OF, min_authority=0.4, limit=20)


@statement("explore_page2_keyset", "entry", "entry_source")
def explore_page2(q):
    """FLT6, SRT4: the page strictly after the tenth entry, by (authority, id)."""
    a = AUTHORITY.replace("{s}", q.table("entry_source"))
    return f"""WITH r AS (SELECT entry_id AS id, round(authority, 9) AS authority FROM ({a}) a),
      cur AS (SELECT authority AS ca, id AS ci FROM (SELECT authority, id, row_number() OVER (ORDER BY authority DESC, id DESC) AS n FROM r) x WHERE n = 10)
      SELECT r.id, round(r.authority, 6) AS authority FROM r JOIN cur ON r.authority < cur.ca OR (r.authority = cur.ca AND r.id < cur.ci) ORDER BY r.authority DESC, r.id DESC LIMIT 10"""


TERMS = ["the", "tion", "elle", "und"]


@statement("search_or_terms", "entry", "entry_source")
def search_or_terms(q):
    """RNK1, RNK2, SRT1, WIN5: any-term search; relevance min-max scaled over the candidate pool, then .5/.2/.3."""
    tf = " + ".join(q.count("lower(content)", rf"(?:^|[^\p{{L}}\p{{N}}]){t}") for t in TERMS)
    return f"""WITH c AS (SELECT e.id, {tf} AS tf, a.authority, {FRESH} AS fresh FROM {q.table("entry")} e JOIN ({AUTHORITY.replace("{s}", q.table("entry_source"))}) a ON e.id = a.entry_id WHERE e.status = 'active'),
      p AS (SELECT * FROM c WHERE tf > 0 ORDER BY tf DESC, id DESC LIMIT 30),
      r AS (SELECT id, CASE WHEN max(tf) OVER () = min(tf) OVER () THEN 1.0 ELSE (tf - min(tf) OVER ()) * 1.0 / (max(tf) OVER () - min(tf) OVER ()) END AS rel, authority, fresh FROM p)
      SELECT id, round(rel, 6) AS relevance, round(0.5 * rel + 0.2 * authority + 0.3 * fresh, 6) AS final FROM r ORDER BY 0.5 * rel + 0.2 * authority + 0.3 * fresh DESC, id DESC LIMIT 10"""


@statement("search_term_coverage", "entry")
def coverage(q):
    """STX14: share of the query's terms that an entry holds as whole words."""
    parts = [f"CASE WHEN {q.matches('lower(content)', rf'(^|[^\p{{L}}\p{{N}}]){t}([^\p{{L}}\p{{N}}]|$)')} THEN 1 ELSE 0 END" for t in ("the", "of", "le", "zzz")]
    return f"SELECT id, ({' + '.join(parts)}) / 4.0 AS coverage FROM {q.table('entry')}"


@statement("freshness_decay", "entry")
def freshness(q):
    """DTM3, MTH1: exp(-decay x days since)."""
    return f"SELECT id, round({FRESH}, 6) AS freshness FROM {q.table('entry')}"


@statement("trust_levels", "entry_source")
def trust_levels(q):
    """AGG12, RNK3: entries by trust level."""
    return f"SELECT trust_level, count(*) AS n FROM (SELECT {LEVEL} AS trust_level FROM ({AUTHORITY.replace('{s}', q.table('entry_source'))}) a) x GROUP BY trust_level"


@statement("filter_min_trust", "entry", "entry_source")
def min_trust(q):
    """FLT1-3, FLT7: active entries of high trust in two languages."""
    return f"""SELECT e.id FROM {q.table("entry")} e JOIN ({AUTHORITY.replace("{s}", q.table("entry_source"))}) a ON e.id = a.entry_id
      WHERE a.authority >= 0.7 AND e.status = 'active' AND e.language IN ('en', 'fr')"""


@statement("filter_domain_semijoin", "entry", "entry_source")
def domain(q):
    """FLT4, JON9: entries with at least one documentation source."""
    return f"SELECT e.id FROM {q.table('entry')} e WHERE EXISTS (SELECT 1 FROM {q.table('entry_source')} s WHERE s.entry_id = e.id AND s.source_type = 'official-docs')"


@statement("filter_tags_any", "entry")
def tags_any(q):
    """FLT5: entries with any of two tags; tags come from the length."""
    return f"SELECT id, tag FROM (SELECT id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS tag FROM {q.table('entry')}) x WHERE tag IN ('short', 'long')"


@statement("host_dedup_first", "pages")
def host_first(q):
    """SRC12, WIN8, STX23: the first page of each host."""
    host = q.replace(q.first("lower(url)", "^[a-z]+://([^/:?#]+)", 1), r"^www\.", "")
    return f"SELECT page_id, host FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM (SELECT page_id, {host} AS host FROM {q.table('pages')}) h) x WHERE n = 1"


@statement("focus_domain_order", "pages")
def focus_order(q):
    """SRC11: first hit of each url, preferred hosts first, order kept."""
    pref = q.matches("url", r"example\.com/en")
    return f"""SELECT page_id, CAST(row_number() OVER (ORDER BY CASE WHEN {pref} THEN 0 ELSE 1 END, page_id) AS BIGINT) AS place FROM (
      SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM {q.table("pages")}) x WHERE n = 1"""
