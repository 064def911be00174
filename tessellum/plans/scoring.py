"""Source types, host authority, feedback strength, rate limits and reporter trust."""

from __future__ import annotations

from ..operators import feedback as fb
from ..sources.bindings import load
from .registry import QUERIES, statement
from .retrieval import AUTHORITY

# Host authority, first match wins.
HOSTS = [
    (0.95, r"\.gov(\.uk|\.kr)?$"), (0.90, r"\.(edu|ac\.uk|ac\.kr)$|(^|\.)(arxiv\.org|nature\.com|science\.org|nih\.gov|ietf\.org|w3\.org)$|pubmed\.ncbi"),
    (0.85, r"(^|\.)github\.com$|developer\.mozilla\.org$|(^|\.)mdn\."), (0.80, r"(^|\.)(bbc\.com|bbc\.co\.uk|reuters\.com|apnews\.com)$"),
    (0.75, r"(^|\.)(nytimes\.com|economist\.com|wsj\.com|ft\.com)$"), (0.70, r"(^|\.)wikipedia\.org$"), (0.60, r"(^|\.)(stackoverflow\.com|stackexchange\.com)$"),
    (0.55, r"(^|\.)(techcrunch\.com|theverge\.com)$"), (0.40, r"(^|\.)(medium\.com|dev\.to|qiita\.com|zenn\.dev)$"), (0.35, r"(^|\.)substack\.com$"),
    (0.25, r"(^|\.)(reddit\.com|hackernews\.com)$"), (0.20, r"(^|\.)(twitter\.com|x\.com)$"), (0.15, r"(^|\.)(facebook\.com|instagram\.com)$"),
]
# Source type by host and path, first match wins.
TYPES = [
    ("research-paper", r"^(www\.)?(arxiv\.org|export\.arxiv\.org|openreview\.net|aclanthology\.org|papers\.nips\.cc|proceedings\.mlr\.press|biorxiv\.org|medrxiv\.org|ssrn\.com)/"),
    ("official-docs", r"^(learn\.microsoft\.com|docs\.microsoft\.com|developer\.mozilla\.org|docs\.python\.org|pytorch\.org|www\.tensorflow\.org|huggingface\.co|kubernetes\.io|go\.dev|nodejs\.org|www\.postgresql\.org|redis\.io|pypi\.org|www\.npmjs\.com)/|^[^/]*\.(gov|edu)/"),
    ("reference-wiki", r"^([a-z]+\.)?(wikipedia\.org|wikidata\.org|handwiki\.org|scholarpedia\.org)/"),
    ("community-forum", r"^github\.com/[^/]+/[^/]+/(issues|discussions|pull)"), ("github-release", r"^github\.com/[^/]+/[^/]+/releases"),
    ("official-docs", r"^github\.com/[^/]+/[^/]+/(blob|tree|wiki)"), ("github-release", r"^(github\.com|gitlab\.com|bitbucket\.org)/"),
    ("established-blog", r"(medium\.com|dev\.to|substack\.com|hashnode\.dev|csdn\.net|qiita\.com|zenn\.dev)/"),
    ("community-forum", r"(stackoverflow\.com|stackexchange\.com|reddit\.com|news\.ycombinator\.com)/"),
]
# Urls that reach every rule, besides those of the pages.
PROBES = [
    "https://arxiv.org/abs/1", "https://docs.python.org/3/", "https://en.wikipedia.org/wiki/X", "https://github.com/a/b/issues/1", "https://github.com/a/b/releases/v1",
    "https://github.com/a/b/blob/main/x", "https://github.com/a/b", "https://medium.com/x", "https://stackoverflow.com/q/1", "https://www.nasa.gov/x", "https://x.com/a", "not a url",
]


def _urls(q) -> str:
    probes = " UNION ALL ".join(f"SELECT {-1 - i} AS id, '{u}' AS url" for i, u in enumerate(PROBES))
    return f"SELECT page_id AS id, url FROM {q.table('pages')} UNION ALL {probes}"


@statement("source_type_from_url", "pages")
def source_type(q):
    """STX25: eleven source types by host and path."""
    cases = "".join(f" WHEN {q.matches('hp', p)} THEN '{k}'" for k, p in TYPES)
    return f"SELECT id, CASE{cases} ELSE 'unknown' END AS source_type FROM (SELECT id, {q.first('lower(url)', '^https?://([^?#]*)', 1)} || '/' AS hp FROM ({_urls(q)}) u) x"


@statement("host_authority", "pages")
def host_authority(q):
    """STX24: authority of a url's host, .5 by default."""
    host = q.replace(q.first("lower(url)", "^https?://([^/:?#]+)", 1), r"^www\.", "")
    cases = "".join(f" WHEN {q.matches('host', p)} THEN {v}" for v, p in HOSTS)
    return f"SELECT id, host, CAST(CASE{cases} ELSE 0.5 END AS DOUBLE) AS authority FROM (SELECT id, {host} AS host FROM ({_urls(q)}) u) x"


@statement("entry_authority_max_avg", "entry_source")
def entry_authority(q):
    """AGG12: best trust x .8 + mean trust x .2; one source is itself."""
    return f"SELECT entry_id, round(authority, 6) AS authority FROM ({AUTHORITY.replace('{s}', q.table('entry_source'))}) a"


STRENGTH = """round(least(1.0, 0.1 + CASE WHEN counter_source_url <> '' THEN 0.3 WHEN counter_source_url_inferred <> '' THEN 0.15 ELSE 0.0 END + CASE WHEN counter_nli_score >= 0.7 THEN 0.2 ELSE 0.0 END
  + CASE WHEN failure_dimension <> '' THEN 0.2 WHEN failure_dimension_inferred <> '' THEN 0.1 ELSE 0.0 END + CASE WHEN context_domain <> '' OR context_scope <> '' THEN 0.1 ELSE 0.0 END
  + CASE WHEN partial_truth IS NOT NULL THEN 0.1 WHEN partial_truth_inferred IS NOT NULL THEN 0.05 ELSE 0.0 END), 3)"""


@statement("feedback_strength", "report")
def strength(q):
    """RNK5: evidence strength of a report, direct evidence before inferred, at most 1."""
    return f"SELECT id, CAST({STRENGTH} AS DOUBLE) AS strength FROM {q.table('report')}"


@statement("entry_feedback_multiplier", "feedback")
def multiplier(q):
    """RNK6: one report's change of authority: x .8 (floor .05 above it), x 1.1 (at most 1), and 0 restarts at .05."""
    return f"""SELECT id, round(CASE WHEN signal = 'negative' THEN CASE WHEN p > 0.05 THEN greatest(0.05, p * 0.8) ELSE p * 0.8 END
      WHEN p = 0 THEN 0.05 ELSE least(1.0, p * 1.1) END, 6) AS authority FROM (SELECT id, signal, CAST((id % 21) / 20.0 AS DOUBLE) AS p FROM {q.table("feedback")}) x"""


@statement("claim_authority_delta", "report")
def claim_delta(q):
    """RNK7, MTH3: authority moves by strength x reporter trust x .05, up if the claim held."""
    return f"""SELECT id, round(greatest(0.0, least(1.0, claim_authority + CASE WHEN outcome = 'held' THEN 1 ELSE -1 END * s * reporter_trust * 0.05)), 6) AS authority
      FROM (SELECT id, outcome, claim_authority, reporter_trust, CAST({STRENGTH} AS DOUBLE) AS s FROM {q.table("report")}) x"""


@statement("reporter_ema", "feedback")
def reporter_ema(q):
    """RNK8, WIN7, SNK3: a reporter's first judged report sets trust, later ones move it by a tenth (closed form over the order of time)."""
    return f"""WITH j AS (SELECT agent_id, CASE WHEN signal = 'positive' THEN 1.0 ELSE 0.0 END AS good, row_number() OVER (PARTITION BY agent_id ORDER BY ts_s, id) AS n, count(*) OVER (PARTITION BY agent_id) AS total FROM {q.table("feedback")})
      SELECT agent_id, round(sum(good * CASE WHEN n = 1 THEN power(0.9, total - 1) ELSE 0.1 * power(0.9, total - n) END), 6) AS trust, count(*) AS total, CAST(sum(good) AS BIGINT) AS correct FROM j GROUP BY agent_id"""


@statement("rate_limit_window", "feedback")
def rate_window(q):
    """WIN6: reports of the same agent on the same entry, and on the entry, in the hour before."""
    f = q.table("feedback")
    return f"""SELECT id, count(*) OVER (PARTITION BY agent_id, entry_id ORDER BY ts_s RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS same_agent,
      count(*) OVER (PARTITION BY entry_id ORDER BY ts_s RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS on_entry FROM {f}"""


QUERIES["rate_limit_exact"] = lambda spark, d: fb.rate_limit(load(spark, d, "feedback"))
