"""Shaping of results, gates and joins by position."""

from __future__ import annotations

from .registry import statement


@statement("dto_shape", "entry", "claim")
def dto(q):
    """PRJ2: names and times as the API gives them; polarity as true, false or null."""
    return f"""SELECT id AS {q.name("entryId")}, {q.iso("created_s")} AS {q.name("createdAt")}, CASE WHEN id % 3 = 0 THEN true WHEN id % 3 = 1 THEN false END AS polarity FROM {q.table("entry")}"""


@statement("conditional_attach", "entry", "claim")
def attach(q):
    """PRJ4, JON12: claims and factuality are attached only to entries that have them."""
    c = q.table("claim")
    return f"""SELECT e.id, g.claims, g.factuality FROM {q.table("entry")} e LEFT JOIN (SELECT entry_id, {q.listed("CAST(id AS VARCHAR(20))")} AS claims,
      round(sum(CASE WHEN verdict = 'verified' THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN verdict IN ('verified', 'disputed') THEN 1 ELSE 0 END), 0), 6) AS factuality FROM {c} GROUP BY entry_id) g ON g.entry_id = e.id"""


@statement("entry_children", "entry", "entry_source")
def children(q):
    """JON12, SRT12: an entry's source types, five at most, or an empty list."""
    return f"""SELECT e.id, coalesce(s.kinds, '') AS kinds, coalesce(s.n, 0) AS n FROM {q.table("entry")} e LEFT JOIN (SELECT entry_id, {q.some_listed("source_type", 5)} AS kinds, count(*) AS n
      FROM {q.table("entry_source")} WHERE trust >= 0.5 GROUP BY entry_id) s ON s.entry_id = e.id"""


def _host(q) -> str:
    return q.replace(q.first("lower(url)", "^[a-z]+://([^/:?#]+)", 1), r"^www\.", "")


@statement("host_lists", "pages")
def host_lists(q):
    """FLT23: hosts by suffix: what is blocked never passes, an empty list of those allowed passes all, no host never does."""
    rows = " UNION ALL ".join(f"SELECT {-1 - i} AS id, '{u}' AS url" for i, u in enumerate(["https://www.ads.example.org/x", "https://example.org", "https://badexample.org", "no url", "http://WWW.Site3.Example.com/a"]))
    ends = lambda hosts: " OR ".join(f"host = '{h}' OR host LIKE '%.{h}'" for h in hosts)
    allow, block = ["example.org", "example.com", "site3.example.com"], ["ads.example.org", "site1.example.com"]
    return f"""SELECT id, host, host <> '' AND NOT ({ends(block)}) AS open_list, host <> '' AND NOT ({ends(block)}) AND ({ends(allow)}) AS allowed FROM (
      SELECT id, coalesce({_host(q)}, '') AS host FROM ({rows} UNION ALL SELECT page_id, url FROM {q.table("pages")}) r) h"""


@statement("entailment_gate", "evidence")
def entailment_gate(q):
    """FLT30: a quote must support its statement by the threshold and oppose it less; for a negated statement the two change places; no score keeps it."""
    swap = "claim_id % 5 = 0"
    return f"""SELECT claim_id, id, CASE WHEN support IS NULL THEN 'kept' WHEN oppose > support THEN 'contradiction' WHEN support < 0.3 THEN 'entailment-low' ELSE 'kept' END AS gate, round(support, 6) AS support FROM (
      SELECT claim_id, id, CASE WHEN id = 7 THEN NULL WHEN {swap} THEN contradiction ELSE entailment END AS support, CASE WHEN {swap} THEN entailment ELSE contradiction END AS oppose FROM {q.table("evidence")}) x"""


@statement("outer_unnest", "kg_relation", "entity")
def outer_unnest(q):
    """JON7: every entity with each of its relation types, or with none."""
    part = "split(kinds, ',')" if q.__name__ == "Spark" else "string_split(kinds, ',')"
    return f"""WITH g AS (SELECT src, {q.listed("kind")} AS kinds FROM {q.table("kg_relation")} GROUP BY src), j AS (SELECT e.id, CASE WHEN kinds IS NOT NULL THEN {part} END AS rels FROM {q.table("entity")} e LEFT JOIN g ON g.src = e.id)
      SELECT id, rel FROM j {q.unnest_outer("rels", "rel")}"""


@statement("train_triples", "kg_relation", "entity", "claim")
def triples(q):
    """JON14, AGG9: a claim's triples as JSON, subjects and objects by name."""
    cell = "named_struct('subject', s.name, 'predicate', k.kind, 'object', t.name)" if q.__name__ == "Spark" else "{'subject': s.name, 'predicate': k.kind, 'object': t.name}"
    all_ = f"to_json(array_sort(collect_list({cell})))" if q.__name__ == "Spark" else f"CAST(to_json(list_sort(list({cell}))) AS VARCHAR)"
    return f"""SELECT c.id, {all_} AS triples FROM {q.table("claim")} c JOIN {q.table("kg_relation")} k ON k.claim_id = c.id JOIN {q.table("entity")} s ON s.id = k.src JOIN {q.table("entity")} t ON t.id = k.dst GROUP BY c.id"""


@statement("index_join", "documents")
def index_join(q):
    """JON18: classes that came back by position are joined to their chunks; a position that is missing gets the default."""
    lines = "split(text, '\\n')" if q.__name__ == "Spark" else "string_split(text, chr(10))"
    chunks = f"SELECT doc_id, CAST(i AS BIGINT) AS i FROM {q.table('documents')} {q.unnest(q.numbers('0', f'least({q.size(lines)}, 5) - 1') if q.__name__ == 'Duck' else f'sequence(0, least(size({lines}), 5) - 1)', 'i')}"
    return f"""WITH c AS ({chunks}), r AS (SELECT doc_id, CAST(doc_id % 4 AS BIGINT) AS i, 'class-' || lang AS label FROM {q.table("documents")})
      SELECT c.doc_id, c.i, coalesce(r.label, 'general') AS label FROM c LEFT JOIN r ON r.doc_id = c.doc_id AND r.i = c.i"""


@statement("capped_ids", "claim_relation")
def capped(q):
    """AGG13, SET4: the different claims that contradict a claim, from either side, eight at most."""
    r = q.table("claim_relation")
    ids = f"SELECT src AS id, dst AS other FROM {r} WHERE kind = 'contradicts' UNION SELECT dst, src FROM {r} WHERE kind = 'contradicts'"
    return f"SELECT id, {q.some_listed('CAST(other AS VARCHAR(20))', 8)} AS others, count(DISTINCT other) AS n FROM ({ids}) x GROUP BY id"


@statement("url_lists", "pages")
def url_lists(q):
    """SET3, SRC12: special results before web results, the first of each url, eight for a topic."""
    p = q.table("pages")
    return f"""WITH u AS (SELECT page_id % 10 AS topic, url, 0 AS list, page_id FROM {p} WHERE page_id % 3 = 0 UNION ALL SELECT (page_id + 3) % 10, url, 1, page_id FROM {p} UNION ALL SELECT page_id % 10, url, 1, page_id FROM {p}),
      f AS (SELECT topic, url, list, page_id, row_number() OVER (PARTITION BY topic, url ORDER BY list, page_id) AS n FROM u),
      k AS (SELECT topic, url, row_number() OVER (PARTITION BY topic ORDER BY list, page_id) AS place FROM f WHERE n = 1) SELECT topic, url, CAST(place AS BIGINT) AS place FROM k WHERE place <= 8"""


@statement("chunk_overlap", "documents")
def overlap(q):
    """WIN10: fixed chunks, each with the whole words at the end of the chunk before."""
    cut = f"SELECT doc_id, CAST(s AS BIGINT) AS s, substr(text, CAST(s AS INT) + 1, 1800) AS part FROM {q.table('documents')} {q.unnest(q.numbers('0', 'CAST(greatest(length(text) - 1, 0) AS INT)', 1800), 's')}"
    tail = "substr(prev, greatest(length(prev) - 179, 1), 180)"
    return f"""WITH c AS ({cut}), l AS (SELECT doc_id, s, part, lag(part) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM c), t AS (SELECT doc_id, s, part, {tail} AS tail FROM l)
      SELECT doc_id, s, CASE WHEN tail IS NULL THEN part ELSE substr(tail, {q.position("tail", "' '")} + 1) || chr(10) || chr(10) || part END AS chunk FROM t"""


@statement("cursor_codec", "entry")
def cursor(q):
    """SRT3: a page's cursor as base64 of JSON, and what comes back of it; a text that is no cursor gives null."""
    made = """'{{"score":' || CAST(CAST(n_chars AS BIGINT) AS VARCHAR(20)) || ',"id":"' || CAST(id AS VARCHAR(20)) || '"}}'"""
    if q.__name__ == "Duck":
        made = made.replace("{{", "{").replace("}}", "}")
    return f"""SELECT id, cursor, {q.first("back", r'^\{{"score":[0-9.]+,"id":"([^"]*)"\}}$'.replace("{{", "{").replace("}}", "}"), 1)} AS last_id FROM (SELECT id, cursor, {q.from_base64("cursor")} AS back FROM (SELECT id, {q.base64(made)} AS cursor FROM {q.table("entry")}) x) y"""


@statement("match_query", "conversations")
def match_query(q):
    """STX15: the words of a query quoted, escaped and joined by OR."""
    word = "'\"' || replace(replace(x, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"'"
    words = "filter(split(text, r'[ \\t\\r\\n]+'), w -> w <> '')" if q.__name__ == "Spark" else "list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')"
    join = "array_join" if q.__name__ == "Spark" else "array_to_string"
    return f"SELECT conv_id, turn, {join}({q.each(words, word)}, ' OR ') AS query FROM {q.table('conversations')}"


@statement("verdict_tokens", "conversations")
def verdict_tokens(q):
    """STX28: the verdict that an answer leads with, or that a short one holds."""
    extra = ["Verified.", "disputed, because", "It is false", "unverified", "the claim was verified by many independent people", "refuted!", "", "  VERIFIED"]
    rows = f"SELECT conv_id * 1000 + turn AS id, text FROM {q.table('conversations')}" + "".join(f" UNION ALL SELECT {-1 - i}, '{t}'" for i, t in enumerate(extra))
    lead = q.replace(q.first("t", r"^[^ \t\r\n]+"), r"^[.,!?:;\x22\x27`]+|[.,!?:;\x22\x27`]+$", "")
    return f"""SELECT id, CASE WHEN lead = 'verified' THEN 'verified' WHEN lead IN ('disputed', 'refuted', 'false') THEN 'disputed' WHEN length(t) > 30 THEN NULL
      WHEN {q.holds("t", "'verified'")} AND NOT {q.holds("t", "'unverified'")} THEN 'verified' WHEN {q.matches("t", "disputed|refuted|false")} THEN 'disputed' END AS verdict
      FROM (SELECT id, t, {lead} AS lead FROM (SELECT id, lower(trim(text)) AS t FROM ({rows}) r) a) b"""


# What of a claim can fail.
DIMENSIONS = ["fully-false", "scope-too-broad", "time-expired", "modality-too-strong", "context-mismatch", "partially-correct"]


@statement("training_prompts", "claim", "documents")
def prompts(q):
    """STX29, PIP12: verdict, citation and feedback examples as prompts; what lacks its answer gives none."""
    nl = "chr(10)"
    base = f"SELECT c.id, c.verdict, {q.first('d.text', '^[^.]*')} AS statement, {q.first('d.text', r'^[^.]*\.([^.]*)', 1)} AS quote FROM {q.table('claim')} c JOIN {q.table('documents')} d ON d.doc_id = c.entry_id"
    dimension = q.pick([f"'{d}'" for d in DIMENSIONS], "id % 6")
    verdict = f"'[task: verdict]' || {nl} || 'Claim: ' || statement || {nl} || 'Source: ' || quote || {nl} || 'Answer with one word (verified | disputed).' || {nl} || {nl} || verdict"
    cite = f"'[task: citation]' || {nl} || 'Extract the sentence from the source that best ' || CASE WHEN verdict = 'verified' THEN 'supports' ELSE 'refutes' END || ' the claim.' || {nl} || {nl} || 'Claim: ' || statement || {nl} || {nl} || quote"
    feedback = f"""'[task: feedback]' || {nl} || 'A claim failed when applied. Which dimension of its truth broke? Answer with one label ({" | ".join(DIMENSIONS)}).' || {nl} || {nl} || 'Claim: ' || statement || {nl} || {nl} || {dimension}"""
    return f"""WITH b AS ({base}) SELECT id, 'verdict' AS task, {verdict} AS prompt FROM b WHERE quote <> '' AND verdict IN ('verified', 'disputed')
      UNION ALL SELECT id, 'citation', {cite} FROM b WHERE quote <> '' AND verdict IN ('verified', 'disputed') UNION ALL SELECT id, 'feedback', {feedback} FROM b WHERE verdict = 'disputed'"""


@statement("answer_support", "documents", "benchmark")
def support(q):
    """STX36: an extracted answer and the expected text support each other if either holds the other."""
    x, y = q.first("lower(d.text)", "[a-z]+ [a-z]+"), "lower(b.text)"
    return f"""SELECT doc_id, item_id, {q.holds("x", "y")} OR {q.holds("y", "x")} AS supported FROM (SELECT d.doc_id, b.item_id, {x} AS x, {y} AS y FROM {q.table("documents")} d
      JOIN {q.table("benchmark")} b ON b.item_id = d.doc_id % 40) p"""


@statement("error_hints", "conversations")
def error_hints(q):
    """STX30: errors cut to 120 characters, without what could steer a model, and cache keys of 500."""
    steer = "(?i)ignore|disregard|system *:|assistant *:|instruction"
    hint = q.replace(q.replace("substr(text, 1, 120)", steer, "[REDACTED]"), "[`<>{}]", " ")
    return f"SELECT conv_id, turn, {hint} AS hint, substr({q.replace('lower(text)', r'[ \t\r\n]+', ' ')}, 1, 500) AS cache_key FROM {q.table('conversations')}"


@statement("subclaim_dedup", "conversations")
def subclaims(q):
    """STX34: the first of each sub-claim up to case and spacing, without those that repeat the claim."""
    key = q.replace("lower(trim(text))", r"[ \t\r\n]+", " ")
    c = q.table("conversations")
    return f"""WITH s AS (SELECT conv_id, turn, trim(text) AS part, {key} AS k FROM {c} UNION ALL SELECT conv_id, turn + 100, upper(text), {key} FROM {c} WHERE turn = 1), p AS (SELECT conv_id, min(CASE WHEN turn = 0 THEN lower(trim(text)) END) AS own FROM {c} GROUP BY conv_id)
      SELECT conv_id, turn, part FROM (SELECT s.conv_id, s.turn, s.part, row_number() OVER (PARTITION BY s.conv_id, s.k ORDER BY s.turn) AS n FROM s JOIN p ON p.conv_id = s.conv_id WHERE s.part <> '' AND (p.own IS NULL OR s.k <> p.own)) x WHERE n = 1"""


@statement("ulid_times", "documents")
def ulid(q):
    """DTM1, SRC6: milliseconds in a ULID's first ten characters, in either case; null for what is no ULID."""
    digits = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    char = lambda k: f"substr('{digits}', CAST(floor(ms / power(32, {9 - k})) AS BIGINT) % 32 + 1, 1)" if q.__name__ == "Duck" else f"substr('{digits}', CAST(CAST(floor(ms / power(32, {9 - k})) AS BIGINT) % 32 + 1 AS INT), 1)"
    made = " || ".join(char(k) for k in range(10))
    rows = f"SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN u ELSE lower(u) END AS ulid FROM (SELECT doc_id, {made} || '0123456789ABCDEF' AS u FROM (SELECT doc_id, 1700000000000 + doc_id * 86400123 AS ms FROM {q.table('documents')}) m) x"
    rows += " UNION ALL SELECT -1, '01HX000000ZZZZZZZZZZZZZZZZ' UNION ALL SELECT -2, 'short' UNION ALL SELECT -3, 'UUUUUUUUUUUU'"
    back = " + ".join(f"(CAST({q.position(repr(digits), f'substr(upper(ulid), {k + 1}, 1)')} AS BIGINT) - 1) * {32 ** (9 - k)}" for k in range(10))
    return f"SELECT id, CASE WHEN {q.matches('upper(ulid)', f'^[{digits}]{{10}}')} THEN {back} END AS ms FROM ({rows}) r"


@statement("published_reference", "entry")
def published(q):
    """DTM2: freshness counts from the date of publication, or from creation where there is none or it lies ahead."""
    at = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN created_s + 86400 * 10000 ELSE created_s - 86400 * (id % 400) END"
    now = 1735689600
    return f"SELECT id, CASE WHEN published IS NULL OR published > {now} THEN created_s ELSE published END AS reference_s FROM (SELECT id, created_s, {at} AS published FROM {q.table('entry')}) x"


@statement("keyset_batches", "entry")
def keyset(q):
    """SRC7: which batch of 100 a walk by id meets each row in, for each language."""
    return f"SELECT language, id, CAST(floor((n - 1) / 100.0) AS BIGINT) AS batch FROM (SELECT language, id, row_number() OVER (PARTITION BY language ORDER BY id) AS n FROM {q.table('entry')}) x"


@statement("queue_claim", "queue")
def queue_claim(q):
    """SRC8: due rows by priority that no other worker holds, six for each of two workers."""
    now = 883612800
    return f"""SELECT claim_id, CAST((n - 1) % 2 AS BIGINT) AS worker FROM (SELECT claim_id, row_number() OVER (ORDER BY priority DESC, queued_s, claim_id) AS n FROM (SELECT claim_id, priority, queued_s FROM {q.table("queue")}
      WHERE next_s <= {now} AND attempts < 3 AND claim_id % 7 <> 0 ORDER BY priority DESC, queued_s, claim_id LIMIT 12) d) x"""


@statement("fetch_status", "pages")
def fetch(q):
    """SRC14: a page's text without scripts and tags, white space squeezed, and whether it holds enough."""
    bare = q.replace(q.replace("html", r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " "), "<[^>]*>", " ")
    text = q.replace(q.replace(bare, r"[ \t\r\n]+", " "), "^ | $", "")
    size = "octet_length(html)" if q.__name__ == "Spark" else "strlen(html)"
    return f"""SELECT page_id, CASE WHEN html IS NULL THEN 'fetch_failed' WHEN {size} > 4194304 THEN 'blocked_type' WHEN length(t) < 100 THEN 'no_content' ELSE 'ok' END AS status, length(t) AS n FROM (SELECT page_id, html, {text} AS t FROM {q.table("pages")}) x"""


@statement("nearest_entities", "kg_relation")
def nearest(q):
    """SRT9, GRA1: what two hops from an entity reach, the nearest first, then by id, ten at most."""
    k = q.table("kg_relation")
    e = f"SELECT src AS a, dst AS b FROM {k} UNION SELECT dst, src FROM {k}"
    return f"""WITH e AS ({e}), one AS (SELECT DISTINCT b FROM e WHERE a = 's2'), two AS (SELECT DISTINCT e.b FROM one JOIN e ON e.a = one.b)
      SELECT id, min(d) AS distance FROM (SELECT b AS id, 1 AS d FROM one UNION ALL SELECT b, 2 FROM two) x GROUP BY id ORDER BY min(d), id LIMIT 10"""


@statement("outcome_judgement", "feedback", "claim")
def judgement(q):
    """RNK8: a verdict's change away from verified proves reporters of failure right, one to verified those of success; other changes say nothing, and only reports of 30 days count."""
    move = """CASE WHEN old = new OR old = 'not-applicable' OR new = 'not-applicable' THEN 'none' WHEN old = 'verified' THEN 'away' WHEN new = 'verified' THEN 'to' ELSE 'none' END"""
    new = q.pick(["'verified'", "'verified'", "'unverified'", "'disputed'", "'disputed'"], "id % 5")
    return f"""WITH c AS (SELECT id, {move} AS move FROM (SELECT id, verdict AS old, {new} AS new FROM {q.table("claim")}) v), f AS (SELECT id, agent_id, entry_id, event_type, ts_s FROM {q.table("feedback")}),
      r AS (SELECT f.agent_id, CASE WHEN (c.move = 'away') = (f.event_type IN ('error', 'click')) THEN 1 ELSE 0 END AS correct, row_number() OVER (PARTITION BY f.agent_id ORDER BY f.ts_s, f.id, c.id) AS n, count(*) OVER (PARTITION BY f.agent_id) AS total
      FROM f JOIN c ON c.id = f.entry_id WHERE c.move <> 'none' AND f.ts_s > (SELECT max(ts_s) FROM f) - 30 * 86400)
      SELECT agent_id, round(sum(correct * CASE WHEN n = 1 THEN power(0.9, total - 1) ELSE 0.1 * power(0.9, total - n) END), 6) AS trust, count(*) AS judged FROM r GROUP BY agent_id"""


@statement("counter_search", "evidence")
def counter(q):
    """RNK13: of a claim's sources that with the strongest contradiction by authority; .5 or more disputes it."""
    w = "round(contradiction * authority, 9)"
    return f"""SELECT claim_id, id, round(contradiction, 6) AS contradiction, w >= 0.5 AS triggered FROM (SELECT claim_id, id, contradiction, {w} AS w, row_number() OVER (PARTITION BY claim_id ORDER BY {w} DESC, id, contradiction) AS n FROM {q.table("evidence")}) x WHERE n = 1"""


@statement("cove_three_way", "evidence")
def cove3(q):
    """RNK14, AGG26: any disputed sub-claim disputes with the largest certainty, all verified verify with the least, else unverified."""
    v = "CASE WHEN entailment > 0.6 THEN 'verified' WHEN contradiction > 0.4 THEN 'disputed' ELSE 'unverified' END"
    some, all_ = "count(CASE WHEN v = 'disputed' THEN 1 END) > 0", "count(CASE WHEN v <> 'verified' THEN 1 END) = 0"
    return f"""SELECT claim_id, CASE WHEN {some} THEN 'disputed' WHEN {all_} THEN 'verified' ELSE 'unverified' END AS verdict,
      round(CASE WHEN {some} THEN max(CASE WHEN v = 'disputed' THEN c END) WHEN {all_} THEN min(c) ELSE 0.0 END, 6) AS certainty FROM (SELECT claim_id, {v} AS v, CAST(authority AS DOUBLE) AS c FROM {q.table("evidence")}) s GROUP BY claim_id"""


@statement("sampled_hash", "claim")
def sampled(q):
    """SRC9, MTH9: a rotating twentieth by a hash of id and hour, 20 rows at most."""
    x = "CAST((id * 48271 + 11 * 69621) % 2147483647 AS BIGINT)"
    return f"SELECT id, verdict FROM {q.table('claim')} WHERE {x} % 20 = 0 ORDER BY {x}, id LIMIT 20"
