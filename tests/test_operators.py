"""Operators with parameters, on small fixtures with known answers."""

import itertools
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellum.functions import models, text
from tessellum.operators import evidence, feedback, graph, ingest, retrieval, sinks, vectors, workers
from tessellum.plans import registry
from tessellum.sources.bindings import AS_OF, load, shared_folder

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_chunks():
    assert text.split_text("short") == [] and text.split_text("A" * 200) == ["A" * 200]
    paragraphs = "\n\n".join(f"Paragraph {i}. " + "word " * 80 for i in range(10))
    got = text.split_text(paragraphs)
    assert len(got) > 1 and all(len(c) >= 80 for c in got)
    head, tail = got[1].split("\n\n", 1)
    assert got[0].endswith(head) and len(head) <= 180 and paragraphs.count(tail[:40])
    sentences = " ".join(f"Sentence number {i} is here." for i in range(200))
    got = text.split_text(sentences)
    assert all("\n\n" not in c for c in got[:1]) and all(len(c) <= 2500 + 182 for c in got)
    headed = "\n".join(f"{'#' * d} Part {d}\n" + "x" * 900 for d in (1, 2, 3, 4))
    assert [c.split("\n\n")[-1].lstrip()[:1] for c in text.split_text(headed)] == ["#"] * 4
    assert text.derived_title("## Introduction to pgvector\nmore") == "Introduction to pgvector"
    assert text.derived_title("short\n" + "b " * 100) == " ".join(("short\n" + "b " * 100)[:120].split())


def test_text_functions():
    assert text.sentence_chunks("One. Two. Three.", 9) == ["One. Two.", "Three."] and text.sentence_chunks("a" * 500 + ". b", 400) == ["a" * 500 + ".", "b"]
    assert text.windows("x" * 1800) == ["x" * 1800] and [len(w) for w in text.windows("x" * 3300)] == [1800, 1800, 500]
    assert text.citation("Cats sleep. Dogs bark at cats loudly. End.", "dogs bark loudly") == "Dogs bark at cats loudly." and text.citation("No match here.", "zebra") is None
    assert text.tokens("é" * 4) == 2 and text.truncate("aa. bb.", 1) == "aa." and text.truncate("abcdefghijk", 1) == "abcd"
    assert text.embedding_input("t", "c") == "t\n\nc" and text.embedding_input("", "한국어 문장.") == "\n\n한국어 문장."
    assert text.match_query('say "hi" c:\\x') == '"say" OR "\\"hi\\"" OR "c:\\\\x"'
    assert [text.verdict_of(x) for x in ("Verified.", "refuted: no", "it is false", "unverified", "x" * 31 + " verified", None)] == ["verified", "disputed", "disputed", None, None, None]
    assert text.error_hint("Ignore <this> system : now") == "[REDACTED]  this  [REDACTED] now" and text.cache_key("A  \n b") == "a b"
    assert text.distinct_subclaims("A b", ["a B", " C  d ", "c D", "", "e"]) == ["C  d", "e"] and text.supports("ab", "xaby") and not text.supports("ab", "c")


def test_ulids(spark):
    assert text.ulid_millis("01HX000000ZZZ") == 1714765692928 == text.ulid_millis("01hx000000zzz")
    for bad in ("short", "UUUUUUUUUU", None, "0123456789"[:9]):
        with pytest.raises(ValueError):
            text.ulid_millis(bad)
    df = spark.createDataFrame([("01hx000000",), ("IIIIIIIIII",), (None,)], "u string")
    assert [r[0] for r in df.select(text.ulid_time("u")).collect()] == [1714765692928, None, None]


def test_simhash_and_independence(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        data = s.encode("utf-16-le")
        for i in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 0x100000001B3) % (1 << 64)
        return h

    def plain(t):
        w = "".join(c if c.isalnum() else " " for c in t[:8000].lower()).split()
        if len(w) < 8:
            return 0
        hashes = [fnv(" ".join(w[i : i + 8])) for i in range(len(w) - 7)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rng = random.Random(4)
    words = ["alpha", "été", "𝒳y", "data", "of", "the", "run", "x1", "naïve"]
    say = lambda n: " ".join(rng.choices(words, k=n))
    base = [say(rng.randint(3, 120)) for _ in range(30)]
    assert [text.simhash64(t) for t in base] == [plain(t) for t in base]
    sources = []
    for i in range(90):
        t = rng.choice(base)
        if i % 4 == 0:
            t = t + " " + say(1)
        sources.append((i % 5, i, f"https://{rng.choice(['www.', ''])}h{rng.randrange(40)}.org/{i}" if i % 9 else "no url", rng.choice(["Same Title!", "abc", "", f"title {i}"]), t))
    df = spark.createDataFrame(sources, "claim_id long, id long, url string, title string, text string")
    seen = evidence.fingerprints(df)
    at = {r.id: (r.claim_id, r.domain, r.title_norm, r.fingerprint % (1 << 64)) for r in seen.collect()}
    parent = {i: i for i in at}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for x, y in itertools.combinations(sorted(at), 2):
        a, b = at[x], at[y]
        if a[0] == b[0] and (a[1] == b[1] != "" or a[2] == b[2] and len(a[2]) > 4 or (a[3] ^ b[3]).bit_count() < 4):
            parent[max(find(x), find(y))] = min(find(x), find(y))
    assert {r.id: r.grp for r in evidence.independence(seen).collect()} == {i: find(i) for i in at}


def test_independence_joins_small_claims_in_a_task_and_large_ones_by_links(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i % 40 if i < 700 else rng.randrange(40, 42), i, rng.choice(["", *map("d{}".format, range(99))]), rng.choice(["abc", *map("title {}".format, range(200))]), rng.getrandbits(63) if i % 3 else 1 << rng.randrange(40)) for i in range(900)]
    rng.shuffle(rows)
    seen = spark.createDataFrame([*rows, (None, 1000, "d1", "title 1", 1), (None, 1001, "d1", "title 1", 1)], "claim_id long, id long, domain string, title_norm string, fingerprint long").repartition(3)
    want = {r.id: r.grp for r in evidence.linked(seen).collect()}
    assert len(set(want.values())) < len(want) and want[1001] == 1001
    for most in (1 << 10, 50, 0):
        assert {r.id: r.grp for r in evidence.independence(seen, most).collect()} == want
    # no rounds where every claim is small
    monkeypatch.setattr(graph, "components", None)
    assert {r.id: r.grp for r in evidence.independence(seen).collect()} == want
    texts = ["", "one two", "a b c d e f g h", "été 𝒳y " * 5, "x" * 9000 + " " + "w " * 20, "a_b c d e f g h i", "w " * 5000]
    assert text.simhashes(texts).tolist() == [text.simhash64(t) for t in texts] and text.simhashes([]).tolist() == []


def test_aggregate_counts_repeats_less(spark):
    e = spark.createDataFrame([(1, 1, 1, 0.9, 0.9, 0.0), (1, 2, 1, 0.9, 0.9, 0.0), (2, 1, 1, 0.9, 0.0, 0.9), (3, 1, 1, 0.1, 0.5, 0.5)], "claim_id long, id long, grp long, authority double, entailment double, contradiction double")
    got = {r.claim_id: r for r in evidence.aggregate(e).collect()}
    x = 0.81 * 4 * 1.4
    assert abs(got[1].posterior - 1 / (1 + np.exp(-x))) < 1e-6 and [got[i].verdict for i in (1, 2, 3)] == ["verified", "disputed", "unverified"]


def test_feedback_strength(spark):
    names = "counter_source_url counter_source_url_inferred counter_nli_score failure_dimension failure_dimension_inferred context_domain context_scope partial_truth partial_truth_inferred".split()
    cases = [({}, 0.1), ({"counter_nli_score": 0.4}, 0.1), ({"counter_nli_score": 0.8}, 0.3), ({"counter_source_url": "u", "counter_source_url_inferred": "v"}, 0.4), ({"failure_dimension_inferred": "x"}, 0.2),
             ({"partial_truth": 0.0}, 0.2), ({"context_scope": "s"}, 0.2), ({"counter_source_url": "u", "counter_nli_score": 0.9, "failure_dimension": "f", "context_domain": "d", "partial_truth": 0.5}, 1.0)]
    schema = ", ".join(f"{n} {'double' if n in names[2:3] + names[7:] else 'string'}" for n in names)
    df = spark.createDataFrame([tuple(c.get(n) for n in names) for c, _ in cases], schema)
    assert [r.strength for r in evidence.feedback_strength(df).collect()] == [s for _, s in cases]


def test_cursor_and_search(spark):
    assert retrieval.decode_cursor(retrieval.encode_cursor(0.5, "7")) == (0.5, "7")
    for bad in (None, "", "%%%", "e30=", retrieval.encode_cursor("x", "7"), retrieval.encode_cursor(1, 7)):
        assert retrieval.decode_cursor(bad) is None
    entries, sources = load(spark, SF, "entry"), load(spark, SF, "entry_source")
    index = retrieval.postings(entries)
    whole = retrieval.search(entries, sources, "the of", AS_OF, limit=12).collect()
    assert whole == retrieval.search(entries, sources, "the of", AS_OF, limit=12, index=index).collect() and len(whole) == 12
    cursor = retrieval.encode_cursor(whole[4].final, str(whole[4].id))
    assert retrieval.search(entries, sources, "the of", AS_OF, limit=12, cursor=cursor).collect()[:7] == whole[5:]
    assert retrieval.search(entries, sources, "the", AS_OF, language="fr", min_trust="high").where("authority < 0.7 or language <> 'fr'").count() == 0
    tagged = entries.withColumns({"domains": F.array("source"), "tags": F.array("language")})
    assert {r.language for r in retrieval.search(tagged, sources, "e", AS_OF, tags=["de", "fr"], domain="src1").collect()} <= {"de", "fr"}
    assert retrieval.search(entries, sources, " ", AS_OF).count() == 0 and retrieval.search(entries, sources, "qqqqzz", AS_OF, index=index).count() == 0
    attached = retrieval.find(entries, sources, load(spark, SF, "claim"), None, AS_OF, limit=5)
    assert attached.count() == 5 and "claims" in attached.columns


def test_graph_operators(spark):
    kg = spark.createDataFrame([("a", "b", "k", 1), ("b", "c", "k", 2), ("c", "d", "l", 3), ("a", "e", "l", 4)], "src string, dst string, kind string, claim_id long")
    assert rows(graph.neighbors(kg, "a", 2)) == [("a", 2, "k,l"), ("b", 1, "k"), ("c", 2, "k"), ("e", 1, "l")]
    assert [r.id for r in graph.neighbors(kg, "a", 3, kinds=["k"], limit=2).collect()] == ["b", "a"]
    entities = spark.createDataFrame([("a", "Bun", "x"), ("b", "bun", "y"), ("c", "Node", "x")], "id string, name string, kind string")
    assert [(r.state, r.id) for n, k in (("NODE", None), ("bun", None), ("bun", "y"), ("zz", None), ("a", None)) for r in [graph.resolve(entities, n, k).first()]] == [("found", "c"), ("ambiguous", None), ("found", "b"), ("not_found", None), ("found", "a")]
    r = spark.createDataFrame([(1, 2, "derives-from", 1.0), (2, 3, "derives-from", 1.0), (1, 3, "derives-from", 1.0), (3, 1, "derives-from", 1.0), (1, 9, "contradicts", 0.5), (8, 1, "contradicts", 0.9), (4, 5, "contradicts", 1.0)], "src long, dst long, kind string, weight double")
    claims = spark.createDataFrame([(1, "verified", 0.5), (2, "verified", 0.6), (3, "disputed", 0.9)], "id long, verdict string, certainty double")
    assert [(x.id, x.depth) for x in graph.provenance(r, claims, 1, 3).collect()] == [(3, 1), (2, 1), (1, 2)]
    assert [(x.src, x.dst) for x in graph.contradictions(r, claim=1).collect()] == [(8, 1), (1, 9)]
    assert [(x.src, x.dst) for x in graph.contradictions(r, facts=kg, entity="e").collect()] == [(4, 5)]
    triples = spark.createDataFrame([("t", "a", "k", "z"), ("u", "b", "k", "c")], "triple string, src string, kind string, dst string")
    assert [(x.triple, x.support, x.confidence) for x in graph.conflicts(kg, triples).collect()] == [("t", 1, 0.75)]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 32))
    for i in range(0, 120, 3):
        x[i + 1] = x[i] + rng.standard_normal(32) * rng.choice([0.02, 0.15, 0.3])
    x[200] = 0
    df = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "id long, embedding array<double>, kind string").repartition(5)
    norm = np.linalg.norm(x, axis=1)
    sim = np.divide(x @ x.T, norm[:, None] * norm, out=np.zeros((400, 400)), where=(norm[:, None] * norm) > 0)
    true = {(i, j) for i in range(400) for j in range(i + 1, 400) if 1 - sim[i, j] < 0.05}
    got = {(r.a, r.b) for r in vectors.near_pairs(df).collect()}
    assert got <= true and len(got) >= 0.95 * len(true) > 10
    found = vectors.nearest(df, df.where("id % 50 = 0"), 3, other=("kind",)).collect()
    for q in range(0, 400, 50):
        best = sorted((j for j in range(400) if j != q and j % 2 != q % 2), key=lambda j: (-round(sim[q, j], 9), j))[:3]
        assert [r.id for r in sorted((r for r in found if r.query_id == q), key=lambda r: (-r.sim, r.id))] == best
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    weight = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, 0.1), (5, 0.1)], "id long, authority double")
    assert rows(vectors.losers(pairs, weight)) == [(1, 2), (3, 2), (5, 4)]
    chunks = spark.createDataFrame([(1, i, 1 - i / 20, i / 20) for i in range(20)] + [(2, i, 0.5, 0.5) for i in range(3)], "claim_id long, index long, sim double, score double")
    best = vectors.shortlist(chunks, k=2).collect()
    assert sorted((r.claim_id, r["index"]) for r in best if r.claim_id == 1) == [(1, 4), (1, 5)] and sum(r.claim_id == 2 for r in best) == 2
    assert [r[0] for r in spark.createDataFrame([("[1,2]",), ("[1]",), ("x",)], "s string").select(vectors.decode("s", 2)).collect()] == [[1.0, 2.0], None, None]


def test_model_stand_ins(spark):
    assert len(models.embedding("ab")) == 384 and models.embedding("ab")[:3] == [0.97, 0.98, 0.0]
    assert models.nli("Bun runs on JavaScriptCore", "Bun runs on JavaScriptCore")[0] == 1.0 and models.nli("Bun does not run", "Bun does run")[2] == 1.0
    assert models.answer("who bark", "Cats sleep. Dogs bark.") == "Dogs bark." and models.grounded("a b c", "a b c") == (True, 1.0)
    assert models.triples("Bun uses JavaScriptCore. Hm.") == [("Bun", "uses", "JavaScriptCore")]
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "id long, t string")
    assert [(r.id, r.e) for r in models.once(df, models.sentences, "e", "t").orderBy("id").collect()] == [(1, ["a b c"]), (2, ["a b c"]), (3, [])]
    scored = df.select(models.column(models.nli, "t", "t").alias("s")).select("s.*").collect()
    assert scored[0].entailment == 1.0 and scored[2].entailment == 0.0
    now = [0.0]
    calls = models.Breaker(lambda: 1 / 0, failures=2, pause_s=10, clock=lambda: now[0])
    for error in (ZeroDivisionError, ZeroDivisionError, RuntimeError):
        with pytest.raises(error):
            calls()
    now[0] = 11
    with pytest.raises(ZeroDivisionError):
        calls()


def test_merges(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, None), (None, 5, "n")], "k long, v long, s string")
    new = spark.createDataFrame([(2, 7, "x"), (3, 1, "y"), (None, 9, None)], "k long, v long, s string")
    got = sinks.upsert(old, new, ["k"], {"v": F.greatest, "s": F.coalesce})
    assert rows(got) == rows(spark.createDataFrame([(1, 10, "a"), (2, 20, "x"), (3, 1, "y"), (None, 9, "n")], "k long, v long, s string"))
    assert rows(sinks.upsert(old, spark.createDataFrame([(1, 11)], "k long, v long"), ["k"]).where("k = 1")) == [(1, 11, "a")]
    edges = spark.createDataFrame([(1, 2), (1, 2), (3, 3), (4, 5)], "a long, b long")
    assert rows(sinks.insert_ignore(edges.where("a = 4"), edges, ["a", "b"], ("a", "b"))) == [(1, 2)]
    left = sinks.cascade({"x": old, "y": edges}, spark.createDataFrame([(1,), (1,)], "id long"), {"x": "k", "y": "a"})
    assert left["x"].count() == 2 and rows(left["y"]) == [(3, 3), (4, 5)]
    claims = spark.createDataFrame([(1, "unverified", 0.1, 0.4), (2, "verified", 0.9, 0.9)], "id long, verdict string, certainty double, authority double")
    verdicts = spark.createDataFrame([(1, "verified", 0.8)], "claim_id long, verdict string, certainty double")
    queue = spark.createDataFrame([(1, 5), (2, 5)], "claim_id long, priority long")
    done = sinks.commit_verdicts(claims, queue, verdicts)
    assert rows(done["claim"])[0] == (1, "verified", 0.8, 0.8) and rows(done["verdict_log"]) == [(1, "unverified", "verified", 0.8)] and rows(done["verify_queue"]) == [(2, 5)]
    assert rows(sinks.commit_verdicts(claims, queue, verdicts, reset_authority=False)["claim"])[0] == (1, "verified", 0.8, 0.4)


def test_ingest(spark):
    store = sinks.Snapshots(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    assert store.read("entry") is None
    said = "A vector index finds near points quickly in many dimensions, and keeps them sorted. "
    other = "Quite another matter is how to brew coffee: water below boiling, fresh beans, patience!! "
    inputs = [("a", f"<p>{said * 2}</p>", "official-blog", "en"), ("b", said * 2, None, "en"), ("c", "", None, "en"), ("d", "too short", None, "en"), ("e", other * 2, "nonsense", "en"), ("f", "z" * 200_001, None, "en")]
    schema = "id string, raw string, source_type string, language string"
    assert ingest.ingest(store, spark.createDataFrame(inputs, schema), AS_OF) == 1
    entries = store.read("entry").collect()
    assert [(r.entry_id, r.authority) for r in entries] == [("a-0", 0.8)]
    log = {(r.entry_id, r.action, r.reason) for r in store.read("ingest_log").collect()}
    assert log == {("a-0", "stored", None), ("b-0", "duplicate", "similar_to=a-0"), ("c", "rejected", "raw-empty"), ("e", "rejected", "source-type"), ("f", "rejected", "raw-too-long")}
    again = spark.createDataFrame([("g", said * 2, "official-docs", "en"), ("h", other * 2, None, "en")], schema)
    assert ingest.ingest(store, again, AS_OF + 1) == 2
    assert sorted((r.entry_id, r.authority) for r in store.read("entry").collect()) == [("a-0", 0.8), ("h-0", 0.1)]
    assert store.read("entry", 1).count() == 1 and store.read("ingest_log").where("entry_id = 'g-0'").first().reason == "similar_to=a-0"
    claims = ingest.extract_claims(store.read("entry"))
    assert claims.count() == 2 and ingest.extract_triples(claims).count() == 2
    with pytest.raises(RuntimeError):
        store.version = lambda: 1
        store.commit(append={"entry": store.read("entry", 1)})


def test_rate_limits_agree(spark):
    reports = load(spark, SF, "feedback").select("id", "agent_id", "entry_id", "ts_s").toPandas().sort_values(["ts_s", "id"])
    kept, expected = {}, {}
    for r in reports.itertuples():
        on = [x for x in kept.get(r.entry_id, []) if x[0] > r.ts_s - 3600]
        expected[r.id] = len(on) < 10 and all(a != r.agent_id for _, a in on)
        kept[r.entry_id] = on + [(r.ts_s, r.agent_id)] * expected[r.id]
    assert not all(expected.values())
    for name in ("rate_limit_exact", "stream_rate_limit_state"):
        assert {r.id: r.accepted for r in registry.QUERIES[name](spark, SF).collect()} == expected


def test_feedback_is_routed(spark):
    reports = spark.createDataFrame([(1, 9, "negative", "wrong", "see x"), (2, 9, "negative", "outdated", None), (3, 9, "negative", "unclear", None)], "entry_id long, agent_id long, signal string, reason string, note string")
    claims = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, 3)], "id long, entry_id long")
    queue = spark.createDataFrame([(10, 150, 2), (30, 5, 1)], "claim_id long, priority long, attempts long")
    got = feedback.route(reports, claims, queue, AS_OF)
    assert rows(got["verify_queue"]) == [(10, 150, 0), (11, 100, 0), (20, 100, 0), (30, 5, 1)]
    assert [r.reason for r in got["feedback_log"].orderBy("entry_id").collect()] == ["wrong:see x", "outdated", "unclear"] and [r.entry_id for r in got["outdated"].collect()] == [2]


def test_workers(spark):
    queue = spark.createDataFrame([(1, 10, 0, 0, 0), (2, 10, -7200, 1, 0), (3, 90, 0, 3, 0), (4, 90, 0, 0, 999), (5, 12, 0, 2, None)], "claim_id long, priority long, queued_s long, attempts long, next_s long")
    assert [(r.claim_id, r["rank"]) for r in workers.due(queue, 0).collect()] == [(2, 14.0), (5, 12.0), (1, 10.0)]
    done = workers.after_attempts(queue, spark.createDataFrame([(1, True), (2, False), (5, False)], "claim_id long, ok boolean"), 100)
    assert rows(done["verify_queue"]) == [(2, 10, -7200, 2, 100 + 60 * 25), (3, 90, 0, 3, 0), (4, 90, 0, 0, 999)] and rows(done["finalized"]) == [(5, "unverified", 0.0)]
    reports = spark.createDataFrame([(1, "awaiting-pull", 0), (2, "awaiting-pull", 50_000), (3, "final", 0)], "id long, status string, since_s long")
    after, gone = workers.expire(reports, 90_000)
    assert [r.status for r in after.orderBy("id").collect()] == ["expired", "awaiting-pull", "final"] and rows(gone) == [(1,)]
    claims = spark.createDataFrame([(1, "verified", 0.8, 0.8), (2, "verified", 0.8, 0.8), (3, "disputed", 0.6, 0.6)], "id long, verdict string, certainty double, authority double")
    checks = spark.createDataFrame([(1, "unverified", 0.1), (2, "disputed", 0.9)], "id long, verdict string, certainty double")
    assert rows(workers.drift(claims, checks)) == [(1, "verified", 0.4, 0.4, None), (2, "disputed", 0.9, 0.9, "verified"), (3, "disputed", 0.6, 0.6, None)]
    domains = spark.createDataFrame([(1, "general"), (2, "general"), (2, "db"), (3, "general")], "entry_id long, domain string")
    found = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "x")], "entry_id long, domain string")
    assert rows(workers.reclassify(domains, found)) == [(1, "a"), (1, "b"), (2, "db"), (2, "general"), (3, "general")]
    held = spark.createDataFrame([("01HX000000ABC", 1714765692928), ("01HX000000ABD", 1714765692928)], "id string, created_ms long")
    assert [r.id for r in workers.lookup(held, "01HX000000ABC").collect()] == ["01HX000000ABC"]
    with pytest.raises(ValueError):
        workers.lookup(held, "x")
    urls = ["https://www.example.org/a", "http://ads.example.org", "https://badexample.org", "no url", None, "https://sub.example.org:80/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(workers.host_passes("url", ["example.org"], ["ads.example.org"])).collect()] == [True, False, False, False, False, True]
    assert [r[0] for r in df.select(workers.host_passes("url")).collect()] == [True, True, True, False, False, True]
    counts = spark.createDataFrame([("b_total", "ok", 3.0), ("a", None, 0.5)], "name string, label string, value double")
    assert workers.metrics_text(counts) == 'a 0.5\nb_total{label="ok"} 3\n'


def test_research_ingests_what_passes(spark):
    store = sinks.Snapshots(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    assert workers.health(store) == {"ok": True, "version": 0}
    about = "A vector index ( such as this one ) finds near points . It keeps them sorted , and answers queries quickly . "
    hits = [("1", "https://a.org/x", "Vector index", about, "official-docs", "en"), ("2", "https://a.org/x", "Vector index", about, None, "en"), ("3", "https://blocked.org/", "Vector index", about * 2, None, "en"),
            ("4", "https://b.org/", "Cooking", "Beans and rice are cooked slowly for a long time with onions, garlic and a bay leaf.", None, "en")]
    df = spark.createDataFrame(hits, "id string, url string, title string, content string, source_type string, language string")
    assert workers.research(store, df, "vector index", AS_OF, block=["blocked.org"]) == 1
    got = store.read("entry").collect()
    assert [(r.entry_id, r.authority) for r in got] == [("1-0", 0.9)] and got[0].content.startswith("A vector index (such as this one) finds near points. It keeps")


def test_near_pairs_are_all_pairs_without_a_shuffle_of_them(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[300:450] = x[:150] + 0.45 * rng.standard_normal((150, 16))
    x[450:470], x[480] = x[0], 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, embedding array<float>").repartition(7)
    y = x.astype(float)
    norm = np.linalg.norm(y, axis=1)
    sim = np.divide(y @ y.T, np.outer(norm, norm), out=np.zeros((600, 600)), where=np.outer(norm, norm) > 0)
    found = vectors.near_pairs(df, 0.2)
    got = {(r.a, r.b): r.distance for r in found.collect()}
    assert set(got) == {(i, j) for i in range(600) for j in range(i + 1, 600) if 1 - round(sim[i, j], 9) < 0.2} and len(got) > 250
    assert all(abs(d - (1 - sim[p])) < 1e-9 for p, d in got.items())
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
