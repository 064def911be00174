"""Operators with parameters, as queries over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import evidence, graph, retrieval
from ..sources.bindings import AS_OF, load
from . import retrieval as sql
from .registry import ORACLES, QUERIES, frame

QUERY = " ".join(sql.TERMS)


@frame("search_indexed")
def indexed(spark, d):
    """API7, SRC4: the search over an inverted index; what it must give is the SQL of the scan."""
    entries = load(spark, d, "entry")
    found = retrieval.search(entries, load(spark, d, "entry_source"), QUERY, AS_OF, index=retrieval.postings(entries))
    return found.select("id", "relevance", "final")


ORACLES["search_indexed"] = ORACLES["search_or_terms"]


@frame("find_with_claims")
def found(spark, d):
    """API1: a search with the claims of what it finds, as one text an entry."""
    got = retrieval.find(load(spark, d, "entry"), load(spark, d, "entry_source"), load(spark, d, "claim"), QUERY, AS_OF)
    return got.select("id", "final", F.to_json("claims").alias("claims"), F.round("factuality", 6).alias("factuality"))


@frame("audit_report")
def audit(spark, d):
    """API8: totals, trust and languages."""
    return retrieval.audit(load(spark, d, "entry"), load(spark, d, "entry_source"), AS_OF)


@frame(
    "provenance_claims",
    """WITH RECURSIVE w AS (SELECT CAST(199 AS BIGINT) AS id, 0 AS depth UNION ALL SELECT r.dst, w.depth + 1 FROM w JOIN claim_relation r ON r.src = w.id AND r.kind = 'derives-from' WHERE w.depth < 4)
      SELECT w.id, min(depth) AS depth, c.verdict, c.certainty FROM w JOIN claim c ON c.id = w.id WHERE depth > 0 GROUP BY w.id, c.verdict, c.certainty""",
    "claim_relation", "claim",
)
def provenance(spark, d):
    """API4, GRA3: what a claim derives from within four steps, with verdicts."""
    return graph.provenance(load(spark, d, "claim_relation"), load(spark, d, "claim"), 199)


@frame(
    "contradictions_of_entity",
    """WITH c AS (SELECT claim_id FROM kg_relation WHERE src = 's1' OR dst = 's1') SELECT DISTINCT src, dst, CAST(weight AS DOUBLE) AS weight FROM claim_relation
      WHERE kind = 'contradicts' AND (src IN (SELECT claim_id FROM c) OR dst IN (SELECT claim_id FROM c)) ORDER BY weight DESC, src, dst LIMIT 20""",
    "claim_relation", "kg_relation",
)
def contradictions(spark, d):
    """API4, GRA4: contradictions among the claims of an entity, the weightiest first."""
    return graph.contradictions(load(spark, d, "claim_relation"), facts=load(spark, d, "kg_relation"), entity="s1")


@frame(
    "graph_conflicts",
    """WITH r AS (SELECT kind, count(DISTINCT dst) * 1.0 / greatest(count(DISTINCT src), 1) AS ratio FROM kg_relation GROUP BY kind),
      t AS (SELECT src || kind AS triple, src, kind, 'n0' AS dst FROM kg_relation WHERE kind = 'located_in' AND src LIKE 's%')
      SELECT t.triple, t.kind, count(DISTINCT k.claim_id) AS support, least(0.95, 0.7 + 0.05 * least(count(DISTINCT k.claim_id), 5)) AS confidence FROM t JOIN r ON r.kind = t.kind AND r.ratio < 1.5
      JOIN kg_relation k ON k.src = t.src AND k.kind = t.kind AND k.dst <> t.dst GROUP BY t.triple, t.kind""",
    "kg_relation",
)
def conflicts(spark, d):
    """GRA5: facts that clash with what the graph says under a functional predicate."""
    kg = load(spark, d, "kg_relation")
    triples = kg.where("kind = 'located_in'").select(F.concat("src", "kind").alias("triple"), "src", "kind", F.lit("n0").alias("dst")).distinct()
    return graph.conflicts(kg, triples)


def sources(spark, d):
    """Documents as sources of claims: sixteen a claim, some republished under another address."""
    docs = load(spark, d, "documents")
    return docs.select(
        F.floor(F.col("doc_id") / 16).cast("long").alias("claim_id"), F.col("doc_id").alias("id"), F.format_string("https://www.site%s.example.com/%s", F.col("doc_id") % 11, "doc_id").alias("url"),
        F.substring_index(F.coalesce("text", F.lit("")), ".", 1).alias("title"), F.coalesce("text", F.lit("")).alias("text"),
    )


@frame("independence_clusters")
def independence(spark, d):
    """JON17, GRA10, STX19-21, AGG19: a claim's sources that are one voice (by domain, title or SimHash); tested against all pairs."""
    return evidence.independence(evidence.fingerprints(sources(spark, d)))


QUERIES["simhash_docs"] = lambda spark, d: load(spark, d, "documents").select("doc_id", F.lower(F.lpad(F.hex(fn.simhash("text")), 16, "0")).alias("fingerprint"))
