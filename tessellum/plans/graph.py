"""Entity and claim graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as op
from ..sources.bindings import load
from .registry import frame, statement

ROOT = "s1"


@statement("neighbors_1hop", "kg_relation")
def one_hop(q):
    """GRA1, JON5, AGG8: undirected neighbours of an entity with the labels that reach them."""
    k = q.table("kg_relation")
    return f"""WITH e AS (SELECT src AS a, dst AS b, kind FROM {k} UNION ALL SELECT dst, src, kind FROM {k}) SELECT b AS id, 1 AS distance, {q.listed("kind")} AS via FROM e WHERE a = '{ROOT}' GROUP BY b"""


TWO_HOPS = f"""WITH RECURSIVE e AS (SELECT DISTINCT a, b, kind FROM (SELECT src AS a, dst AS b, kind FROM kg_relation UNION ALL SELECT dst, src, kind FROM kg_relation) x),
  w AS (SELECT '{ROOT}' AS id, 0 AS d, CAST([] AS VARCHAR[]) AS rels UNION ALL SELECT DISTINCT e.b, w.d + 1, list_sort(list_distinct(list_append(w.rels, e.kind))) FROM w JOIN e ON w.id = e.a WHERE w.d < 2)
  SELECT id, CAST(min(d) AS INTEGER) AS distance, string_agg(DISTINCT r, ',' ORDER BY r) AS via FROM (SELECT id, d, unnest(rels) AS r FROM w WHERE d > 0) u GROUP BY id"""


@frame("neighbors_2hop", TWO_HOPS, "kg_relation")
def two_hops(spark, d):
    """GRA1: two hops; the root comes back at the second."""
    return op.neighbors(load(spark, d, "kg_relation"), ROOT, hops=2)


@statement("provenance_depth", "claim_relation")
def provenance(q):
    """GRA3, JON6, AGG7, SET1: what a claim derives from, with the least depth."""
    r = q.table("claim_relation")
    return f"""WITH RECURSIVE w AS (SELECT CAST(199 AS BIGINT) AS id, 0 AS depth UNION ALL SELECT r.dst, w.depth + 1 FROM w JOIN {r} r ON r.src = w.id AND r.kind = 'derives-from' WHERE w.depth < 8)
      SELECT id, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY id"""


@statement("contradictions_by_claim", "claim_relation")
def by_claim(q):
    """GRA4, SRT8: contradiction pairs that touch a claim, by weight."""
    return f"SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM {q.table('claim_relation')} WHERE kind = 'contradicts' AND (src = 35 OR dst = 42) ORDER BY weight DESC, src LIMIT 20"


@statement("contradictions_by_entity", "claim_relation", "kg_relation")
def by_entity(q):
    """GRA4, JON4, JON11: pairs with an end among the claims of an entity; the either-or join is a union of two."""
    r, k = q.table("claim_relation"), q.table("kg_relation")
    return f"""WITH c AS (SELECT claim_id FROM {k} WHERE src = '{ROOT}' UNION SELECT claim_id FROM {k} WHERE dst = '{ROOT}')
      SELECT src, dst FROM {r} WHERE kind = 'contradicts' AND src IN (SELECT claim_id FROM c) UNION SELECT src, dst FROM {r} WHERE kind = 'contradicts' AND dst IN (SELECT claim_id FROM c)"""


@statement("functional_predicates", "kg_relation")
def functional(q):
    """AGG6, MTH10: predicates with fewer than 1.5 objects a subject."""
    return f"SELECT kind, round(count(DISTINCT dst) * 1.0 / greatest(count(DISTINCT src), 1), 6) AS ratio, count(DISTINCT dst) * 1.0 / greatest(count(DISTINCT src), 1) < 1.5 AS functional FROM {q.table('kg_relation')} GROUP BY kind"


@statement("conflicting_objects", "kg_relation")
def conflicting(q):
    """AGG5, GRA5: objects other than the expected one by support, with the confidence of a conflict."""
    return f"""SELECT dst, support, round(least(0.95, 0.7 + 0.05 * least(support, 5)), 6) AS confidence FROM (SELECT dst, count(DISTINCT claim_id) AS support FROM {q.table("kg_relation")}
      WHERE src = '{ROOT}' AND kind = 'supplies-n' AND dst <> 'p1' GROUP BY dst) x ORDER BY support DESC, dst LIMIT 5"""


@statement("kg_fact_expansion", "kg_relation", "entity")
def expansion(q):
    """GRA8, JON1, FLT11, STX31: facts that touch a named entity, as sentences."""
    k, e = q.table("kg_relation"), q.table("entity")
    return f"""SELECT s.name || ' ' || {q.replace("k.kind", "_", " ")} || ' ' || t.name || '.' AS fact, CAST(k.weight AS DOUBLE) AS weight, k.claim_id FROM {k} k JOIN {e} s ON k.src = s.id JOIN {e} t ON k.dst = t.id
      WHERE k.src = '{ROOT}' ORDER BY k.weight DESC, k.claim_id, k.dst LIMIT 6"""


@statement("fact_bundles", "claim_relation")
def bundles(q):
    """GRA9, WIN3, JON13: up to five links of each type of every claim, outgoing before incoming."""
    r = q.table("claim_relation")
    return f"""SELECT hub, kind, other, CAST(place AS BIGINT) AS place FROM (SELECT hub, kind, other, row_number() OVER (PARTITION BY hub, kind ORDER BY dir, weight DESC, other) AS place FROM (
      SELECT src AS hub, kind, dst AS other, 0 AS dir, weight FROM {r} UNION ALL SELECT dst, kind, src, 1, weight FROM {r} WHERE kind = 'contradicts') x) y WHERE place <= 5"""


@statement("edge_insert_ignore", "claim_relation")
def insert_ignore(q):
    """SNK7, GRA11: new edges without those known and without loops."""
    r = q.table("claim_relation")
    return f"""SELECT DISTINCT n.src, n.dst, n.kind FROM (SELECT src, CASE WHEN src % 2 = 0 THEN dst ELSE src END AS dst, CASE WHEN src % 3 = 0 THEN 'refines' ELSE kind END AS kind FROM {r}) n
      LEFT JOIN {r} o ON n.src = o.src AND n.dst = o.dst AND n.kind = o.kind WHERE o.src IS NULL AND n.src <> n.dst"""


@frame("components_minlabel")
def independent(spark, d):
    """GRA10: connected groups of contradicting claims by least label (its SQL closure is quadratic in a group: tested on a small graph)."""
    edges = load(spark, d, "claim_relation").where("kind = 'contradicts'")
    return op.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
