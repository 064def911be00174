"""Vector search over embeddings: operators with the engine's own thresholds, and the SQL of what they give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as op
from ..sources.bindings import load
from .registry import frame

_COS = "coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0)"


def _oracle(k: int, on: str = "", least: float = -2, queries: str = "a.id % 100 = 0") -> str:
    return f"""SELECT query_id, id, sim, verdict FROM (SELECT query_id, id, sim, verdict, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS n FROM (
      SELECT a.id AS query_id, b.id, b.verdict, {_COS} AS sim FROM claim a JOIN claim b ON a.id <> b.id {on} WHERE {queries}) s WHERE round(sim, 9) >= {least}) t WHERE n <= {k}"""


def _queries(claims):
    return claims.where("id % 100 = 0")


@frame("cosine_topk_exact", f"SELECT query_id, id, round(sim, 6) AS sim FROM ({_oracle(5)}) x", "claim")
def topk(spark, d):
    """SRC5, VEC1, SRT10: the five nearest of a query set (every hundredth claim), by exact cosine."""
    claims = load(spark, d, "claim")
    return op.nearest(claims, _queries(claims), 5).select("query_id", "id", F.round("sim", 6).alias("sim"))


@frame("near_dup_pairs", f"SELECT query_id, id, round(1 - sim, 6) AS distance FROM ({_oracle(8)}) x WHERE 1 - round(sim, 9) < 0.05", "claim")
def near(spark, d):
    """VEC3: of a query set, the eight nearest and then those within a distance of .05."""
    claims = load(spark, d, "claim")
    return op.nearest(claims, _queries(claims), 8).where("1 - sim < 0.05").select("query_id", "id", F.round(1 - F.col("sim"), 6).alias("distance"))


_REF = _oracle(20, "AND a.entry_id <> b.entry_id AND b.verdict IN ('verified', 'disputed')", 0.8)


@frame("cross_ref_counts", f"SELECT query_id, count(CASE WHEN verdict = 'verified' THEN 1 END) AS verified, count(CASE WHEN verdict = 'disputed' THEN 1 END) AS disputed FROM ({_REF}) x GROUP BY query_id", "claim")
def cross_ref(spark, d):
    """VEC4: verdicts of other entries' claims that are .8 similar or more, 20 at most, for each of a query set."""
    claims = load(spark, d, "claim")
    found = op.nearest(claims.where("verdict IN ('verified', 'disputed')"), _queries(claims), 20, 0.8, other=("entry_id",))
    met = found.join(claims.select("id", "verdict"), "id")
    return met.groupBy("query_id").agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("verified", "disputed")])


@frame("entity_fuzzy_top1", f"SELECT query_id, CASE WHEN round(sim, 9) >= 0.9 THEN id ELSE query_id END AS resolved FROM ({_oracle(1, 'AND a.verdict = b.verdict')}) x", "claim")
def fuzzy(spark, d):
    """GRA6: the nearest of the same kind, which an entity is taken for from .9 on."""
    claims = load(spark, d, "claim")
    found = op.nearest(claims, _queries(claims), 1, same=("verdict",))
    return found.select("query_id", F.when(F.col("sim") >= 0.9, F.col("id")).otherwise(F.col("query_id")).alias("resolved"))


@frame(
    "near_dup_survivors",
    f"""WITH p AS (SELECT a.id AS a, b.id AS b, a.certainty AS wa, b.certainty AS wb FROM claim a JOIN claim b ON a.id < b.id WHERE 1 - round({_COS}, 9) < 0.05 AND NOT (list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) = 0)),
      l AS (SELECT CASE WHEN wa >= wb THEN b ELSE a END AS id, CASE WHEN wa >= wb THEN a ELSE b END AS keep_id, greatest(wa, wb) AS w FROM p)
      SELECT c.id, first(l.keep_id ORDER BY l.w DESC, l.keep_id) AS keep_id FROM claim c LEFT JOIN l ON l.id = c.id GROUP BY c.id""",
    "claim",
)
def survivors(spark, d):
    """VEC5: every claim, with the one that it gives way to: within a distance of .05 the more certain stays, of equals the smaller id."""
    claims = load(spark, d, "claim")
    weight = claims.select("id", F.col("certainty").alias("authority"))
    gone = op.losers(op.near_pairs(claims.select("id", "embedding")), weight)
    return claims.select("id").join(gone, "id", "left")


@frame("near_pairs", f"SELECT a.id AS a, b.id AS b, round(1 - {_COS}, 6) AS distance FROM claim a JOIN claim b ON a.id < b.id WHERE 1 - round({_COS}, 9) < 0.2", "claim")
def pairs(spark, d):
    """JON16: pairs of claims that are .8 similar or more, all of them."""
    claims = load(spark, d, "claim")
    return op.near_pairs(claims.select("id", "embedding"), 0.2).select("a", "b", F.round("distance", 6).alias("distance"))
