"""Ranked retrieval as DataFrame functions."""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

# The least authority of a trust level, and the weights of relevance, authority and freshness.
LEVELS = {"high": 0.7, "medium": 0.4, "low": 0.0}
WEIGHTS = (0.5, 0.2, 0.3)


def encode_cursor(score: float, id_: str) -> str:
    """SRT3."""
    return base64.b64encode(json.dumps({"score": score, "id": id_}, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str | None) -> tuple[float, str] | None:
    """SRT3: (score, id); None for what is no cursor."""
    try:
        got = json.loads(base64.b64decode(cursor or "", validate=True))
        score, id_ = got["score"], got["id"]
    except (ValueError, KeyError, TypeError, binascii.Error):
        return None
    return (score, id_) if isinstance(score, (int, float)) and not isinstance(score, bool) and isinstance(id_, str) else None


def postings(entries: DataFrame) -> DataFrame:
    """SRC4: (token, id, tf), an inverted index of entries(id, content); write it partitioned by head, the first letter."""
    tokens = F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return entries.select("id", tokens.alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf")).withColumn("head", F.substring("token", 1, 1))


def _eligible(entries: DataFrame, sources: DataFrame, min_authority: float, min_trust: str | None, domain: str | None, tags: list[str] | None, language: str | None) -> DataFrame:
    """Active entries that pass the filters, with authority: FLT1-5, FLT7."""
    least = max(min_authority, LEVELS[min_trust] if min_trust else 0.0)
    rows = entries.where("status = 'active'")
    if language:
        rows = rows.where(F.col("language") == language)
    if domain:
        rows = rows.where(F.array_contains("domains", domain))
    if tags:
        rows = rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return rows.join(entry_authority(sources).where(F.col("authority") >= least), F.col("id") == F.col("entry_id"))


def search(
    entries: DataFrame, sources: DataFrame, query: str, as_of: int, limit: int = 10, index: DataFrame | None = None, min_authority: float = 0.0,
    min_trust: str | None = None, domain: str | None = None, tags: list[str] | None = None, language: str | None = None, cursor: str | None = None,
) -> DataFrame:
    """API7, RNK1-2, SRT1-4: entries with a word that begins like any of the query's, the best first.

    The max(3 x limit, 20) with most such words are scored: .5 relevance (their counts from 0
    to 1; 1 if all agree), .2 authority, .3 freshness; ties to the larger id. With ``index``
    (``postings``) only tokens under the query's first letters are read. A cursor continues
    strictly behind the row that it names; one that can't be read starts anew. A query
    without words finds nothing.
    """
    terms = [t.lower() for t in query.split()]
    rows = _eligible(entries, sources, min_authority, min_trust, domain, tags, language)
    if index is not None:
        hit: Column = F.lit(False)
        for t in terms:
            hit = hit | F.col("token").startswith(t)
        n = sum((F.when(F.col("token").startswith(t), F.col("tf")).otherwise(0) for t in terms), F.lit(0))
        found = index.where(F.col("head").isin(sorted({t[0] for t in terms})) & hit).groupBy("id").agg(F.sum(n).alias("tf"))
        scored = rows.join(found, "id")
    else:
        count = lambda t: F.regexp_count(F.lower("content"), F.lit(rf"(?:^|[^\p{{L}}\p{{N}}]){re.escape(t)}"))
        scored = rows.withColumn("tf", sum((count(t) for t in terms), F.lit(0))).where("tf > 0")
    pool = scored.orderBy(F.desc("tf"), F.desc("id")).limit(max(3 * limit, 20))
    ends = pool.agg(F.min("tf").alias("_lo"), F.max("tf").alias("_hi"))
    relevance = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((F.col("tf") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    final = WEIGHTS[0] * relevance + WEIGHTS[1] * F.col("authority") + WEIGHTS[2] * scoring.freshness(F.col("decay_rate"), F.col("created_s"), as_of)
    ranked = pool.join(F.broadcast(ends)).select("id", "language", F.round(relevance, 6).alias("relevance"), F.round("authority", 6).alias("authority"), F.round(final, 6).alias("final"))
    return _page(ranked, cursor, limit)


def _page(ranked: DataFrame, cursor: str | None, limit: int) -> DataFrame:
    after = decode_cursor(cursor)
    if after is not None:
        id_ = F.lit(after[1]).cast(ranked.schema["id"].dataType)
        ranked = ranked.where((F.col("final") < after[0]) | ((F.col("final") == after[0]) & (F.col("id") < id_)))
    return ranked.orderBy(F.desc("final"), F.desc("id")).limit(limit)


def find(entries: DataFrame, sources: DataFrame, claims: DataFrame, query: str | None, as_of: int, limit: int = 10, **filters) -> DataFrame:
    """API1, PRJ4: a search, or without a query what is best by authority and freshness, with the claims and factuality of entries that have any."""
    found = search(entries, sources, query, as_of, limit, **filters) if query and query.strip() else explore(entries, sources, as_of, limit=limit, **filters)
    checked = F.col("verdict").isin("verified", "disputed")
    about = claims.join(found.select(F.col("id").alias("entry_id")), "entry_id").groupBy("entry_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("id").alias("claim_id"), "verdict", "certainty"))).alias("claims"),
        (F.sum(F.when(F.col("verdict") == "verified", 1)) / F.sum(F.when(checked, 1))).alias("factuality"),
    )
    return found.join(about, F.col("id") == F.col("entry_id"), "left").drop("entry_id").orderBy(F.desc("final"), F.desc("id"))


def audit(entries: DataFrame, sources: DataFrame, as_of: int) -> DataFrame:
    """API8, AGG1-3: (section, name, value): totals, mean authority and the twenty commonest languages."""
    scored = entries.join(entry_authority(sources), F.col("id") == F.col("entry_id"), "left")
    totals = scored.agg(
        F.count("*").cast("double").alias("entries"), F.count(F.when(F.col("status") == "active", 1)).cast("double").alias("active"),
        F.coalesce(F.round(F.avg("authority"), 3), F.lit(0.0)).alias("mean_authority"), F.count(F.when(F.col("created_s") > as_of - 30 * 86400, 1)).cast("double").alias("last_30_days"),
    )
    names = totals.columns
    cells = totals.select(F.explode(F.array(*[F.struct(F.lit("totals").alias("section"), F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("c")).select("c.*")
    top = entries.groupBy("language").count().orderBy(F.desc("count"), "language").limit(20)
    return cells.union(top.select(F.lit("languages"), "language", F.col("count").cast("double")))


def entry_authority(sources: DataFrame) -> DataFrame:
    """(entry_id, authority): best trust x .8 + mean trust x .2, or the only source's trust."""
    best, mean = F.max("trust"), F.avg("trust")
    return sources.groupBy("entry_id").agg(F.when(F.count("*") == 1, best).otherwise(best * 0.8 + mean * 0.2).alias("authority"))


def explore(entries: DataFrame, sources: DataFrame, as_of: int, min_authority: float = 0.0, limit: int = 10, after: tuple | None = None) -> DataFrame:
    """The next ``limit`` active entries by .4 authority + .6 freshness, ties by larger id.

    ``after`` is the (final, id) of the last row seen, a true keyset: the page holds what
    stands strictly behind it.
    """
    ranked = (
        entries.where("status = 'active'")
        .join(entry_authority(sources).where(F.col("authority") >= min_authority), F.col("id") == F.col("entry_id"))
        .withColumn("_fresh", scoring.freshness(F.col("decay_rate"), F.col("created_s"), as_of))
        .withColumn("_final", 0.4 * F.col("authority") + 0.6 * F.col("_fresh"))
    )
    if after is not None:
        ranked = ranked.where(F.struct("_final", "id") < F.struct(F.lit(after[0]), F.lit(after[1])))
    top = ranked.orderBy(F.desc("_final"), F.desc("id")).limit(limit)
    return top.select(
        "id",
        "language",
        F.round("authority", 6).alias("authority"),
        F.round("_fresh", 6).alias("freshness"),
        F.round("_final", 6).alias("final"),
        scoring.trust_level(F.col("authority")).alias("trust_level"),
    )
