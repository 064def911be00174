"""Steps of the engine's workers over snapshots: queues, expiry, drift, lookups, research, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from .ingest import ingest
from .sinks import Snapshots

ATTEMPTS = 3


def due(queue: DataFrame, now_s: int, limit: int = 50) -> DataFrame:
    """STR2, SRT5, FLT19: the rows of queue(claim_id, priority, queued_s, attempts, next_s) to work on: priority and a point for each half hour waited."""
    rank = F.col("priority") + (F.lit(now_s) - F.col("queued_s")) / 1800.0
    ready = queue.where((F.coalesce("next_s", F.lit(0)) <= now_s) & (F.col("attempts") < ATTEMPTS))
    return ready.withColumn("rank", rank).orderBy(F.desc("rank"), "claim_id").limit(limit)


def after_attempts(queue: DataFrame, outcomes: DataFrame, now_s: int) -> dict[str, DataFrame]:
    """STR2-3, DTM5, SNK6, SNK15: the queue and the claims given up after outcomes(claim_id, ok).

    What succeeded leaves the queue. What failed waits 5, 25, then 125 minutes; the third
    failure ends it as unverified with certainty 0. Rows without an outcome stay.
    """
    met = queue.join(outcomes, "claim_id", "left")
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    tried = F.col("attempts") + F.when(failed, 1).otherwise(0)
    stay = met.where(~F.coalesce("ok", F.lit(False)) & ~(failed & (tried >= ATTEMPTS)))
    wait = F.lit(now_s) + 60 * F.pow(F.lit(5), tried).cast("long")
    kept = stay.withColumns({"next_s": F.when(failed, wait).otherwise(F.col("next_s")), "attempts": tried.cast("long")}).select(*queue.columns)
    ended = met.where(failed & (tried >= ATTEMPTS)).select("claim_id", F.lit("unverified").alias("verdict"), F.lit(0.0).alias("certainty"))
    return {"verify_queue": kept, "finalized": ended}


def expire(reports: DataFrame, now_s: int, ttl_s: int = 86400) -> tuple[DataFrame, DataFrame]:
    """STR7, SNK14: reports(id, status, since_s) with those that waited longer than the time to live expired, and the ids of these."""
    old = (F.col("status") == "awaiting-pull") & (F.col("since_s") < now_s - ttl_s)
    return reports.withColumn("status", F.when(old, "expired").otherwise(F.col("status"))), reports.where(old).select("id")


def drift(claims: DataFrame, checks: DataFrame) -> DataFrame:
    """PIP6: claims(id, verdict, certainty, authority) after checks(id, verdict, certainty) of old verdicts.

    A check that finds nothing halves the certainty and keeps the verdict; any other is
    taken as it is. Authority follows the certainty; drifted_from has the verdict before a change.
    """
    new = checks.select("id", F.col("verdict").alias("_v"), F.col("certainty").alias("_c"))
    met = claims.join(new, "id", "left")
    weak = F.col("_v") == "unverified"
    certainty = F.when(F.col("_v").isNull(), F.col("certainty")).when(weak, F.col("certainty") / 2).otherwise(F.col("_c"))
    verdict = F.when(F.col("_v").isNull() | weak, F.col("verdict")).otherwise(F.col("_v"))
    return met.select(
        "id", verdict.alias("verdict"), certainty.alias("certainty"), F.when(F.col("_v").isNull(), F.col("authority")).otherwise(certainty).alias("authority"),
        F.when(verdict != F.col("verdict"), F.col("verdict")).alias("drifted_from"),
    )


def reclassify(domains: DataFrame, found: DataFrame, generic: tuple[str, ...] = ("general",), most: int = 5) -> DataFrame:
    """PIP5, SNK16: domains(entry_id, domain) where entries that have only generic ones get those that were found, ``most`` at most, in order of name."""
    poor = domains.groupBy("entry_id").agg(F.max((~F.col("domain").isin(*generic)).cast("int")).alias("good")).where("good = 0").select("entry_id")
    new = found.join(poor, "entry_id", "left_semi").groupBy("entry_id").agg(F.slice(F.array_sort(F.collect_set("domain")), 1, most).alias("d"))
    return domains.join(new.select("entry_id"), "entry_id", "left_anti").select("entry_id", "domain").union(new.select("entry_id", F.explode("d")))


def lookup(entries: DataFrame, id_: str) -> DataFrame:
    """SRC6: the entry of a ULID; its time, which the id holds, is the partition that is read. ValueError for what is no ULID."""
    millis = fn.ulid_millis(id_)
    return entries.where((F.col("created_ms") == millis) & (F.col("id") == id_))


def host_passes(url: str, allow: list[str] = (), block: list[str] = ()) -> Column:
    """FLT23: whether a url's host is allowed by suffix: what is blocked never is, an empty list allows all, no host never is."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z]+://([^/:?#]+)", 1), r"^www\.", "")
    ends = lambda hosts: F.exists(F.array(*[F.lit(h.lower().removeprefix("www.")) for h in hosts]).cast("array<string>"), lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))
    return F.coalesce((host != "") & ~ends(block) & (ends(allow) if allow else F.lit(True)), F.lit(False))


def research(store: Snapshots, hits: DataFrame, topic: str, as_of: int, allow: list[str] = (), block: list[str] = (), least: float = 0.25) -> int:
    """PIP2, FLT22, STX4: hits(id, url, title, content, source_type, language) that pass the host lists and name enough of the topic are ingested.

    Each url once, the first by id; returns the version of the store that shows them. A
    topic without terms of two letters passes all.
    """
    terms = sorted({t for t in topic.lower().split() if len(t) >= 2})
    hay = F.lower(F.concat_ws(" ", "title", "content"))
    share = sum((F.when(F.contains(hay, F.lit(t)), 1.0).otherwise(0.0) for t in terms), F.lit(0.0)) / max(len(terms), 1)
    good = hits.where(host_passes("url", allow, block) & (share >= (least if terms else 0.0)))
    first = good.groupBy("url").agg(F.min("id").alias("id"))
    closed = F.regexp_replace("content", r"\s+([.,;:!?)\]}'\"])", "$1")
    tidy = F.trim(F.regexp_replace(F.regexp_replace(closed, r"([(\[{])\s+", "$1"), r"[ \t]+", " "))
    return ingest(store, good.join(first, ["url", "id"], "left_semi").select("id", tidy.alias("raw"), "source_type", "language"), as_of)


def metrics_text(counts: DataFrame) -> str:
    """API10, SNK18: counts(name, label, value) of a bounded set of metrics in the text format that monitors read."""
    rows = sorted(counts.select("name", "label", "value").collect())
    return "".join(f'{r.name}{{label="{r.label}"}} {r.value:g}\n' if r.label else f"{r.name} {r.value:g}\n" for r in rows)


def health(store: Snapshots) -> dict[str, object]:
    """API10: whether the store answers, and the version that it shows."""
    try:
        return {"ok": True, "version": store.version()}
    except Exception as e:
        return {"ok": False, "error": fn.error_hint(str(e))}
