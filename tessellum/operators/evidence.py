"""Evidence: independent groups of sources, and the verdict that they give."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from . import graph


def fingerprints(sources: DataFrame) -> DataFrame:
    """JON17: adds domain, title and fingerprint to sources(claim_id, id, url, title, text)."""
    host = F.regexp_replace(F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/:?#]+)", 1), r"^www\.", "")
    title = F.trim(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", " "))
    return sources.withColumns({"domain": F.coalesce(host, F.lit("")), "title_norm": F.coalesce(title, F.lit("")), "fingerprint": fn.simhash("text")})


#: Sources of a claim that one task joins; those of a claim that has more are joined by links and rounds.
TASK_SOURCES = 1 << 10


def _voices(claim: list, ids: list, domains: list, titles: list, prints: list) -> list:
    """The grp of each source of one claim; the smallest id comes first, null last."""
    if claim[0] is None:
        return ids
    root = list(range(len(ids)))

    def join(x, y):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)

    first: list[dict] = [{}, {}, {}]
    for i, (domain, title, fingerprint) in enumerate(zip(domains, titles, prints, strict=True)):
        for some, key, known in zip((domain, title and len(title) > 4, True), (domain, title, fingerprint), first, strict=True):
            if some and (j := known.setdefault(key, i)) != i:
                join(i, j)
    f, at = np.array(list(first[2]), np.int64), list(first[2].values())
    for x, y in zip(*(c.tolist() for c in np.nonzero(np.triu(np.bitwise_count((f[:, None] ^ f[None]).view(np.uint64)) < 4, 1))), strict=True):
        join(at[x], at[y])
    for i in range(len(root)):
        root[i] = root[root[i]]
    return [None if x is None else ids[r] for x, r in zip(ids, root, strict=True)]


def _joined(batches):
    """(claim_id, id, grp) of sources (claim_id, id, domain, title_norm, fingerprint), which come sorted by claim and id."""
    rows: list[list] = [[] for _ in range(5)]

    def out(upto):
        grp, starts = [], [0, *(i for i in range(1, upto) if rows[0][i] != rows[0][i - 1]), upto]
        for lo, hi in zip(starts, starts[1:]):  # noqa: B905
            grp += _voices(*(c[lo:hi] for c in rows))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((rows[0][:upto], rows[1][:upto], grp), kinds, strict=True)], ["claim_id", "id", "grp"])

    for batch in batches:
        kinds = [batch.schema.types[i] for i in (0, 1, 1)]
        for c, more in zip(rows, batch.columns, strict=True):
            c += more.to_pylist()
        # the last claim may go on in the next batch
        upto = next((i for i in range(len(rows[0]) - 1, 0, -1) if rows[0][i] != rows[0][i - 1]), 0)
        if upto:
            yield out(upto)
            for c in rows:
                del c[:upto]
    if rows[0]:
        yield out(len(rows[0]))


def independence(sources: DataFrame, task_sources: int = TASK_SOURCES) -> DataFrame:
    """(claim_id, id, grp): GRA10, clusters of a claim's sources that are one voice.

    Sources of one claim are linked by the same domain, by the same title of more than four
    characters or by fingerprints that differ in fewer than four bits, and transitively.
    A claim's sources meet in one task, which joins them; those of claims with more than
    ``task_sources`` are joined by ``linked``. ``grp`` is the cluster's smallest id; ids are unique
    within a claim.
    """
    s = sources.select("claim_id", "id", "domain", "title_norm", "fingerprint")
    large = s.groupBy("claim_id").count().where(F.col("count") > task_sources).select("claim_id")
    some = not large.isEmpty()
    if some:
        s, large = graph.kept(s), graph.kept(large)
    small = s.join(large, s.claim_id.eqNullSafe(large.claim_id), "left_anti") if some else s
    small = small.withColumn("title_norm", F.when(F.length("title_norm") > 4, F.col("title_norm"))).repartition("claim_id").sortWithinPartitions("claim_id", F.asc_nulls_last("id"))
    kind = dict(s.dtypes)
    found = small.mapInArrow(_joined, f"claim_id {kind['claim_id']}, id {kind['id']}, grp {kind['id']}")
    return found.union(linked(s.join(large, s.claim_id.eqNullSafe(large.claim_id), "left_semi"))) if some else found


def linked(s: DataFrame) -> DataFrame:
    """``independence`` by links of sources(claim_id, id, domain, title_norm, fingerprint), for claims of any size.

    Equal domains, titles and fingerprints are stars to the smallest id; near fingerprints
    share one of four 16-bit bands.
    """

    def star(key: Column, some: Column) -> DataFrame:
        keyed = s.where(some).select("claim_id", "id", key.alias("k"))
        first = keyed.groupBy("claim_id", "k").agg(F.min("id").alias("b"))
        return keyed.join(first, ["claim_id", "k"]).select("claim_id", F.col("id").alias("a"), "b")

    distinct = s.groupBy("claim_id", "fingerprint").agg(F.min("id").alias("id"))
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fingerprint", 16 * k).bitwiseAND(F.lit(0xFFFF)).alias("bits")) for k in range(4)])
    banded = distinct.select("claim_id", "id", "fingerprint", F.explode(bands).alias("b")).select("claim_id", "id", "fingerprint", "b.*")
    x, y = banded.alias("x"), banded.alias("y")
    same = functools.reduce(lambda p, c: p & (F.col(f"x.{c}") == F.col(f"y.{c}")), ["claim_id", "band", "bits"], F.lit(True))
    near = x.join(y, same & (F.col("x.id") < F.col("y.id"))).where(fn.hamming(F.col("x.fingerprint"), F.col("y.fingerprint")) < 4)
    links = (
        star(F.col("domain"), F.col("domain") != "").union(star(F.col("title_norm"), F.length("title_norm") > 4)).union(star(F.col("fingerprint"), F.lit(True)))
        .union(near.select("x.claim_id", F.col("y.id").alias("a"), F.col("x.id").alias("b")))
    )
    node = lambda c: F.struct("claim_id", F.col(c).alias("id"))
    found = graph.components(links.select(node("a").alias("a"), node("b").alias("b")).where("a <> b").distinct())
    found = found.select(F.col("id.claim_id").alias("claim_id"), F.col("id.id").alias("id"), F.col("component.id").alias("grp"))
    return s.select("claim_id", "id").join(found, ["claim_id", "id"], "left").select("claim_id", "id", F.coalesce("grp", "id").alias("grp"))


def aggregate(evidence: DataFrame, damping: float = 0.4, scale: float = 4.0, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """(claim_id, posterior, verdict, certainty): RNK4 over evidence(claim_id, id, grp, authority, entailment, contradiction).

    Within a group the best authority counts whole, each further one by ``damping`` more.
    """
    rank = F.row_number().over(Window.partitionBy("claim_id", "grp").orderBy(F.desc("authority"), "id"))
    x = (F.col("entailment") - F.col("contradiction")) * F.col("authority") * F.pow(F.lit(damping), rank - 1) * scale
    p = evidence.select("claim_id", x.alias("x")).groupBy("claim_id").agg((1 / (1 + F.exp(-F.round(F.sum("x"), 9)))).alias("posterior"))
    verdict = F.when(F.col("posterior") >= high, "verified").when(F.col("posterior") <= low, "disputed").otherwise("unverified")
    certainty = F.when(F.col("posterior") >= high, F.col("posterior")).when(F.col("posterior") <= low, 1 - F.col("posterior")).otherwise(F.greatest("posterior", 1 - F.col("posterior")))
    return p.select("claim_id", F.round("posterior", 6).alias("posterior"), verdict.alias("verdict"), F.round(certainty, 6).alias("certainty"))


def feedback_strength(reports: DataFrame) -> DataFrame:
    """RNK5: adds strength to reports with the nine evidence fields; direct evidence counts before inferred, 1 at most.

    counter_source_url, counter_source_url_inferred, counter_nli_score, failure_dimension,
    failure_dimension_inferred, context_domain, context_scope, partial_truth,
    partial_truth_inferred; any may be null, empty texts count as null.
    """
    some = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    known = lambda c: F.col(c).isNotNull()
    parts = [
        F.when(some("counter_source_url"), 0.3).when(some("counter_source_url_inferred"), 0.15),
        F.when(F.col("counter_nli_score") >= 0.7, 0.2),
        F.when(some("failure_dimension"), 0.2).when(some("failure_dimension_inferred"), 0.1),
        F.when(some("context_domain") | some("context_scope"), 0.1),
        F.when(known("partial_truth"), 0.1).when(known("partial_truth_inferred"), 0.05),
    ]
    total = functools.reduce(lambda a, b: a + F.coalesce(b, F.lit(0.0)), parts, F.lit(0.1))
    return reports.withColumn("strength", F.round(F.least(F.lit(1.0), total), 3))
