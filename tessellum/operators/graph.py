"""Graph operators: bounded walks with label sets, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bindings import shared_folder


def neighbors(relations: DataFrame, root: str, hops: int = 1, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(id, distance, via): GRA1, what an undirected walk of 1 to ``hops`` steps (of ``kinds``, if given) reaches, with all labels on the way.

    Walks are not enumerated: a hop keeps each (node, label set) once. Walks may turn back, so
    the root itself is reached at the second hop. With a limit the nearest come, then by id.
    """
    r = relations.select("src", "dst", "kind")
    if kinds:
        r = r.where(F.col("kind").isin(kinds))
    edges = r.union(r.select("dst", "src", "kind")).toDF("a", "b", "kind").distinct()
    front = edges.sparkSession.createDataFrame([(root,)], "id string").withColumn("rels", F.array().cast("array<string>"))
    reached = []
    for d in range(1, hops + 1):
        front = front.join(edges, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.array_sort(F.array_union("rels", F.array("kind"))).alias("rels")).distinct()
        reached.append(front.withColumn("d", F.lit(d)))
    walked = reached[0]
    for x in reached[1:]:
        walked = walked.union(x)
    out = walked.select("id", "d", F.explode("rels").alias("r")).groupBy("id").agg(F.min("d").alias("distance"), F.array_join(F.array_sort(F.collect_set("r")), ",").alias("via"))
    return out if limit is None else out.orderBy("distance", "id").limit(limit)


def resolve(entities: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """(state, id, candidates): GRA2, an entity by its id or, whatever the case, its name; two or more are ambiguous, with five at most."""
    rows = entities.where((F.col("id") == name) | (F.lower("name") == name.lower()))
    if kind:
        rows = rows.where((F.col("id") == name) | (F.col("kind") == kind))
    exact = F.max(F.when(F.col("id") == name, F.col("id")))
    got = rows.agg(F.count("*").alias("n"), exact.alias("exact"), F.array_sort(F.collect_list(F.struct("id", "name", "kind"))).alias("all"))
    one = F.coalesce("exact", F.when(F.col("n") == 1, F.col("all")[0]["id"]))
    state = F.when(one.isNotNull(), "found").when(F.col("n") == 0, "not_found").otherwise("ambiguous")
    return got.select(state.alias("state"), one.alias("id"), F.when(state == "ambiguous", F.slice("all", 1, 5)).alias("candidates"))


def provenance(relations: DataFrame, claims: DataFrame, claim: int, depth: int = 4, limit: int = 100) -> DataFrame:
    """(id, depth, verdict, certainty): GRA3, what a claim derives from within ``depth`` steps; the nearest first, then the most certain."""
    steps = relations.where("kind = 'derives-from'").select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    front = relations.sparkSession.createDataFrame([(claim,)], "id long")
    reached = None
    for d in range(1, depth + 1):
        front = front.join(steps, F.col("id") == F.col("_s")).select(F.col("_d").alias("id")).distinct()
        here = front.withColumn("depth", F.lit(d))
        reached = here if reached is None else reached.union(here)
    nearest = reached.groupBy("id").agg(F.min("depth").alias("depth"))
    return nearest.join(claims.select("id", "verdict", "certainty"), "id").orderBy("depth", F.desc("certainty"), "id").limit(limit)


def contradictions(relations: DataFrame, claim: int | None = None, facts: DataFrame | None = None, entity: str | None = None, limit: int = 20) -> DataFrame:
    """(src, dst, weight): GRA4, pairs that contradict and touch a claim, or any claim of facts(src, dst, claim_id) that names an entity."""
    pairs = relations.where("kind = 'contradicts'").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    if claim is not None:
        touched = pairs.where((F.col("src") == claim) | (F.col("dst") == claim))
    else:
        ids = facts.where((F.col("src") == entity) | (F.col("dst") == entity)).select("claim_id").distinct()
        touched = pairs.join(ids, pairs.src == ids.claim_id, "left_semi").union(pairs.join(ids, pairs.dst == ids.claim_id, "left_semi")).distinct()
    return touched.orderBy(F.desc("weight"), "src", "dst").limit(limit)


def conflicts(relations: DataFrame, triples: DataFrame) -> DataFrame:
    """(triple, kind, support, confidence): GRA5, AGG5-6, the strongest conflict of each triples(triple, src, kind, dst) with the graph.

    What else the graph says of the subject under the predicate conflicts if the predicate
    is functional, that is has fewer than 1.5 objects a subject. Confidence grows by .05 for
    each claim behind it from .7, at most .95.
    """
    ratio = relations.groupBy("kind").agg((F.count_distinct("dst") / F.greatest(F.count_distinct("src"), F.lit(1))).alias("ratio"))
    functional = ratio.where("ratio < 1.5").select("kind")
    other = triples.join(functional, "kind").alias("t").join(relations.alias("r"), (F.col("t.src") == F.col("r.src")) & (F.col("t.kind") == F.col("r.kind")) & (F.col("t.dst") != F.col("r.dst")))
    support = other.groupBy("t.triple", "t.kind").agg(F.count_distinct("r.claim_id").alias("support"))
    return support.withColumn("confidence", F.least(F.lit(0.95), 0.7 + 0.05 * F.least("support", F.lit(5))))


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, component): the least node that each node of edges(a, b) reaches.

    Labels take the least of their neighbours' and then jump to their label's label, so
    rounds grow with the logarithm of the diameter; each round is a table in the folder
    of spark.checkpoint.dir. The driver sees one count a round.
    """
    both = kept(edges.union(edges.select("b", "a")).distinct())
    labels = kept(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        new = labels.join(seen, "id").select("id", F.least("component", "m").alias("component"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = kept(new.join(jump, "component").select("id", F.least("component", "next").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "was"), "id").where("was <> component").count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("no fixpoint")
