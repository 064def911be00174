"""Ingest: raw texts to entries, sources and a log, committed together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as fn
from ..sources.bindings import SOURCE_TRUST
from . import retrieval, vectors
from .sinks import Snapshots

MOST = 200_000


def validate(inputs: DataFrame) -> DataFrame:
    """FLT32: adds errors, the limits that an input(id, raw, source_type) breaks."""
    kinds = [F.lit(k) for k in SOURCE_TRUST]
    size = F.coalesce(F.length("raw"), F.lit(0))
    tests = [F.when(size < 1, "raw-empty"), F.when(size > MOST, "raw-too-long"), F.when(F.col("source_type").isNotNull() & ~F.col("source_type").isin(*kinds), "source-type")]
    return inputs.withColumn("errors", F.array_compact(F.array(*tests)))


def decompose(inputs: DataFrame) -> DataFrame:
    """PIP1, PIP2: (id, index, title, content) of the chunks of each input's text without tags."""
    bare = F.regexp_replace("raw", "<[^>]*>", "")

    @F.pandas_udf("array<struct<title:string,content:string>>")
    def pieces(text):
        return text.map(lambda t: [{"title": fn.derived_title(c), "content": c} for c in fn.split_text(t or "")])

    return inputs.select("id", F.posexplode(pieces(bare)).alias("index", "piece")).select("id", "index", "piece.*")


def ingest(store: Snapshots, inputs: DataFrame, as_of: int, distance: float = 0.05) -> int:
    """API5, PIP1, SNK1: inputs(id, raw, source_type, language) become entries; returns the version that shows them.

    Inputs that break a limit are rejected, texts too short for a chunk have nothing to
    store, and a chunk within ``distance`` of an entry that is there, or of an earlier chunk,
    is a duplicate of it. Entries get the authority of their input's source. Everything, the
    log too, is committed in one version. Ids of entries are ``<input>-<chunk>``; an id that
    is there already is ignored.
    """
    checked = validate(inputs)
    good = checked.where(F.size("errors") == 0)
    chunks = decompose(good).join(good.select("id", "source_type", "language"), "id")
    chunks = chunks.withColumn("entry_id", F.concat_ws("-", "id", "index"))
    old = store.read("entry")
    if old is not None:
        chunks = chunks.join(old.select("entry_id"), "entry_id", "left_anti")
    new = models.once(chunks, models.embedding, "embedding", "content").withColumn("new", F.lit(True))
    known = new.select("entry_id", "embedding", "new")
    if old is not None:
        known = known.unionByName(old.select("entry_id", "embedding").withColumn("new", F.lit(False)))
    # equal vectors are one for the search; what was there first, then the least id, stands for them
    group = known.groupBy("embedding").agg(F.min(F.struct("new", "entry_id")).alias("first"))
    numbered = group.select(F.xxhash64("first.entry_id").alias("id"), "embedding", "first")
    pairs = vectors.near_pairs(numbered, distance)
    by_id = numbered.select("id", "first")
    both = pairs.union(pairs.select("b", "a", "distance")).toDF("a", "b", "distance")
    closest = both.join(by_id.toDF("a", "fa"), "a").join(by_id.toDF("b", "fb"), "b").where(F.col("fb") < F.col("fa")).groupBy("fa").agg(F.min("fb").alias("to"))
    firsts = group.join(closest, F.col("first") == F.col("fa"), "left").select("embedding", F.coalesce("to", "first").alias("keep"))
    marked = new.join(firsts, "embedding").withColumn("similar_to", F.when(F.col("keep.entry_id") != F.col("entry_id"), F.col("keep.entry_id")))
    stored = marked.where(F.col("similar_to").isNull())
    kind = F.coalesce("source_type", F.lit("unknown"))
    trust = F.create_map(*[F.lit(x) for pair in SOURCE_TRUST.items() for x in pair])[kind]
    sources = stored.select("entry_id", kind.alias("source_type"), trust.alias("trust"))
    scored = retrieval.entry_authority(sources)
    entries = stored.join(scored, "entry_id").select("entry_id", "title", "content", "language", "embedding", "authority", F.lit("active").alias("status"), F.lit(as_of).cast("long").alias("created_s"))
    log = (
        checked.where(F.size("errors") > 0).select(F.col("id").cast("string").alias("entry_id"), F.lit("rejected").alias("action"), F.array_join("errors", ",").alias("reason"))
        .union(marked.select("entry_id", F.when(F.col("similar_to").isNull(), "stored").otherwise("duplicate"), F.concat(F.lit("similar_to="), F.col("similar_to"))))
    )
    return store.commit(append={"entry": entries, "entry_source": sources, "ingest_log": log.withColumn("at_s", F.lit(as_of).cast("long"))})


def extract_claims(entries: DataFrame, most: int = 20) -> DataFrame:
    """PIP3: (claim_id, entry_id, statement, verdict): statements of each entry by the model, each key once an entry."""
    said = models.once(entries.select("entry_id", "content"), models.sentences, "statements", "content")
    rows = said.select("entry_id", F.posexplode(F.slice("statements", 1, most)).alias("n", "statement"))
    keyed = rows.withColumn("key", fn.mapped(fn.key_of, "statement")).where(F.length("key") >= 8)
    first = keyed.groupBy("entry_id", "key").agg(F.min(F.struct("n", "statement")).alias("s"))
    return first.select(F.concat_ws("-", "entry_id", "s.n").alias("claim_id"), "entry_id", "s.statement", F.lit("unverified").alias("verdict"))


def extract_triples(claims: DataFrame) -> DataFrame:
    """PIP4: (claim_id, subject, predicate, object) of each claim by the model, one of each."""
    said = models.once(claims.select("claim_id", "statement"), models.triples, "triples", "statement")
    return said.select("claim_id", F.explode("triples").alias("t")).select("claim_id", "t.*").where("subject <> object").distinct()
