"""The engine's logical tables, bound to the driver's Parquet tables.

Each binding is one statement over base tables, written for a dialect, so the same
derivation reaches Spark as a lazily read DataFrame and the oracle as a table expression.
Times are epoch seconds; ``AS_OF`` stands for now.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = 1735689600  # 2025-01-01T00:00:00Z
START = 1704067200  # 2024-01-01T00:00:00Z
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# Source types, and how far each is trusted.
SOURCE_TRUST = {
    "official-docs": 0.9, "github-release": 0.85, "cve-db": 0.9, "official-blog": 0.8, "research-paper": 0.75, "established-blog": 0.6,
    "reference-wiki": 0.6, "community-forum": 0.4, "personal-blog": 0.3, "ai-generated": 0.2, "unknown": 0.1,
}
# Decay rates a day, from axioms to news.
DECAY_RATES = [0.0001, 0.001, 0.005, 0.01, 0.02, 0.05]


def _trust(kind: str) -> str:
    return "CASE " + kind + "".join(f" WHEN '{k}' THEN {v}" for k, v in SOURCE_TRUST.items()) + " ELSE 0.1 END"


def _entry(q) -> str:
    rates = q.pick([f"CAST({r} AS DOUBLE)" for r in DECAY_RATES], "doc_id % 6")
    return f"""SELECT doc_id AS id, coalesce(text, '') AS content, lang AS language, source, n_chars, {START} + doc_id * 3600 AS created_s,
      {rates} AS decay_rate, CASE WHEN doc_id % 17 = 0 THEN 'draft' ELSE 'active' END AS status FROM {q.table("documents")}"""


def _entry_source(q) -> str:
    kinds = [f"'{k}'" for k in SOURCE_TRUST]
    no = f"CAST({q.first('source', '[0-9]+')} AS BIGINT)"
    one = q.pick(kinds, f"{no} % 11")
    two = q.pick(kinds, f"({no} + 5) % 11")
    t = q.table("documents")
    return f"""SELECT entry_id, source_type, CAST({_trust("source_type")} AS DOUBLE) AS trust FROM (
      SELECT doc_id AS entry_id, {one} AS source_type FROM {t} UNION ALL SELECT doc_id, {two} FROM {t} WHERE doc_id % 3 = 0) s"""


def _claim(q) -> str:
    return f"""SELECT vec_id AS id, CAST(label AS BIGINT) AS entry_id, {q.pick(["'unverified'", "'verified'", "'disputed'", "'not-applicable'"], "vec_id % 4")} AS verdict,
      (vec_id % 100) / 100.0 AS certainty, embedding, {START} + vec_id * 7200 AS created_s, CASE WHEN vec_id % 9 < 2 THEN {START} + vec_id * 9000 END AS valid_until_s FROM {q.table("embeddings")}"""


def _claim_relation(q) -> str:
    t = q.table("documents")
    return f"""SELECT doc_id AS src, CAST(floor(doc_id / 2) AS BIGINT) AS dst, 'derives-from' AS kind, 1.0 AS weight FROM {t} WHERE doc_id > 0
      UNION ALL SELECT doc_id, doc_id + 7, 'contradicts', (doc_id % 10) / 10.0 FROM {t} WHERE doc_id % 5 = 0
      UNION ALL SELECT doc_id, doc_id + 3, 'supports', 0.5 FROM {t}"""


def _entity(q) -> str:
    return f"""SELECT 's' || CAST(s_suppkey AS VARCHAR(20)) AS id, s_name AS name, 'supplier' AS kind FROM {q.table("supplier")}
      UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR(20)), p_name, 'part' FROM {q.table("part")}
      UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR(20)), n_name, 'nation' FROM {q.table("nation")}"""


def _kg_relation(q) -> str:
    return f"""SELECT 's' || CAST(l_suppkey AS VARCHAR(20)) AS src, 'p' || CAST(l_partkey AS VARCHAR(20)) AS dst, 'supplies-' || lower(l_returnflag) AS kind, l_orderkey AS claim_id, l_discount AS weight
      FROM {q.table("lineitem")} WHERE l_linenumber = 1
      UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR(20)), 'n' || CAST(s_nationkey AS VARCHAR(20)), 'located_in', -s_suppkey, 1.0 FROM {q.table("supplier")}"""


def _feedback(q) -> str:
    epoch = "unix_seconds(CAST(ts AS TIMESTAMP))" if q.__name__ == "Spark" else "CAST(floor(epoch(ts)) AS BIGINT)"
    k = q.first("props", "[0-9]+")
    return f"""SELECT event_id AS id, user_id AS agent_id, CAST({k} AS BIGINT) AS entry_id, CASE WHEN event_type = 'error' THEN 'negative' ELSE 'positive' END AS signal,
      event_type, value, {epoch} AS ts_s FROM {q.table("events")}"""


def _queue(q) -> str:
    epoch = "unix_seconds(CAST(o_orderdate AS TIMESTAMP))" if q.__name__ == "Spark" else "CAST(floor(epoch(o_orderdate)) AS BIGINT)"
    return f"""SELECT o_orderkey AS claim_id, {epoch} AS queued_s, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10 AS priority,
      o_orderkey % 4 AS attempts, {epoch} + 60 * (o_orderkey % 4) AS next_s FROM {q.table("orders")}"""


def _report(q) -> str:
    """Claim feedback: an outcome, what the reporter gave as evidence or what was inferred, and the standing of reporter and claim."""
    t = q.table("feedback")
    return f"""SELECT id, agent_id, entry_id, ts_s, CASE WHEN event_type = 'purchase' THEN 'held' WHEN event_type = 'click' THEN 'partial' ELSE 'failed' END AS outcome, signal,
      CASE WHEN id % 2 = 0 THEN 'https://counter.example.org/' || CAST(id AS VARCHAR(20)) END AS counter_source_url, CASE WHEN id % 3 = 0 THEN 'https://guess.example.org' END AS counter_source_url_inferred,
      CASE WHEN id % 4 < 3 THEN value / 100.0 END AS counter_nli_score, CASE WHEN id % 5 = 0 THEN 'time-expired' END AS failure_dimension, CASE WHEN id % 7 = 0 THEN 'scope-too-broad' END AS failure_dimension_inferred,
      CASE WHEN id % 11 = 0 THEN 'databases' END AS context_domain, CASE WHEN id % 23 = 0 THEN 'on one machine' END AS context_scope, CASE WHEN id % 13 = 0 THEN 0.5 END AS partial_truth,
      CASE WHEN id % 17 = 0 THEN 0.25 END AS partial_truth_inferred, CAST((agent_id % 11) / 10.0 AS DOUBLE) AS reporter_trust, CAST((id % 21) / 20.0 AS DOUBLE) AS claim_authority FROM {t}"""


def _golden(q) -> str:
    return f"""SELECT d.doc_id AS id, d.lang AS kind, CASE WHEN quality = 1 THEN 'keep' ELSE 'drop' END AS expected,
      CASE WHEN n_chars >= 500 THEN 'keep' ELSE 'drop' END AS predicted FROM {q.table("labels")} l JOIN {q.table("documents")} d ON l.doc_id = d.doc_id"""


def _evidence(q) -> str:
    place = ", place" if q.__name__ == "Spark" else ""
    return f"""SELECT l_orderkey AS claim_id, l_linenumber AS id, l_suppkey % 3 AS grp, l_quantity / 50.0 AS authority, l_discount * 10 AS entailment, l_tax * 6 AS contradiction{place} FROM {q.table("lineitem")}"""


LOGICAL = {
    "entry": (_entry, ["documents"]),
    "entry_source": (_entry_source, ["documents"]),
    "claim": (_claim, ["embeddings"]),
    "claim_relation": (_claim_relation, ["documents"]),
    "entity": (_entity, ["supplier", "part", "nation"]),
    "kg_relation": (_kg_relation, ["lineitem", "supplier"]),
    "feedback": (_feedback, ["events"]),
    "report": (_report, ["feedback"]),
    "queue": (_queue, ["orders"]),
    "golden": (_golden, ["labels", "documents"]),
    "evidence": (_evidence, ["lineitem"]),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base or logical table as a DataFrame."""
    from ..plans.dialect import Spark, doubles

    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, needs = LOGICAL[name]
    tables = {n: load(spark, sf_dir, n) for n in needs}
    if name == "evidence":
        tables["lineitem"] = tables["lineitem"].select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    return spark.sql(doubles(sql(Spark)), **tables)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none is named and all run on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"tessellum-{os.getpid()}")
    return base.rstrip("/")
