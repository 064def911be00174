"""The training-data queries: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, exact_dedup, mixing, packing, quality_rules, sharding, simhash, substring_dedup, warc
from .common import ascii_lower, new_path, read_table, text_of


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_bytes(read_table(spark, sf_dir, "documents"))

    def cut(batches):
        for batch in batches:
            ids, texts, spans = batch.columns
            sizes, removed, counts, digests = [], [], [], []
            for t, s in zip(texts, spans.to_pylist(), strict=True):
                data, at, h = t.as_buffer(), 0, hashlib.sha256()
                data = memoryview(data) if data is not None else b""
                for x in s or ():
                    h.update(data[at : x["start"]])
                    at = x["stop"]
                h.update(data[at:])
                sizes.append(len(data))
                removed.append(sum(x["stop"] - x["start"] for x in s or ()))
                counts.append(len(s or ()))
                digests.append(h.hexdigest())
            columns = [pa.array(x, pa.int64()) for x in (sizes, removed, counts)]
            yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    store = sharding.shard_arrivals(docs, new_path(spark, "shards"))
    return store.read().select(
        "doc_id", "lang", "source", "n_chars", F.octet_length(text_of()).cast("long").alias("n_bytes"), F.sha2(text_of(), 256).alias("text_sha256")
    )


OP2_SQL = """
SELECT doc_id, lang, source, n_chars, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op3_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents")).drop("ids")


def op4_progressive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(ascii_lower(text_of()), 256))
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = classifier.train_quality(docs, read_table(spark, sf_dir, "labels"))
    return classifier.score_quality(docs, model).select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.archive_pages(read_table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_aggregate(list_transform(range(0, 5), lambda k:
    CAST((((strpos('0123456789abcdef', substr(x, CAST((5 * i + k) // 4 + 1 AS BIGINT), 1)) - 1) >> (3 - (5 * i + k) % 4)) & 1) << (4 - k) AS BIGINT)), 'sum')::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, source, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1 GROUP BY doc_id),
c AS (SELECT l.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(list_aggregate(ws, 'string_agg', '')) AS BIGINT) AS chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  len(ls) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words FROM l LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_symbols * 10 > coalesce(chars, 0) AS symbols_failed, n_dup_lines * 10 > n_lines * 3 AS lines_failed FROM c),
h AS (SELECT source, count(*) AS n, x.rule, sum(CAST(x.failed AS DOUBLE)) AS k FROM f, LATERAL (SELECT unnest([1, 2, 3]) AS rule, unnest([base_failed, symbols_failed, lines_failed]) AS failed) x GROUP BY source, x.rule),
p AS (SELECT rule, sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) AS s, count(*) AS hosts, sum(n) AS total FROM h GROUP BY rule),
q AS (SELECT rule, m, CASE WHEN s - m * m - m * (1 - m) * hosts / total <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, m * (1 - m) / (s - m * m - m * (1 - m) * hosts / total) - 1)) END AS weight FROM p),
v AS (SELECT source, max((k + m * weight) / (n + weight)) > 0.5 AS host_failed FROM h JOIN q USING (rule) GROUP BY source)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


def op10_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_words(read_table(spark, sf_dir, "documents"))

    def cut(batches):
        for batch in batches:
            ids, texts, spans = batch.columns
            n, removed, digests = [], [], []
            for t, s in zip(texts, spans.to_pylist(), strict=True):
                words, kept, at = t.as_py().split(), [], 0
                for x in s or ():
                    kept += words[at : x["start"]]
                    at = x["stop"]
                kept += words[at:]
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_size_tiered_shards": op2_size_tiered_shards,
    "op3_window_packing": op3_window_packing,
    "op4_progressive_dedup": op4_progressive_dedup,
    "op5_simhash_components": op5_simhash_components,
    "op6_source_mix": op6_source_mix,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_warc_round_trip": op8_warc_round_trip,
    "op9_host_rules": op9_host_rules,
    "op10_fingerprint_index": op10_fingerprint_index,
    "pipeline": pipeline,
}
ORACLES = {"op2_size_tiered_shards": OP2_SQL, "op4_progressive_dedup": OP4_SQL, "op8_warc_round_trip": OP8_SQL, "op9_host_rules": OP9_SQL}
