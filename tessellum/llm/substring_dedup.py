"""Substring dedup over whole texts: maximal repeats of bytes, and repeated word windows by a fingerprint index."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import Scratch, drop_path, free_shuffles, materialize, new_path

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
LAST = (1 << 63) - 1
#: Text of a bucket of a new fingerprint index.
BUCKET_BYTES = 32 << 20


def _identified(docs: DataFrame, id_col: str, text_col: str, null_id: int) -> DataFrame:
    """docs(d, h, t): a row is known by its id and a hash of its text, so repeated ids and null ids do no harm."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(null_id)).alias("d"), F.xxhash64(text).alias("h"), text.cast("binary").alias("t"))


def _spread(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """docs(d, h, t) with spans: what found(d, h, runs) covers of each."""
    runs = found.groupBy("d", "h").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    def merge(batches):
        for batch in batches:
            spans = [[{"start": a, "stop": b} for a, b in W.cover(r, window)] for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS)], ["d", "h", "spans"])

    spans = runs.mapInArrow(merge, "d long, h long, spans array<struct<start:long,stop:long>>")
    return docs.join(spans, ["d", "h"], "left")


def _met(texts: DataFrame, window: int, gram: int, scratch: Scratch) -> DataFrame:
    """The superwindows (W.ROW) of anchors that occur twice; ``open`` are those of anchors with different ones."""
    rows = W.scan(texts, "bytes", window, gram)
    ends = [f(c).alias(f"_{k}{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in ("c", "c2")]
    anchors = rows.groupBy("anchor").agg(F.count("*").alias("_n"), *ends).where("_n > 1")
    anchors = scratch.write(anchors.select("anchor", ((F.col("_loc") != F.col("_hic")) | (F.col("_loc2") != F.col("_hic2"))).alias("open")), "repeat-anchors")
    free_shuffles(texts.sparkSession)
    met = materialize(rows.join(anchors, "anchor"), "repeat-rows")
    free_shuffles(texts.sparkSession)
    return met


def _contents(texts: DataFrame, met: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """The bytes of each different superwindow of ``met``, with the number of its places."""
    first = F.min(F.struct("d", "h", "start", "n")).alias("at")
    places = met.groupBy(*W.KEY).agg(F.count("*").alias("count"), first).select(*W.KEY, "count", "at.*", F.lit(0).cast("long").alias("d0"))
    contents = scratch.write(W.contents_of(texts, places, "bytes", window), "repeat-contents")
    free_shuffles(texts.sparkSession)
    return contents


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 64) -> DataFrame:
    """(d, t, spans): the maximal byte ranges of each text covered by ``window`` bytes that also start anywhere else.

    A repeat never crosses a document and may lie in the document itself. All occurrences
    are marked, the first too. Null and empty texts have none. A row repeated repeats its
    whole text. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    texts = _identified(docs, id_col, text_col, -LAST - 1)
    met = _met(texts, window, gram, scratch)
    open_ = met.where("open")
    contents = _contents(texts, open_, window, scratch)
    settled = materialize(W.settle(contents, window, 1, False), "repeat-runs")
    scratch.drop()
    free_shuffles(docs.sparkSession)

    some = F.transform("runs", lambda r: F.struct((F.col("start") + r["w"]).alias("s"), r["n"].alias("n")))
    all_ = F.array(F.struct(F.col("start").alias("s"), F.col("n").alias("n")))
    found = open_.join(settled, W.KEY).select("d", "h", some.alias("runs")).union(met.where(~F.col("open")).select("d", "h", all_.alias("runs")))
    return _spread(texts, found, window).select(F.when(F.col("d") != -LAST - 1, F.col("d")).alias("doc_id"), "t", "spans")


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 64) -> DataFrame:
    """(grp, length, doc_id, start): the maximal repeats of ``window`` bytes or more, one row for each of all their occurrences.

    Repeats are the intervals of enhanced suffix arrays, one array an anchor, whose places
    are not all preceded by the same byte, and what an anchor that is always surrounded alike
    spans. A repeat that crosses anchors is given once for each, clipped to the windows of
    the anchor; every group has all places of its bytes in the corpus. Rows repeated with
    id and text give their places as often. Null and empty texts have none; a null id stays
    null; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    texts = _identified(docs, id_col, text_col, -LAST - 1)
    met = _met(texts, window, gram, scratch)
    contents = _contents(texts, met.where("open"), window, scratch)
    intervals = materialize(W.repeat_intervals(contents, window, 1), "repeat-intervals")
    scratch.drop()
    free_shuffles(docs.sparkSession)
    id_ = F.when(F.col("d") != -LAST - 1, F.col("d")).alias("doc_id")
    found = met.where("open").join(intervals, W.KEY).select("grp", "length", id_, (F.col("start") + F.col("w")).alias("start"))
    whole = met.where(~F.col("open")).select(F.xxhash64(*W.KEY).alias("grp"), (F.col("n") - 1 + window).cast("int").alias("length"), id_, "start")
    return found.union(whole)


class FingerprintIndex:
    """Log-structured index of window fingerprints: sorted immutable runs under a manifest, in a folder that stays.

    A run holds each different superwindow of one batch once, with the least place that has
    it, in ``buckets`` files by hash of the anchor, each sorted by anchor. ``add`` makes a run
    of the new batch and merge-joins it with every run, bucket by bucket: history is read in
    its order and never shuffled. What the batch shares with smaller documents is verified
    before the batch becomes history; then runs of a size tier are compacted into one when
    ``fanout`` of them have come together. The manifest, ``manifest/<version>.json``, names
    the runs; an index opened on the same folder goes on where the last one ended.
    """

    RUN = "anchor long, c long, c2 long, at struct<d:long,h:long,start:long,n:int>"

    def __init__(self, spark, root: str, unit: str = "words", window: int = 50, gram: int = 16, fanout: int = 3, buckets: int = 24):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        self.version = max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), default=0)
        fixed = {"unit": unit, "window": window, "gram": gram, "fanout": fanout, "buckets": buckets}
        self.state = {**fixed, "last": None, "runs": []}
        if self.version:
            self.state = json.loads(spark.read.text(f"{self.root}/manifest/{self.version:08d}.json", wholetext=True).first()[0])
            if any(self.state[k] != v for k, v in fixed.items() if k != "fanout"):
                raise ValueError("the index was made with other parameters")
        self.unit, self.window, self.gram, self.fanout, self.buckets = unit, window, gram, fanout, self.state["buckets"]

    def _commit(self, runs: list[dict], last: int | None) -> None:
        """Publishes a manifest under the next version, which no other writer may have taken."""
        self.state = {**self.state, "runs": runs, "last": last}
        out = self._fs.create(self._path(f"{self.root}/manifest/.{self.version + 1:08d}"), True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        final = self._path(f"{self.root}/manifest/{self.version + 1:08d}.json")
        if self._fs.exists(final) or not self._fs.rename(self._path(f"{self.root}/manifest/.{self.version + 1:08d}"), final):
            raise RuntimeError("another writer has changed the index")
        self.version += 1

    def _write(self, df: DataFrame, tier: int) -> dict:
        """A new run of df, whose rows are dealt so that a bucket is written by one task, as one sorted file."""
        run = {"tier": tier, "name": f"run_{uuid.uuid4().hex}"}
        dealt = df.repartition(self.buckets, F.pmod(F.hash("anchor"), F.lit(self.buckets)))
        writer = dealt.write.bucketBy(self.buckets, "anchor").sortBy("anchor").format("parquet")
        writer.option("path", f"{self.root}/runs/{run['name']}").saveAsTable(run["name"])
        return run

    def _read(self, run: dict) -> DataFrame:
        """A run as a bucketed table; the session's catalog learns of it if it is from an earlier one."""
        if not self.spark.catalog.tableExists(run["name"]):
            kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spark.createDataFrame([], self.RUN).schema)
            self.spark.sql(f"CREATE TABLE {run['name']} ({kinds}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{self.root}/runs/{run['name']}'")
        return self.spark.table(run["name"])

    def _drop(self, run: dict) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run['name']}")
        drop_path(self.spark, f"{self.root}/runs/{run['name']}")

    def add(self, texts: DataFrame, archive: DataFrame | None = None) -> DataFrame:
        """found(d, h, runs): the windows of texts(d, h, t) that a smaller document has too; then the batch is history.

        Batches come in order of d: a batch that begins at or below what is there is refused.
        ``archive`` has the texts of all documents so far, the batch's too (by default the
        batch alone); open anchors are compared on them symbol by symbol. An empty batch
        changes nothing.
        """
        scratch = Scratch(self.spark)
        rows = scratch.write(W.scan(texts, self.unit, self.window, self.gram), "index-rows")
        ends = texts.agg(F.min("d"), F.max("d")).first()
        last = self.state["last"]
        if ends[0] is not None and last is not None and ends[0] <= last:
            raise ValueError("batches must come in order of d")
        own = self._write(rows.groupBy(*W.KEY).agg(F.min(F.struct("d", "h", "start", "n")).alias("at")), 0)
        runs = [*self.state["runs"], own]
        mine = self._read(own).groupBy("anchor").agg(F.lit(1).alias("_one")).select("anchor")
        entries = None
        for run in runs:  # both sides are bucketed by anchor: no exchange
            part = self._read(run)
            part = part if run is own else part.join(mine.hint("merge"), "anchor", "left_semi")
            entries = part if entries is None else entries.union(part)
        ends_ = [f(c).alias(f"_{k}{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in ("c", "c2")]
        known = entries.groupBy("anchor").agg(F.min("at.d").alias("d0"), F.max("at.d").alias("d1"), *ends_)
        open_ = (F.col("_loc") != F.col("_hic")) | (F.col("_loc2") != F.col("_hic2"))
        # an anchor with one superwindow can only repeat in a batch that has it twice; whether it does, its rows tell
        known = scratch.write(known.select("anchor", "d0", open_.alias("open")), "index-known")
        met = materialize(rows.join(known, "anchor").where("d0 < d").select(*W._COLUMNS, "open"), "index-met")
        free_shuffles(self.spark)
        found = materialize(self._verify(archive if archive is not None else texts, met, entries, scratch), "index-found")
        scratch.drop()
        free_shuffles(self.spark)
        self._commit(runs, max((x for x in (last, ends[1]) if x is not None), default=None))
        self._compact()
        return found

    def _verify(self, archive: DataFrame, met: DataFrame, entries: DataFrame, scratch: Scratch) -> DataFrame:
        """found(d, h, runs) of ``met``: where anchors are open, symbol by symbol; else superwindows agree in 128 bits."""
        open_ = met.where("open")
        anchors = open_.select("anchor").distinct()
        places = entries.groupBy(*W.KEY).agg(F.min("at").alias("at")).join(anchors, "anchor", "left_semi")
        places = places.select(*W.KEY, "at.*", F.lit(1).cast("long").alias("count"), F.col("at.d").alias("d0"))
        contents = scratch.write(W.contents_of(archive, places, self.unit, self.window), "index-contents")
        free_shuffles(self.spark)
        settled = scratch.write(W.settle(contents, self.window, 1 if self.unit == "bytes" else 8, True), "index-runs")
        free_shuffles(self.spark)
        earlier = F.filter("runs", lambda r: r["d"] < F.col("d"))
        some = F.transform(earlier, lambda r: F.struct((F.col("start") + r["w"]).alias("s"), r["n"].alias("n")))
        all_ = F.array(F.struct(F.col("start").alias("s"), F.col("n").alias("n")))
        return open_.join(settled, W.KEY).select("d", "h", some.alias("runs")).where(F.size("runs") > 0).union(
            met.where(~F.col("open")).select("d", "h", all_.alias("runs"))
        )

    def _compact(self) -> None:
        """Merges the runs of each tier that has ``fanout`` of them; they are dropped once the manifest no longer names them."""
        for tier in sorted({r["tier"] for r in self.state["runs"]}):
            group = [r for r in self.state["runs"] if r["tier"] == tier]
            if len(group) < self.fanout:
                continue
            whole = self._read(group[0])
            for r in group[1:]:
                whole = whole.union(self._read(r))
            merged = self._write(whole.groupBy(*W.KEY).agg(F.min("at").alias("at")), tier + 1)
            self._commit([r for r in self.state["runs"] if r["tier"] != tier] + [merged], self.state["last"])
            for r in group:
                self._drop(r)
            free_shuffles(self.spark)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 16, batches: int = 3, index: FingerprintIndex | None = None) -> DataFrame:
    """(d, t, spans): the word ranges of each text covered by ``window`` words that also start in a smaller document.

    Documents are fed to a FingerprintIndex, a new one by default (of a bucket for each
    BUCKET_BYTES of text), in batches by ranges of their id. A null id counts as the largest: such a row gives way to every other and to no
    other null. Rows that share an id are one document. Null and empty texts have no words.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = _identified(docs, id_col, text_col, LAST)
    if index is None:
        total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        index = FingerprintIndex(spark, new_path(spark, "index"), "words", window, gram, buckets=max(24, total // BUCKET_BYTES))
    cuts = docs.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [k / batches for k in range(1, batches)], 0.01)
    edges = sorted({int(x) for x in cuts})
    found = None
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part, sofar = texts, texts
        if low is not None:
            part = part.where(F.col("d") > low)
        if high is not None:
            part, sofar = part.where(F.col("d") <= high), sofar.where(F.col("d") <= high)
        got = index.add(part, sofar)
        found = got if found is None else found.union(got)
    return _spread(texts, found, window).select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "t", "spans")
