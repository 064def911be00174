"""Size-tiered compaction of immutable shards under a versioned manifest."""

from __future__ import annotations

import json
import math
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, new_path


class ShardStore:
    """A table as immutable Parquet shards and a manifest of each version.

    ``append`` writes an arrival as small shards; ``compact`` merges shards of the same
    size tier, ``fanout`` or more, into files of about ``target_mb``; both commit by
    publishing a finished manifest as ``manifest/<version>.json``, which never replaces one
    that is there: of two writers one gets the version, and the other lays its shards on
    top of what is then the current version. Readers see the shards of one version only.
    Shards that the current version doesn't name stay until ``vacuum``. Data and manifests
    are read and written through Spark's file systems; the store needs one whose rename is
    atomic and refuses a taken name (HDFS; in a local folder a link does that).
    """

    RETRIES = 20

    def __init__(self, spark: SparkSession, root: str, target_mb: float = 128, fanout: int = 4):
        self.spark, self.root, self.target, self.fanout = spark, root, target_mb * 1e6, fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{root}/manifest"))

    def version(self) -> int:
        """The last version committed, 0 for an empty store."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """The shards of a version: name and bytes, in order of arrival."""
        version = self.version() if version is None else version
        if not version:
            return []
        text = self.spark.read.text(f"{self.root}/manifest/{version:08d}.json", wholetext=True).first()
        return json.loads(text[0])

    def _commit(self, version: int, shards: list[dict]) -> None:
        part = self._path(f"{self.root}/manifest/.{version:08d}.{new_path(self.spark, 'm')[-32:]}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(shards).encode()))
        out.close()
        try:
            self._publish(part, self._path(f"{self.root}/manifest/{version:08d}.json"))
        except Exception as e:
            raise RuntimeError(f"version {version} is taken; read the manifest again and retry") from e
        finally:
            self._fs.delete(part, False)

    def _publish(self, part, final) -> None:
        """Gives a finished file its name, or fails if the name is taken, in one step of the file system."""
        if self._fs.getScheme() == "file":
            os.link(part.toUri().getPath(), final.toUri().getPath())
            return
        jvm = self.spark.sparkContext._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(part, final, options)

    def _commit_over(self, change) -> int:
        """Commits ``change`` of the current shards; if another writer was first, of what that one left. None changes nothing."""
        for _ in range(self.RETRIES):
            was = self.version()
            shards = change(self.manifest(was))
            if shards is None:
                return was
            try:
                self._commit(was + 1, shards)
                return was + 1
            except RuntimeError:
                if self.version() == was:
                    raise
        raise RuntimeError(f"{self.RETRIES} versions in a row were taken by other writers")

    def _write(self, df: DataFrame, name: str) -> list[dict]:
        df.write.parquet(f"{self.root}/data/{name}")
        files = self._fs.listStatus(self._path(f"{self.root}/data/{name}"))
        found = [{"name": f"{name}/{x.getPath().getName()}", "bytes": x.getLen()} for x in files]
        return sorted((x for x in found if x["name"].endswith(".parquet")), key=lambda x: x["name"])

    def append(self, df: DataFrame) -> int:
        """Adds an arrival; returns the version that shows it."""
        arrived = self._write(df, f"a{self.version() + 1:08d}-{new_path(self.spark, 's')[-8:]}")
        return self._commit_over(lambda shards: shards + arrived)

    def tier(self, size: float) -> int:
        """0 for shards of the target's size or more, one more for each factor of ``fanout`` below it."""
        return max(0, math.ceil(math.log(self.target / max(size, 1), self.fanout) - 1e-9))

    def compact(self) -> int:
        """Merges once in every tier that has ``fanout`` shards or more; returns the current version.

        Shards of the target's size are left alone. The merged files take the place of
        the first shard that they hold. Merges whose shards another writer has meanwhile
        merged are dropped.
        """
        by_tier: dict[int, list[dict]] = {}
        for s in self.manifest():
            by_tier.setdefault(self.tier(s["bytes"]), []).append(s)
        merges = []
        for tier in sorted(by_tier, reverse=True):
            group = by_tier[tier]
            if tier == 0 or len(group) < self.fanout:
                continue
            files = max(1, round(sum(s["bytes"] for s in group) / self.target))
            merged = self._write(self._read(group).coalesce(files), f"c{self.version() + 1:08d}-{tier}-{new_path(self.spark, 's')[-8:]}")
            merges.append(({s["name"] for s in group}, merged))

        def change(shards: list[dict]) -> list[dict] | None:
            names, done = {s["name"] for s in shards}, False
            for gone, merged in merges:
                if gone <= names:
                    at = next(i for i, s in enumerate(shards) if s["name"] in gone)
                    shards = shards[:at] + merged + [s for s in shards[at:] if s["name"] not in gone]
                    done = True
            return shards if done else None

        return self._commit_over(change)

    def _read(self, shards: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/data/{s['name']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default. An empty store has no schema yet and can't be read."""
        shards = self.manifest(version)
        if not shards:
            raise ValueError("the store is empty")
        return self._read(shards)

    def vacuum(self, older_s: float = 86400) -> int:
        """Deletes shards that the current version doesn't name and that are ``older_s`` seconds old.

        Older versions can't be read afterwards. The age protects what another writer has
        written and not yet committed; it must exceed the longest append or merge.
        """
        before = time.time() - older_s
        live, n = {s["name"] for s in self.manifest()}, 0
        for folder in self._fs.listStatus(self._path(f"{self.root}/data")):
            name = folder.getPath().getName()
            files = list(self._fs.listStatus(folder.getPath()))
            last = max([folder.getModificationTime(), *(f.getModificationTime() for f in files)]) / 1000
            if last <= before and not any(f"{name}/{f.getPath().getName()}" in live for f in files):
                drop_path(self.spark, folder.getPath().toString())
                n += 1
        return n


def shard_arrivals(df: DataFrame, root: str, key: str = "doc_id", arrivals: int = 4, **options) -> ShardStore:
    """Feeds df to a new store in ``arrivals`` batches (by hash of ``key``), compacting after each.

    Null keys go with one batch; every row arrives once, repeated rows as often as they
    are there. Columns pass through unchanged. The store's only writer is this one, so what
    a merge has replaced is deleted at once.
    """
    store = ShardStore(df.sparkSession, root, **options)
    for k in range(arrivals):
        store.append(df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(arrivals)) == k))
        store.compact()
        store.vacuum(0)
    return store
