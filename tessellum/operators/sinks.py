"""Tables as snapshots: merges as DataFrame functions, and a store that commits several tables at once."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """SNK2-6, SNK9, SNK17: old with new laid over it by ``keys``; new has each key once.

    A column of a key that both have is the new value, or what ``rules`` makes of (old, new);
    one that only old has stays. Null keys are equal to each other.
    """
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    both, rules = F.col("_o") & F.col("_n"), rules or {}

    def cell(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"o.{c}", f"n.{c}").alias(c)
        if c not in new.columns:
            return F.col(f"o.{c}").alias(c)
        x, y = F.col(f"o.{c}"), F.col(f"n.{c}")
        return F.when(both, rules[c](x, y) if c in rules else y).when(F.col("_n"), y).otherwise(x).alias(c)

    return o.join(n, on, "full_outer").select(*[cell(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], loop: tuple[str, str] | None = None) -> DataFrame:
    """SNK7, SNK8, GRA11: the rows of new whose keys old lacks, one for each key; rows whose two ``loop`` columns agree are no edges."""
    rows = new if loop is None else new.where(F.col(loop[0]) != F.col(loop[1]))
    return rows.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def cascade(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """SNK13: every table without the rows whose key (``keys`` by table) is in the first column of gone."""
    ids = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
    return {t: df.join(ids, df[keys[t]] == F.col("_gone"), "left_anti") if t in keys else df for t, df in tables.items()}


def commit_verdicts(claims: DataFrame, queue: DataFrame, verdicts: DataFrame, reset_authority: bool = True) -> dict[str, DataFrame]:
    """SNK11, SNK15: claims(id, verdict, certainty, authority), queue and log rows after verdicts(claim_id, verdict, certainty).

    Authority becomes the certainty, unless the verdict only closes a failed attempt
    (``reset_authority`` False). The log has the verdict before and after.
    """
    v = verdicts.select(F.col("claim_id").alias("id"), F.col("verdict").alias("_v"), F.col("certainty").alias("_c"))
    met = claims.join(v, "id", "left")
    new = {"verdict": F.coalesce("_v", "verdict"), "certainty": F.coalesce("_c", "certainty")}
    if reset_authority:
        new["authority"] = F.coalesce("_c", "authority")
    log = claims.join(v, "id").select(F.col("id").alias("claim_id"), F.col("verdict").alias("old_verdict"), F.col("_v").alias("new_verdict"), F.col("_c").alias("certainty"))
    return {"claim": met.withColumns(new).select(*claims.columns), "verdict_log": log, "verify_queue": queue.join(verdicts.select("claim_id"), "claim_id", "left_anti")}


class Snapshots:
    """SNK1, SNK10, SRC7: a folder of tables that change together.

    A commit writes the new tables and then one manifest, ``versions/<n>.json``, that names a
    folder for each; readers see the tables of one version only, and a commit that meets a
    version already taken fails. Appends keep the folders that a table had.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    def version(self) -> int:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/versions"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        version = self.version() if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:08d}.json", wholetext=True).first()[0]) if version else {}

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The table, or None before its first commit."""
        folders = self.manifest(version).get(table)
        return self.spark.read.parquet(*[f"{self.root}/data/{f}" for f in folders]) if folders else None

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> int:
        """Writes whole tables and rows to add, then shows all of them at once; returns the version."""
        was = self.version()
        shown = self.manifest(was)
        for add, tables in ((False, replace or {}), (True, append or {})):
            for t, df in tables.items():
                folder = f"{t}-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.root}/data/{folder}")
                shown[t] = [*(shown.get(t, []) if add else []), folder]
        part = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(shown).encode()))
        out.close()
        final = self._path(f"{self.root}/versions/{was + 1:08d}.json")
        try:
            if self._fs.getScheme() == "file":
                os.link(part.toUri().getPath(), final.toUri().getPath())
            else:
                jvm = self.spark.sparkContext._jvm
                kind = jvm.org.apache.hadoop.fs.Options.Rename
                never = self.spark.sparkContext._gateway.new_array(kind, 1)
                never[0] = kind.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(part, final, never)
        except Exception as e:
            raise RuntimeError(f"version {was + 1} is taken; read the tables again and retry") from e
        finally:
            self._fs.delete(part, False)
        return was + 1
