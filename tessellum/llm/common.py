"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, and a word.
ASCII_SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows and bytes of an Arrow batch at most, where whole texts go to Python; Spark's own defaults suit short rows.
BATCH_ROWS, BATCH_BYTES = 2000, 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; batches of whole texts are kept small for the session that reads it."""
    arrow = "spark.sql.execution.arrow"
    if not 0 < int(spark.conf.get(f"{arrow}.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set(f"{arrow}.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set(f"{arrow}.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; a pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def scratch_base(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is named and all run on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"tessellum-{os.getpid()}")
    return base.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_base(spark)}/tessellum/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that are broadcast at most to choose rows by them, about 20 MB; more are joined by a shuffle of the rows.
BROADCAST_IDS = 1 << 19


def chosen(rows: DataFrame, ids: DataFrame, how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """The rows whose key, the one column of ids, is among ids, or is not (left_anti); few ids, counted first, go to the rows, which are then not shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids.hint("merge"), ids.columns[0], how)


class Scratch:
    """Intermediate tables in the shared folder, dropped together once what was made of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, what: str) -> DataFrame:
        self.paths.append(new_path(self.spark, what))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        while self.paths:
            drop_path(self.spark, self.paths.pop())


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
