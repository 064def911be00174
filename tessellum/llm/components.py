"""Connected components of a link table by alternating large-star and small-star steps, the last links in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, free_shuffles, new_path

#: Links that one task joins at most, 4 MB of them; while there are more, rounds go on.
TASK_LINKS = 1 << 18


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _joined(batches):
    """(a, b) of all links of a task: each node that reaches a smaller one, and the smallest that it reaches."""
    blocks = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches]
    if not sum(x.shape[1] for x in blocks):
        return
    nodes, at = np.unique(np.concatenate(blocks, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        # of two roots the larger goes to the smallest that it meets, then every node to its root
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
    down = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[down]), pa.array(nodes[root[down]])], ["a", "b"])


def components(links: DataFrame, most_rounds: int = 50, task_links: int = TASK_LINKS) -> DataFrame:
    """(a, b): every node a that is linked to a smaller one, and b, the smallest node that it reaches.

    ``links`` has long columns a and b in any direction. Each round first links every node's
    larger neighbours, then its smaller ones, to the smallest; rounds grow with the
    logarithm of the longest path. Once ``task_links`` links or fewer are left, or from the
    start, one task joins them, which costs the driver one small job instead of a round's
    shuffles. Links stay in the shared folder; the driver sees two numbers a round. A hot node's rows meet only in joins and in sums that combine before
    the shuffle. Self links are dropped; an empty table gives an empty table.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    path = new_path(spark, "links")
    edges.write.parquet(path)
    edges = spark.read.schema("a long, b long").parquet(path)
    seen = _fingerprint(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            return edges
        if seen[0] <= task_links:
            new = new_path(spark, "links")
            edges.coalesce(1).mapInArrow(_joined, "a long, b long").write.parquet(new)
            drop_path(spark, path)
            free_shuffles(spark)
            return spark.read.schema("a long, b long").parquet(new)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # now every link points down; a node and its smaller neighbours go to the smallest of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        small = small.where("a <> b").distinct()
        new = new_path(spark, "links")
        small.write.parquet(new)
        drop_path(spark, path)
        path, edges = new, spark.read.schema("a long, b long").parquet(new)
        free_shuffles(spark)
        was, seen = seen, _fingerprint(edges)
        if was == seen:
            return edges
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
