"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Surviving (length, prefix hash) pairs that are broadcast at most, about 20 MB; more are joined by a shuffle.
BROADCAST_PAIRS = 1 << 19


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=ascii_lower,
    prefix_chars: int = 256,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """Adds keep_id, group_size, kept and full_hash to every row of docs.

    1. rows are counted by octet length, 2. rows of a length that occurs twice by
    (length, hash of the first characters), 3. only rows whose pair occurs twice have
    their whole text hashed (SHA-256); full_hash stays null for the rest, which take no
    part in any shuffle. The surviving pairs, counted first, reach the scan as a broadcast
    of at most ``broadcast_pairs`` rows; beyond that, rows meet them in a join by length
    and prefix hash. Either way each row is refined by exact pairs.

    Null texts count as empty. Of equal texts the largest id stays; a null id is the
    smallest. Rows repeated with id and text are counted in group_size and one of them
    is kept. Columns of docs with the names of the results are replaced; any other name
    may occur. An empty table gives an empty table.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "full_hash")
    tag = "_"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    n, p, hit, keep, twice = (tag + x for x in ("n", "p", "hit", "keep", "twice"))
    columns, slim = docs.columns, F.coalesce(F.col(text_col), F.lit(""))
    size, prefix = F.octet_length(slim), F.xxhash64(normalise(F.substring(slim, 1, prefix_chars)))

    counted = docs.select(size.alias(n), prefix.alias(p)).groupBy(n, p).agg(F.count("*").alias("c"))
    lengths = counted.groupBy(n).agg(F.sum("c").alias("k")).where("k > 1").select(n)
    pairs = materialize(counted.join(lengths, n, "left_semi").where("c > 1").select(n, p), "dedup-pairs")
    found = pairs.withColumn(hit, F.lit(True))
    found = F.broadcast(found) if pairs.count() <= broadcast_pairs else found.hint("merge")
    refined = docs.withColumns({n: size, p: prefix}).join(found, [n, p], "left")
    hashed = refined.withColumn("full_hash", F.when(F.col(hit), F.sha2(normalise(slim), 256))).select(*columns, "full_hash")

    id_ = F.col(id_col)
    alone = hashed.where(F.col("full_hash").isNull()).select(
        *columns, id_.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash"
    )
    met = hashed.where(F.col("full_hash").isNotNull())
    ids = met.groupBy("full_hash", id_.alias("i")).agg(F.count("*").alias("c"))
    groups = ids.groupBy("full_hash").agg(F.max(F.struct("i", "c")).alias("top"), F.sum("c").alias("group_size"))
    groups = materialize(groups.select("full_hash", F.col("top.i").alias(keep), "group_size", F.col("top.c").alias(twice)), "dedup-groups")
    marked = met.join(groups, "full_hash").withColumn("kept", id_.eqNullSafe(F.col(keep)))
    result = [*columns, F.col(keep).alias("keep_id"), "group_size", "kept", "full_hash"]
    if groups.where(F.col(twice) > 1).head(1):
        # rows repeated with id and text: one of them stays
        repeated = marked.where(F.col("kept") & (F.col(twice) > 1))
        order = Window.partitionBy("full_hash").orderBy(F.lit(1))
        repeated = repeated.withColumn("kept", F.row_number().over(order) == 1)
        marked = marked.where(~(F.col("kept") & (F.col(twice) > 1))).unionByName(repeated)
    return alone.union(marked.select(*result))
