"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple = (5, 2, 1), most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of each source, from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of
    all sizes. A target stops at ``most`` times its source's size and the excess goes to
    the others by weight, until none is above: sources are taken by cap / weight, and
    those below the water level get their cap. Works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    turn = F.array(*(F.lit(float(x)) for x in weights))
    table = (
        sizes.withColumn("_w", F.element_at(turn, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * float(most))
        .withColumn("_all", F.sum("source_size").over(everything) * float(share))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    )
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn(
        "_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    # the level that would hold if exactly the sources before this one were capped; the first under its own cap holds
    table = table.withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_left"))
    first = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))
    table = table.withColumn("_lambda", F.min(first).over(everything)["_level"])
    target = F.when(F.col("_lambda").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_lambda") * F.col("_w")))
    return table.select("source", "source_size", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: Column, tie: list[str]) -> DataFrame:
    """Adds integer ``seats``: within each group the seats go to the highest quotients votes / (2k + 1).

    All but about one seat per party are certain: with T seats and n parties, the divisor
    total / (T - n/2) hands out at most T, and total / (T + n/2) at least T. Only quotients
    between the two are ranked.
    """
    g = Window.partitionBy(*group)
    table = (
        parties.withColumn("_t", seats.cast("double"))
        .withColumn("_sum", F.sum(F.col(votes).cast("double")).over(g))
        .withColumn("_half", F.count("*").over(g) / 2.0)
    )
    rounded = lambda d: F.floor(F.col(votes) * d / F.col("_sum") + 0.5)
    table = table.withColumn(
        "_low", F.when((F.col("_t") > F.col("_half")) & (F.col("_sum") > 0), rounded(F.col("_t") - F.col("_half"))).otherwise(F.lit(0))
    ).withColumn("_high", F.when((F.col("_sum") > 0) & (F.col("_t") > 0), rounded(F.col("_t") + F.col("_half")) + 1).otherwise(F.lit(0)))
    table = table.withColumn("_open", F.col("_t") - F.sum("_low").over(g))
    keep = [c for c in parties.columns]
    ks = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1))
    quotients = table.select(*keep, "_low", "_open", F.explode_outer(ks).alias("_k"))
    quotients = quotients.withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    rank = Window.partitionBy(*group).orderBy(F.col("_q").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie], "_k")
    won = quotients.withColumn("_won", ((F.row_number().over(rank) <= F.col("_open")) & F.col("_q").isNotNull()).cast("long"))
    return won.groupBy(*keep, "_low").agg(F.sum("_won").alias("_won")).select(*keep, (F.col("_low") + F.col("_won")).alias("seats"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    weights: tuple = (5, 2, 1),
    most: float = 2.0,
    block: int = 8,
    shard_words: int = 1_000_000,
    seed: int = 42,
) -> DataFrame:
    """Per row: id, source, size, source_size, target and taken (words the mix takes, repeats counted).

    A source's target is cut into blocks of ``block`` words. Sainte-Laguë gives each
    source an integer number of blocks, and each shard of a source (about ``shard_words``
    words, rows dealt by a seeded hash, so a large source spreads over many tasks) its
    quota. A shard's rows stand in seeded order; the blocks taken are the first of that
    order, once around and then from its start again, ``most`` times at most.

    Null and empty texts have size 0 and are never taken; a null source is a source of
    its own, last. Equal rows are interchangeable. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.xxhash64(text)).alias("_h"),
        ),
        "mix-sizes",
    )
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(by_source, share, weights, most)
    quota = sainte_lague(
        targets.withColumn("_one", F.lit(1)), ["_one"], "target",
        F.round(F.sum("target").over(Window.partitionBy()) / block), ["source"],
    )
    quota = materialize(
        quota.select("source", "source_size", "target", F.col("seats").alias("_blocks"))
        .withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")),
        "mix-sources",
    )

    dealt = rows.join(quota, rows.source.eqNullSafe(quota.source), "inner").select(
        "doc_id", rows.source, "size", "_h", "source_size", "target", "_blocks",
        F.pmod(F.xxhash64("_h", F.lit("shard")), F.col("_shards")).alias("_shard"),
    )
    shards = dealt.groupBy("source", "_shard", "_blocks").agg(F.sum("size").alias("_words"))
    share_of = sainte_lague(shards, ["source"], "_words", F.col("_blocks"), ["_shard"]).select(
        F.col("source").alias("_src"), F.col("_shard").alias("_no"), "_words", (F.col("seats") * block).alias("_want")
    )
    at = dealt.join(share_of, dealt.source.eqNullSafe(F.col("_src")) & (F.col("_shard") == F.col("_no")), "inner")
    order = Window.partitionBy("source", "_shard").orderBy("_h", "doc_id", "size")
    at = at.repartition("source", "_shard").withColumn("_from", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    laps = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("_want") - F.col("_words") * k - F.col("_from"))) for k in range(int(most))]
    taken = sum(laps[1:], laps[0])
    return at.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"))
