"""Vector search: exact over blocks of queries, also for near duplicates."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..sources.bindings import shared_folder

#: Queries that are sent to the executors at once, and rows of a block of vectors.
BLOCK = 4096
#: Vectors of a side of the product that a task holds.
SIDE = 1 << 15


def cosine(a: Column, b: Column) -> Column:
    """VEC2: cosine of two arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(values) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros((0, 1))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 8, least: float = -2.0, same: tuple[str, ...] = (), other: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, sim): SRC5, VEC1, SRT10, the ``k`` nearest of each query by cosine, of those at ``least`` similar or more.

    Both have id and embedding; columns in ``same`` must agree and those in ``other`` must
    differ between a query and what it finds, and no query finds its own id. Queries go to
    the executors in blocks of BLOCK, each met by one pass over the vectors that keeps k
    rows a query and batch; ties go to the smaller id. Vectors of no length are 0 similar.
    """
    spark, extra = vectors.sparkSession, [*same, *other]
    rows = sorted(queries.select("id", "embedding", *extra).toLocalIterator(), key=lambda r: r.id)
    found = None
    for at in range(0, max(len(rows), 1), BLOCK):
        block = rows[at : at + BLOCK]
        sent = spark.sparkContext.broadcast((np.array([r.id for r in block], np.int64), _unit(_matrix([r.embedding for r in block])), {c: np.array([r[c] for r in block], object) for c in extra}))

        def search(batches, sent=sent):
            ids, unit, tags = sent.value
            for b in batches:
                if not len(b) or not len(ids):
                    continue
                mine = b["id"].to_numpy(np.int64)
                sim = np.round(unit @ _unit(_matrix(b["embedding"].tolist())).T, 9)
                bad = (ids[:, None] == mine[None]) | (sim < least)
                for c in same:
                    bad |= tags[c][:, None] != b[c].to_numpy(object)[None]
                for c in other:
                    bad |= tags[c][:, None] == b[c].to_numpy(object)[None]
                order = np.lexsort((np.broadcast_to(mine, sim.shape), -sim, bad), axis=1)[:, :k]
                row = np.repeat(np.arange(len(ids)), order.shape[1])
                col = order.ravel()
                good = ~bad[row, col]
                yield pd.DataFrame({"query_id": ids[row[good]], "id": mine[col[good]], "sim": sim[row[good], col[good]]})

        part = vectors.select("id", "embedding", *extra).mapInPandas(search, "query_id long, id long, sim double")
        found = part if found is None else found.union(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def near_pairs(vectors: DataFrame, distance: float = 0.05) -> DataFrame:
    """(a, b, distance), a < b: JON16, all pairs of vectors(id, embedding) within a cosine distance.

    Vectors are packed in blocks of BLOCK rows at most, written once to the shared folder, and
    every two blocks meet in a product that shuffles nothing but the blocks. Products of
    matrices in single precision screen the pairs, with room for their error; what is left is
    computed in double. So disk is one or two copies of the vectors, while time grows with the
    square of their number. Vectors of no length and nulls have no pairs.
    """
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, FloatType) else "<f8"

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column(1).to_pylist()).astype(kind)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                cells = [[uuid.uuid4().hex], [len(ids)], [ids.tobytes()], [x.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "n", "ids", "x"])

    def opened(n, ids, x):
        x = np.frombuffer(x, kind).reshape(n, -1).astype(np.float64)
        unit = _unit(x)
        return np.frombuffer(ids, "<i8"), unit, unit.astype(np.float32)

    def meet(batches):
        last, left = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                if r["xblock"] != last:
                    last, left = r["xblock"], opened(r["xn"], r["xids"], r["xx"])
                right = left if r["yblock"] == last else opened(r["yn"], r["yids"], r["yx"])
                for at in range(0, len(left[0]), 512):
                    near = left[2][at : at + 512] @ right[2].T > 1 - distance - 1e-4
                    if right is left:
                        near = np.triu(near, at + 1)
                    u, v = np.nonzero(near)
                    for k in range(0, len(u), 1 << 16):
                        p, q = u[k : k + (1 << 16)] + at, v[k : k + (1 << 16)]
                        apart = 1 - np.einsum("ij,ij->i", left[1][p], right[1][q])
                        a, b = left[0][p], right[0][q]
                        good = (np.round(apart, 9) < distance) & (a != b) & left[1][p].any(axis=1) & right[1][q].any(axis=1)
                        cells = [np.minimum(a, b)[good], np.maximum(a, b)[good], apart[good]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["a", "b", "distance"])

    rows = vectors.select(F.col("id").cast("long").alias("id"), "embedding").where("id IS NOT NULL AND embedding IS NOT NULL")
    path = f"{shared_folder(spark)}/vector-blocks-{uuid.uuid4().hex}"
    rows.mapInArrow(pack, "block string, n long, ids binary, x binary").write.parquet(path)
    packed = spark.read.schema("block string, n long, ids binary, x binary").parquet(path)
    n = packed.agg(F.sum("n")).first()[0] or 0
    # a task holds one side of SIDE rows or so, and a batch one pair of blocks
    packed = packed.repartition(max(4, -(-n // SIDE)))
    side = lambda s: packed.select(*[F.col(c).alias(s + c) for c in packed.columns])
    met = side("x").hint("shuffle_replicate_nl").join(side("y"), F.col("xblock") <= F.col("yblock"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    return met.mapInArrow(meet, "a long, b long, distance double")


def losers(pairs: DataFrame, authority: DataFrame) -> DataFrame:
    """(id, keep_id): VEC5, of each pair the row of lower authority(id, authority) goes, of equals the larger id; a row that loses to several names the best.

    The rule looks at pairs alone, so the order of rows is of no matter: what loses to any
    row goes, even if that row loses too.
    """
    a = authority.select(F.col("id").alias("a"), F.col("authority").alias("wa"))
    b = authority.select(F.col("id").alias("b"), F.col("authority").alias("wb"))
    met = pairs.select("a", "b").join(a, "a").join(b, "b")
    first = (F.col("wa") > F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("a") < F.col("b")))
    kept, gone = (F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    lost = met.select(gone.alias("id"), F.struct(-F.greatest("wa", "wb"), kept.alias("keep")).alias("by"))
    return lost.groupBy("id").agg(F.min("by").alias("by")).select("id", F.col("by.keep").alias("keep_id"))


def shortlist(chunks: DataFrame, k: int = 6, wide: int = 3) -> DataFrame:
    """VEC6, VEC7, SRT11: of chunks(claim_id, index, sim, score) the ``wide`` x k by similarity, and of those the k by the model's score; all if there are no more than k."""
    w = Window.partitionBy("claim_id")
    by = lambda c: F.row_number().over(w.orderBy(F.desc(c), "index"))
    first = chunks.withColumns({"_n": by("sim"), "_all": F.count("*").over(w)}).where(F.col("_n") <= wide * k)
    return first.withColumn("place", by("score")).where((F.col("_all") <= k) | (F.col("place") <= k)).drop("_n", "_all")


def decode(column: str, size: int = 384) -> Column:
    """VEC8: a vector in text form, null unless it has ``size`` numbers."""
    parsed = F.from_json(column, "array<double>")
    return F.when(F.size(parsed) == size, parsed)
