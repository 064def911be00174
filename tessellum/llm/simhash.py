"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_shuffles, materialize
from .components import components

BITS = 64
#: Fingerprints of a task before each becomes its variants.
SPREAD = 1 << 17


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the XXH64s of a text's word shingles, A-Z lower-cased, repeats included.

    A text of fewer words is one shingle; one without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths).tolist()
    joined = b" ".join(words)
    stops = (ends - 1)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(stops)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], np.uint64)  # noqa: B905
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the bit pattern of each text's fingerprint, as a long. Null texts count as empty."""

    def compute(batches):
        for batch in batches:
            texts = [x.as_buffer() for x in batch.column(1)]
            fps = [_signed(simhash(b"" if x is None else x.to_pybytes(), shingle, seed)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), binary.alias("t")).mapInArrow(compute, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(value: Column, bits: int) -> list[Column]:
    return [value] + [value.bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(bits)]


def ball_links(fps: DataFrame) -> DataFrame:
    """(a, b): a links to the smallest fingerprint of each radius-1 ball that it shares with others.

    Each fingerprint emits its 65 variants within one bit. All that meet on a variant are
    within one bit of it, hence within two of each other: true links without a check, and
    a star to the smallest links them all, so a large group costs as many rows as it has
    members.
    """
    variants = fps.select("fp", F.explode(F.array(*_flips(F.col("fp"), BITS))).alias("v"))
    least = variants.groupBy("v").agg(F.min("fp").alias("b"), F.max("fp").alias("_top")).where("b < _top").select("v", "b")
    # a shared variant's members lie within one bit of it, so it is asked for them the same way
    members = least.select("b", F.explode(F.array(*_flips(F.col("v"), BITS))).alias("a"))
    return members.join(fps, members.a == fps.fp, "left_semi").where("a <> b").select("a", "b")


def half_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between classes (``c``) that hold fingerprints within ``radius`` = 3 bits, as spanning trees.

    Pairs at three bits have different parity and at most one differing bit in one of the
    two 32-bit halves. Odd fingerprints emit their two halves, even ones the 33 variants
    of each half within one bit; they meet on the variant and are verified on all bits.
    ``fps`` is (fp, c) and only pairs of different classes matter, so a variant that one
    class alone has is dropped before any pair is looked at. The rest is dealt by variant
    and each byte of the other half in turn: three bits leave one of four bytes equal, so
    a hot variant is split into 1,024 groups. A group gives one link less than the classes
    that it joins, however many pairs of them are near.
    """
    odd = F.bit_count("fp") % 2 == 1
    halves = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))]
    keyed = lambda h, x: (x * 2 + h)
    own = [keyed(h, x) for h, x in enumerate(halves)]
    balls = [keyed(h, y) for h, x in enumerate(halves) for y in _flips(x, 32)]
    probe = fps.where(odd).select("fp", "c", F.lit(1).alias("o"), F.explode(F.array(*own)).alias("v"))
    build = fps.where(~odd).select("fp", "c", F.lit(0).alias("o"), F.explode(F.array(*balls)).alias("v"))
    rows = probe.union(build).select("v", "o", "c", "fp")
    mixed = rows.groupBy("v").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.min("o").alias("_e"), F.max("o").alias("_o"))
    mixed = mixed.where("_lo < _hi and _e < _o").select("v")
    other = F.when(F.col("v") % 2 == 0, halves[1]).otherwise(halves[0])  # a variant's last bit names its half
    part = [F.lit(256 * k) + F.shiftright(other, 8 * k).bitwiseAND(F.lit(255).cast("long")) for k in range(4)]
    open_ = rows.join(mixed, "v", "left_semi").select("v", F.explode(F.array(*part)).alias("part"), "o", "c", "fp")
    open_ = open_.repartition("v", "part").sortWithinPartitions("v", "part", "o", "fp")

    def meet(batches):
        key, blocks = None, []
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            if not len(x):
                continue
            for group in np.split(x, np.flatnonzero(np.diff(x[:, :2], axis=0).any(axis=1)) + 1):
                if key is not None and tuple(group[0, :2]) != key:
                    yield from _cross(np.concatenate(blocks), radius)
                    blocks = []
                key = tuple(group[0, :2])
                blocks.append(group)
        if blocks:
            yield from _cross(np.concatenate(blocks), radius)

    return open_.mapInArrow(meet, "a long, b long")


def _cross(rows: np.ndarray, radius: int):
    """A spanning forest of the classes with an even and an odd member within ``radius`` bits, compared in blocks."""
    even, odd = rows[rows[:, 2] == 0], rows[rows[:, 2] == 1]
    parent: dict[int, int] = {}
    links = []

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for i in range(0, len(odd), 256):
        o = odd[i : i + 256]
        for k in range(0, len(even), 4096):
            e = even[k : k + 4096]
            near = np.bitwise_count((o[:, None, 4] ^ e[None, :, 4]).view(np.uint64)) <= radius
            near &= o[:, None, 3] != e[None, :, 3]
            a, b = np.nonzero(near)
            for x, y in {*zip(o[a, 3].tolist(), e[b, 3].tolist(), strict=True)}:
                p, q = find(x), find(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    links.append((x, y))
    if links:
        x = np.array(links, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def classes(fps: DataFrame) -> DataFrame:
    """(fp, root): root is the smallest fingerprint that a chain of links of 3 or fewer bits reaches.

    ``fps`` has each fingerprint once. Links within two bits come from radius-1 balls over
    all 64 bits, their classes from components, and links at three bits between classes
    from radius-1 balls over halves (the ball of radius 2 that three bits would need on
    whole words has 2,081 variants). The second run of components sees classes only.
    """
    spark = fps.sparkSession
    scratch = Scratch(spark)
    fps = fps.select("fp")
    # each row becomes 65 and 34 rows, so they are spread before
    fps = fps.repartition(max(spark.sparkContext.defaultParallelism, -(-fps.count() // SPREAD)))
    label = components(scratch.write(ball_links(fps), "simhash-balls"))
    joined = fps.join(label.withColumnRenamed("a", "fp"), "fp", "left")
    labelled = scratch.write(joined.select("fp", F.coalesce("b", "fp").alias("c")), "simhash-labels")
    spread = labelled.repartition(max(spark.sparkContext.defaultParallelism, -(-labelled.count() // SPREAD)))
    top = components(scratch.write(half_links(spread), "simhash-halves"))
    roots = labelled.join(top.select(F.col("a").alias("c"), "b"), "c", "left").select("fp", F.coalesce("b", "c").alias("root"))
    roots = materialize(roots, "simhash-classes")
    scratch.drop()
    free_shuffles(spark)
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that a chain of links reaches.

    Fingerprints link at 3 or fewer differing bits; equal ones are merged first, so a
    group of copies costs its fingerprint's row.

    Null and empty texts have fingerprint 0 and link like any other. Null ids take no part
    in the smallest id, unless a component has no other. A row repeated gets the same
    component each time. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    least = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("m")), "simhash-distinct")
    found = classes(least)
    first = scratch.write(found.join(least, "fp").groupBy("root").agg(F.min("m").alias("component_id")), "simhash-least")
    named = materialize(found.join(first, "root").select("fp", "component_id"), "simhash-components")
    scratch.drop()
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
