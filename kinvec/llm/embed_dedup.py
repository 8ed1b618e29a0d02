"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine, components.

Vectors of one label meet in a bucket when their signs against the hyperplanes
of one of several tables agree.  The number of bits follows the largest label
(buckets of about 32), the number of tables the bits, so that a pair at the
threshold meets with probability 0.9999.  In a bucket every pair is verified by
its cosine in double precision, in blocks of at most 1024 by 1024: a large
bucket is many block pairs, each a task's small piece of work, and a block pair
returns a count and a root for each vector, never its pairs.  A pair that an
earlier table has in one bucket too is not counted again.  Equal vectors are
one, with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, vectors

THRESHOLD, MISS, PER_BUCKET, BLOCK, MOST_BITS = 0.93, 1e-4, 32, 1024, 32
_PAIRS = "uid long, links long, root long"


def plan(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits a table, tables) for labels of at most that many vectors."""
    bits = int(np.clip(math.ceil(math.log2(max(largest, 1) / PER_BUCKET)) if largest > PER_BUCKET else 1, 1, MOST_BITS))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def roots(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """The least index of each one's component under links p[i] - q[i]."""
    label = np.arange(n)
    while True:
        old = label.copy()
        least = np.minimum(label[p], label[q])
        np.minimum.at(label, p, least)
        np.minimum.at(label, q, least)
        label = label[label]
        if (label == old).all():
            return label


def _verify(batches, threshold: float):
    """Rows (key columns, side, uid, m, v, codes) sorted by key: a count and a root for each vector with links."""

    def one(table: pa.Table):
        uid, m, side = table["uid"].to_numpy(), table["m"].to_numpy(), table["side"].to_numpy()
        t = int(table["t"][0].as_py())
        x = vectors.matrix(table["v"])
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), "<u4").reshape(len(uid), -1)
        x = vectors.unit(x)
        first, second = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        p, q = np.nonzero(x[first] @ x[second].T >= threshold)
        p, q = first[p], second[q]
        once = (p < q) if (side == 0).any() else np.ones(len(p), bool)
        p, q = p[once], q[once]
        if t and len(p):
            new = np.ones(len(p), bool)
            for at in range(0, len(p), 1 << 18):
                own = slice(at, at + (1 << 18))
                new[own] = ~(codes[p[own], :t] == codes[q[own], :t]).any(axis=1)
            p, q = p[new], q[new]
        if not len(p):
            return
        links = np.bincount(p, weights=m[q], minlength=len(uid)) + np.bincount(q, weights=m[p], minlength=len(uid))
        root = roots(p, q, len(uid))
        has = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(uid[has]), pa.array(links[has].astype(np.int64)), pa.array(uid[root[has]])], names=["uid", "links", "root"])

    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = batch.column("key").to_numpy()
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if key[a] != last and kept:
                yield from one(pa.Table.from_batches(kept))
                kept = []
            last = key[a]
            kept.append(batch.slice(a, b - a))
    if kept:
        yield from one(pa.Table.from_batches(kept))


def links(embeddings: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows whose label is null or whose vector is null, empty, zero or holds null
    or non-finite components have no links; vectors of different length have
    none with each other.  Labels of any type are compared as text.  A vec_id on
    several rows is several vectors, which may link with each other.
    """
    spark = embeddings.sparkSession
    rows, kind = vectors.read(embeddings), vectors.kind_of(embeddings)
    own = rows.where(F.col("v").isNotNull() & F.col("label").isNotNull())
    equal = own.groupBy("label", "v").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"))
    equal = runtime.written(equal, "vectors")
    salt = 0  # a hash by which no two of these vectors are one
    while equal.groupBy(F.xxhash64(F.lit(salt), "label", "v")).count().where("count > 1").limit(1).count():
        salt += 1
    uid = F.xxhash64(F.lit(salt), "label", "v")
    equal = equal.withColumn("uid", uid)
    largest = equal.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, threshold, miss)

    def sign(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            size = np.diff(batch.column("v").offsets.to_numpy())
            for d in np.unique(size).tolist():
                part = batch.filter(pa.array(size == d))
                if d not in planes:
                    planes[d] = np.random.default_rng(d).normal(size=(d, tables * bits))
                up = (vectors.unit(vectors.matrix(part.column("v"))) @ planes[d] > 0).reshape(-1, tables, bits)
                codes = (up << np.arange(bits)).sum(axis=2).astype("<u4")
                out = [part.column("uid"), part.column("label"), part.column("m"), pa.array([d] * len(codes), pa.int32()), part.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(codes.astype(np.int64).tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, names=["uid", "label", "m", "d", "v", "codes", "code"])

    coded = equal.select("uid", "label", "m", "v").mapInArrow(runtime.task(sign), f"uid long, label string, m long, d int, v {kind}, codes binary, code array<long>")
    coded = runtime.written(coded, "codes")
    places = coded.select("uid", "label", "d", F.posexplode("code").alias("t", "c"))
    sizes = places.groupBy("label", "d", "t", "c").count().where("count > 1").select("label", "d", "t", "c", F.ceil(F.col("count") / block).cast("int").alias("nb"))
    every = coded.select("uid", "label", "m", "d", "v", "codes", F.posexplode("code").alias("t", "c")).join(sizes, ["label", "d", "t", "c"])
    every = every.withColumn("b", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("nb")).cast("int"))
    dealt = every.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    dealt = dealt.select(
        F.xxhash64("label", "d", "t", "c", F.least("b", "o"), F.greatest("b", "o")).alias("key"), "t",
        F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side"), "uid", "m", "v", "codes",
    )
    found = dealt.repartition(runtime.parts(spark), "key").sortWithinPartitions("key").mapInArrow(runtime.task(lambda it: _verify(it, threshold)), _PAIRS)
    found = runtime.written(found, "links")
    labels = runtime.components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")), "embed")

    total = found.groupBy("uid").agg(F.sum("links").alias("links"))
    named = equal.select("uid", "m", "least").join(total, "uid", "left").join(labels.withColumnRenamed("id", "uid"), "uid", "left").select("uid", "m", "least", "links", F.coalesce("component", "uid").alias("c"))
    first = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(first, "c").select("uid", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    all_rows = rows.select("vec_id", F.when(F.col("v").isNotNull() & F.col("label").isNotNull(), uid).alias("uid"))
    out = all_rows.join(named, "uid", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal vectors of one label, over all embeddings."""
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
