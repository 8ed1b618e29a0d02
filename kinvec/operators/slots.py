"""Packed-slot dot products in plain text (V22-V26, C11, C12); block size and count are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 16


def pack(rows: DataFrame, key: str, block: int, blocks: int = BLOCKS) -> DataFrame:
    """(key, n, slots): each key's vectors (idx, v) one block after another, the rest zero; more than `blocks`, or others than `block` long, raise."""
    out = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", F.col("v").cast("array<double>").alias("v")))).alias("all"))
    good = (F.size("all") <= blocks) & F.forall("all", lambda s: F.size(s["v"]) == block)
    flat = F.flatten(F.transform("all", lambda s: s["v"]))
    padded = F.concat(flat, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(block * blocks) - F.size(flat))))
    return out.select(key, F.size("all").alias("n"), F.when(good, padded).otherwise(F.raise_error(F.lit("vectors don't fit the blocks")).cast("array<double>")).alias("slots"))


def replicate(v: Column, blocks: int = BLOCKS) -> Column:
    return F.flatten(F.array_repeat(v.cast("array<double>"), blocks))


def block_sums(products: Column, count: Column, block: int) -> Column:
    """The sum of each of the first `count` blocks; none of none."""
    each = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.aggregate(F.slice(products, i * block + 1, block), F.lit(0.0), lambda s, x: s + x))
    return F.when(count > 0, each).otherwise(F.array().cast("array<double>"))


def scores(packed: DataFrame, query: Column, block: int, blocks: int = BLOCKS) -> Column:
    """All of a packed row's dot products with one query: one product of slots, then block sums."""
    return block_sums(F.zip_with("slots", replicate(query, blocks), lambda x, y: x * y), F.col("n"), block)


def rotation_steps(block: int) -> list[int]:
    """The rotations that add up a block: half of it, a quarter, ..., 1."""
    if block < 1 or block & (block - 1):
        raise ValueError("a block's size is a power of two")
    return [block >> k for k in range(1, block.bit_length())]


def rotated(slots: Column, step: int) -> Column:
    """All slots moved to the left in a circle."""
    return F.concat(F.slice(slots, step + 1, F.greatest(F.size(slots) - step, F.lit(0))), F.slice(slots, 1, step))


def rotate_and_sum(products: Column, block: int) -> Column:
    """What adding up by rotations leaves: slot i * block holds the sum of block i, the others partial sums."""

    def added(step: int):
        return lambda s: F.zip_with(s, rotated(s, step), lambda x, y: x + y)

    out = products
    for step in rotation_steps(block):
        out = F.transform(F.array(out), added(step))[0]
    return out


def batch(queries: DataFrame, order: str, blocks: int = BLOCKS) -> DataFrame:
    """queries (order, v) with `batch` and `idx`: as many a batch as there are blocks, in their order."""
    from .ordered import positions

    return positions(queries, order).select((F.floor(F.col("pos") / blocks)).cast("long").alias("batch"), (F.col("pos") % blocks).cast("int").alias("idx"), order, "v")


def batch_scores(packed: DataFrame, gallery: Column, block: int, blocks: int = BLOCKS) -> Column:
    """All dot products of a packed row of queries with one gallery vector, which stands in every block."""
    return scores(packed, gallery, block, blocks)
