"""Shuffles of packed columns: a row carries many entries for one bucket.

Map tasks gather numpy columns, deal them to buckets and emit one binary row a
bucket; reduce tasks get whole buckets.  The number of buckets follows
spark.sql.shuffle.partitions, so memory for a bucket is the cluster's setting.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import runtime
from .text import U64, mix

PACKED = "bucket int, payload binary"
PROBES, MOST_BITS, SHARDS = 2, 30, 16


def pack(columns: list[np.ndarray], dtypes: str) -> bytes:
    """Columns of one length, one after another; dtypes: a numpy code each, blank-separated."""
    return b"".join(np.ascontiguousarray(c, dtype=d).tobytes() for c, d in zip(columns, dtypes.split(), strict=True))


def unpack(payloads: Iterable[bytes], dtypes: str) -> list[np.ndarray]:
    """The columns of all payloads, concatenated."""
    kinds = [np.dtype(d) for d in dtypes.split()]
    width = sum(k.itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[np.empty(0, k)] for k in kinds]
    for p in payloads:
        n, at = len(p) // width, 0
        for column, k in zip(out, kinds, strict=True):
            column.append(np.frombuffer(p, k, n, at))
            at += n * k.itemsize
    return [np.concatenate(c) for c in out]


def dealt(bucket: np.ndarray, columns: list[np.ndarray], dtypes: str) -> Iterator[pa.RecordBatch]:
    """One packed row for each bucket that occurs; entries keep their order."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 65536 else bucket, kind="stable")
    sorted_ = bucket[order]
    heads = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.empty(0, np.int64)
    tails = np.append(heads[1:], len(sorted_))
    columns = [c[order] for c in columns]
    ids, payloads, size = [], [], 0
    for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
        ids.append(int(sorted_[a]))
        payloads.append(pack([c[a:b] for c in columns], dtypes))
        size += len(payloads[-1])
        if size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])
            ids, payloads, size = [], [], 0
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])


def of_hash(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(40)) % U64(buckets)).astype(np.int64)


def n_buckets(df: DataFrame) -> int:
    return 8 * runtime.parts(df.sparkSession)


def gathered(packed: DataFrame) -> DataFrame:
    """Whole buckets together, sorted by bucket, so that one is in memory at a time."""
    return packed.repartition(runtime.parts(packed.sparkSession), "bucket").sortWithinPartitions("bucket")


def by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, payloads) from rows sorted by bucket."""
    now, payloads = None, []
    for batch in batches:
        for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now and payloads:
                yield now, payloads
                payloads = []
            now = bucket
            payloads.append(payload)
    if payloads:
        yield now, payloads


class Members:
    """A Bloom filter of hashes: `may` is true of every member, and of few others while bits are many."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    def may(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for at in probes(h, self.bits):
            out &= (self.table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(h.view(U64) + U64(0x6A09E667F3BCC909 + i)) >> U64(64 - bits)).astype(np.int64) for i in range(PROBES)]


def members(hashes: DataFrame, n: int, most_bits: int = MOST_BITS) -> Members:
    """The filter of n hashes (one long column): 16 bits or more each, 2**most_bits (128 MB) in all at most."""
    bits = min(most_bits, max(10, (16 * n).bit_length()))
    per = (1 << bits) // SHARDS

    def placed(batches):
        for batch in batches:
            at = np.unique(np.concatenate(probes(batch.column(0).to_numpy(), bits)))
            yield from dealt(at // per, [at % per], "<u4")

    def merge(batches):
        for bucket, payloads in by_bucket(batches):
            own = np.zeros(per, dtype=bool)
            for p in payloads:
                own[np.frombuffer(p, "<u4")] = True
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["bucket", "payload"])

    packed = hashes.mapInArrow(runtime.task(placed), PACKED).repartition(SHARDS, "bucket").sortWithinPartitions("bucket")
    out = np.zeros((SHARDS, per // 8), dtype=np.uint8)
    for bucket, payload in packed.mapInArrow(runtime.task(merge), PACKED).toLocalIterator():
        out[bucket] = np.frombuffer(payload, np.uint8)
    return Members(out.reshape(-1), bits)
