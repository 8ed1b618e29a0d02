"""Substring dedup: a count-min prefilter, then exact grouping of what it lets through.

A window is 20 consecutive words.  A window's estimate is a count-min count of
its lightest 8-word gram (least hash of the 13 in it, leftmost): equal windows
have that gram at the same place, so the estimate never lies below the window's
own count, and neighbouring windows share one gram, so the sketch takes about a
seventh as many counts as there are windows.

Pass 1: every task counts its grams; the counts are added in a sketch that is
dealt over the partitions by cell (2**32 cells each, kept sparse), so it grows
with the cluster and is never in one place.  Its cells of two or more are what
is broadcast: ROWS rows of bits, eight cells for each repeated one, at most
ROWS * 2**MOST_BITS bits (128 MB).  Pass 2: windows whose cells all have the bit
go, as 128 bits of hashes, to a bucket of their gram and of the words next to
it; there the first place of each window is exact and every later one is
marked.  Windows that a task has met before are marked without that: they go
along with their document, without hashes.  An estimate is never too low, so
nothing is lost where bits are many; only more windows then go to pass 2.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange, runtime
from .text import U64, Rolling, Words, chunks, mix, ragged, sliding_min, union_spans

WINDOW, GRAM, BESIDE = 20, 8, 6
ROWS, MOST_BITS, SHARDS = 2, 29, 16
_FLUSH = 1 << 20
_PLACE = U64((1 << 28) - 1)
_OTHER = 0xD6E8FEB86659FD93
_NONE = -(2**63)
_MARKS = "k long, h long, start long, n long"


def _light(words: Words, n_rows: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """(starts of whole windows, the place of each one's lightest gram, every gram's hash, rolling hash of words)."""
    rolling = Rolling(words.hash)
    grams = rolling.windows(gram)
    n = len(words.hash) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), grams, rolling
    light = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=U64), window - gram + 1)[:n]
    whole = words.doc[:n] == words.doc[window - 1 :]
    return np.flatnonzero(whole), (light[whole] & _PLACE).astype(np.int64), grams, rolling


def _wide(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, cell) of the dealt sketch."""
    return exchange.of_hash(grams, buckets), (mix(grams + U64(0x2545F491)) >> U64(32)).astype("<u4")


def _bits(bucket: np.ndarray, cell: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The place in a row of bits of a cell of the dealt sketch."""
    return (mix((bucket.astype(U64) << U64(32) | cell) + U64(row * 0x9E3779B9 + 1)) >> U64(64 - bits)).astype(np.int64)


class Sketch:
    """Rows of bits of the cells that two or more grams fell into; buckets: of the dealt sketch."""

    def __init__(self, table: np.ndarray, bits: int, buckets: int):
        self.table, self.bits, self.buckets = table, bits, buckets

    def repeated(self, grams: np.ndarray) -> np.ndarray:
        bucket, cell = _wide(grams, self.buckets)
        out = np.ones(len(grams), dtype=bool)
        for row in range(ROWS):
            at = _bits(bucket, cell, row, self.bits)
            out &= (self.table[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out


def sketch(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, most_bits: int = MOST_BITS) -> Sketch:
    """The cells with counts of two or more, of the light grams of all windows."""
    buckets = exchange.n_buckets(documents)

    def flushed(kept: list[np.ndarray]):
        grams, count = np.unique(np.concatenate(kept), return_counts=True)
        bucket, cell = _wide(grams, buckets)
        yield from exchange.dealt(bucket, [cell, np.minimum(count, 2)], "<u4 u1")

    def count(batches):
        kept: list[np.ndarray] = []
        for batch in batches:
            for part in chunks(batch.column(0)):
                _, light, grams, _ = _light(Words(part, lower=False), len(part), window, gram)
                if len(light):
                    kept.append(grams[light[np.append(True, light[1:] != light[:-1])]])
                if sum(map(len, kept)) > 4 * _FLUSH:
                    yield from flushed(kept)
                    kept = []
        if kept:
            yield from flushed(kept)

    def add(batches):
        for bucket, payloads in exchange.by_bucket(batches):
            cell, n = exchange.unpack(payloads, "<u4 u1")
            order = np.argsort(cell, kind="stable")
            cell, n = cell[order], n[order]
            head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            own = cell[head][np.add.reduceat(n.astype(np.int64), head) > 1]
            for at in range(0, len(own), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([own[at : at + (1 << 20)].tobytes()], pa.binary())], names=["bucket", "payload"])

    packed = documents.select("text").mapInArrow(runtime.task(count), exchange.PACKED)
    often = runtime.written(exchange.gathered(packed).mapInArrow(runtime.task(add), exchange.PACKED), "often")
    n = (often.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) // 4
    bits = min(most_bits, max(10, (8 * n).bit_length()))
    per = (1 << bits) // SHARDS

    def placed(batches):
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cell = np.frombuffer(payload, "<u4")
                for row in range(ROWS):
                    at = np.unique(_bits(np.full(len(cell), bucket), cell, row, bits))
                    yield from exchange.dealt(row * SHARDS + at // per, [at % per], "<u4")

    def merge(batches):
        for bucket, payloads in exchange.by_bucket(batches):
            own = np.zeros(per, dtype=bool)
            for p in payloads:
                own[np.frombuffer(p, "<u4")] = True
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["bucket", "payload"])

    merged = often.mapInArrow(runtime.task(placed), exchange.PACKED).repartition(ROWS * SHARDS, "bucket").sortWithinPartitions("bucket").mapInArrow(runtime.task(merge), exchange.PACKED)
    out = np.zeros((ROWS * SHARDS, per // 8), dtype=np.uint8)
    for bucket, payload in merged.toLocalIterator():
        out[bucket] = np.frombuffer(payload, np.uint8)
    runtime.dropped(often)
    return Sketch(out.reshape(ROWS, -1), bits, buckets)


def _first(entry: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(indices sorted so that equal windows stand together, whether each is the first of its window)."""
    h1, h2, k, _, at = entry
    order = np.lexsort((at, k, h2, h1))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    # as early as the first: the same place of a repeated row
    group = np.cumsum(head) - 1
    lead = order[np.flatnonzero(head)][group]
    return order, (k[order] == k[lead]) & (at[order] == at[lead])


def _heads(k: np.ndarray, h: np.ndarray, at: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where a run of consecutive places begins."""
    head = np.ones(len(k), dtype=bool)
    head[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)
    for x in more:
        head[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(head)


def _runs(k: np.ndarray, h: np.ndarray, at: np.ndarray):
    """Marks of consecutive places as one row."""
    order = np.lexsort((at, h, k))
    k, h, at = k[order], h[order], at[order].astype(np.int64)
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    k, h, at = k[new], h[new], at[new]
    heads = _heads(k, h, at)
    n = np.diff(np.append(heads, len(k)))
    for i in range(0, len(heads), 100_000):
        a, m = heads[i : i + 100_000], n[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(k[a]), pa.array(h[a]), pa.array(at[a]), pa.array(m)], names=["k", "h", "start", "n"])


def _dealt(bucket: np.ndarray, h1: np.ndarray, h2: np.ndarray, k: np.ndarray, h: np.ndarray, at: np.ndarray, told: bool):
    """Packed rows of windows: their hashes (where told) and, once for each run of places, the document."""
    order = np.lexsort((at, h, k, bucket))
    bucket, h1, h2, k, h, at = (c[order] for c in (bucket, h1, h2, k, h, at))
    head = _heads(k, h, at, bucket)
    n = np.diff(np.append(head, len(k)))
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(bucket)]
    ids, payloads, size = [], [], 0
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if a == b:
            continue
        r = slice(*np.searchsorted(head, [a, b]).tolist())
        runs = [k[head[r]], h[head[r]], at[head[r]].astype("<u4"), n[r].astype("<u4")]
        ids.append(int(bucket[a]))
        payloads.append(struct.pack("<II", (b - a) * told, r.stop - r.start) + b"".join(c.tobytes() for c in ([h1[a:b], h2[a:b]] * told + runs)))
        size += len(payloads[-1])
        if size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])
            ids, payloads, size = [], [], 0
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])


def _undealt(payload: bytes) -> tuple[bool, list[np.ndarray]]:
    """(whether hashes are told, h1, h2, k, h, at) of a packed row; without hashes both are empty."""
    windows, runs = struct.unpack_from("<II", payload)
    at, out = 8, []
    for n, kind in ((windows, "<u8"), (windows, "<u8"), (runs, "<i8"), (runs, "<i8"), (runs, "<u4"), (runs, "<u4")):
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * int(kind[-1])
    h1, h2, k, h, start, n = out
    n = n.astype(np.int64)
    return windows > 0, [h1, h2, np.repeat(k, n), np.repeat(h, n), ragged(start.astype(np.int64), n)]


def marks(documents: DataFrame, found: Sketch, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k, h, start, n): in document k with text hash h, windows from start on, n of them, that also start earlier."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(found)  # at most ROWS * 2**MOST_BITS bits
    buckets = exchange.n_buckets(documents)
    beside = min(BESIDE, (window - gram) // 2)

    def combined(kept: list[list[np.ndarray]]):
        bucket, *entry = [np.concatenate(c) for c in zip(*kept, strict=True)]
        order, first = _first(entry)
        own, late = order[first], order[~first]
        if len(own):
            yield from _dealt(bucket[own], *[c[own] for c in entry], told=True)
        if len(late):  # settled in this task: any bucket will do, so one of the document's
            entry = [c[late] for c in entry]
            yield from _dealt(exchange.of_hash(mix(entry[2].view(U64) ^ entry[3].view(U64)), buckets), *entry, told=False)

    def through(batches):
        kept, size = [], 0
        for batch in batches:
            ks, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in chunks(batch.column(2)):
                words = Words(part, lower=False, second=_OTHER)
                start, light, grams, rolling = _light(words, len(part), window, gram)
                if not len(start):
                    continue
                heads = np.flatnonzero(np.append(True, light[1:] != light[:-1]))
                pass_ = np.repeat(shared.value.repeated(grams[light[heads]]), np.diff(np.append(heads, len(light))))
                start, light = start[pass_], light[pass_]
                if not len(start):
                    continue
                doc = words.doc[start]
                second = Rolling(words.again, _OTHER)
                h1 = (rolling.sums[start + window] - rolling.sums[start]) * rolling.inv[start]
                h2 = (second.sums[start + window] - second.sums[start]) * second.inv[start]
                # equal windows have their gram at one place, so also the words beside it on the wider side
                before = light - start >= beside
                side = np.where(before, light - beside, light + gram)
                key = mix(grams[light] ^ rolling.ranges(side, side + beside))
                kept.append([exchange.of_hash(key, buckets), mix(h1), mix(h2), ks[part.rows][doc], hs[part.rows][doc], start - words.first[doc]])
                size += len(start)
                if size > _FLUSH:
                    yield from combined(kept)
                    kept, size = [], 0
        if kept:
            yield from combined(kept)

    def settle(batches):
        for _, payloads in exchange.by_bucket(batches):
            told: list[list[np.ndarray]] = []
            late: list[list[np.ndarray]] = []
            for p in payloads:
                known, entry = _undealt(p)
                (told if known else late).append(entry)
            again = [e[2:] for e in late]
            if told:
                own = [np.concatenate(c) for c in zip(*told, strict=True)]
                order, first = _first(own)
                again.append([c[order[~first]] for c in own[2:]])
            yield from _runs(*[np.concatenate(c) for c in zip(*again, strict=True)])

    packed = documents.select("k", "h", "text").mapInArrow(runtime.task(through), exchange.PACKED)
    return exchange.gathered(packed).mapInArrow(runtime.task(settle), _MARKS)


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text, k (doc_id, the least long for null) and h (a hash of the text)."""
    docs = runtime.plain(documents, doc_id="long", text="string")
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_NONE)).alias("k"), F.xxhash64("text").alias("h"))


def with_marks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Every row of keyed documents with its marks (an array of (start, n); null without any).

    A document has at most as many marks as windows, so its array is bounded by its text.
    """
    each = found.groupBy("k", "h").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    return documents.join(each, ["k", "h"], "left").select("doc_id", "text", "marks")


def spans_of(marks_: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    own = marks_[i].values
    return own.field(0).to_numpy(), own.field(1).to_numpy()


def dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (text), n_words, n_removed, kept_sha256 for every document.

    Removed: each word covered by a window whose words also start earlier (in a
    smaller doc_id, or earlier in the same document).  Kept words are joined by
    one blank.  Null or empty texts have no words; a null doc_id orders first;
    rows of one doc_id are one document, so the same place of them is not
    earlier than itself, whether or not their texts are equal.
    """
    docs = keyed(documents)
    bits = sketch(docs, window, gram)

    def rest(batches):
        for batch in batches:
            texts, marked = batch.column(1), batch.column(2)
            n_words, n_removed, sha, kept = [], [], [], []
            for i, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
                words = (raw or b"").split()
                n = len(words)
                if marked[i].is_valid:
                    start, length = spans_of(marked, i)
                    s, e = union_spans(start, start + length + window - 1)
                    keep, last = [], 0
                    for a, b in zip(s.tolist(), e.tolist(), strict=True):
                        keep += words[last:a]
                        last = b
                    words = keep + words[last:]
                own = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                sha.append(hashlib.sha256(own).hexdigest())
                kept.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "kept", "n_words", "n_removed", "kept_sha256"])

    out = with_marks(docs, marks(docs, bits, window, gram))
    return out.mapInArrow(runtime.task(rest), "doc_id long, kept string, n_words long, n_removed long, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that occur earlier, removed from every document."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
