"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a document: its words (lower-cased A-Z, 64-bit hash modulo 2**14,
count over the root of the sum of squares) and bucketed statistics of its
structure (shares of blanks, capitals, figures, marks, line breaks, repeated
words and lines, lengths) and of its metadata (n_chars), each bucket a feature.
Pairs interact through k-dimensional factors; the score is linear in the number
of features, since the sum over pairs is half of (sum of v x)**2 - sum of
(v x)**2, per factor.

It is fitted by Adam on the logistic loss over a bounded, hash-chosen sample of
labelled documents outside fold 0 (`max_rows`), on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .langid import fold
from .text import U64, Chunk, Words, chunks

MAX_ROWS, FACTORS, HASH_BITS = 3000, 8, 14
THRESHOLD = 0.3
LEAST_STEPS = 280
_BUCKETS, _STATS = 12, 10
DIMENSIONS = (1 << HASH_BITS) + _BUCKETS * _STATS


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets]).astype(np.float64)


def features(part: Chunk, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n + 1 offsets, feature, value) of each row, features ascending and distinct in a row."""
    words, n = Words(part, lower=True), len(part)
    size = np.diff(part.offsets).astype(np.float64)
    data = part.data
    count = np.diff(words.first).astype(np.float64)
    hashed = (words.hash >> U64(64 - HASH_BITS)).astype(np.int64)
    both, times = np.unique(words.doc * (1 << HASH_BITS) + hashed, return_counts=True)
    row, feature = both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)
    norm = np.sqrt(np.bincount(row, weights=times.astype(np.float64) ** 2, minlength=n))
    value = times / np.maximum(norm, 1)[row]

    distinct = np.bincount(np.unique(words.doc.astype(U64) << U64(40) | words.hash >> U64(24)).astype(U64) >> U64(40), minlength=n) if len(words.doc) else np.zeros(n)
    again = np.zeros(len(words.hash), dtype=bool)
    if len(again):
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    mark = ((data > 32) & (data < 127)) & ~upper & ~digit & ~((data >= 97) & (data <= 122))
    meta = np.array([np.nan if x is None else float(x) for x in n_chars])
    full, per = np.maximum(size, 1), np.maximum(count, 1)
    share = [
        _sums(upper, part.offsets) / full * 20,
        _sums(digit, part.offsets) / full * 40,
        _sums(mark, part.offsets) / full * 40,
        _sums(data == 10, part.offsets) / per * 60,
        distinct / per * (_BUCKETS - 1),
        np.bincount(words.doc, weights=again, minlength=n) / per * 40,
        np.log2(per),
        np.log2(full / per) * 3,
        _sums(data >= 128, part.offsets) / full * 40,
        np.where(np.isnan(meta), 0, np.log2(np.maximum(np.nan_to_num(meta), 1)) / 2),
    ]
    bucket = np.clip(np.stack(share, axis=1), 0, _BUCKETS - 1).astype(np.int64)
    stat = (1 << HASH_BITS) + np.arange(_STATS) * _BUCKETS + bucket
    row = np.concatenate([row, np.repeat(np.arange(n), _STATS)])
    feature = np.concatenate([feature, stat.ravel()])
    value = np.concatenate([value, np.full(n * _STATS, 0.5)])
    order = np.argsort(row, kind="stable")
    return np.append(0, np.cumsum(np.bincount(row, minlength=n))), feature[order], value[order]


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, offsets: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Linear time: sum w x + half of the sum over factors of (sum v x)**2 - sum (v x)**2."""
        if not len(feature):
            return np.full(len(offsets) - 1, self.bias)
        vx = self.factor[feature] * value[:, None]
        at = offsets[:-1]  # every row has features
        return self.bias + np.add.reduceat(self.weight[feature] * value, at) + 0.5 * (np.add.reduceat(vx, at) ** 2 - np.add.reduceat(vx * vx, at)).sum(axis=1)


def train(offsets: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, factors: int = FACTORS, epochs: int = 6, rate: float = 0.02, seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    n = len(label)
    epochs = max(epochs, -(-LEAST_STEPS * 64 // n))  # a small sample is gone through more often
    size = DIMENSIONS * (factors + 1) + 1
    theta = np.concatenate([np.zeros(DIMENSIONS + 1), rng.normal(0, 0.02, DIMENSIONS * factors)])
    mean, square, step = np.zeros(size), np.zeros(size), 0
    rate_now = rate
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            rows = order[at : at + 64]
            length = offsets[rows + 1] - offsets[rows]
            index = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows])
            f, x = feature[index], value[index]
            local = np.append(0, np.cumsum(length))
            m = Machine(theta[0], theta[1 : DIMENSIONS + 1], theta[DIMENSIONS + 1 :].reshape(DIMENSIONS, factors))
            error = 1 / (1 + np.exp(-np.clip(m.logits(local, f, x), -30, 30))) - label[rows]
            error /= len(rows)
            each = np.repeat(error, length)
            vx = m.factor[f] * x[:, None]
            total = np.repeat(np.add.reduceat(vx, local[:-1]), length, axis=0)
            gradient = np.zeros(size)
            gradient[0] = error.sum()
            gradient[1 : DIMENSIONS + 1] = np.bincount(f, weights=each * x, minlength=DIMENSIONS)
            own = (each * x)[:, None] * (total - vx)
            both = gradient[DIMENSIONS + 1 :].reshape(DIMENSIONS, factors)
            for k in range(factors):
                both[:, k] = np.bincount(f, weights=own[:, k], minlength=DIMENSIONS)
            gradient[1:] += 1e-6 * theta[1:]
            step += 1
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient * gradient
            theta = theta - rate_now * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        rate_now = rate * (1 - (epoch + 1) / (epochs + 1))
    return Machine(float(theta[0]), theta[1 : DIMENSIONS + 1].copy(), theta[DIMENSIONS + 1 :].reshape(DIMENSIONS, factors).copy())


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = 6) -> Machine:
    """From labelled documents outside fold 0; without any, the machine that scores all alike at 0.5.

    A doc_id with several labels, or several rows, gives an example for each pair
    of them; labels other than 0 and 1 are left out.
    """
    own = runtime.plain(labels, doc_id="long", quality="int").where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    n = own.count()
    own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < min(1.0, max_rows / max(n, 1)) * 1_000_000)

    def encode(batches):
        for batch in batches:
            for part in chunks(batch.column(1)):
                at = slice(part.rows.start, part.rows.stop)
                offsets, feature, value = features(part, batch.column(2).to_pylist()[at])
                rows = [feature[a:b].astype("<i4").tobytes() + value[a:b].astype("<f4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at.start, len(part)), batch.column(3).slice(at.start, len(part)), pa.array(rows, pa.binary())], names=["doc_id", "quality", "row"])

    known = documents.join(F.broadcast(own), "doc_id").select("doc_id", "text", "n_chars", "quality")  # own: at most about max_rows rows
    got = known.mapInArrow(runtime.task(encode), "doc_id long, quality int, row binary").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return Machine(0.0, np.zeros(DIMENSIONS), np.zeros((DIMENSIONS, FACTORS)))
    rows = got["row"].to_pylist()
    feature = np.concatenate([np.frombuffer(r[: len(r) // 2], "<i4") for r in rows]).astype(np.int64)
    value = np.concatenate([np.frombuffer(r[len(r) // 2 :], "<f4") for r in rows]).astype(np.float64)
    offsets = np.append(0, np.cumsum([len(r) // 8 for r in rows]))
    return train(offsets, feature, value, got["quality"].to_numpy().astype(np.float64), epochs=epochs)


def score(documents: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every document; null and empty texts are scored by structure alone."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(machine)

    def predict(batches):
        m = shared.value
        for batch in batches:
            for part in chunks(batch.column(1)):
                at, n = part.rows.start, len(part)
                z = m.logits(*features(part, batch.column(2).slice(at, n).to_pylist()))
                p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text", "n_chars").mapInArrow(runtime.task(predict), "doc_id long, score double, predicted int")


def with_metadata(documents: DataFrame) -> DataFrame:
    """doc_id, text, n_chars (null where documents have none)."""
    if "n_chars" not in documents.columns:
        documents = documents.withColumn("n_chars", F.lit(None).cast("double"))
    return runtime.plain(documents, doc_id="long", text="string", n_chars="double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned outside fold 0."""
    documents = with_metadata(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = score(documents, fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
