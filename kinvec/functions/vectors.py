"""Unit-vector algebra as Catalyst expressions (V1-V3, A1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_NORM = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double; vectors of different length raise."""
    total = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("dimension mismatch")).cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def bound(value: Column, use) -> Column:
    """use(value), the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalise(v: Column) -> Column:
    """v over its length; empty and zero vectors raise."""
    error = F.raise_error(F.lit("a zero or empty vector can't be normalised")).cast("array<double>")

    def over(own: Column):
        return lambda length: F.when(length > MIN_NORM, F.transform(own, lambda x: x / length)).otherwise(error)

    return bound(doubles(v), lambda own: bound(norm(own), over(own)))


def mean_by(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, mean): the renormalised mean of each key's vectors, with partial sums by position."""
    at = df.select(key, F.posexplode(doubles(F.col(vector))).alias("pos", "x")).groupBy(key, "pos").agg(F.sum("x").alias("x"))
    whole = at.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("total"))
    return whole.select(key, normalise(F.col("total")).alias("mean"))


def unit(seed: Column, dimension: int = 512) -> Column:
    """A unit vector that depends on the seed only: normal numbers by pairs of uniform ones from its hash."""
    uniform = lambda i, salt: (F.shiftrightunsigned(F.xxhash64(seed, i, F.lit(salt)), 11).cast("double") + 0.5) / float(1 << 53)
    normal = F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda i: F.sqrt(-2.0 * F.log(uniform(i, 1))) * F.cos(2.0 * F.pi() * uniform(i, 2)))
    return normalise(normal)


def measurement(total_ns: Column, iterations: Column) -> Column:
    """struct(avg_ns, avg_us, avg_ms, per_second) of a timed run."""
    avg, total = total_ns.cast("double") / iterations, total_ns.cast("double")
    rate = F.when(total == 0, F.lit(float("inf"))).otherwise(F.try_divide(iterations * F.lit(1e9), total))  # rounded once
    return F.struct(avg.alias("avg_ns"), (avg / 1e3).alias("avg_us"), (avg / 1e6).alias("avg_ms"), rate.alias("per_second"))


def projected_cost(users: Column, avg_ms: Column, workers: Column) -> Column:
    """Seconds to compare one vector with that many users, shared evenly."""
    return users * avg_ms / 1000.0 / workers
