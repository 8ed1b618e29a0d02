"""Reports from the command line: python -m kinvec {verify,identify,all,bench} ...."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .operators import metrics, reports, scoring, slots
from .sources import protocol


def verify(spark: SparkSession, pairs: str, embeddings: str) -> str:
    """The verification report of a pair file over embeddings (id, v) of its pictures' names."""
    listed = protocol.parse_pairs(protocol.read_lines(spark, pairs)).withColumnsRenamed({"image_a": "a_id", "image_b": "b_id"})
    return reports.verification_text(metrics.scored_pairs(listed, spark.read.parquet(embeddings), vectors.dot))


def identify(spark: SparkSession, probes: str, gallery: str, threshold: float, mode: str = "raw", scores: str | None = None, reuse: bool = False) -> str:
    """The identification report of videos' vectors (probe_id, own, v) against galleries (gallery_id, v); scores are kept in `scores` where it is given."""

    def make() -> DataFrame:
        p, g = spark.read.parquet(probes), spark.read.parquet(gallery)
        return scoring.collected(p.select("probe_id", "own").distinct(), p.where("v is not null").select("probe_id", "v"), g)

    found = protocol.cached_scores(spark, scores, reuse, make) if scores else make()
    ranked = scoring.rank(found, threshold, mode)
    return reports.identification_text(ranked.withColumn("target", protocol.target_of(F.col("probe_id").cast("string"))))


def bench(spark: SparkSession, users: int = 1000, dimension: int = 512, rounds: int = 3) -> str:
    """Times of plain scoring: one probe, and sixteen in one packed row, against that many users; and what more users would take."""
    block = 1 << (dimension - 1).bit_length()
    padded = F.concat(vectors.unit(F.col("id"), dimension), F.array_repeat(F.lit(0.0), block - dimension))
    gallery = spark.range(users).select(F.col("id").alias("gallery_id"), padded.alias("v")).persist()
    gallery.count()
    queries = spark.range(users, users + slots.BLOCKS).select(F.col("id").alias("probe_id"), F.lit(-1).cast("long").alias("own"), padded.alias("v"))
    packed = slots.pack(slots.batch(queries.select("probe_id", "v"), "probe_id").withColumnRenamed("batch", "g"), "g", block)
    packed = spark.createDataFrame(packed.collect(), packed.schema)  # one row
    jobs = {
        "one probe": lambda: scoring.best_scores(queries.limit(1), gallery),
        "sixteen probes, as matrices": lambda: scoring.best_scores(queries, gallery),
        "sixteen probes, packed slots": lambda: gallery.crossJoin(F.broadcast(packed)).select(slots.batch_scores(packed, F.col("v"), block).alias("s")),
    }
    out = []
    for name, job in jobs.items():
        began = time.perf_counter_ns()
        for _ in range(rounds):
            job().write.format("noop").mode("overwrite").save()
        spent = time.perf_counter_ns() - began
        m = spark.range(1).select(vectors.measurement(F.lit(spent), F.lit(rounds)).alias("m")).select("m.*").first()
        cost = {n: m["avg_ms"] / users * n / 1000 for n in (10_000, 1_000_000)}
        out.append(f"{name:<30}: {m['avg_ms']:.1f} ms, {m['per_second']:.2f} a second; " + ", ".join(f"{n} users {s:.1f} s" for n, s in cost.items()))
    gallery.unpersist()
    return "\n".join(out) + "\n"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(prog="kinvec", description=__doc__)
    parser.add_argument("what", choices=("verify", "identify", "all", "bench"))
    parser.add_argument("--pairs")
    parser.add_argument("--embeddings")
    parser.add_argument("--probes")
    parser.add_argument("--gallery")
    parser.add_argument("--threshold", type=float, default=0.25)
    parser.add_argument("--mode", default="raw", type=scoring.parse_mode)
    parser.add_argument("--scores")
    parser.add_argument("--reuse", action="store_true")
    parser.add_argument("--users", type=int, default=1000)
    args = parser.parse_args(argv)
    wanted = {"verify": ("pairs", "embeddings"), "identify": ("probes", "gallery"), "all": ("pairs", "embeddings", "probes", "gallery"), "bench": ()}[args.what]
    if missing := [f"--{w}" for w in wanted if getattr(args, w) is None]:
        parser.error(f"{args.what} needs {', '.join(missing)}")
    spark = spark or SparkSession.builder.appName("kinvec").getOrCreate()
    out = ""
    if args.what in ("verify", "all"):
        out += verify(spark, args.pairs, args.embeddings)
    if args.what in ("identify", "all"):
        out += identify(spark, args.probes, args.gallery, args.threshold, args.mode, args.scores, args.reuse)
    if args.what == "bench":
        out += bench(spark, args.users)
    return out


if __name__ == "__main__":
    print(main(), end="")
