"""Probe and gallery scoring, ranking and reports.

Scores are one row a probe and gallery identity.  Both sides are dealt in blocks
and meet as matrices, block by block: no task holds more than one block of each,
and of a block only the best score for each gallery identity leaves it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import upper_median

MODES = ("raw", "probe_z", "gallery_z")
PROBES, GALLERY = 1024, 2048
NO_SCORE = float("-inf")


def parse_mode(name: str) -> str:
    """raw, probe_z or gallery_z, in any case and with blanks around; anything else raises."""
    known = {"raw": "raw", "probez": "probe_z", "probe-z": "probe_z", "galleryz": "gallery_z", "gallery-z": "gallery_z", "probe_z": "probe_z", "gallery_z": "gallery_z"}
    try:
        return known[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown scoring mode {name!r}") from None


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    own = table[name].combine_chunks()
    own = own if not isinstance(own, pa.ChunkedArray) else pa.concat_arrays(own.chunks)
    size = np.unique(np.diff(own.offsets.to_numpy()))
    if len(size) != 1:
        raise ValueError("dimension mismatch")
    return own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), int(size[0]))


def best_scores(probes: DataFrame, gallery: DataFrame, probe_block: int = PROBES, gallery_block: int = GALLERY) -> DataFrame:
    """(probe_id, own, gallery_id, score): the best cosine of any vector of a probe with any of each identity.

    probes: probe_id, own, v; gallery: gallery_id, v.  Unit vectors; of different
    length they raise.
    """
    n = max(1, -(-probes.count() // probe_block))
    m = max(1, -(-gallery.count() // gallery_block))
    block = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))) if k > 1 else F.lit(0)
    left = probes.select("probe_id", "own", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("probe_id", "v"), F.lit(n)).cast("int").alias("pb"), block(m).alias("gb"))
    right = gallery.select("gallery_id", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("gallery_id", "v"), F.lit(m)).cast("int").alias("gb"), block(n).alias("pb"))
    kinds = {f.name: f.dataType.simpleString() for df in (probes, gallery) for f in df.schema}

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["probe_id", "own", "gallery_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table({"probe_id": a["probe_id"].slice(0, 0), "own": a["own"].slice(0, 0), "gallery_id": b["gallery_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        own = b["gallery_id"].combine_chunks().dictionary_encode()
        own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
        code = own.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        x, y = _matrix(a, "v"), _matrix(b, "v")[order]
        if x.shape[1] != y.shape[1]:
            raise ValueError("dimension mismatch")
        heads = np.flatnonzero(np.append(True, np.diff(code[order]) > 0))
        best = np.maximum.reduceat(x @ y.T, heads, axis=1)
        p, g = np.divmod(np.arange(best.size), len(heads))
        return pa.table([a["probe_id"].take(p), a["own"].take(p), own.dictionary.take(code[order][heads][g]), pa.array(best.ravel())], names=names)

    schema = f"probe_id {kinds['probe_id']}, own {kinds['own']}, gallery_id {kinds['gallery_id']}, score double"
    each = left.groupBy("pb", "gb").cogroup(right.groupBy("pb", "gb")).applyInArrow(lambda a, b: meet(a, b), schema)
    return each.groupBy("probe_id", "own", "gallery_id").agg(F.max("score").alias("score"))


def scorable(probes: DataFrame, gallery: DataFrame, own: str = "own") -> DataFrame:
    """Probes of the identities that have a gallery; the others can't be scored."""
    return probes.join(gallery.select(F.col("gallery_id").alias(own)).distinct(), own, "left_semi")


def collected(videos: DataFrame, tracks: DataFrame, gallery: DataFrame) -> DataFrame:
    """(probe_id, own, gallery_id, score): of each video (probe_id, own) of an identity with a gallery, the best of its tracks (probe_id, v).

    A video without tracks scores -infinity against every identity.
    """
    videos = scorable(videos, gallery).select("probe_id", "own")
    found = best_scores(tracks.join(videos, "probe_id").select("probe_id", "own", "v"), gallery)
    without = videos.join(tracks.select("probe_id").distinct(), "probe_id", "left_anti")
    # a row for each identity is what is asked for
    none = without.crossJoin(gallery.select("gallery_id").distinct()).select("probe_id", "own", "gallery_id", F.lit(NO_SCORE).alias("score"))
    return found.union(none.select(found.columns))


def _finite(x: Column) -> Column:
    return F.when((x > NO_SCORE) & (x < float("inf")), x)


def normalised(scores: DataFrame, mode: str) -> DataFrame:
    """scores with `used`: raw, or z-scored by probe or by gallery; finite scores only enter mean and deviation.

    A deviation of 0, or of fewer than two scores, leaves the score as it is.
    """
    mode = parse_mode(mode)
    if mode == "raw":
        return scores.withColumn("used", F.col("score"))
    w = Window.partitionBy("probe_id" if mode == "probe_z" else "gallery_id")
    m, sd = F.avg(_finite(F.col("score"))).over(w), F.coalesce(F.stddev_samp(_finite(F.col("score"))).over(w), F.lit(0.0))
    return scores.withColumn("m", m).withColumn("sd", sd).withColumn("used", F.when(F.col("sd") != 0, (F.col("score") - F.col("m")) / F.col("sd")).otherwise(F.col("score"))).drop("m", "sd")


def rank(scores: DataFrame, threshold: float, mode: str = "raw") -> DataFrame:
    """One row a probe: matched, rank1, own_rank, candidates, own_score, best_other, best_other_id.

    matched and the best other are always of raw scores.  Equal scores keep the
    galleries' order; own_rank 0: the identity has no gallery.
    """
    used = normalised(scores, mode)
    by = Window.partitionBy("probe_id")
    used = used.withColumn("place", F.row_number().over(by.orderBy(F.desc("used"), "gallery_id")))
    own, other = F.col("gallery_id") == F.col("own"), F.col("gallery_id") != F.col("own")
    # greatest score, then least gallery: one ordered minimum
    best = F.min(F.when(other, F.struct((-F.col("score")).alias("s"), F.col("gallery_id").alias("g"))))
    out = used.groupBy("probe_id", "own").agg(
        F.coalesce(F.max(F.when(own, F.col("score"))), F.lit(NO_SCORE)).alias("own_score"),
        F.coalesce(F.max(F.when(own, F.col("place"))), F.lit(0)).cast("long").alias("own_rank"),
        F.count(F.lit(1)).alias("candidates"),
        best.alias("best"),
    )
    return out.select(
        "probe_id", "own", "own_score", "own_rank", "candidates",
        (F.col("own_score") >= threshold).alias("matched"), (F.col("own_rank") == 1).alias("rank1"),
        F.coalesce(-F.col("best.s"), F.lit(NO_SCORE)).alias("best_other"), F.col("best.g").alias("best_other_id"),
    )


def cumulative_match(results: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """(k, hits, n, rate) over the probes that have a rank."""
    counts = results.where("own_rank > 0").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("own_rank") <= k).alias(f"h{k}") for k in ks])
    rows = counts.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])).alias("r"))
    return rows.select("r.k", "r.hits", "n", F.try_divide("r.hits", "n").alias("rate"))


def cumulative_summary(results: DataFrame) -> DataFrame:
    """(candidates, n, median_rank, mean_rank, missed, second): over the probes that have a rank; second: the share of misses at rank 2."""
    ranked = results.where("own_rank > 0")
    out = ranked.agg(
        F.coalesce(F.max("candidates"), F.lit(0)).alias("candidates"), F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("own_rank"), F.lit(0.0)).alias("mean_rank"),
        F.count_if(F.col("own_rank") > 1).alias("missed"), F.count_if(F.col("own_rank") == 2).alias("twos"),
    )
    median = upper_median(ranked.select(F.col("own_rank").cast("double").alias("r")), "r").select(F.col("upper_median").cast("long").alias("median_rank"))
    return out.crossJoin(F.broadcast(median)).select("candidates", "n", "median_rank", "mean_rank", "missed", F.coalesce(F.try_divide("twos", "missed"), F.lit(0.0)).alias("second"))


def report_by_identity(results: DataFrame) -> DataFrame:
    """(own, n, match_rate, rank1_rate, mean_own, mean_other) of each identity; finite best others only."""
    return results.groupBy("own").agg(*_rates())


def report_total(results: DataFrame) -> DataFrame:
    return results.agg(*_rates())


def _rates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.avg(F.col("matched").cast("double")).alias("match_rate"), F.avg(F.col("rank1").cast("double")).alias("rank1_rate"),
        F.avg("own_score").alias("mean_own"), F.avg(_finite(F.col("best_other"))).alias("mean_other"),
    ]


def _chance(results: DataFrame) -> DataFrame:
    n = results.agg(F.countDistinct("own").alias("n"))
    return n.select(F.when(F.col("n") > 1, 1.0 / (F.col("n") - 1)).otherwise(0.0).alias("chance"))


def _median(df: DataFrame, value: Column, name: str) -> DataFrame:
    return upper_median(df.select(value.alias("x")), "x").select(F.col("upper_median").alias(name))


def diagnostics(results: DataFrame, near: float = 0.02) -> DataFrame:
    """(probes, misranked, won_by_target, share, chance, near_misses, median_deficit, median_margin), one row.

    Only results with a target count as misranked or well ranked; probes and the
    chance are of all.  Medians are the upper ones, 0 of none.
    """
    known = results.where(F.col("target").isNotNull())
    wrong, margin = ~F.col("rank1"), F.col("own_score") - F.col("best_other")
    won = wrong & F.coalesce(F.col("best_other_id") == F.col("target"), F.lit(False))
    out = known.agg(F.count_if(wrong).alias("misranked"), F.count_if(won).alias("won_by_target"), F.count_if(wrong & (-margin < near)).alias("near_misses"))
    parts = [results.agg(F.count(F.lit(1)).alias("probes")), _chance(results), _median(known.where(wrong), -margin, "median_deficit"), _median(known.where(~wrong), margin, "median_margin")]
    for one in parts:  # a row each
        out = out.crossJoin(F.broadcast(one))
    return out.select("probes", "misranked", "won_by_target", F.coalesce(F.try_divide("won_by_target", "misranked"), F.lit(0.0)).alias("share"), "chance", "near_misses", "median_deficit", "median_margin")


def leakage(results: DataFrame, tight: float = 0.05) -> DataFrame:
    """(known, outranks, outrank_share, error_share, chance, median_gap, tight), one row, of the results with a target.

    outranks: the target is the best other identity and above the own one;
    error_share: of the misranked, how many the target won.
    """
    known = results.where(F.col("target").isNotNull())
    is_target = F.coalesce(F.col("best_other_id") == F.col("target"), F.lit(False))
    wrong, gap = ~F.col("rank1"), F.abs(F.col("own_score") - F.col("best_other"))
    out = known.agg(
        F.count(F.lit(1)).alias("known"), F.count_if(is_target & (F.col("best_other") > F.col("own_score"))).alias("outranks"),
        F.count_if(wrong).alias("wrong"), F.count_if(wrong & is_target).alias("won"), F.count_if(gap < tight).alias("tight"),
    )
    for one in (_chance(results), _median(known, gap, "median_gap")):
        out = out.crossJoin(F.broadcast(one))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select("known", "outranks", share("outranks", "known").alias("outrank_share"), share("won", "wrong").alias("error_share"), "chance", "median_gap", "tight")
