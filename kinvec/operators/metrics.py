"""Verification metrics over scored pairs (A5-A12): score double, same boolean.

Pairs are first counted by distinct score, so what is cumulated is bounded by
the number of distinct scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import positions, running

_UP = Window.unboundedPreceding


def by_score(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("score").agg(F.count_if("same").alias("g"), F.count_if(~F.col("same")).alias("i"))


def validated(pairs: DataFrame) -> DataFrame:
    """pairs, unless there is no genuine or no impostor pair."""
    r = pairs.agg(F.count_if("same").alias("g"), F.count_if(~F.col("same")).alias("i")).first()
    if not r["g"] or not r["i"]:
        raise ValueError("metrics need at least one genuine and one impostor pair")
    return pairs


def roc(pairs: DataFrame) -> DataFrame:
    """(threshold, far, tar) at every distinct score and at +infinity, acceptance by >=."""
    own = by_score(pairs)
    totals = own.agg(F.sum("g").alias("gs"), F.sum("i").alias("is"))
    run = running(own, "score", {"g": "g", "i": "i"}, descending=True).crossJoin(F.broadcast(totals))
    points = run.select(F.col("score").alias("threshold"), (F.col("i") / F.col("is")).alias("far"), (F.col("g") / F.col("gs")).alias("tar"))
    top = pairs.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, far double, tar double")
    return top.union(points)


def auc(points: DataFrame) -> DataFrame:
    """(auc): trapezium rule over the points by false-accept rate.

    Points of one rate are a line upwards: its lowest is reached from the rate
    before, its highest goes on to the next.
    """
    rates = points.groupBy("far").agg(F.min("tar").alias("low"), F.max("tar").alias("high"))
    # the rate before: positions in order, joined with themselves one place on
    at = positions(rates, "far")
    before = at.select((F.col("pos") + 1).alias("pos"), F.col("far").alias("f0"), F.col("high").alias("t0"))
    step = at.join(before, "pos")
    return step.agg(F.coalesce(F.sum((F.col("far") - F.col("f0")) * (F.col("low") + F.col("t0")) / 2), F.lit(0.0)).alias("auc"))


def equal_error_rate(points: DataFrame) -> DataFrame:
    """(eer, threshold) where the two error rates are nearest; of several the highest threshold."""
    frr = 1 - F.col("tar")
    return points.orderBy(F.abs(F.col("far") - frr), F.desc("threshold")).limit(1).select(((F.col("far") + frr) / 2).alias("eer"), "threshold")


def tar_at_far(points: DataFrame, target: float, impostors: int) -> DataFrame:
    """(tar, threshold) of the best point within the target; a target finer than 1 / impostors raises (0 is allowed)."""
    if not 0 <= target <= 1:
        raise ValueError("a rate lies between 0 and 1")
    if target and target < 1 / impostors:
        raise ValueError(f"a rate of {target} is finer than {impostors} impostor pairs can tell")
    return points.where(F.col("far") <= target).orderBy(F.desc("tar"), F.desc("threshold")).limit(1).select("tar", "threshold")


def best_global_threshold(pairs: DataFrame) -> DataFrame:
    """(threshold, accuracy) of most correct decisions over the distinct scores; of several the highest."""
    own = by_score(pairs)
    totals = own.agg(F.sum("i").alias("is"), F.sum(F.col("g") + F.col("i")).alias("n"))
    run = running(own, "score", {"g": "g", "i": "i"}, descending=True).crossJoin(F.broadcast(totals))
    correct = F.col("g") + F.col("is") - F.col("i")
    best = run.agg(F.max(F.struct((correct / F.col("n")).alias("accuracy"), F.col("score").alias("threshold"))).alias("b"))
    return best.select("b.threshold", "b.accuracy")


def ten_fold(pairs: DataFrame, folds: int = 10, fold_size: int = 600) -> DataFrame:
    """(fold, threshold, accuracy): each fold tested at the best threshold of the others.

    pairs: pair_idx from 0, contiguous; any other number of pairs than folds *
    fold_size raises.  Training counts are totals less the fold's own.
    """
    r = pairs.agg(F.count(F.lit(1)).alias("n"), F.min("pair_idx").alias("lo"), F.max("pair_idx").alias("hi"), F.countDistinct("pair_idx").alias("d")).first()
    n = folds * fold_size
    if (r["n"], r["lo"], r["hi"], r["d"]) != (n, 0, n - 1, n):
        raise ValueError(f"the protocol needs exactly {n} pairs numbered from 0")
    pairs = pairs.withColumn("fold", F.floor(F.col("pair_idx") / fold_size).cast("int"))
    own = pairs.groupBy("fold", "score").agg(F.count_if("same").alias("g"), F.count_if(~F.col("same")).alias("i"))
    every = own.groupBy("score").agg(F.sum("g").alias("g"), F.sum("i").alias("i"))
    each = pairs.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    grid = every.crossJoin(F.broadcast(each)).join(own.select("fold", "score", F.col("g").alias("fg"), F.col("i").alias("fi")), ["fold", "score"], "left").na.fill(0, ["fg", "fi"])
    train = grid.select("fold", "score", (F.col("g") - F.col("fg")).alias("g"), (F.col("i") - F.col("fi")).alias("i"), "fg", "fi")
    down = Window.partitionBy("fold").orderBy(F.desc("score")).rowsBetween(_UP, 0)
    whole = Window.partitionBy("fold")
    run = train.select(
        "fold", "score", (F.sum("g").over(down) + F.sum("i").over(whole) - F.sum("i").over(down)).alias("correct"),
        (F.sum("fg").over(down) + F.sum("fi").over(whole) - F.sum("fi").over(down)).alias("test"), (F.col("g") + F.col("i") > 0).alias("trained"),
    )
    best = run.where("trained").groupBy("fold").agg(F.max(F.struct("correct", "score", "test")).alias("b"))
    return best.select("fold", F.col("b.score").alias("threshold"), (F.col("b.test") / fold_size).alias("accuracy"))


def ten_fold_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("accuracy").alias("mean"), (F.stddev_samp("accuracy") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("stderr"))


def scored_pairs(pairs: DataFrame, embeddings: DataFrame, score) -> DataFrame:
    """pairs (a_id, b_id, ...) with `score` of the vectors of both; null where a side has no vector (embeddings: id, v)."""
    a = embeddings.select(F.col("id").alias("a_id"), F.col("v").alias("_a"))
    b = embeddings.select(F.col("id").alias("b_id"), F.col("v").alias("_b"))
    out = pairs.join(a, "a_id", "left").join(b, "b_id", "left")
    there = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return out.withColumn("score", F.when(there, score(F.col("_a"), F.col("_b")))).drop("_a", "_b")


def counts(scored: DataFrame) -> DataFrame:
    """(genuine, impostors, skipped) of pairs with `same` and a score, which is null for those skipped."""
    has = F.col("score").isNotNull()
    return scored.agg(F.count_if(has & F.col("same")).alias("genuine"), F.count_if(has & ~F.col("same")).alias("impostors"), F.count_if(~has).alias("skipped"))


def verification(scored: DataFrame, rates: tuple[float, ...] = (1e-3, 1e-4)) -> dict:
    """The whole report of scored pairs (same, score): counts, auc, eer, and the rate at each false-accept rate that the impostors can tell (None elsewhere)."""
    n = counts(scored).first().asDict()
    out = dict(n)
    if not n["genuine"] or not n["impostors"]:
        return out
    points = roc(scored.where("score is not null")).persist()
    try:
        out["auc"] = auc(points).first()["auc"]
        out["eer"], out["eer_threshold"] = equal_error_rate(points).first()
        for r in rates:
            best = tar_at_far(points, r, n["impostors"]).first() if r * n["impostors"] >= 1 else None
            out[f"tar_at_{r:g}"] = None if best is None else tuple(best)
    finally:
        points.unpersist()
    return out
