"""Judgements over small sets of vectors (A3, A4, P9): set_id, idx, embedding.

A set is what one person offers at once, some tens of vectors, so it is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, mean_by

CENTROID, PAIRWISE, MINIMUM, CAP = 0.35, 0.175, 3, 5
#: The names under which an enrolment's outcome is stored.
ACCEPTED, QUALITY, MIXED, TOO_FEW = OUTCOMES = ("Accepted", "RejectedQuality", "RejectedMixedIdentity", "RejectedTooFewPhotos")


def consistency(sets: DataFrame, centroid: float = CENTROID, pairwise: float = PAIRWISE) -> DataFrame:
    """(set_id, n, outliers, min_similarity, verdict); a single vector is consistent."""
    near = sets.join(mean_by(sets, "set_id"), "set_id").select("set_id", dot(F.col("embedding"), F.col("mean")).alias("s"))
    near = near.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") < centroid).alias("outliers"))
    a, b = sets.alias("a"), sets.alias("b")
    worst = a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.idx") < F.col("b.idx"))).groupBy(F.col("a.set_id").alias("set_id")).agg(F.min(dot(F.col("a.embedding"), F.col("b.embedding"))).alias("min_similarity"))
    out = near.join(worst, "set_id", "left")
    mixed = (F.col("n") > 1) & ((F.col("outliers") > 0) | (F.col("min_similarity") < pairwise))
    return out.select("set_id", "n", F.when(F.col("n") > 1, F.col("outliers")).otherwise(F.lit(0)).cast("long").alias("outliers"), "min_similarity", F.when(mixed, "Mixed").otherwise("Consistent").alias("verdict"))


def farthest_points(vectors: np.ndarray, count: int) -> list[int]:
    """Indices picked: the one farthest from the mean, then each time the one least like those picked; first on ties."""
    if count < 1:
        raise ValueError("at least one vector must be asked for")
    n = len(vectors)
    if n <= count:
        return list(range(n))
    total = vectors.sum(axis=0)
    length = np.sqrt((total * total).sum())
    if length <= 1e-12:
        raise ValueError("the mean of these vectors is zero")
    picked = [int(np.argmin(vectors @ (total / length)))]
    worst = vectors @ vectors[picked[0]]
    while len(picked) < count:
        worst[picked] = np.inf
        picked.append(int(np.argmin(worst)))
        worst = np.maximum(worst, vectors @ vectors[picked[-1]])
    return picked


def select(sets: DataFrame, count: int = CAP) -> DataFrame:
    """(set_id, pick, idx): the vectors kept of each set, in the order picked; a small set stays as it is."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        own = farthest_points(np.stack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]]), count)
        return pd.DataFrame({"set_id": pdf["set_id"].iloc[0], "pick": range(len(own)), "idx": pdf["idx"].to_numpy()[own]})

    kind = {f.name: f.dataType.simpleString() for f in sets.schema}
    return sets.select("set_id", "idx", "embedding").groupBy("set_id").applyInPandas(one, f"set_id {kind['set_id']}, pick int, idx {kind['idx']}")


def three_places(similarity: Column) -> Column:
    return F.format_string("%.3f", similarity)


def decide(sets: DataFrame, minimum: int = MINIMUM, shown: Callable[[Column], Column] = three_places) -> DataFrame:
    """(set_id, n, outcome, reason): too few vectors, then inconsistent ones, are rejected; an accepted set has no reason.

    shown: how a reason writes the lowest similarity.
    """
    c = consistency(sets)
    few = F.format_string("%d usable photographs, at least %d required", "n", F.lit(minimum))
    who = F.when(F.col("outliers") == 0, F.lit("the photographs do not all show the same person")).when(F.col("outliers") == 1, F.lit("1 photograph shows a different person"))
    who = who.otherwise(F.format_string("%d photographs show a different person", "outliers"))
    mixed = F.concat(who, F.lit(" (lowest similarity "), shown(F.col("min_similarity")), F.lit(")"))
    outcome = F.when(F.col("n") < minimum, TOO_FEW).when(F.col("verdict") == "Mixed", MIXED).otherwise(ACCEPTED)
    return c.select("set_id", "n", outcome.alias("outcome"), F.when(F.col("n") < minimum, few).when(F.col("verdict") == "Mixed", mixed).alias("reason"))


def enrolled(sets: DataFrame, minimum: int = MINIMUM, count: int = CAP) -> DataFrame:
    """(set_id, pick, idx, embedding): the vectors kept of each accepted set, in the order picked."""
    good = decide(sets, minimum).where(F.col("outcome") == ACCEPTED).select("set_id")
    picked = select(sets.join(good, "set_id", "left_semi"), count)
    return picked.join(sets.select("set_id", "idx", "embedding"), ["set_id", "idx"]).select("set_id", "pick", "idx", "embedding")
