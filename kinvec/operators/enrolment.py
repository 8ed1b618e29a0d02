"""Enrolment from photographs to the store (F10, A24, P9-P12) and trials of pictures.

Detections have image_id, det_idx, image_width, image_height, box, points and
embedding; a photograph is of one user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, images, vectors
from ..sources.store import Store
from . import identity, metrics, models, scoring, slots, tracking


def usable(faces: DataFrame, pictures: DataFrame | None = None) -> DataFrame:
    """The centre-most face of each photograph, if it is accepted; faces have `sharpness`, or pictures (image_id, picture) give it.

    The choice comes first: a photograph whose centre-most face is rejected has none.
    """
    chosen = geometry.centre_most(faces)
    if pictures is not None:
        cut = geometry.crop(F.col("box"), F.col("image_width"), F.col("image_height"))
        chosen = chosen.join(pictures.select("image_id", "picture"), "image_id").withColumn("sharpness", images.sharpness_of(F.col("picture"), cut)).drop("picture")
    verdict = geometry.assess(F.col("box"), F.col("points.left_eye"), F.col("points.right_eye"), F.col("sharpness"))
    return chosen.withColumn("verdict", verdict).where("verdict.accepted").drop("verdict")


def decided(photographs: DataFrame, faces: DataFrame, minimum: int = identity.MINIMUM) -> DataFrame:
    """(user_id, photos_offered, photos_usable, outcome, reason) of every user of photographs (user_id, image_id); faces are the usable ones."""
    offered = photographs.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("photos_offered"))
    sets = photographs.join(faces.select("image_id", "embedding"), "image_id").select(F.col("user_id").alias("set_id"), F.col("image_id").alias("idx"), "embedding")
    own = identity.decide(sets, minimum).withColumnRenamed("set_id", "user_id")
    out = offered.join(own, "user_id", "left")
    none = F.format_string("%d usable photographs, at least %d required", F.lit(0), F.lit(minimum))
    return out.select(
        "user_id", "photos_offered", F.coalesce("n", F.lit(0)).cast("int").alias("photos_usable"),
        F.coalesce("outcome", F.lit(identity.TOO_FEW)).alias("outcome"), F.when(F.col("outcome").isNull(), none).otherwise(F.col("reason")).alias("reason"),
    )


def galleries(photographs: DataFrame, faces: DataFrame, minimum: int = identity.MINIMUM, count: int = identity.CAP) -> DataFrame:
    """(user_id, pick, image_id, embedding): what an accepted user's gallery holds."""
    sets = photographs.join(faces.select("image_id", "embedding"), "image_id").select(F.col("user_id").alias("set_id"), F.col("image_id").alias("idx"), "embedding")
    return identity.enrolled(sets, minimum, count).withColumnsRenamed({"set_id": "user_id", "idx": "image_id"})


def enrol_and_store(store: Store, users: DataFrame, photographs: DataFrame, faces: DataFrame, keys: DataFrame, seal: Callable[[Column], Column], block: int) -> DataFrame:
    """Decide, and write users, keys, sealed galleries and audit rows in one transaction; the decisions.

    users: id, display_name, enrolled_at; keys: user_id, public_key, galois_keys.
    A rejected user leaves an audit row and no key and no gallery.  seal makes the
    ciphertext of a user's packed slots: nothing here writes a vector.
    """
    result = decided(photographs, faces).persist()
    kept = galleries(photographs, faces)
    now = F.current_timestamp()
    good = result.where(F.col("outcome") == identity.ACCEPTED).select("user_id")
    packed = slots.pack(kept.select("user_id", F.col("pick").alias("idx"), F.col("embedding").alias("v")), "user_id", block)
    with store.transaction():
        store.insert_users(users)
        store.put_keys(keys.join(good, "user_id", "left_semi").withColumn("created_at", now))
        store.put_galleries(packed.select("user_id", seal(F.col("slots")).alias("ciphertext"), F.col("n").alias("vector_count"), now.alias("created_at")))
        store.record(result.withColumn("occurred_at", now))
    return result


def trial(pairs: DataFrame, faces: DataFrame) -> DataFrame:
    """pairs (image_a, image_b, same) with the score of the centre-most faces; null where a picture has none."""
    own = geometry.centre_most(faces).select(F.col("image_id").alias("id"), F.col("embedding").alias("v"))
    named = pairs.withColumnsRenamed({"image_a": "a_id", "image_b": "b_id"})
    return metrics.scored_pairs(named, own, vectors.dot).withColumnsRenamed({"a_id": "image_a", "b_id": "image_b"})


def pictures_trial(pairs: DataFrame, pictures: DataFrame, detector, embedder) -> DataFrame:
    """`trial` from the pictures (image_id, picture): each is detected and embedded once, and only its centre-most face."""
    wanted = pairs.select(F.col("image_a").alias("image_id")).union(pairs.select("image_b")).distinct()
    faces = models.detect_and_embed(pictures.join(wanted, "image_id", "left_semi"), detector, embedder, choose=geometry.centre_most)
    return trial(pairs, faces)


def collect(videos: DataFrame, detections: DataFrame, gallery: DataFrame) -> DataFrame:
    """Scores of videos (probe_id, own) from the detections in their frames (video, ts, ...) against gallery (gallery_id, v)."""
    tracks = tracking.track_vectors(detections).select(F.col("video").alias("probe_id"), "v")
    return scoring.collected(videos, tracks, gallery)


def run(videos: DataFrame, detections: DataFrame, gallery: DataFrame, threshold: float, mode: str = "raw") -> DataFrame:
    """`collect`, then ranked."""
    return scoring.rank(collect(videos, detections, gallery), threshold, mode)
