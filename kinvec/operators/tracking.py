"""Entity tracking over time-ordered detections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_IOU, MIN_COSINE, MAX_GAP = 0.2, 0.4, 1.5


def _iou(a, b) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return 0.0 if w <= 0 or h <= 0 else w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


class Tracker:
    """Open tracks of one entity stream; feed frames in time order."""

    def __init__(self):
        self.open: list[dict] = []
        self.closed: list[dict] = []
        self.next = 0

    def frame(self, ts: float, detections: list[tuple]) -> None:
        """detections: (box, vector), in order; each takes the best free open track that passes both gates."""
        live = []
        for track in self.open:
            (self.closed if ts - track["t1"] > MAX_GAP else live).append(track)
        free, touched = live, []
        for box, vector in detections:
            best, best_score = None, -np.inf
            for track in free:
                overlap, cosine = _iou(track["box"], box), float(np.dot(track["vector"], vector))
                if overlap >= MIN_IOU and cosine >= MIN_COSINE and overlap + cosine > best_score:
                    best, best_score = track, overlap + cosine
            if best is None:
                best = {"id": self.next, "t0": ts, "sum": np.zeros(len(vector)), "n": 0}
                self.next += 1
            else:
                free = [t for t in free if t is not best]
            best.update(t1=ts, box=box, vector=vector, sum=best["sum"] + vector, n=best["n"] + 1)
            touched.insert(0, best)
        self.open = touched + free

    def finished(self) -> list[dict]:
        return sorted(self.closed + self.open, key=lambda t: t["id"])


def mean_vector(total: np.ndarray) -> np.ndarray:
    length = float(np.sqrt((total * total).sum()))
    if length <= 1e-12:
        raise ValueError("the mean of these vectors is zero")
    return total / length


def segments(detections: DataFrame, gap: float = MAX_GAP) -> DataFrame:
    """detections with `segment`: no track lives through a gap of more than that, so a long video is several pieces of work."""
    w = Window.partitionBy("video").orderBy("ts")
    new = F.when(F.col("ts") - F.lag("ts").over(w) > gap, 1).otherwise(0)
    return detections.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def track(detections: DataFrame) -> DataFrame:
    """(video, track_id, n_obs, t0, t1, duration, mean): the tracks of each video.

    detections: video, ts, det_idx, x, y, width, height, embedding (unit), and
    `frame` where several frames have one timestamp: they are taken one after
    another.  Tracks are numbered from 0 in the order in which they begin; a
    zero mean raises.
    """
    if "frame" not in detections.columns:
        detections = detections.withColumn("frame", F.lit(0))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, tracker = pdf.sort_values(["ts", "frame", "det_idx"], kind="stable"), Tracker()
        for (ts, _), frame in pdf.groupby(["ts", "frame"], sort=False):
            tracker.frame(float(ts), [((r.x, r.y, r.width, r.height), np.asarray(r.embedding, dtype=np.float64)) for r in frame.itertuples()])
        done = tracker.finished()
        return pd.DataFrame({"video": pdf["video"].iloc[0], "segment": pdf["segment"].iloc[0], "track_id": [t["id"] for t in done], "n_obs": [t["n"] for t in done], "t0": [t["t0"] for t in done], "t1": [t["t1"] for t in done], "mean": [list(mean_vector(t["sum"])) for t in done]})

    own = segments(detections).groupBy("video", "segment").applyInPandas(one, "video string, segment long, track_id int, n_obs int, t0 double, t1 double, mean array<double>")
    number = F.row_number().over(Window.partitionBy("video").orderBy("segment", "track_id")) - 1
    return own.select("video", number.cast("int").alias("track_id"), "n_obs", "t0", "t1", (F.col("t1") - F.col("t0")).alias("duration"), "mean")


def sampled(frames: DataFrame, interval: float = 0.5, key: str = "video") -> DataFrame:
    """The first frame (key, ts, ...) at or after each multiple of the interval, within it."""
    if interval <= 0:
        raise ValueError("the interval must be more than 0")
    slot = F.floor(F.col("ts") / interval)
    w = Window.partitionBy(key, "_slot").orderBy("ts")
    return frames.withColumn("_slot", slot).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_slot", "_r")


def first_frames(frames: DataFrame, count: int = 3, interval: float = 3.0, key: str = "video") -> DataFrame:
    """The first `count` frames of each video, one an interval."""
    w = Window.partitionBy(key).orderBy("ts")
    return sampled(frames, interval, key).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r")


def track_vectors(frames: DataFrame, interval: float = 0.5) -> DataFrame:
    """(video, track_id, v): one vector for each appearance; frames have detections, those without any are not there."""
    return track(sampled_frames(frames, interval)).select("video", "track_id", F.col("mean").alias("v"))


def sampled_frames(detections: DataFrame, interval: float = 0.5) -> DataFrame:
    """All detections of the frames that `sampled` keeps."""
    kept = sampled(detections.select("video", "ts").distinct(), interval)
    return detections.join(kept, ["video", "ts"], "left_semi")


def gap_sessions(events: DataFrame, key: str, ts: str, gap_seconds: float, then: str | None = None) -> DataFrame:
    """(key, session, n, t0, t1): runs without a gap of more than that; a gap of exactly that goes on.  then: what orders equal times."""
    w = Window.partitionBy(key).orderBy(ts, *([then] if then else []))
    at = F.unix_micros(ts)
    new = F.when(at - F.lag(at).over(w) > int(gap_seconds * 1e6), 1).otherwise(0)
    runs = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("t0"), F.max(ts).alias("t1"))
