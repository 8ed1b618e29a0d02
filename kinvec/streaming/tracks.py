"""Tracking and sampling over a stream of detections.

The state of a video is its open tracks.  A track that no detection has met for
longer than the gap, by event time, is given out and leaves the state, so state is
bounded by what is in sight.  Detections are taken in the order of their time
within a micro-batch; those older than the watermark are dropped by Spark.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import MAX_GAP, Tracker, mean_vector

TRACKS = "video string, track_id int, n_obs int, t0 double, t1 double, duration double, mean array<double>"


def _rows(video: str, done: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({"video": video, "track_id": [t["id"] for t in done], "n_obs": [t["n"] for t in done], "t0": [t["t0"] for t in done], "t1": [t["t1"] for t in done], "duration": [t["t1"] - t["t0"] for t in done], "mean": [list(mean_vector(t["sum"])) for t in done]})


def tracks(detections: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """The closed tracks of a stream (video, at timestamp, det_idx, x, y, width, height, embedding), as they close.

    Append mode.  A track closes when a frame comes more than the gap after its
    last one, or when the watermark has passed that point.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (video,) = key
        tracker = Tracker()
        if state.exists:
            tracker = pickle.loads(state.get[0])
        if state.hasTimedOut:
            tracker.closed, tracker.open = tracker.closed + tracker.open, []
        else:
            batch = pd.concat(list(frames))
            batch = batch.assign(ts=batch["at"].astype("int64") / 1e9 if str(batch["at"].dtype).endswith("ns]") else batch["at"].astype("datetime64[ns]").astype("int64") / 1e9)
            for ts, frame in batch.sort_values(["ts", "det_idx"], kind="stable").groupby("ts", sort=False):
                tracker.frame(float(ts), [((r.x, r.y, r.width, r.height), np.asarray(r.embedding, dtype=np.float64)) for r in frame.itertuples()])
        done, tracker.closed = sorted(tracker.closed, key=lambda t: t["id"]), []
        state.update((pickle.dumps(tracker),))
        if tracker.open:
            last = max(t["t1"] for t in tracker.open) + MAX_GAP
            state.setTimeoutTimestamp(max(int(last * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield _rows(video, done)

    own = detections.withWatermark("at", lateness)
    return own.groupBy("video").applyInPandasWithState(follow, TRACKS, "tracker binary", "append", GroupStateTimeout.EventTimeTimeout)


def sampled(frames: DataFrame, interval: str = "500 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """(video, at, frame): the first frame (video, at, frame) of each interval, once the watermark has passed it."""
    own = frames.withWatermark("at", lateness).groupBy("video", F.window("at", interval))
    return own.agg(F.min(F.struct("at", "frame")).alias("first")).select("video", "first.at", "first.frame")
