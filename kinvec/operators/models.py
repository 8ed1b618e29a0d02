"""Vision models as plug-ins (S13, S14, V7, V10-V12): pictures in, detections and vectors out.

A detector gives, for one picture, rows (x, y, width, height, score, ten numbers
of the five points); an embedder gives a vector for an aligned picture.  Both are
made once for a Python worker by a function that is sent to it, so a model file is
read there from a path that all executors see.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, images

Detector = Callable[[np.ndarray], list[tuple]]
Embedder = Callable[[np.ndarray], np.ndarray]
_BOX = "struct<x:double,y:double,width:double,height:double>"
_POINTS = "struct<" + ",".join(f"{p}:struct<x:double,y:double>" for p in geometry.POINTS) + ">"


class OnnxModel:
    """A model file under onnxruntime; a missing file raises before anything is loaded."""

    def __init__(self, path: str, threads: int = 1):
        if not os.path.isfile(path):
            raise FileNotFoundError(f"model file {path} is missing")
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads
        self._session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])

    def run(self, x: np.ndarray) -> list[np.ndarray]:
        """All outputs for one input."""
        return self._session.run(None, {self._session.get_inputs()[0].name: x})


def arcface(path: str) -> Embedder:
    """An embedder from a model that takes 1 x 3 x 112 x 112 with (pixel - 127.5) / 127.5, red first."""
    model = OnnxModel(path)
    return lambda picture: model.run(((picture[:, :, ::-1].astype(np.float32) - 127.5) / 127.5).transpose(2, 0, 1)[None])[0].ravel()


def detect(pictures: DataFrame, make: Callable[[], Detector], key: str = "image_id", overlap: float = 0.3, top: int = 50) -> DataFrame:
    """(key, image_width, image_height, det_idx, score, box, points): the detections of each picture (key, picture) left after suppression.

    A picture without any has no row.
    """
    kind = pictures.schema[key].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = make()
        for batch in batches:
            rows = []
            for k, p in zip(batch[key], batch["picture"], strict=True):
                p = p if isinstance(p, dict) else p.asDict()
                for i, (x, y, w, h, score, *points) in enumerate(found(images.unpacked(p))):
                    own = {n: {"x": float(points[2 * j]), "y": float(points[2 * j + 1])} for j, n in enumerate(geometry.POINTS)}
                    rows.append((k, p["width"], p["height"], i, float(score), {"x": float(x), "y": float(y), "width": float(w), "height": float(h)}, own))
            yield pd.DataFrame(rows, columns=[key, "image_width", "image_height", "det_idx", "score", "box", "points"])

    schema = f"{key} {kind}, image_width int, image_height int, det_idx int, score double, box {_BOX}, points {_POINTS}"
    return geometry.suppressed(pictures.select(key, "picture").mapInPandas(each, schema), key, overlap, top)


def embed(aligned: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """aligned (face) with `embedding` in place of the picture: the model's vector, normalised; a zero vector raises."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            out = []
            for p in batch["face"]:
                p = p if isinstance(p, dict) else p.asDict()
                v = np.asarray(model(images.unpacked(p)), dtype=np.float64)
                length = float(np.sqrt((v * v).sum()))
                if length <= 1e-12:
                    raise ValueError("a zero vector can't be normalised")
                out.append(list(v / length))
            yield batch.drop(columns=["face"]).assign(embedding=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name != "face")
    return aligned.mapInPandas(each, f"{kinds}, embedding array<double>")


def detect_and_embed(pictures: DataFrame, detector: Callable[[], Detector], embedder: Callable[[], Embedder], key: str = "image_id", choose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The detections of each picture (all, or those that `choose` leaves) with their vectors."""
    found = detect(pictures, detector, key)
    found = found if choose is None else choose(found)
    both = found.join(pictures.select(key, "picture"), key)
    face = images.aligned(F.col("picture"), geometry.similarity(geometry.landmark_array(F.col("points"))))
    return embed(both.withColumn("face", face).drop("picture"), embedder)
