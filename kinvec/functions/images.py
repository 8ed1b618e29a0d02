"""Pictures as arrays: decoding, sharpness, cropping and aligning.

Uncompressed and losslessly packed formats are read here (PNG without
interlacing, PGM and PPM, 24-bit BMP); others raise, as do damaged files.
Pixels are 8 bits, blue, green, red.  Columns are decoded in Arrow batches of few
rows, in memory; nothing is written to a file.
"""

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 112
PICTURE = "struct<width:int,height:int,pixels:binary>"


def decode(raw: bytes) -> np.ndarray:
    """height x width x 3 (blue, green, red); what is no picture raises ValueError."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw[:2] in (b"P5", b"P6"):
            return _pnm(raw)
        if raw[:2] == b"BM":
            return _bmp(raw)
    except (IndexError, struct.error, zlib.error, ValueError) as e:
        raise ValueError(f"the picture can't be decoded: {e}") from e
    raise ValueError("the picture can't be decoded: unknown format")


def _pnm(raw: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    w, h, most = fields
    if most != 255:
        raise ValueError("only 8 bits a sample")
    planes = 3 if raw[:2] == b"P6" else 1
    own = np.frombuffer(raw, np.uint8, w * h * planes, at + 1).reshape(h, w, planes)
    return np.ascontiguousarray(np.repeat(own, 3, axis=2) if planes == 1 else own[:, :, ::-1])


def _bmp(raw: bytes) -> np.ndarray:
    start, w, h, depth, packed = *struct.unpack_from("<I", raw, 10), *struct.unpack_from("<ii", raw, 18), *struct.unpack_from("<HI", raw, 28)
    if depth != 24 or packed:
        raise ValueError("only 24 bits a pixel, not packed")
    stride = (w * 3 + 3) // 4 * 4
    own = np.frombuffer(raw, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * 3].reshape(abs(h), w, 3)
    return np.ascontiguousarray(own[::-1] if h > 0 else own)


def _png(raw: bytes) -> np.ndarray:
    at, body, palette = 8, b"", None
    while at < len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        data = raw[at + 8 : at + 8 + n]
        if len(data) < n:
            raise ValueError("cut short")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += data
        elif kind == b"IEND":
            break
        at += n + 12
    if depth != 8 or interlaced:
        raise ValueError("only 8 bits a sample, not interlaced")
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * planes)
    out = np.zeros((h + 1, w + 1, planes), np.uint8)  # a line above and a pixel to the left of zeros
    for y in range(h):
        rule, own = lines[y, 0], lines[y, 1:].reshape(w, planes)
        up = out[y, 1:]
        if rule == 0:
            out[y + 1, 1:] = own
        elif rule == 1:
            out[y + 1, 1:] = np.cumsum(own, axis=0, dtype=np.uint8)
        elif rule == 2:
            out[y + 1, 1:] = own + up
        elif rule in (3, 4):
            for x in range(w):
                a, b, c = out[y + 1, x].astype(int), up[x].astype(int), out[y, x].astype(int)
                if rule == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                out[y + 1, x + 1] = (own[x] + guess) & 255
        else:
            raise ValueError("unknown line filter")
    own = out[1:, 1:]
    if colour == 3:
        own = palette[own[:, :, 0]]
    elif planes < 3:
        own = np.repeat(own[:, :, :1], 3, axis=2)
    return np.ascontiguousarray(own[:, :, 2::-1])


def grey(picture: np.ndarray) -> np.ndarray:
    """Luma in whole numbers."""
    b, g, r = (picture[:, :, i].astype(np.float64) for i in range(3))
    return np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5)


def sharpness(picture: np.ndarray) -> float:
    """The variance of the Laplacian of the grey picture, mirrored at its edges."""
    g = np.pad(grey(picture), 1, mode="reflect") if min(picture.shape[:2]) > 1 else np.pad(grey(picture), 1, mode="edge")
    edges = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(edges.var())


def warped(picture: np.ndarray, matrix: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The picture under a 2 x 3 matrix, between pixels by their weights; zeros outside."""
    m = np.vstack([np.asarray(matrix, float).reshape(2, 3), [0, 0, 1]])
    y, x = np.mgrid[:size, :size]
    sx, sy, _ = np.linalg.inv(m) @ np.stack([x.ravel(), y.ravel(), np.ones(size * size)])
    h, w = picture.shape[:2]
    own = np.pad(picture.astype(np.float64), ((1, 2), (1, 2), (0, 0)))
    sx, sy = np.clip(sx, -1, w) + 1, np.clip(sy, -1, h) + 1
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[:, None], (sy - y0)[:, None]
    out = (own[y0, x0] * (1 - fx) + own[y0, x0 + 1] * fx) * (1 - fy) + (own[y0 + 1, x0] * (1 - fx) + own[y0 + 1, x0 + 1] * fx) * fy
    return np.rint(out).astype(np.uint8).reshape(size, size, 3)


def unpacked(p: dict) -> np.ndarray:
    return np.frombuffer(p["pixels"], np.uint8).reshape(p["height"], p["width"], 3)


def _packed(x: np.ndarray) -> dict:
    return {"width": x.shape[1], "height": x.shape[0], "pixels": x.tobytes()}


def _decoded(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_packed(decode(bytes(x))) if x is not None else {"width": None, "height": None, "pixels": None} for x in raw], columns=["width", "height", "pixels"])


def _sharp(picture: pd.DataFrame, crop: pd.DataFrame) -> pd.Series:
    out = []
    for p, c in zip(picture.to_dict("records"), crop.to_dict("records"), strict=True):
        out.append(None if p["pixels"] is None else sharpness(unpacked(p)[int(c["y0"]) : int(c["y1"]), int(c["x0"]) : int(c["x1"])]))
    return pd.Series(out, dtype="float64")


def _aligned(picture: pd.DataFrame, matrix: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_packed(warped(unpacked(p), np.asarray(m))) for p, m in zip(picture.to_dict("records"), matrix, strict=True)], columns=["width", "height", "pixels"])


def decoded(raw: Column) -> Column:
    """struct(width, height, pixels) of a column of file contents; null has null fields."""
    return F.pandas_udf(_decoded, PICTURE)(raw)


def sharpness_of(picture: Column, crop: Column) -> Column:
    """The sharpness of a decoded picture within a crop."""
    return F.pandas_udf(_sharp, "double")(picture, crop)


def aligned(picture: Column, matrix: Column) -> Column:
    """The picture under a matrix of `geometry.similarity`, 112 x 112."""
    return F.pandas_udf(_aligned, PICTURE)(picture, matrix)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, picture) of the files under a path; a missing path, or a file that is no picture, raises."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", decoded(F.col("content")).alias("picture"))
