"""Vector columns shared by the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def kind_of(embeddings: DataFrame) -> str:
    """The type in which components are kept: their own where that is float or double, else double."""
    own = embeddings.schema["embedding"].dataType
    return own.simpleString() if own.simpleString() in ("array<float>", "array<double>") else "array<double>"


def read(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (as text, whatever its type), v (null where it is not usable), of the original components."""
    kind = kind_of(embeddings)
    out = runtime.plain(embeddings, vec_id="long", label="string", embedding=kind)
    zero = F.lit(0.0).cast(kind[6:-1])
    # -0.0 becomes 0.0, so that equal vectors are equal in every hash
    return out.select("vec_id", "label", F.when(usable(F.col("embedding")), F.transform("embedding", lambda x: x + zero)).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of one length as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths, by way of their largest component, so that none overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, initial=0, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def dimension(rows: DataFrame) -> int | None:
    """The commonest length of v (the shorter on a tie); None without rows."""
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return top[0]["d"] if top else None
