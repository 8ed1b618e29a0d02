"""Spark plumbing: the shared checkpoint folder, written tables, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES, _BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 25


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only in local mode, where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        path = tempfile.mkdtemp(prefix="kinvec-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinvec/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinvec_path = path
    _clean(spark)
    return out


def _clean(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished writes: it does so only once the driver has collected its garbage."""
    for _ in range(2):  # the last plan is let go of after the first time only
        gc.collect()  # handles of Python to what the driver holds
        spark._jvm.java.lang.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_kinvec_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns asked for, cast to fixed types, so that extra or clashing columns can't interfere.

    Rows of these operators are whole texts or sets of thousands of hashes, so
    Arrow batches of the default 10,000 rows would not be bounded memory, nor
    would 1,000 rows of very long texts.
    """
    if df.sparkSession.conf.get(_BATCH, "10000") == "10000":
        df.sparkSession.conf.set(_BATCH, "1000")
        df.sparkSession.conf.set(_BATCH_BYTES, str(_BYTES))
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


_KEPT: dict[tuple[str, str], object] = {}


def kept(owner: str, name: str, make: Callable[[], object]):
    """What `make` gives, kept in this worker process for later tasks of its owner; one thing for each owner."""
    if (owner, name) not in _KEPT:
        _let_go_of(lambda key: key[0] == owner)
        _KEPT[owner, name] = make()
    return _KEPT[owner, name]


def _let_go_of(which: Callable[[tuple[str, str]], bool]) -> None:
    for key in [key for key in _KEPT if which(key)]:
        del _KEPT[key]


def _begin(owner: str | None) -> None:
    _let_go_of(lambda key: key[0] != owner)


def _end() -> None:
    """Give freed memory back to the machine: worker processes live on and serve other operators."""
    text.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def task(each: Callable[[Iterable], Iterator], owner: str | None = None) -> Callable[[Iterable], Iterator]:
    """`each` for mapInArrow: only what its owner keeps stays in the worker, and freed memory is returned at the end."""

    def run(batches):
        _begin(owner)
        try:
            yield from each(batches)
        finally:
            _end()

    return run


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, component), component the smallest id.

    Every round moves each id to the least label among its neighbours and then to
    that label's own label, so paths shorten fast; ends when no label changes.
    Labels are written to the shared folder each round.  An id of very many edges
    is met by partial aggregation and by AQE's split of skewed joins.  Ids only
    appear when an edge has them; no edges, no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        step = step.join(up, "component", "left").select("id", "old", F.least("component", F.coalesce("up", "component")).alias("component"))
        step = written(step, f"{name}-labels")
        changed = step.where("old <> component").limit(1).count()
        dropped(labels)
        labels = step.select("id", "component")
        labels._kinvec_path = step._kinvec_path
        if not changed:
            dropped(both)
            return labels
