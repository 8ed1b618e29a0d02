"""A corpus pipeline: language ID, quality, near copies, repeated strings, packing.

STAGES are applied in order to `documents`; each gets what its predecessor kept,
written as Parquet and read again, and all but the last return the columns of
documents.  Rows are told apart by all their columns (a 64-bit hash), so a null or
repeated doc_id loses nothing; rows equal in all columns share every decision, and
near_copies reduces them to one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinvec.llm import langid, ngram_join, packing, quality_fm, runtime, suffix_dedup


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _row: a hash of all columns and of which of them are null."""
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in docs.columns])
    return docs.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], nulls))


def _by_row(docs: DataFrame) -> DataFrame:
    """docs with _row as doc_id, for the operators."""
    return _keyed(docs).withColumn("doc_id", F.col("_row")).drop("_row")


def _kept(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose _row is a doc_id in rows, all columns and _row."""
    return _keyed(docs).join(rows.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    own = runtime.plain(docs, doc_id="long", text="string", lang="string")
    return _kept(docs, langid.identify(_by_row(docs), langid.fit(own)).where("not rejected")).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold."""
    own = quality_fm.with_metadata(docs)
    machine = quality_fm.fit(own, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, quality_fm.score(quality_fm.with_metadata(_by_row(docs)), machine).where("predicted = 1")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of least doc_id (null last); of equal rows one."""
    found = ngram_join.join(_by_row(docs)).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    ids = _keyed(docs).select("_row", "doc_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least")
    first = ids.join(found, "_row").groupBy("component_id").agg(least).select(F.col("least._row").alias("doc_id"))
    return _kept(docs, first).dropDuplicates(["_row"]).select(docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur elsewhere too; letters cut in two go as well; emptied texts go."""
    found = suffix_dedup.dedup(_by_row(docs)).where("n_bytes = 0 or n_removed < n_bytes")

    def readable(batches):
        for batch in batches:
            kept = [None if x is None else x.decode("utf-8", "ignore") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["_row", "_cut"])

    kept = F.when(F.col("n_removed") > 0, F.col("kept")).alias("kept")
    cut = found.select("doc_id", kept).mapInArrow(runtime.task(readable), "_row long, _cut string").dropDuplicates(["_row"])
    out = _keyed(docs).join(cut, "_row").withColumn("text", F.coalesce("_cut", "text"))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the texts that are left, in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("packing", pack),
]

#: Learned models, a tokenizer and components: no SQL; tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = runtime.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
