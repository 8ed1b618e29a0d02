"""The stages on rows with null and repeated doc_ids."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
RNG = random.Random(11)


def prose(n):
    return " ".join("".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(n))


A, B, C, D, E, P = (prose(80) for _ in range(6))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "aa", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_near_copies_and_repeated_strings_keep_one_of_equal_rows(spark):
    docs = frame(spark, [(5, A), (5, A), (9, A), (7, B), (7, C), (None, D), (None, D), (None, E), (3, ""), (4, None), (None, A)])
    want = Counter([(5, A), (7, B), (7, C), (None, D), (None, E), (3, ""), (4, None)])
    kept = corpus_pipeline.near_copies(spark, docs, SF)
    assert kept.columns == docs.columns and rows_of(kept) == want
    assert rows_of(corpus_pipeline.repeated_strings(spark, frame(spark, list(want)), SF)) == want
    assert corpus_pipeline.near_copies(spark, docs.where("false"), SF).count() == 0


def test_repeated_strings_cuts_each_row_by_itself(spark):
    # a shared blank would make the repeated string longer than P
    docs = frame(spark, [(7, P + "1" + B), (7, P + "2" + C), (None, P + "3" + D), (1, E)])
    want = Counter([(7, "1" + B), (7, "2" + C), (None, "3" + D), (1, E)])
    assert rows_of(corpus_pipeline.repeated_strings(spark, docs, SF)) == want


def test_a_null_id_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = docs.union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    for stage in (corpus_pipeline.language_id, corpus_pipeline.quality):
        got = stage(spark, both, SF).select("doc_id", "text").collect()
        own, none = Counter(r["text"] for r in got if r["doc_id"] is not None), Counter(r["text"] for r in got if r["doc_id"] is None)
        assert own and own == none
