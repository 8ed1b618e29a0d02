"""Operators for training-data pipelines, on documents and embeddings.

Nothing else of the library imports this subpackage.  Every operator module has
its own general interface and one query for __spark_entry__.py; where SQL can
express a query, its SQL is in `oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, embed_dedup, langid, license_scan, ngram_join, packing, quality_fm, substring_dedup, suffix_dedup, unigram
from .oracles import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            ann.op1_ann,
            langid.op2_langid,
            suffix_dedup.op3_suffix_dedup,
            packing.op4_packing,
            license_scan.op5_license_scan,
            quality_fm.op6_quality,
            embed_dedup.op7_embed_dedup,
            unigram.op8_unigram,
            ngram_join.op9_ngram_join,
            substring_dedup.op10_substring_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
