"""Query of the language-model scoring operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ngram import score

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def good(labels: DataFrame) -> DataFrame:
    """Ids that any label calls of good quality and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored, each without its own counts; the target are those that ``labels`` calls good, the background is all; trigrams of the whole vocabulary."""
    docs, targets = table(spark, sf_dir, "documents"), good(table(spark, sf_dir, "labels"))
    return score(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, order=3, targets=targets, leave_out=True)


QUERIES = {"op5_cross_entropy": op5_cross_entropy}
