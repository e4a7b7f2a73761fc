"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .divergence import judged, oracle


def op8_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every whole text of ``documents``."""
    return judged(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


QUERIES = {"op8_divergence": op8_divergence}
ORACLE_SQL = {"op8_divergence": oracle()}
