"""Query of the media column operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .gif import media_digests


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as a GIF, read back and described."""
    return media_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op4_gif": op4_gif}
