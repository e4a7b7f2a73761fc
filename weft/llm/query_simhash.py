"""Query of the SimHash operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .simhash import near_duplicates


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: 3-word shingles, fingerprints linked at 2 or fewer differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, budget=2)


QUERIES = {"op7_simhash": op7_simhash}
