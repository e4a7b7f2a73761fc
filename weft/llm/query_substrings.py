"""Query of the repeated substring operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .substrings import substring_digests


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without strings of 200 bytes that start anywhere else."""
    return substring_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op2_substrings": op2_substrings}
