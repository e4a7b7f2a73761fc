"""Query of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import mixed_sizes, oracle


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed at weights 5, 2, 1 and at most 3 epochs."""
    return mixed_sizes(table(spark, sf_dir, "documents"))


QUERIES = {"op3_mixing": op3_mixing}
ORACLE_SQL = {"op3_mixing": oracle()}
