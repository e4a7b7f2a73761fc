"""Query of the HTML extraction operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .html_text import extract


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page of ``pages``."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html": op9_html}
