"""Query of the token file operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import fresh_folder, table
from .token_files import read_token_digests, write_token_files


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as token files in the shared folder, and what these hold per document."""
    folder = fresh_folder(spark, "tokens")
    files = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return read_token_digests(spark, folder, files)


QUERIES = {"op6_token_files": op6_token_files}
