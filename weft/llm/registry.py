"""Queries of this subpackage and, where SQL can express one, the DuckDB SQL it is held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Each module has QUERIES (name to function) and may have ORACLE_SQL (name to SQL).
MODULES = [
    "query_licenses", "query_substrings", "query_mixing", "query_gif", "query_ngram", "query_token_files", "query_simhash", "query_divergence", "query_html", "query_bpe",
]


def _modules() -> list:
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict[str, Query]:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _modules() for name, q in getattr(m, "ORACLE_SQL", {}).items()}
