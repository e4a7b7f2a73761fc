"""A corpus from raw documents to token ids, in five stages; each is given what the one before it kept."""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm.bpe import encode_documents
from weft.llm.common import delete, made_since, n_made, table, written
from weft.llm.divergence import kept_documents
from weft.llm.mixing import mix
from weft.llm.simhash import first_of_near_copies
from weft.llm.substrings import remove_repeated

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


#: Tables that the stage before worked with, by application.
_left: dict[str, list[str]] = {}


def _stage(f: Callable) -> Callable:
    """A stage; its input has been written, so the tables that the stage before it worked with go first."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault(spark.sparkContext.applicationId, [])
        while left:
            delete(spark, left.pop())
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # lets Spark delete shuffle files that no plan holds
        n = n_made()
        out = f(spark, docs, sf_dir)
        left.extend(made_since(n))
        return out

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from their language go.

    Null and empty texts fail the base rules; a null language has a reference of its own. Repeated rows are judged each. An empty table stays empty; columns may have any names.
    """
    return kept_documents(docs)


@_stage
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of at least 0.8 of 5-word shingles) the document of the smallest id stays.

    A null id comes last, of equal ids any one row stays. Null and empty texts are one group. An empty table stays empty; columns may have any names.
    """
    return first_of_near_copies(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start at more than one place are cut out of the texts.

    All rows stay, those with null texts, null ids and repeated ones as well; ``n_chars`` is counted anew. An empty table stays empty; other columns may have any names.
    """
    return remove_repeated(docs)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed at weights 5, 2, 1 and at most 3 epochs: a document appears as often as it is taken.

    Null, empty and blank texts have no words and are not taken. A null source is a source; null and repeated ids are taken like others. An empty table stays empty; columns may have any names.
    """
    return mix(docs)


@_stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, token ``ids`` of the texts, and the bytes that they decode to.

    A null text has no ids. Rows are kept as they are, repeated ones and null ids included. An empty table stays empty; other columns are not read.
    """
    return encode_documents(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("suffix-array dedup", substring_dedup),
    ("mixing to target weights", mixing),
    ("byte-level BPE", byte_bpe),
]

#: The method's construction and traversal aren't expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it; what a stage has read goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        before, docs = docs, stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = written(docs, f"stage-{n}")
            if n > 1:
                delete(spark, before.written_to)
    return docs
