"""Query of the licence scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .licenses import inherit, scan

#: Documents of a folder.
FOLDER = 64


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all ``documents``, by their own notices or inherited.

    The table has no paths; a document's is source/language/folder/id, with runs of 64 ids as folders. A document with a line that is
    a notice and little else (cosine 0.9 or more), or that is a licence, stands for its folder, as a licence file would. Whole texts are compared with whole licences, lines with notices.
    """
    docs = table(spark, sf_dir, "documents")
    unknown = F.lit("unknown")
    path = F.concat_ws("/", F.coalesce("source", unknown), F.coalesce("lang", unknown), F.coalesce(F.floor(F.col("doc_id") / FOLDER).cast("string"), unknown), F.coalesce(F.col("doc_id").cast("string"), unknown))
    scanned = written(scan(docs.withColumn("path", path), "doc_id", "path", "text", whole_texts=True), "scanned")
    return inherit(scanned, F.coalesce(F.col("score") >= 0.9, F.lit(False))).withColumnRenamed("id", "doc_id")


QUERIES = {"op1_licenses": op1_licenses}
