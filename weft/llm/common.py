"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code units that separate words: space and U+0009 to U+000D, which is also what
#: ``bytes.split()`` separates at.
SPACES = b" \t\n\r\x0b\x0c"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small in rows and bytes, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def map_batches(
    df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def gathered(batches: Iterator[pa.RecordBatch], size: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in larger ones, of about ``size`` bytes but for a batch that has more; without empty ones."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if held and total + batch.nbytes > size:
            yield pa.concat_batches(held)
            held, total = [], 0
        if batch.num_rows:
            held.append(batch)
            total += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset
    on a single machine, as in tests, a folder of this session's own. A cluster without the setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session has ended; its folder goes with it
            return


atexit.register(_clean)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted as the driver ends."""
    path = f"{shared_folder(spark)}/weft-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def made_since(n: int) -> list[str]:
    """Paths of the tables that were written after the first ``n``."""
    return [path for _, path in _written[n:]]


def n_made() -> int:
    return len(_written)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: ``df`` written as Parquet in the shared folder and read back.

    A lost executor costs only the tasks that it ran; files of finished stages stay.
    """
    path = fresh_folder(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    found = df.sparkSession.read.schema(schema).parquet(path)
    found.written_to = path
    return found


def drop(found: DataFrame) -> None:
    """Deletes a table of :func:`written` that nothing reads any more, and lets Spark delete shuffle files that no plan holds."""
    delete(found.sparkSession, found.written_to)
    gc.collect()
    found.sparkSession.sparkContext._jvm.System.gc()


def column_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores in front until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def row_of(df: DataFrame) -> Column:
    """A row's columns as a struct, to be carried along whatever their names."""
    return F.struct(*(df[f"`{c}`"] for c in df.columns))


# --- rows by their place ---------------------------------------------------------------------------------------

#: Rows of a file whose side rows are read together, as a power of two.
_RUN = 14


def open_store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder, as a task opens it, and the folder's path there."""
    if "://" not in folder:
        folder = f"file://{os.path.abspath(folder.removeprefix('file:'))}"
    scheme, rest = folder.split("://", 1)
    return pyarrow.fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def with_places(docs: DataFrame) -> DataFrame:
    """Rows as ``file`` (a hash of its path), ``at`` (the row's number in it) and ``doc``, all columns in a struct.

    Both are the same however often and in whatever splits the files are read. A DataFrame that isn't a plain scan of Parquet files is
    written first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = written(docs, "placed")
    about = docs.metadataColumn("_metadata")
    return docs.select(F.xxhash64(about["file_path"]).alias("file"), about["row_index"].alias("at"), row_of(docs).alias("doc"))


class Side:
    """A table of rows that belong to places, for tasks that scan these places: no document is shuffled to meet them.

    It is dealt into folders by runs of 16,384 rows of a file and sorted. A task reads what belongs to a run as it comes to it, so what it
    holds is bounded by the run.
    """

    def __init__(self, rows: DataFrame, name: str, n: int):
        """``rows`` has ``file``, ``at`` and more; ``n``, about how many there are, decides on the number of folders."""
        self.spread = min(1 << 16, max(64, n >> 18))
        self.path = fresh_folder(rows.sparkSession, name)
        self.names = rows.columns
        self.kinds = None
        folder = F.pmod(F.col("file").bitwiseXOR(F.shiftright("at", _RUN)), F.lit(self.spread)).cast("int")
        dealt = rows.withColumn("folder", folder).repartition("folder", "file", F.shiftright("at", _RUN))
        dealt.sortWithinPartitions("folder", "file", "at").write.partitionBy("folder").parquet(self.path)

    def _of(self, file: int, run: int) -> pa.Table | None:
        fs, root = open_store(self.path)
        where = f"{root}/folder={(file ^ run) % self.spread}"
        if fs.get_file_info(where).type == pyarrow.fs.FileType.NotFound:
            return None
        at = pyarrow.dataset.field("at")
        mine = (pyarrow.dataset.field("file") == file) & (at >= run << _RUN) & (at < run + 1 << _RUN)
        found = pyarrow.dataset.dataset(where, filesystem=fs, format="parquet").to_table(columns=self.names, filter=mine)
        return found.sort_by("at") if len(found) else None

    def beside(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Table | None, np.ndarray, np.ndarray]]:
        """Batches that begin with ``file`` and ``at``, in parts of one run each, the run's side rows, and from where to where in them those of each row lie."""
        key, side, places = None, None, np.empty(0, np.int64)
        for batch in batches:
            file, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            run = at >> _RUN
            edges = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (run[1:] != run[:-1]), [True]])) if len(at) else np.zeros(1, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if key != (int(file[a]), int(run[a])):
                    key = (int(file[a]), int(run[a]))
                    side = self._of(*key)
                    places = np.empty(0, np.int64) if side is None else side.column("at").to_numpy()
                yield batch.slice(a, b - a), side, np.searchsorted(places, at[a:b], "left"), np.searchsorted(places, at[a:b], "right")


def without_places(placed: DataFrame, gone: Side) -> DataFrame:
    """The documents of :func:`with_places` whose place has no row in ``gone``, with their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, lo, hi in gone.beside(batches):
            yield batch.select([2]).filter(pa.array(lo == hi))

    return map_batches(placed, run, T.StructType([placed.schema["doc"]])).select("doc.*")
