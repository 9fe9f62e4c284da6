"""Tables, ids and stores, as all operators of this subpackage use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnsieve.storage import discard, new_folder, scratch, written  # noqa: F401  the operators take them from here


def text_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Bytes that a Python worker gets at once, where the session has set no number: Spark's default of 64 MB
    of whole texts takes that much in the worker and again beside the executor's heap.  The queries of this
    subpackage call it for their session; the operators themselves change no settings."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, most_bytes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id, as long, and the whole text, under the names that the operators use."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def store(uri: str):
    """(file system, path) of a URI, for files that Spark's writers can't make."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def with_row_key(documents: DataFrame, name: str, most_broadcast: int = 1_000_000) -> DataFrame:
    """documents and a long of its own for each row, whatever its id: its file's number and its place there, so
    that a repeated scan gives the same.  Other than a plain table of files is written first."""
    if documents._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or "_metadata" in map(str.lower, documents.columns):
        documents = written(documents, "rows")
    path, index, number = (f"{name}_{part}" for part in ("path", "index", "file"))
    at = documents.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
    # a row for each file
    files = at.select(path).distinct().select(path, F.row_number().over(Window.orderBy(path)).cast("long").alias(number))
    files = written(files, "files")
    if files.count() <= most_broadcast:
        files = F.broadcast(files)
    return at.join(files, path).select(*(F.col(f"`{c}`") for c in documents.columns), (F.shiftleft(number, 40) + F.col(index)).alias(name))


def without(documents: DataFrame, removed: DataFrame, key: str, most_broadcast: int = 1_000_000) -> DataFrame:
    """documents but for those whose key is in `removed` (a column of the same name); a row without a key stays.

    Up to `most_broadcast` keys (8 bytes each) are counted and broadcast, so texts aren't shuffled;
    more are joined by a shuffle.
    """
    keys = written(removed.select(key).where(F.col(key).isNotNull()).distinct(), "removed")
    if keys.count() <= most_broadcast:
        keys = F.broadcast(keys)
    return documents.join(keys, key, "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))
