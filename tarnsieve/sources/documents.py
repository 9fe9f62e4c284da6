"""A table of documents read as files: a row is a file, its text the content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve import schema
from tarnsieve.functions.hashing import digest, partial_bytes
from tarnsieve.functions.names import extension
from tarnsieve.storage import written

# The extensions that ids get in turn.
_EXTENSIONS = (".txt", ".PDF", ".jpg", ".mp4", ".docx", ".log", ".csv")


def _hashes(window: int, kind: str) -> list[Column]:
    return [digest(partial_bytes(F.col("text"), window), kind).alias("ph"), digest(F.encode("text", "UTF-8"), kind).alias("fh")]


def document_files(spark: SparkSession, sf_dir: str, hashes: bool = False, window: int = 256, kind: str = "md5", content: bool = False) -> DataFrame:
    """doc_id and the columns of an observed file; with `hashes` also partial (ph) and full hash (fh)
    of the text, with `content` the text, so texts are read only where they are asked for."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    suffix = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % len(_EXTENSIONS) + 1).cast("int"))
    files = docs.select(
        "doc_id",
        F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang").alias("dir"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), suffix).alias("name"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(1700000000.0) + F.col("doc_id") * F.lit(60.5)).alias("mtime"),
        *(_hashes(window, kind) if hashes else []),
        *(["text"] if content else []),
    )
    typed = files.withColumns({"path": F.concat("dir", F.lit("/"), "name"), "ext": extension(F.col("name"))})
    return typed.withColumn("category", schema.category(F.col("ext"))).where(F.col("category").isNotNull())


def copy_candidates(spark: SparkSession, sf_dir: str, window: int = 256, kind: str = "md5", most_broadcast: int = 1_000_000) -> DataFrame:
    """The files that share their size with another, with both hashes, written once.  Sizes are pruned
    first, and only the texts that are left are hashed.  Up to `most_broadcast` sizes (8 bytes each) are
    broadcast, so no text is shuffled."""
    sizes = document_files(spark, sf_dir).groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    sizes = written(sizes, "repeated-sizes")
    if sizes.count() <= most_broadcast:
        sizes = F.broadcast(sizes)
    files = document_files(spark, sf_dir, content=True).join(sizes, "size", "left_semi")
    return written(files.select(*[c for c in files.columns if c != "text"], *_hashes(window, kind)), "copy-candidates")
