"""Staged candidate pruning: size, then partial hash, then full hash.

A stage keeps rows whose key occurs at least twice.  Keys are counted with map-side aggregation and
joined back by a semi join on the key; only keys and the row's own columns move, and a key that a
large share of the rows has is split by the adaptive skew join.  (A count over a window would save an
exchange but put all rows of a key into one task.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def repeated(rows: DataFrame, *keys: str, plan: str = "join") -> DataFrame:
    """Rows whose keys, none of them null, occur more than once.  plan: join, or window for comparison."""
    some = rows.dropna(subset=list(keys))
    if plan == "window":
        return some.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")
    often = some.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return some.join(often, list(keys), "left_semi")


def size_candidates(files: DataFrame, plan: str = "join") -> DataFrame:
    """Files that share their size with another; only they can be copies."""
    return repeated(files, "size", plan=plan)


def partial_candidates(files: DataFrame, plan: str = "join") -> DataFrame:
    """Files that share size and partial hash with another; only they need a full hash."""
    return repeated(files, "size", "partial_hash", plan=plan)


def missing_partial(catalog: DataFrame) -> DataFrame:
    """(path, size) of the files whose partial hash is still to be computed."""
    return size_candidates(catalog.select("path", "size", "partial_hash")).where(F.col("partial_hash").isNull()).select("path", "size")


def missing_full(catalog: DataFrame) -> DataFrame:
    """(path, size) of the files whose full hash is still to be computed."""
    return partial_candidates(catalog.select("path", "size", "partial_hash", "full_hash")).where(F.col("full_hash").isNull()).select("path", "size")


def group_keys(catalog: DataFrame) -> DataFrame:
    """Full hashes that two files or more have."""
    return catalog.where(F.col("full_hash").isNotNull()).groupBy("full_hash").agg(F.count("*").alias("n")).where("n > 1")
