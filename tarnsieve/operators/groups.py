"""Exact-duplicate groups: totals, members, order and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsieve.functions.display import group_header
from tarnsieve.functions.names import matches

from tarnsieve.storage import written

from .candidates import repeated
from .positions import numbered_within


def duplicates(catalog: DataFrame) -> DataFrame:
    """The files of all groups: those whose full hash another file has too."""
    return repeated(catalog, "full_hash")


def group_totals(catalog: DataFrame) -> DataFrame:
    """Per group: n files, rep (size of its first file by path), total bytes and wasted, the bytes that
    removing all but one would free."""
    known = catalog.where(F.col("full_hash").isNotNull())
    totals = known.groupBy("full_hash").agg(F.count("*").alias("n"), F.min_by("size", "path").alias("rep"), F.sum("size").alias("total")).where("n > 1")
    return totals.withColumn("wasted", F.col("rep") * (F.col("n") - 1))


def reclaimable(catalog: DataFrame) -> DataFrame:
    return group_totals(catalog).agg(F.coalesce(F.sum("wasted"), F.lit(0)).cast("long").alias("reclaimable"))


def pages(catalog: DataFrame, size: int = 1000) -> DataFrame:
    """Groups page by page: a row for each `size` files of a group, with full_hash, page (from 0), the group's n files,
    total bytes and header, and files, an array of the page's files by path.  Largest group first.

    Places come from a range exchange, so a group of any size is spread over tasks and no row holds more than a page.
    """
    dups = written(duplicates(catalog), "members")
    columns = [c for c in catalog.columns if c not in ("path", "full_hash")]
    placed = numbered_within(dups, "full_hash", [F.col("path")], "_place").withColumn("page", F.floor((F.col("_place") - 1) / size).cast("long"))
    held = placed.groupBy("full_hash", "page").agg(F.array_sort(F.collect_list(F.struct("path", *columns))).alias("files"))
    totals = dups.groupBy("full_hash").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min_by("size", "path").alias("_rep"))
    headed = totals.select("full_hash", "n", "total", group_header(F.col("n"), F.col("_rep")).alias("header"))
    return held.join(headed, "full_hash").select("full_hash", "page", "n", "total", "header", "files").orderBy(F.desc("total"), "full_hash", "page")


def summary(catalog: DataFrame, root: str, removed: int = 0) -> DataFrame:
    """The one row that a scan ends with."""
    files = catalog.where(F.col("root") == root)
    counts = files.groupBy("full_hash").agg(F.count("*").alias("n"))
    grouped = F.count_if(F.col("full_hash").isNotNull() & (F.col("n") > 1))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_files"), grouped.cast("long").alias("exact_group_count"))
    return totals.select(F.lit(root).alias("root"), "total_files", F.lit(removed).cast("long").alias("removed"), "exact_group_count", F.lit(False).alias("cancelled"))


def search(dups: DataFrame, query: str) -> DataFrame:
    """Files of groups whose name or path holds the query."""
    return dups.where(matches(query, F.col("name"), F.col("path")))


def visibility(dups: DataFrame, query: str) -> DataFrame:
    """Each file with hit, and group_visible: whether any file of its group is a hit."""
    hit = dups.withColumn("hit", matches(query, F.col("name"), F.col("path")))
    shown = hit.where("hit").select("full_hash").distinct().withColumn("group_visible", F.lit(True))
    return hit.join(shown, "full_hash", "left").withColumn("group_visible", F.coalesce("group_visible", F.lit(False)))
