"""Incremental maintenance: one scan's observations merged into the previous snapshot.

A merge is a join of two tables by path and makes the next snapshot; nothing is updated in place, and
no row is marked and swept: what was not observed below the scanned root is what an anti join gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsieve import schema


def last_wins(rows: DataFrame, seq: str = "seq", key: str = "path") -> DataFrame:
    """Of the rows that share a key, the one with the highest seq."""
    columns = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("_row"))
    return newest.select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in rows.columns])


def observed(previous: DataFrame, seen: DataFrame) -> DataFrame:
    """The observed rows, each with the hashes and error of the previous one of its path if size and
    mtime are unchanged; is_new tells paths that the catalog didn't have."""
    old = previous.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), *[F.col(c).alias(f"_{c}") for c in ("partial_hash", "full_hash", "error") if c in previous.columns], F.lit(True).alias("_known"))
    joined = seen.join(old, "path", "left")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    carried = [F.when(same, F.col(f"_{c}")).alias(c) for c in ("partial_hash", "full_hash", "error") if c in previous.columns]
    return joined.select(*seen.columns, *carried, F.col("_known").isNull().alias("is_new"))


def swept(previous: DataFrame, seen: DataFrame, root: str | None = None) -> DataFrame:
    """Rows of the root that weren't observed any more."""
    rows = previous if root is None else previous.where(F.col("root") == root)
    return rows.join(seen.select("path"), "path", "left_anti")


def new_rows(previous: DataFrame, seen: DataFrame) -> DataFrame:
    return seen.join(previous.select("path"), "path", "left_anti")


def merge_scan(previous: DataFrame, seen: DataFrame, root: str) -> DataFrame:
    """The next snapshot after a finished scan of `root`: its observed rows, owned by this root from now
    on, and the rows of other roots at other paths.  An empty scan empties the root."""
    now = observed(previous, seen).withColumn("root", F.lit(root))
    others = previous.where(F.col("root") != root).join(seen.select("path"), "path", "left_anti")
    names = [f.name for f in schema.CATALOG]
    return now.select(*names).unionByName(others.select(*names))


def changes(previous: DataFrame, seen: DataFrame, root: str) -> DataFrame:
    """The rows of merge_scan's result for `seen` that aren't in `previous` as they are, with `was_root`, the root that
    had the path before (null: none)."""
    names = [f.name for f in schema.CATALOG]
    old = previous.select("path", *[F.col(c).alias(f"_{c}") for c in names if c != "path"], F.lit(True).alias("_known"))
    joined = seen.join(old, "path", "left").withColumn("root", F.lit(root))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    kept = ("partial_hash", "full_hash", "error")
    row = joined.withColumns({c: F.when(same, F.col(f"_{c}")) for c in kept})
    alike = F.col("_known").isNotNull()
    for c in names:
        if c not in ("path", *kept):
            alike = alike & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return row.where(~alike).select(*names, F.col("_root").alias("was_root"))


def leaving(previous: DataFrame, seen: DataFrame, changed: DataFrame, root: str) -> DataFrame:
    """path and root of the rows that leave their root: swept ones, and those which this root takes over."""
    moved = changed.where(F.col("was_root").isNotNull() & (F.col("was_root") != root)).select("path", F.col("was_root").alias("root"))
    return swept(previous, seen, root).select("path", "root").unionByName(moved)


def with_hashes(catalog: DataFrame, hashed: DataFrame, column: str) -> DataFrame:
    """The catalog with the results (path, hash, error) written to `column`.  A new error replaces the
    old one, but a success leaves it: it goes when size or mtime change."""
    results = hashed.select("path", F.col("hash").alias("_hash"), F.col("error").alias("_error"), F.lit(True).alias("_done"))
    joined = catalog.join(results, "path", "left")
    value = {column: F.when(F.col("_done"), F.col("_hash")).otherwise(F.col(column)), "error": F.coalesce("_error", "error")}
    return joined.select(*[value[c].alias(c) if c in value else c for c in catalog.columns])


def upsert_rules(rules: DataFrame, entries: DataFrame) -> DataFrame:
    """Rules with the entries' recursive and rank put in or added; other rules keep theirs."""
    fresh = entries.select("path", F.col("recursive").alias("_recursive"), F.col("rank").alias("_rank"))
    both = rules.select("path", "recursive", "rank").join(fresh, "path", "full_outer")
    return both.select("path", F.coalesce("_recursive", "recursive").alias("recursive"), F.coalesce("_rank", "rank").alias("rank"))
