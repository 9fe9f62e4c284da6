"""Registered queries of the deduplication engine, over the documents table read as files.

Each has a DuckDB counterpart in catalog_sql.py under the same key.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve import schema
from tarnsieve.functions import display
from tarnsieve.functions.hashing import hash_files
from tarnsieve.functions.names import matches, natural_key
from tarnsieve.operators import candidates, groups, merge, ordering, policy
from tarnsieve.operators.positions import numbered, numbered_within
from tarnsieve.sources.documents import copy_candidates, document_files
from tarnsieve.sources.files import walk
from tarnsieve.sources.snapshots import CatalogTable
from tarnsieve.storage import new_folder, written

from .catalog_sql import SQL

#: The rules of the fixtures.
RULES = [("/lib/src1", True, 0), ("/lib/src2/en", False, 1), ("/lib/src1/fr", False, 5), ("/lib/src3", False, 2), ("/lib/src2", True, 3)]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir)


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir, hashes=True).withColumnsRenamed({"ph": "partial_hash", "fh": "full_hash"})


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_candidates(spark, sf_dir).withColumnsRenamed({"ph": "partial_hash", "fh": "full_hash"})


def _dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all groups, written once: what follows reads these rows alone, some of them several times."""
    return written(groups.duplicates(_candidates(spark, sf_dir)), "dups")


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, k) for k, r in enumerate(RULES)], "path string, recursive boolean, rank int, rule_seq int")


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that count as removed already."""
    return _files(spark, sf_dir).where("doc_id % 4 = 1").select("path")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, then partial, then full hash: the groups of exact copies, largest first."""
    staged = candidates.partial_candidates(_candidates(spark, sf_dir))
    return groups.group_totals(staged).orderBy(F.desc("total"), "full_hash")


def catalog_scan(spark, sf_dir):
    return _files(spark, sf_dir).select("path", "dir", "name", "ext", "category", "size")


def size_candidates(spark, sf_dir):
    return candidates.size_candidates(_files(spark, sf_dir).select("path", "size"))


def partial_candidates(spark, sf_dir):
    return candidates.partial_candidates(_candidates(spark, sf_dir).select("path", "size", "partial_hash")).withColumnRenamed("partial_hash", "ph")


def exact_groups(spark, sf_dir):
    return groups.group_totals(_hashed(spark, sf_dir)).select(F.col("full_hash").alias("fh"), "n", "rep", F.col("total").alias("tot"), "wasted")


def count_files(spark, sf_dir):
    return _files(spark, sf_dir).agg(F.count("*").alias("total_files"))


def null_predicates(spark, sf_dir):
    """F2, over a catalog in which a third lacks the full hash and a fifth of these the partial one too."""
    rows = _hashed(spark, sf_dir).select("path", F.when(F.col("doc_id") % 15 != 0, F.col("partial_hash")).alias("ph"), F.when(F.col("doc_id") % 3 != 0, F.col("full_hash")).alias("fh"))
    return rows.select("path", F.col("ph").isNull().alias("needs_partial"), (F.col("fh").isNull() & F.col("ph").isNotNull()).alias("may_need_full"), F.col("fh").isNotNull().alias("hashed"))


def lookup(spark, sf_dir):
    return _files(spark, sf_dir).where(F.col("path") == "/lib/src0/en/doc0.txt").unionByName(_files(spark, sf_dir).where(F.col("name") == "doc14.txt")).select("path", "size")


def members(spark, sf_dir):
    rows = _dups(spark, sf_dir).select(F.col("full_hash").alias("fh"), "path")
    return numbered_within(rows, "fh", [F.col("path")])


def reclaimable(spark, sf_dir):
    return groups.reclaimable(_hashed(spark, sf_dir))


def group_order(spark, sf_dir):
    totals = groups.group_totals(_hashed(spark, sf_dir)).select(F.col("full_hash").alias("fh"), "total")
    return numbered(totals, [F.desc("total"), F.col("fh")]).select("fh", "pos")


def search(spark, sf_dir):
    return groups.search(_hashed(spark, sf_dir), "OC12 ").select(F.col("full_hash").alias("fh"), "path")


def visibility(spark, sf_dir):
    return groups.visibility(_dups(spark, sf_dir), "src1/").select(F.col("full_hash").alias("fh"), "path", "hit", "group_visible")


def can_delete(spark, sf_dir):
    return policy.can_delete(_dups(spark, sf_dir), _actions(spark, sf_dir)).select(F.col("full_hash").alias("fh"), "path", "can_delete")


def live_folders(spark, sf_dir):
    return policy.live_folders(_dups(spark, sf_dir), _actions(spark, sf_dir))


def folder_ranks(spark, sf_dir):
    return policy.folder_ranks(_files(spark, sf_dir), _rules(spark)).select("dir", F.when(F.col("rank") < float("inf"), F.col("rank").cast("int")).alias("rank"))


def _plan(spark, sf_dir):
    return policy.suggest(_dups(spark, sf_dir), _rules(spark))


def suggest_delete(spark, sf_dir):
    return _plan(spark, sf_dir).select(F.col("full_hash").alias("fh"), "path", "size", "why")


def suggest_live(spark, sf_dir):
    return policy.suggest(_dups(spark, sf_dir), _rules(spark), _actions(spark, sf_dir)).select(F.col("full_hash").alias("fh"), "path", "why")


def plan_totals(spark, sf_dir):
    return policy.totals(_plan(spark, sf_dir))


def plan_preview(spark, sf_dir):
    dups = _dups(spark, sf_dir)
    return policy.preview(policy.suggest(dups, _rules(spark)), dups)


def sorted_folders(spark, sf_dir):
    return numbered(policy.live_folders(_dups(spark, sf_dir), _actions(spark, sf_dir)), [F.col("dir")]).select("dir", "pos")


def prefill(spark, sf_dir):
    rows = policy.prefill(_dups(spark, sf_dir).select("dir").distinct(), _rules(spark))
    return numbered(rows, policy.prefill_order()).select("dir", "recursive", "pos")


def highlight(spark, sf_dir):
    """folders that hold the text, and which of them is first in the list."""
    found = _files(spark, sf_dir).select("dir").distinct().where(matches(" SRC1", F.col("dir")))
    first = found.agg(F.min("dir").alias("first"))
    return found.join(F.broadcast(first), F.col("dir") == F.col("first"), "left").select("dir", F.col("first").isNotNull().alias("is_first"))


def rank_numbers(spark, sf_dir):
    """W4, W5: ranks and shown numbers of the list of folders, after French ones went up by one and those of src1 to the top."""
    folders = _files(spark, sf_dir).select("dir").distinct()
    listed = written(numbered(folders, [F.col("dir")], "place").withColumn("chosen", F.col("dir").endswith("/fr")), "folders")
    moved = written(ordering.nudged(listed, "place", "chosen"), "nudged")
    order = ordering.edge_order(F.col("dir").startswith("/lib/src1/"), F.col("place"), top=True)
    return ordering.with_places(moved.select("dir", "place"), order).select(F.col("dir").alias("path"), F.col("dir").startswith("/lib/src1/").alias("recursive"), "rank", "shown")


def _previous(spark, sf_dir):
    mtime = F.when(F.col("doc_id") % 5 == 0, F.col("mtime") - 1).otherwise(F.col("mtime"))
    return _hashed(spark, sf_dir).where("doc_id % 10 <> 3").select("path", "size", mtime.alias("mtime"), "partial_hash", "full_hash")


def _seen(spark, sf_dir):
    return _files(spark, sf_dir).where("doc_id % 11 <> 0").select("path", "size", "mtime")


def incremental_merge(spark, sf_dir):
    return merge.observed(_previous(spark, sf_dir), _seen(spark, sf_dir)).withColumnsRenamed({"partial_hash": "ph", "full_hash": "fh"})


def swept_rows(spark, sf_dir):
    return merge.swept(_files(spark, sf_dir).select("path"), _seen(spark, sf_dir))


def removed_count(spark, sf_dir):
    return swept_rows(spark, sf_dir).agg(F.count("*").alias("removed"))


def new_rows(spark, sf_dir):
    return merge.new_rows(_previous(spark, sf_dir), _files(spark, sf_dir).select("path"))


def error_merge(spark, sf_dir):
    rows = _files(spark, sf_dir)
    catalog = rows.select("path", F.lit(None).cast("string").alias("full_hash"), F.when(F.col("doc_id") % 3 == 0, "old").alias("error"))
    hashed = rows.where("doc_id % 2 = 0").select("path", F.lit("h").alias("hash"), F.when(F.col("doc_id") % 5 == 0, "new").alias("error"))
    return merge.with_hashes(catalog, hashed, "full_hash").select("path", "error")


def last_wins(spark, sf_dir):
    rows = _files(spark, sf_dir)
    again = rows.where("doc_id % 6 = 0").select("path", (F.col("size") + 1).alias("size"), (F.col("doc_id") + 100000).alias("seq"))
    return merge.last_wins(rows.select("path", "size", F.col("doc_id").alias("seq")).unionByName(again)).select("path", "size")


def rules_upsert(spark, sf_dir):
    """M7: rules of all sources, into which those of French folders and of the sources that end in 1 are put."""
    dirs = written(_files(spark, sf_dir).select("dir", F.regexp_extract("dir", "^(/lib/[^/]*)/", 1).alias("source")).distinct(), "folders")
    old = ordering.with_places(dirs.select(F.col("source").alias("path")).distinct().withColumn("recursive", F.lit(True)), [F.col("path")]).drop("shown")
    named = dirs.where(F.col("dir").endswith("/fr")).select(F.col("dir").alias("path")).union(dirs.where(F.col("source").endswith("1")).select("source")).distinct()
    entries = ordering.with_places(named.withColumn("recursive", F.lit(False)), [F.col("path")]).drop("shown")
    return merge.upsert_rules(old, entries).select(F.col("path").alias("rpath"), "recursive", F.col("rank").alias("rnk"))


def _catalog(spark: SparkSession, sf_dir: str) -> CatalogTable:
    """A catalog of all files with hashes, its rows under two roots."""
    rows = _hashed(spark, sf_dir).withColumns({"root": F.when(F.col("doc_id") % 2 == 0, "/lib").otherwise("/other"), "ctime": F.lit(None).cast("double"), "error": F.lit(None).cast("string")})
    table = CatalogTable(spark, new_folder(spark, "catalog"), buckets=8)
    table.publish(rows)
    return table


def catalog_lookup(spark, sf_dir):
    """F1, F3, S4: rows of one root, and of one path, from the catalog's leaves."""
    table = _catalog(spark, sf_dir)
    path = _files(spark, sf_dir).agg(F.max("path")).first()[0] or ""
    return table.read(root="/lib").unionByName(table.lookup(path)).select("path", "root", "size", "full_hash").withColumnRenamed("full_hash", "fh")


def catalog_update(spark, sf_dir):
    """M2, M4, M5, J4: the catalog after a scan of /lib that sees two thirds of all files, a fifth of them changed."""
    table = _catalog(spark, sf_dir)
    mtime = F.when(F.col("doc_id") % 5 == 0, F.col("mtime") - 1).otherwise(F.col("mtime"))
    seen = written(_files(spark, sf_dir).where("doc_id % 3 <> 0").withColumns({"mtime": mtime, "ctime": F.lit(None).cast("double")}).select(*schema.SEEN.names), "seen")
    before = table.read()
    changed = written(merge.changes(before, seen, "/lib"), "changed")
    table.replace(changed, merge.leaving(before, seen, changed, "/lib"))
    return table.read().select("path", "root", "mtime", "partial_hash", "full_hash").withColumnsRenamed({"partial_hash": "ph", "full_hash": "fh"})


def member_pages(spark, sf_dir):
    """A5, J7: groups in pages of two files."""
    found = groups.pages(_dups(spark, sf_dir).select("path", "full_hash", "size"), 2)
    return found.select(F.col("full_hash").alias("fh"), "page", "n", "total", F.array_join(F.transform("files", lambda f: f["path"]), "|").alias("paths"))


def summary(spark, sf_dir):
    return groups.summary(_hashed(spark, sf_dir).withColumn("root", F.lit("/lib")), "/lib", 3)


def natural_order(spark, sf_dir):
    rows = _files(spark, sf_dir).select("path", natural_key(F.col("name")).alias("key"))
    return numbered(rows, [F.col("key"), F.col("path")]).select("path", "pos")


def format_size(spark, sf_dir):
    return _files(spark, sf_dir).select("path", display.size_text(F.col("size")).alias("size_text"))


def format_time(spark, sf_dir):
    return _files(spark, sf_dir).select("path", display.time_text(F.col("mtime")).alias("time_text"))


def group_headers(spark, sf_dir):
    totals = groups.group_totals(_hashed(spark, sf_dir))
    return totals.select(F.col("full_hash").alias("fh"), display.group_header(F.col("n"), F.col("rep")).alias("header"))


def thousands(spark, sf_dir):
    return _files(spark, sf_dir).select("path", display.thousands(F.col("size") * 1000).alias("size_text"))


def details(spark, sf_dir):
    rows = _hashed(spark, sf_dir).withColumns({"error": F.when(F.col("doc_id") % 9 == 0, "unreadable"), "ctime": F.when(F.col("doc_id") % 2 == 0, F.col("mtime")), "full_hash": F.when(F.col("doc_id") % 3 == 0, F.col("full_hash"))})
    return rows.select("path", display.detail_text({c: F.col(c) for c in rows.columns}).alias("detail"))


def file_tree(spark, sf_dir):
    """The documents as files on disk, found by the walker and hashed by blake2b; how many files share each hash.
    The tree is made in the shared folder, which every executor has to see as a local path."""
    root = new_folder(spark, "tree").removeprefix("file://").removeprefix("file:")
    if "://" in root:
        raise ValueError("the walker reads mounted folders: set spark.checkpoint.dir to one")

    def put(batches):
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
                with open(f"{root}/{name}", "wb") as out:
                    out.write((text or "").encode())
            yield batch.select(["path"])

    document_files(spark, sf_dir, content=True).select("path", "text").mapInArrow(put, "path string").write.format("noop").mode("overwrite").save()
    found = written(walk(spark, root), "walked")
    for kind in ("partial", "full"):
        hashed = written(hash_files(found.select("path", "size"), kind, spark.sparkContext.defaultParallelism), kind)
        same = hashed.groupBy("hash").agg(F.count("*").alias(f"same_{kind}"))
        # a file that couldn't be read stays, without a hash
        found = found.join(hashed.join(same, "hash", "left").select("path", F.length("hash").alias(f"{kind}_digits"), f"same_{kind}"), "path", "left")
    return found.select(F.expr(f"substring(path, {len(os.path.realpath(root)) + 1})").alias("path"), "name", "category", "size", "partial_digits", "full_digits", "same_partial", "same_full")


_QUERIES = {
    "S1_catalog_scan": catalog_scan,
    "J1_size_candidates": size_candidates,
    "J2_partial_candidates": partial_candidates,
    "A3_exact_groups": exact_groups,
    "A4_count_files": count_files,
    "F2_null_predicates": null_predicates,
    "F3_lookup": lookup,
    "A5_members": members,
    "A7_reclaimable": reclaimable,
    "O2_group_order": group_order,
    "F5_search": search,
    "F5_group_visibility": visibility,
    "F6_highlight": highlight,
    "A8_P1_can_delete": can_delete,
    "A9_folders": live_folders,
    "J5_folder_ranks": folder_ranks,
    "W2_suggest_delete": suggest_delete,
    "F7_suggest_live": suggest_live,
    "A12_plan_totals": plan_totals,
    "O6_plan_preview": plan_preview,
    "O3_sorted_folders": sorted_folders,
    "J6_O4_prefill": prefill,
    "W4_W5_rank_numbers": rank_numbers,
    "M4_incremental_merge": incremental_merge,
    "M2_swept_rows": swept_rows,
    "A13_removed": removed_count,
    "J3_new_rows": new_rows,
    "M6_error_merge": error_merge,
    "M3_last_wins": last_wins,
    "M7_rules_upsert": rules_upsert,
    "F1_F3_catalog_lookup": catalog_lookup,
    "M2_M4_catalog_update": catalog_update,
    "A5_J7_member_pages": member_pages,
    "A14_summary": summary,
    "O5_natural_order": natural_order,
    "X5_format_size": format_size,
    "X6_format_time": format_time,
    "X13_group_headers": group_headers,
    "X14_thousands": thousands,
    "X15_details": details,
    "S1_X1_X2_file_tree": file_tree,
}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(SQL)
