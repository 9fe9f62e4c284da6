"""A file tree as a table: a walk in rounds, each a Spark job over the folders known so far.

A round deals the folders that are still to be listed evenly over its tasks.  A task lists its own and then their
sub-folders, up to twice its share (a few dozen while there are few), and hands back those it hasn't come to; they are
dealt out anew in the next round.  So a deep or uneven tree never stays with one task, and the driver holds nothing but
counts.  Names are listed first; size and times are asked for in a last job over evenly dealt files, so a folder with
most of the files is listed by one task but looked at by all.  Symbolic links are neither followed nor listed; folders
and entries that can't be read are skipped, and so are names that aren't UTF-8.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve import schema
from tarnsieve.functions.names import extension
from tarnsieve.storage import written

#: kind: 0 a file, 1 a folder that is still to be listed, 2 how many folders the task has listed (`n`).
_LISTED = "kind int, dir string, name string, n long"
_FILE, _FOLDER, _TOLD = range(3)
_RAW = "path string, dir string, name string, size long, mtime double, ctime double"


def _entries(folder: str):
    """(kind, name) of a folder's files and folders, as they are read."""
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    entry.path.encode()  # a name that isn't UTF-8 can't be a Spark string
                    if entry.is_dir(follow_symlinks=False):
                        yield _FOLDER, entry.name
                    elif entry.is_file(follow_symlinks=False):
                        yield _FILE, entry.name
                except (OSError, UnicodeEncodeError):
                    continue
    except OSError:
        return


def _round(frontier: DataFrame, tasks: int, budget: int) -> DataFrame:
    """What the tasks of a round find: each lists its share of the folders and sub-folders up to `budget`."""

    def rows(found):
        columns = list(zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64()))], names=["kind", "dir", "name", "n"])

    def run(batches):
        own = [folder for batch in batches for folder in batch.column(0).to_pylist()]
        least, listed, found = len(own), 0, []
        # own folders first, then the sub-folders met last
        below: list[str] = []
        while own or (below and listed < max(budget, least)):
            folder = own.pop() if own else below.pop()
            listed += 1
            for kind, name in _entries(folder):
                if kind == _FOLDER:
                    below.append(os.path.join(folder, name))
                else:
                    found.append((_FILE, folder, name, None))
                    if len(found) == 10_000:
                        yield rows(found)
                        found = []
        found += [(_FOLDER, folder, None, None) for folder in below]
        if listed:
            yield rows([*found, (_TOLD, None, None, listed)])

    return frontier.repartition(tasks).mapInArrow(run, _LISTED)


def checked_root(root: str) -> str:
    """The resolved root of a scan; it has to be a folder."""
    root = root.strip()
    if not root or not os.path.isdir(root):
        raise ValueError(f"not a folder: {root!r}")
    return os.path.realpath(root)


def walk(spark: SparkSession, root: str, tasks: int | None = None, small: int = 64, told: Callable[[list[int]], None] | None = None, done=None) -> DataFrame:
    """The catalogued files below a root.  told: gets, after each round, how many folders each of its tasks has listed.

    small: folders that a task may list in a round with fewer folders than tasks.  done: an accumulator that counts
    the files looked at.
    """
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    frontier, known, rounds = spark.createDataFrame([(checked_root(root),)], "dir string"), 1, []
    while known:
        pieces = min(tasks, known)
        found = written(_round(frontier, pieces, max(small, 2 * -(-known // pieces))), "listed")
        rounds.append(found._tarnsieve_folder)
        if told:
            told([r["n"] for r in found.where(F.col("kind") == _TOLD).select("n").collect()])  # a row for each task
        frontier = found.where(F.col("kind") == _FOLDER).select("dir")
        known = frontier.count()
    files = spark.read.schema(_LISTED).parquet(*rounds).where(F.col("kind") == _FILE).select("dir", "name")
    wanted = files.withColumn("ext", extension(F.col("name"))).where(schema.category(F.col("ext")).isNotNull()).select("dir", "name")
    return classified(_looked_at(wanted.repartition(tasks), done))


def _looked_at(files: DataFrame, done=None) -> DataFrame:
    """Files with path, size and times; those that are gone or no files any more are left out."""

    def run(batches):
        for batch in batches:
            found = []
            for folder, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = os.path.join(folder, name)
                try:
                    seen = os.stat(path, follow_symlinks=False)
                except OSError:
                    continue
                if stat.S_ISREG(seen.st_mode):
                    found.append((path, folder, name, seen.st_size, seen.st_mtime, seen.st_ctime))
            if done is not None:
                done.add(len(found))
            if found:
                columns = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()))], names=["path", "dir", "name", "size", "mtime", "ctime"])

    return files.mapInArrow(run, _RAW)


def classified(found: DataFrame) -> DataFrame:
    """Adds extension and category, dropping files whose extension isn't catalogued."""
    typed = found.withColumn("ext", extension(F.col("name"))).withColumn("category", schema.category(F.col("ext")))
    return typed.where(F.col("category").isNotNull()).select(*[f.name for f in schema.SEEN])
