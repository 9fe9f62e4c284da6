"""The catalog as immutable Parquet snapshots and a pointer to the newest.

A writer makes a new folder and then moves the pointer, so readers see the old snapshot or the new
one.  Pointer files are numbered; each is written whole under another name and then named without
overwriting: of two writers that started from the same snapshot one fails instead of losing the other's
rows, and a pointer is never seen before it is whole.  Works on any store of Hadoop whose renames are atomic.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsieve import schema
from tarnsieve.storage import hadoop_path, written


def default_location() -> str:
    """Where a catalog is kept unless told otherwise."""
    # Windows names the folder of a user's own data
    base = os.environ.get("LOCALAPPDATA") or os.path.join(os.path.expanduser("~"), ".local", "share")
    return os.path.join(base, "tarnsieve", "catalog")


class SnapshotTable:
    """One versioned table at `location`."""

    def __init__(self, spark: SparkSession, location: str, schema: T.StructType):
        self.spark, self.location, self.schema = spark, location.rstrip("/"), schema

    def version(self) -> int:
        """Number of the newest snapshot; 0 if there is none."""
        files, at = hadoop_path(self.spark, f"{self.location}/_versions")
        if not files.exists(at):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _folder(self, version: int) -> str:
        files, at = hadoop_path(self.spark, f"{self.location}/_versions/{version}")
        stream = files.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.location}/{self._folder(version)}")

    def publish(self, df: DataFrame, after: int | None = None) -> int:
        """Writes df as the snapshot that follows version `after` (by default the newest)."""
        version = (self.version() if after is None else after) + 1
        folder = f"snapshot-{version:09d}-{uuid.uuid4().hex}"
        df.select(*[f.name for f in self.schema]).write.parquet(f"{self.location}/{folder}")
        self._point(version, folder)
        return version

    def _point(self, version: int, folder: str) -> None:
        """Makes the pointer file, which holds a text; fails if another writer was first."""
        files, at = hadoop_path(self.spark, f"{self.location}/_versions/{version}")
        _, draft = hadoop_path(self.spark, f"{self.location}/_versions/draft-{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(folder.encode())
        stream.close()
        try:
            if files.getUri().getScheme() == "file":  # Java's rename would overwrite
                os.link(draft.toUri().getPath(), at.toUri().getPath())
            else:
                sc = self.spark.sparkContext
                context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), sc._jsc.hadoopConfiguration())
                context.rename(draft, at, sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        finally:
            files.delete(draft, False)


#: Beyond so many touched rows their paths are joined by a shuffle rather than broadcast.
MOST_BROADCAST_PATHS = 100_000


class CatalogTable(SnapshotTable):
    """The catalog of files, in leaves: a folder for each root (by its MD5) and bucket of paths (by their hash).

    A snapshot names its leaves, so a change writes the leaves it touches and names the others again.  A scan of one
    root reads that root's leaves alone; within a leaf rows are sorted by size, so that a range of sizes skips row groups,
    and a bloom filter on the path serves lookups.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64, options: dict[str, str] | None = None):
        """buckets: of a new catalog; one that exists keeps its own.  options: of the Parquet writer."""
        super().__init__(spark, location, schema.CATALOG)
        self.new_buckets, self.options = buckets, options or {}
        self.data = f"{self.location}/data"

    def _state(self, version: int | None) -> tuple[int, list[str]]:
        """(buckets, leaves) of a snapshot."""
        version = self.version() if version is None else version
        if not version:
            return self.new_buckets, []
        state = json.loads(self._folder(version))
        return state["buckets"], state["leaves"]

    @staticmethod
    def root_id(root: Column) -> Column:
        return F.md5(root.cast("binary"))

    @staticmethod
    def bucket(path: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")

    def _leaves(self, leaves: list[str]) -> DataFrame:
        """The rows of leaves, with root_id and bucket as columns that Spark prunes by."""
        fields = T.StructType([*self.schema, T.StructField("root_id", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not leaves:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).option("basePath", self.data).parquet(*(f"{self.data}/{leaf}" for leaf in leaves)).select(*fields.names)

    def read(self, version: int | None = None, root: str | None = None) -> DataFrame:
        """All rows, or those of one root, from its leaves."""
        rows = self._leaves(self._state(version)[1])
        if root is not None:
            rows = rows.where((F.col("root_id") == self.root_id(F.lit(root))) & (F.col("root") == root))
        return rows.select(*self.schema.names)

    def lookup(self, path: str) -> DataFrame:
        """The row of a path, from the leaves of its bucket."""
        buckets, leaves = self._state(None)
        return self._leaves(leaves).where((F.col("bucket") == self.bucket(F.lit(path), buckets)) & (F.col("path") == path)).select(*self.schema.names)

    def _write(self, rows: DataFrame, buckets: int) -> list[str]:
        """Writes rows as new leaves."""
        write = f"write={uuid.uuid4().hex}"
        keyed = rows.select(*self.schema.names).withColumns({"root_id": self.root_id(F.col("root")), "bucket": self.bucket(F.col("path"), buckets)})
        ordered = keyed.repartition("root_id", "bucket").sortWithinPartitions("root_id", "bucket", "size", "path")
        options = {"parquet.bloom.filter.enabled#path": "true"} | self.options
        ordered.write.partitionBy("root_id", "bucket").options(**options).parquet(f"{self.data}/{write}")
        files, at = hadoop_path(self.spark, f"{self.data}/{write}/root_id=*/bucket=*")
        found = files.globStatus(at) or []
        return sorted("/".join(str(s.getPath()).rsplit("/", 3)[-3:]) for s in found)

    def publish(self, df: DataFrame, after: int | None = None) -> int:
        """Writes df as the whole snapshot that follows version `after` (by default the newest)."""
        version = (self.version() if after is None else after) + 1
        buckets = self._state(version - 1)[0]
        self._point(version, json.dumps({"buckets": buckets, "leaves": self._write(df, buckets)}))
        return version

    def replace(self, changed: DataFrame, gone: DataFrame, after: int | None = None) -> int:
        """The snapshot that follows version `after` with the rows `changed` put in by path, and those of `gone` taken out.

        gone: path and root of rows that leave their root, also those that `changed` has under another one.  Only
        leaves of these rows are written.
        """
        before = self.version() if after is None else after
        buckets, leaves = self._state(before)

        def place(rows: DataFrame) -> DataFrame:
            return rows.select(self.root_id(F.col("root")).alias("root_id"), self.bucket(F.col("path"), buckets).alias("bucket"))

        # at most a row for each leaf
        touched = {f"root_id={r['root_id']}/bucket={r['bucket']}" for r in place(changed).union(place(gone)).distinct().collect()}
        old = [leaf for leaf in leaves if leaf.split("/", 1)[1] in touched]
        paths = written(changed.select("path").union(gone.select("path")).distinct(), "touched-paths")
        if paths.count() <= MOST_BROADCAST_PATHS:
            paths = F.broadcast(paths)
        rest = self._leaves(old).select(*self.schema.names).join(paths, "path", "left_anti")
        made = self._write(rest.select(*self.schema.names).unionByName(changed.select(*self.schema.names)), buckets) if touched else []
        self._point(before + 1, json.dumps({"buckets": buckets, "leaves": sorted({*leaves} - {*old}) + made}))
        return before + 1

    def expire(self, keep: int = 2, older_than: float = 86_400.0) -> int:
        """Deletes all snapshots but the newest `keep`, and the leaves that only those name; how many leaves went.

        A leaf that is younger than `older_than` seconds stays: a writer may be about to name it.
        """
        newest = self.version()
        files, at = hadoop_path(self.spark, f"{self.location}/_versions")
        versions = sorted(int(s.getPath().getName()) for s in (files.listStatus(at) if files.exists(at) else ()) if s.getPath().getName().isdigit())
        named = {leaf for v in versions if v > newest - keep for leaf in self._state(v)[1]}
        gone = 0
        _, pattern = hadoop_path(self.spark, f"{self.data}/write=*/root_id=*/bucket=*")
        for found in files.globStatus(pattern) or []:
            leaf = "/".join(str(found.getPath()).rsplit("/", 3)[-3:])
            if leaf not in named and found.getModificationTime() / 1000 < time.time() - older_than:
                gone += bool(files.delete(found.getPath(), True))
        for v in versions:
            if v <= newest - keep:
                files.delete(hadoop_path(self.spark, f"{self.location}/_versions/{v}")[1], False)
        return gone
