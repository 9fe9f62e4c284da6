"""Observed files that arrive in batches, as a stream of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarnsieve import schema
from tarnsieve.operators import merge
from tarnsieve.sources.snapshots import CatalogTable
from tarnsieve.storage import hadoop_path, written

#: What `merge_epochs` reads: observed rows of a scan (root and epoch), and its last marker, a row without a path that
#: says in `n` how many files the scan has seen.
EPOCH_ROWS = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in schema.SEEN), T.StructField("root", T.StringType(), False), T.StructField("epoch", T.LongType(), False), T.StructField("n", T.LongType(), True)])


def _put(catalog: CatalogTable, rows: DataFrame, root: str) -> None:
    """Adds and updates the rows of one root; of rows that share a path the one of latest mtime counts, of equal ones the last."""
    order = F.struct("mtime", F.monotonically_increasing_id().alias("at"))
    seen = written(merge.last_wins(rows.select(*schema.SEEN.names).withColumn("seq", order)).drop("seq"), "observed")
    version = catalog.version()
    changed = written(merge.changes(catalog.read(version), seen, root), "changed")
    moved = changed.where(F.col("was_root").isNotNull() & (F.col("was_root") != root)).select("path", F.col("was_root").alias("root"))
    catalog.replace(changed, moved, version)


def merge_batches(spark: SparkSession, arrivals: str, catalog: CatalogTable, root: str, checkpoint: str) -> StreamingQuery:
    """Merges every batch of observed rows that lands in `arrivals` into the catalog's rows of `root`.

    Batches add and update rows; only a whole scan can tell that files are gone (`merge_epochs`).  A batch that is tried
    again after a failure gives the same rows, so it does no harm.  Only leaves of the catalog that a batch touches are written.
    """

    def merge_one(batch, _):
        if not batch.isEmpty():
            _put(catalog, batch, root)

    arriving = spark.readStream.schema(schema.SEEN).parquet(arrivals)
    return arriving.writeStream.foreachBatch(merge_one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_epochs(spark: SparkSession, arrivals: str, catalog: CatalogTable, state: str, checkpoint: str) -> StreamingQuery:
    """As merge_batches, for rows that say which root and epoch (number of a scan) they belong to, and with sweeping.

    An epoch closes when its last marker and as many different paths as it names have arrived, in whatever order.  Then
    the root's rows that neither this epoch nor a later one has seen are removed; rows of open epochs never are.  `state`
    keeps the paths seen, markers and closed epochs by batch: a batch that is tried again writes its own part
    anew, so a restart finds the state as it was.
    """

    def part(name: str, spec: str) -> DataFrame:
        files, at = hadoop_path(spark, f"{state}/{name}")
        if not files.exists(at):
            return spark.createDataFrame([], spec)
        return spark.read.schema(spec).parquet(f"{state}/{name}/*")

    def merge_one(batch, number):
        batch = written(batch, "arrived")
        rows = batch.where(F.col("path").isNotNull())
        rows.select("root", "epoch", "path").distinct().write.mode("overwrite").parquet(f"{state}/seen/{number}")
        batch.where(F.col("path").isNull() & F.col("n").isNotNull()).select("root", "epoch", "n").distinct().write.mode("overwrite").parquet(f"{state}/marks/{number}")
        # epochs under way are few: a row for each root that is being scanned
        for r in rows.groupBy("root").agg(F.max("epoch")).orderBy("root").collect():
            _put(catalog, rows.where(F.col("root") == r["root"]), r["root"])
        seen, closed = part("seen", "root string, epoch long, path string"), part("closed", "root string, epoch long")
        waiting = part("marks", "root string, epoch long, n long").groupBy("root", "epoch").agg(F.max("n").alias("n")).join(closed, ["root", "epoch"], "left_anti")
        counts = seen.distinct().groupBy("root", "epoch").agg(F.count("*").alias("found"))
        ready = [r for r in waiting.join(counts, ["root", "epoch"], "left").where(F.coalesce("found", F.lit(0)) >= F.col("n")).orderBy("root", "epoch").collect()]
        for r in ready:
            version = catalog.version()
            later = seen.where((F.col("root") == r["root"]) & (F.col("epoch") >= r["epoch"])).select("path").distinct()
            gone = written(merge.swept(catalog.read(version, r["root"]), later, r["root"]).select("path", "root"), "swept")
            catalog.replace(catalog.read(version).limit(0), gone, version)
        spark.createDataFrame([(r["root"], r["epoch"]) for r in ready], "root string, epoch long").write.mode("overwrite").parquet(f"{state}/closed/{number}")

    arriving = spark.readStream.schema(EPOCH_ROWS).parquet(arrivals)
    return arriving.writeStream.foreachBatch(merge_one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
