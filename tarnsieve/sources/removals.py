"""Removal of files in two phases, as a Spark data sink with a journal.

First the intents are written: for each file its path, the place it goes to, and a file of its group that stays.  Then
`write.format("tarnsieve_removals")` moves the files, a task its share, and notes every outcome in the journal as it happens;
the commit of the write closes the journal.  A run that ends half-way leaves its journal open, and `replay` of the same
intents ends in the same state: a file that is already in its new place counts as removed.  A file is
only moved while the one that stays is there, so no group loses its last copy, however often and late a
journal is replayed.  Paths, trash and journal are folders that all executors see.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tarnsieve.operators.positions import numbered_within

_INTENT = "path string, target string, keeper string"
_OUTCOME = "path string, removed boolean, error string"


def move(path: str, target: str, keeper: str) -> str | None:
    """Moves a file unless that is done already; the error, if there is one."""
    try:
        if not os.path.lexists(path):
            return None if os.path.lexists(target) else f"{path}: no such file"
        if os.path.realpath(keeper) == os.path.realpath(path) or not os.path.lexists(keeper):
            return f"{path}: the copy that was to stay is gone ({keeper})"
        try:
            os.replace(path, target)
        except OSError:  # another device: the copy appears under its name when it is whole
            part = f"{target}.{uuid.uuid4().hex}.part"
            shutil.copy2(path, part)
            os.replace(part, target)
            os.unlink(path)
        return None
    except OSError as error:
        return f"{path}: {error}"


@dataclass
class Moved(WriterCommitMessage):
    n: int


class Mover(DataSourceWriter):
    def __init__(self, journal: str):
        self.journal = journal

    def write(self, iterator):
        n = 0
        with open(f"{self.journal}/outcomes/{uuid.uuid4().hex}.jsonl", "a", encoding="utf-8") as log:
            for row in iterator:
                error = move(row["path"], row["target"], row["keeper"])
                log.write(json.dumps({"path": row["path"], "removed": error is None, "error": error}) + "\n")
                log.flush()
                os.fsync(log.fileno())
                n += 1
        return Moved(n)

    def commit(self, messages):
        with open(f"{self.journal}/closed", "w", encoding="utf-8") as out:
            out.write(str(sum(m.n for m in messages if m)))

    def abort(self, messages):
        """The journal stays open: `replay` takes it up."""


class Removals(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarnsieve_removals"

    def schema(self) -> str:
        return _INTENT

    def writer(self, schema, overwrite) -> Mover:
        return Mover(self.options["journal"])


def _targets(batches, trash: str, run: str):
    """Free names in the trash: the file's own, or with a part of its path's digest, or with the run's name too."""
    from hashlib import md5

    for batch in batches:
        targets = []
        for path, place in zip(batch.column("path").to_pylist(), batch.column("_place").to_pylist()):
            stem, ext = os.path.splitext(os.path.basename(path))
            digest = md5(path.encode()).hexdigest()[:12]
            names = [f"{stem}{ext}"] if place == 1 else []
            names += [f"{stem}.{digest}{ext}", f"{stem}.{digest}.{run}{ext}"]
            targets.append(next((t for t in (os.path.join(trash, n) for n in names) if not os.path.lexists(t)), os.path.join(trash, names[-1])))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(targets, pa.string()), batch.column("keeper")], names=["path", "target", "keeper"])


def open_journal(planned: DataFrame, trash: str) -> str:
    """Phase one: the intents of planned files (path, keeper), written whole; the journal's folder."""
    run = uuid.uuid4().hex[:12]
    journal = f"{trash.rstrip('/')}.journal/{run}"
    os.makedirs(trash, exist_ok=True)
    os.makedirs(f"{journal}/outcomes")
    named = planned.select("path", "keeper", F.element_at(F.split("path", "/"), -1).alias("_name"))
    placed = numbered_within(named, "_name", [F.col("path")], "_place")
    placed.mapInArrow(lambda batches: _targets(batches, trash, run), _INTENT).write.parquet(f"file://{os.path.abspath(journal)}/intents")
    return journal


def replay(spark: SparkSession, journal: str, tasks: int | None = None) -> None:
    """Phase two, or what is left of it."""
    spark.dataSource.register(Removals)
    intents = spark.read.schema(_INTENT).parquet(f"file://{os.path.abspath(journal)}/intents")
    intents.repartition(tasks or spark.sparkContext.defaultParallelism).write.format("tarnsieve_removals").option("journal", journal).mode("append").save()


def open_journals(trash: str) -> list[str]:
    """Journals whose intents are whole and whose removals aren't."""
    folder = f"{trash.rstrip('/')}.journal"
    found = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    return [f"{folder}/{run}" for run in found if os.path.exists(f"{folder}/{run}/intents/_SUCCESS") and not os.path.exists(f"{folder}/{run}/closed")]


def noted(journal: str) -> int:
    """How many outcomes have been noted so far."""
    total = 0
    for entry in os.scandir(f"{journal}/outcomes"):
        with open(entry.path, "rb") as log:
            total += sum(part.count(b"\n") for part in iter(lambda: log.read(1 << 20), b""))
    return total


def outcomes(spark: SparkSession, journal: str) -> DataFrame:
    """(path, removed, error) of every intent; of several attempts a successful one counts."""
    tried = spark.read.schema(_OUTCOME).json(f"file://{os.path.abspath(journal)}/outcomes")
    best = tried.groupBy("path").agg(F.max("removed").alias("removed"), F.max("error").alias("error"))
    intents = spark.read.schema(_INTENT).parquet(f"file://{os.path.abspath(journal)}/intents").select("path")
    met = intents.join(best, "path", "left").withColumn("removed", F.coalesce("removed", F.lit(False)))
    return met.select("path", "removed", F.when(~F.col("removed"), F.col("error")).alias("error"))
