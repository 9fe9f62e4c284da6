"""Content hashes: blake2b of files, read by executors, and built-in digests of text columns."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsieve.operators.positions import numbered

WINDOW = 64 * 1024
STEP = 1024 * 1024


def partial_of(path: str, window: int = WINDOW) -> str:
    """blake2b-128 of a file's first `window` bytes and, if it is longer, its last `window` bytes too."""
    digest = hashlib.blake2b(digest_size=16)
    with open(path, "rb", buffering=0) as file:
        digest.update(_exactly(file, window))
        size = file.seek(0, os.SEEK_END)
        if size > window:
            file.seek(size - window)
            digest.update(_exactly(file, window))
    return digest.hexdigest()


def _exactly(file, n: int) -> bytes:
    parts = []
    while n and (part := file.read(n)):
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def full_of(path: str) -> str:
    """blake2b-256 of a whole file, a step at a time."""
    digest = hashlib.blake2b(digest_size=32)
    with open(path, "rb", buffering=0) as file:
        while part := file.read(STEP):
            digest.update(part)
    return digest.hexdigest()


def dealt(files: DataFrame, tasks: int) -> DataFrame:
    """(path, size) dealt over `tasks` tasks by size: the largest first, one to each task in turn.  Numbers of files
    differ by one at most, and bytes by at most the largest file's, so no task has over twice the mean unless one file
    alone has more than the mean."""
    placed = numbered(files.select("path", "size"), [F.desc("size"), F.col("path")], "_place")
    return placed.withColumn("_task", F.pmod(F.col("_place") - 1, F.lit(tasks)).cast("int")).repartitionById(tasks, "_task").select("path", "size")


def hash_files(files: DataFrame, kind: str, tasks: int | None = None, done=None) -> DataFrame:
    """(path, hash, error) of each file in `path`; an unreadable one has its error instead.

    tasks: deal the files out anew by size, over so many tasks.  done: an accumulator that counts files.
    """
    of = {"partial": partial_of, "full": full_of}[kind]

    def run(batches):
        for batch in batches:
            paths, hashes, errors = batch.column(0).to_pylist(), [], []
            for path in paths:
                try:
                    hashes.append(of(path))
                    errors.append(None)
                except OSError as error:
                    hashes.append(None)
                    errors.append(str(error))
            if done is not None:
                done.add(len(paths))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(hashes, pa.string()), pa.array(errors, pa.string())], names=["path", "hash", "error"])

    shared = dealt(files, tasks) if tasks else files.select("path", "size")
    return shared.mapInArrow(run, "path string, hash string, error string")


def partial_bytes(text: Column, window: int) -> Column:
    """What the partial hash of a text's UTF-8 bytes reads."""
    data = F.encode(text, "UTF-8")
    head = F.substring(data, 1, window)
    return F.when(F.octet_length(text) > window, F.concat(head, F.substring(data, -window, window))).otherwise(head)


def digest(data: Column, kind: str = "md5") -> Column:
    """md5 or sha256, inside the JVM."""
    return F.md5(data) if kind == "md5" else F.sha2(data, 256)
