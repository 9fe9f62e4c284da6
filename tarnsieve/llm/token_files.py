"""Token-ID files: blocks of ids, transposed into bit or byte planes, each plane compressed.

A shard file holds a run of documents in ascending id order:

    magic "TSBP1\\n"
    chunks: the planes of `chunk_ids` ids each (the last has fewer), least significant plane first,
            each compressed with zstandard; a plane without any set bit takes no bytes
    document table: int64 ids (null ids come first and are counted apart), int64 lengths, compressed
    footer: JSON {mode, ids, docs, null_docs, table, chunks: [[offset, ids, [plane sizes]]...]}
    uint64 length of the footer, magic

1. Texts are tokenized where they are read; each gives a row for every `run_ids` of its ids, as compressed
   byte planes.  This table is written, so texts are neither tokenized twice nor shuffled.
2. Its rows are dealt out by ranges of (document, row) - not of the id alone, so an id that very many rows
   share, or none, is no hot key - and sorted; about `shard_ids` ids make a range.
3. A task writes its range, run by run, and begins a new shard after `shard_ids` ids or `shard_docs`
   documents; a document stays in one shard.

Shards are written by executors under names of their own; the index table beside them, which
Spark commits, names the shards of the tasks that succeeded.  A retried task thus leaves at most a
file that nothing refers to.  Paths are URIs of any store that pyarrow opens (file, hdfs, s3, gs).

Nulls and ties: a null text is an empty one; null ids come first; rows that repeat an id follow
one another in the order of the checksums of their ids; other columns are ignored; an empty table gives
no shards.  Of a very long text a worker holds the ids, at four bytes each, and a writer one run of them.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import id_and_text, store, written
from .tokens import CACHE_BYTES, END_ID, blocks, crc32, tokenizer

MAGIC = b"TSBP1\n"


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """mode "byte": 4 planes of a byte an id; "bit": 32 planes of a bit an id.  Planes of zeros are empty."""
    ids = np.ascontiguousarray(ids, np.uint32)
    used = int(np.bitwise_or.reduce(ids)) if len(ids) else 0
    if mode == "byte":
        return [(ids >> np.uint32(8 * k)).astype(np.uint8).tobytes() if used >> 8 * k & 255 else b"" for k in range(4)]
    return [np.packbits((ids >> np.uint32(k) & np.uint32(1)).astype(bool), bitorder="little").tobytes() if used >> k & 1 else b"" for k in range(32)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        if p:
            part = np.frombuffer(p, np.uint8) if mode == "byte" else np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
            ids |= part.astype(np.uint32) << np.uint32(8 * k if mode == "byte" else k)
    return ids


class ShardWriter:
    """Writes one shard, a chunk at a time."""

    def __init__(self, out, mode: str, chunk_ids: int, level: int):
        import zstandard

        self.out, self.mode, self.chunk_ids = out, mode, chunk_ids
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.at, self.chunks, self.rest = 0, [], []
        self.docs, self.lens = array("q"), array("q")
        self.nulls = self.ids = self.held = self.doc_ids = 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    @property
    def n_docs(self) -> int:
        return len(self.docs)

    def add(self, doc: int | None, ids: np.ndarray, last: bool) -> None:
        """The next ids of a document; `last` if it has no more."""
        self.doc_ids += len(ids)
        if last:
            self.nulls += doc is None
            self.docs.append(doc or 0)
            self.lens.append(self.doc_ids)
            self.doc_ids = 0
        self.ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.chunk_ids:
            whole = np.concatenate(self.rest)
            done = len(whole) // self.chunk_ids * self.chunk_ids
            for at in range(0, done, self.chunk_ids):
                self._chunk(whole[at : at + self.chunk_ids])
            self.rest, self.held = [whole[done:].copy()], len(whole) - done

    def _chunk(self, ids: np.ndarray) -> None:
        offset = self.at
        planes = [p and self.compress(p) for p in to_planes(ids, self.mode)]
        self.chunks.append([offset, len(ids), [len(p) for p in planes]])
        self._write(b"".join(planes))

    def close(self) -> dict:
        if self.held:
            self._chunk(np.concatenate(self.rest))
        table = [self.at]
        for column in (self.docs, self.lens):
            packed = self.compress(np.asarray(column, "<i8").tobytes())
            table.append(len(packed))
            self._write(packed)
        about = {"mode": self.mode, "ids": self.ids, "docs": len(self.docs), "null_docs": self.nulls, "table": table, "chunks": self.chunks}
        footer = json.dumps(about).encode()
        self._write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return about


class ShardReader:
    """Reads a shard: its footer first, then single chunks by their place in the index."""

    def __init__(self, source):
        import zstandard

        self.source, self.decompress = source, zstandard.ZstdDecompressor().decompress
        end = source.size()
        tail = self._read(end - 8 - len(MAGIC), 8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack("<Q", tail[:8])
        self.about = json.loads(self._read(end - 8 - len(MAGIC) - n, n))
        at, a, b = self.about["table"]
        self.docs = np.frombuffer(self.decompress(self._read(at, a)), "<i8") if self.about["docs"] else np.empty(0, np.int64)
        self.lens = np.frombuffer(self.decompress(self._read(at + a, b)), "<i8") if self.about["docs"] else np.empty(0, np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.about["chunks"][k]
        raw, planes = self._read(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.decompress(raw[:size]) if size else b"")
            raw = raw[size:]
        return from_planes(planes, n, self.about["mode"])

    def digests(self):
        """(length, crc32) of each document, holding one chunk at a time."""
        chunks = range(len(self.about["chunks"]))
        k, now, at = 0, np.empty(0, np.uint32), 0
        for length in self.lens.tolist():
            crc, left = 0, length
            while left:
                if at == len(now):
                    now, at = self.chunk(chunks[k]), 0
                    k += 1
                part = now[at : at + left]
                crc = zlib.crc32(np.ascontiguousarray(part, "<u4"), crc)
                at, left = at + len(part), left - len(part)
            yield length, crc


def pack_run(ids: np.ndarray) -> bytes:
    """The low bytes of all ids, then the next ones, as many planes as the largest id needs."""
    planes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    return planes[: max(1, -(-int(ids.max()).bit_length() // 8))].tobytes()


def unpack_run(planes: bytes, n: int) -> np.ndarray:
    ids = np.zeros((n, 4), np.uint8)
    found = np.frombuffer(planes, np.uint8).reshape(-1, n)
    ids[:, : len(found)] = found.T
    return ids.reshape(-1).view("<u4")


def token_runs(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID, run_ids: int = 1 << 16, cache_bytes: int = CACHE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each document in runs: doc_id, ids_crc32, doc_row (a number of the row), run, n_ids, last, ids
    (see `pack_run`)."""
    fields = {"doc_id": pa.int64(), "ids_crc32": pa.int64(), "doc_row": pa.int64(), "run": pa.int32(), "n_ids": pa.int32(), "last": pa.bool_(), "ids": pa.binary()}

    def encode(batches):
        import zstandard

        encode, compress = tokenizer(tokenizer_path, cache_bytes).encode, zstandard.ZstdCompressor(level=1).compress
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            names = batch.column(0)
            for first, run in blocks(batch.column(1)):
                ids, lens = encode(run, end_id)
                n = -(-lens // run_ids)
                doc = np.repeat(np.arange(len(run)), n)
                at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                size = np.minimum(lens[doc] - at * run_ids, run_ids)
                ends = np.cumsum(size)
                blobs = [compress(pack_run(ids[b - k : b])) for k, b in zip(size.tolist(), ends.tolist())]
                bounds = np.concatenate([[0], np.cumsum(lens)]).tolist()
                crcs = np.array([crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:])], np.int64)
                columns = [names.slice(first, len(run)).take(pa.array(doc)), pa.array(crcs[doc]), pa.array(row + doc), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(at == n[doc] - 1), pa.array(blobs, pa.binary())]
                row += len(run)
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(fields.items())))

    return id_and_text(documents, id_col, text_col).mapInArrow(encode, "doc_id long, ids_crc32 long, doc_row long, run int, n_ids int, last boolean, ids binary")


def write_token_files(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, mode: str = "byte", chunk_ids: int = 1 << 20, level: int = 1, shard_ids: int = 1 << 25, shard_docs: int = 1 << 20, cache_bytes: int = CACHE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards of all documents to `folder` and returns their index, read from there."""
    if mode not in ("bit", "byte"):
        raise ValueError("mode: bit or byte")
    spark = documents.sparkSession
    columns = {"part": pa.int32(), "shard": pa.int32(), "file": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64(), "n_bytes": pa.int64(), "n_chunks": pa.int32()}

    def write(batches):
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        part, shard, writer, out, name = TaskContext.get().partitionId(), 0, None, None, None

        def done():
            about = writer.close()
            out.close()
            row = [part, shard, f"shards/{name}", about["docs"], about["ids"], writer.at, len(about["chunks"])]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, columns.values())], names=list(columns))

        for batch in batches:
            for doc, last, blob, n in zip(*(batch.column(c) for c in ("doc_id", "last", "ids", "n_ids"))):
                if writer is None:
                    name = f"part-{part:06d}-{shard:06d}-{uuid.uuid4().hex}.tsbp"
                    files, path = store(f"{folder}/shards")
                    files.create_dir(path, recursive=True)
                    out = files.open_output_stream(f"{path}/{name}")
                    writer = ShardWriter(out, mode, chunk_ids, level)
                writer.add(doc.as_py(), unpack_run(decompress(blob.as_py()), n.as_py()), last.as_py())
                if last.as_py() and (writer.ids >= shard_ids or writer.n_docs >= shard_docs):
                    yield done()
                    shard, writer = shard + 1, None
        if writer is not None:
            yield done()

    spec = "part int, shard int, file string, n_docs long, n_ids long, n_bytes long, n_chunks int"
    runs = written(token_runs(documents, tokenizer_path, end_id, cache_bytes=cache_bytes, id_col=id_col, text_col=text_col), "token-runs")
    total = runs.agg(F.coalesce(F.sum("n_ids"), F.lit(0))).first()[0]
    ranges = max(-(-total // shard_ids), spark.sparkContext.defaultParallelism)
    order = ("doc_id", "ids_crc32", "doc_row")
    runs.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "run").mapInArrow(write, spec).write.parquet(f"{folder}/index")
    return spark.read.schema(spec).parquet(f"{folder}/index")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    index = spark.read.parquet(f"{folder}/index")
    # a row for each shard; the running total over shards is over as many rows as there are files
    order = Window.orderBy("part", "shard")
    based = index.withColumns({"base": F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), "at": F.row_number().over(order)})
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                files, path = store(f"{folder}/{file}")
                with files.open_input_file(path) as source:
                    shard = ShardReader(source)
                    docs = pa.array(shard.docs, mask=np.arange(len(shard.docs)) < shard.about["null_docs"])
                    starts = (base or 0) + np.cumsum(shard.lens) - shard.lens
                    digests, step = shard.digests(), 1 << 16
                    for at in range(0, len(docs), step):
                        crcs = np.fromiter((c for _, c in islice(digests, step)), np.int64)
                        yield pa.RecordBatch.from_arrays([docs.slice(at, step), pa.array(starts[at : at + step]), pa.array(shard.lens[at : at + step]), pa.array(crcs)], names=names)

    n = max(1, index.count())
    return based.select("at", "file", "base").repartition(n, "at").mapInArrow(read, ", ".join(f"{c} long" for c in names))
