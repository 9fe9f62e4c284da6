"""Packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

Documents are tokenized where they are read and cut into pieces of at most `capacity` ids;
only the pieces' descriptions (a few numbers each) are shuffled.  All pieces of a document go to the group
that a hash of its row (partition and number there) gives it, so a group holds about `group_docs` documents
whatever their id, source, length or order, and groups don't depend on each other.  Spark sorts each
group's pieces by falling length and a Python worker places them one by one; it holds the tree of one group.

Nulls and ties: a null text is an empty one (its piece is the end id alone); a null id is kept as
null; repeated rows are packed as often as they occur, each in a group of its own drawing; columns other
than the id and the text are ignored.  An empty table gives no pieces.  A very long text is tokenized in
slices; what is held of it whole is its ids, at four bytes each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text
from .tokens import CACHE_BYTES, END_ID, blocks, crc32, tokenizer


class CapacityTree:
    """A tournament over bins: each match is won by the larger free capacity, so the leftmost
    bin that takes an item is found, and its new capacity played up again, in log2(bins) matches."""

    def __init__(self, capacity: int, bins: int = 256):
        self.capacity, self.bins, self.tree = capacity, bins, [capacity] * (2 * bins)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) of the first bin with room for `size`."""
        while self.tree[1] < size:
            self._grow()
        tree, at = self.tree, 1
        while at < self.bins:
            at *= 2
            if tree[at] < size:
                at += 1
        found, offset = at - self.bins, self.capacity - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
        return found, offset

    def _grow(self) -> None:
        leaves = self.tree[self.bins :] + [self.capacity] * self.bins
        self.bins *= 2
        self.tree = [0] * self.bins + leaves
        for at in range(self.bins - 1, 0, -1):
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = END_ID, keep_ids: bool = False, cache_bytes: int = CACHE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, doc_row (a number of the
    document's row) and ids, if kept."""
    fields = [pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_row")] + [pa.field("ids", pa.list_(pa.int32()))] * keep_ids
    schema = pa.schema(fields)

    def cut(batches):
        encode = tokenizer(tokenizer_path, cache_bytes).encode
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for first, run in blocks(texts):
                ids, lens = encode(run, end_id)
                n = -(-lens // capacity)  # every text has its end id, so one piece at least
                doc = np.repeat(np.arange(len(run)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(lens[doc] - start, capacity)
                at = np.concatenate([[0], np.cumsum(length)])
                crcs = [crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                columns = [names.slice(first, len(run)).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(lens[doc]), pa.array(row + doc)]
                row += len(run)
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return id_and_text(documents, id_col, text_col).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_row long" + ", ids array<int>" * keep_ids)


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = END_ID, group_docs: int = 8192, n_groups: int | None = None, seed: int = 1, keep_ids: bool = False, cache_bytes: int = CACHE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with the sequence_id they are packed into and their offset there.

    n_groups: by default the documents are counted for it, which for files costs their footers only.
    keep_ids: carry the ids along, for `sequences`.  cache_bytes: a smaller word cache saves memory in the
    workers, which then tokenize more slowly.
    """
    if n_groups is None:
        n_groups = max(1, math.ceil(documents.count() / group_docs))
    found = pieces(documents, tokenizer_path, capacity, end_id, keep_ids, cache_bytes, id_col, text_col)
    grouped = found.withColumn("_group", F.pmod(F.xxhash64("doc_row", F.lit(seed)), F.lit(n_groups)))
    # about the same amount of each group meets in each task; a task holds several groups
    sorted_ = grouped.repartition("_group").sortWithinPartitions("_group", F.desc("length"), "doc_row", "start")
    names = [c for c in grouped.columns if c not in ("doc_row", "_group")]
    schema = pa.schema([pa.field(n, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n in names] + [pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])

    def place(batches):
        group, tree = None, None
        for batch in batches:
            groups, sizes = batch.column("_group").to_pylist(), batch.column("length").to_pylist()
            bins, offsets = [0] * len(sizes), [0] * len(sizes)
            for i, size in enumerate(sizes):
                if groups[i] != group:
                    group, tree = groups[i], CapacityTree(capacity)
                bin_, offsets[i] = tree.place(size)
                bins[i] = (group << 32) + bin_
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], schema=schema)

    spec = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in [*names, "sequence_id", "offset"])
    return sorted_.mapInArrow(place, spec)


def sequences(packed: DataFrame, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """The sequences of pack(..., keep_ids=True): sequence_id, used and `capacity` ids.  A sequence
    whose ids number a power of two is not padded."""
    runs = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("runs"))
    ids = F.flatten(F.transform("runs", lambda r: r["ids"]))
    used = runs.select("sequence_id", ids.alias("ids")).withColumn("used", F.size("ids"))
    whole = (F.bit_count("used") == 1) | (F.col("used") >= capacity)
    return used.select("sequence_id", "used", F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), capacity - F.col("used")))).alias("ids"))
