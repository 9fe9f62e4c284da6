"""Substring dedup: every word that a repeated window of words covers goes, but for its first occurrence.

1. Workers hash each window of `window` words with two Rabin-Karp rolling hashes of independent bases (64
   bits each; words are hashed the same way over their bytes).  Of equal windows in a worker's batch
   only the first stands for the batch; the others are known to be repeats already, and go straight to the buckets of
   their documents.
2. The second hash's leading bits name a bucket.  A batch sends each bucket one packed row: 8 bytes a window, the first
   hash, plus its place (document and position), gap-coded.  A window in a third of all documents thus reaches its
   bucket once a batch, in one place.
3. A bucket's worker counts equal hashes and marks all but the earliest place of each, by document
   id, then position; the marks go, packed again, to buckets of documents.
4. There they meet the texts, and marked windows merge into maximal intervals, which are removed.

Sizes follow the table (`sizes_for`): buckets of 12 MB of text and batches of a million windows up to some 50 GB, then both grow to 64 MB
and eight million; beyond 2 TB windows go in two hops, first to 2^(bits - 12) coarse buckets (with 12 bits more each) and from there,
gathered into batches again, to their own.  So a row never holds fewer than some 250 windows of distinct texts, and a
hop costs 9 to 11.6 bytes a window at any size (ids in the files' order; up to 15 for ids at random).  There are at most 65,536 partitions, whose buckets are taken one after another.

A batch or bucket, not a key, is what a task holds; nothing is collected but the table's size.  Windows count as
equal if 64 bits and the bucket's own b are; the words behind them are not compared.  Of n different windows
n^2 / 2^(65 + b) pairs are expected to be taken for equal though they are not: 3e-5 of a pair for
a billion windows in 2^10 buckets, 12 for 3e13 windows (100 TB) in 2^21.

Nulls and ties: a null text has no words; texts shorter than a window lose nothing; a null id comes
before all others.  An id names one document: rows that repeat it share their marks, and windows at
the same position of it are not earlier than one another.  Empty tables give no rows; columns other
than id and text are ignored.  Of a very long text a worker holds the words and some 40 bytes a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text

_U = np.uint64
# odd, so each has an inverse mod 2^64
_BYTE_BASE, _WORD_BASE, _BUCKET_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407
#: Stands for a null id: less than any other.
NULL_ID = -(1 << 63)


class _Powers:
    """Powers of an odd base and of its inverse, mod 2^64, as many as were ever asked for."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 1 << 64))
        self.arrays = [np.ones(1, _U), np.ones(1, _U)]

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.arrays[0]) < n:
            for k, base in enumerate(self.bases):
                steps = np.full(n + n // 4, base, _U)
                steps[0] = 1
                self.arrays[k] = np.cumprod(steps, dtype=_U)
        return self.arrays[0][:n], self.arrays[1][:n]


_byte_powers, _word_powers, _bucket_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE), _Powers(_BUCKET_BASE)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Rabin-Karp hashes of values[start:end], each from two prefix sums."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up, out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes, text number and word position of every window of the texts, in order."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    text_of = np.searchsorted(text_ends, starts, "right")
    n = len(starts) - window + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int32)
    words = np.empty(len(starts), _U)
    # a megabyte of whole words at a time: the sums take several times a text's memory
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), 1 << 20)))
    for a, b in zip(cuts, [*cuts[1:], len(starts)]):
        if b > a:
            low, high = starts[a], ends[b - 1]
            words[a:b] = _rolled(data[low:high].astype(_U) + _U(1), starts[a:b] - low, ends[a:b] - low, _byte_powers)
    at = np.arange(n)
    hashes, keys = (_rolled(words, at, at + window, powers) for powers in (_word_powers, _bucket_powers))
    first_word = np.searchsorted(text_of, np.arange(len(texts)))
    whole = text_of[:n] == text_of[window - 1 :]
    of = text_of[:n][whole]
    return hashes[whole], keys[whole], of, (at[whole] - first_word[of]).astype(np.int32)


def _pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    import zstandard

    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    blob = zstandard.compress(np.ascontiguousarray(raw.T).tobytes(), 1)
    return np.array([len(values), len(blob)], "<u4").tobytes() + blob


def _unpack(blob: bytes, at: int, kind) -> tuple[np.ndarray, int]:
    import zstandard

    n, size = np.frombuffer(blob, "<u4", 2, at).tolist()
    raw = np.frombuffer(zstandard.decompress(blob[at + 8 : at + 8 + size]) if n else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).reshape(-1).view(kind) if n else np.empty(0, kind), at + 8 + size


def pack_places(docs: np.ndarray, positions: np.ndarray) -> bytes:
    """Places sorted by document, then position; runs of a document name it once."""
    first = np.concatenate([[True], docs[1:] != docs[:-1]]) if len(docs) else np.empty(0, bool)
    starts = np.flatnonzero(first)
    gaps = np.diff(positions, prepend=np.int32(0)).astype(np.int32)
    gaps[starts] = positions[starts]
    counts = np.diff(np.concatenate([starts, [len(docs)]])).astype(np.int32)
    return _pack(np.diff(docs[starts].view(_U), prepend=_U(0))) + _pack(counts) + _pack(gaps)


def unpack_places(blob: bytes, at: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    ids, at = _unpack(blob, at, _U)
    counts, at = _unpack(blob, at, np.int32)
    gaps, at = _unpack(blob, at, np.int32)
    starts = np.cumsum(counts) - counts
    sums = np.cumsum(gaps, dtype=np.int64)
    before = np.concatenate([[0], sums])[starts]
    return np.repeat(np.cumsum(ids).view(np.int64), counts), (sums - np.repeat(before, counts)).astype(np.int32), at


def xxhash64_of_long(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's xxhash64 gives for one bigint."""
    p1, p2, p3, p4, p5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x, r):
        return (x << _U(r)) | (x >> _U(64 - r))

    h = (_U(seed) + p5 + _U(8)) ^ (turn(values.astype(np.int64).view(_U) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> _U(33))) * p2
    h = (h ^ (h >> _U(29))) * p3
    return h ^ (h >> _U(32))


def _by_bucket(buckets: np.ndarray):
    """(bucket, indexes in order) of the buckets that occur."""
    order = np.argsort(buckets.astype(np.uint16) if len(buckets) and buckets.max() < 1 << 16 else buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(buckets[part[0]]), part


def sizes_for(size: int, bucket_bytes: int | None = None, batch_windows: int | None = None, single: int = 15) -> tuple[int, int, int]:
    """(bits of buckets, bits of coarse ones, windows of a batch) for so many bytes of text.  single: bits up to which
    batches go to the buckets in one hop."""
    bucket = bucket_bytes or min(max(size >> 12, 12 << 20), 64 << 20)
    bits = max(1, -(-size // bucket) - 1).bit_length()
    coarse = bits if bits <= single else max(1, bits - 12)
    return bits, coarse, batch_windows or min(max(250 << coarse, 1_000_000), 8_000_000)


def _send(hashes, keys, docs, positions, bits: int, doc_buckets: int, finer: int = 0):
    """(bucket, to, payload) rows of one batch of windows.  to = -1: places and hashes for the bucket, with `finer` bits
    more of each window's bucket; else places already known as repeats, on their way to the bucket `to` of documents,
    so to hash buckets drawn from those."""
    if (docs[1:] < docs[:-1]).any():  # texts come in any order of ids
        order = np.lexsort((positions, docs))
        hashes, keys, docs, positions = hashes[order], keys[order], docs[order], positions[order]
    by_hash = np.argsort(hashes, kind="stable")
    same = np.concatenate([[False], (hashes[by_hash][1:] == hashes[by_hash][:-1]) & (keys[by_hash][1:] == keys[by_hash][:-1])])
    first_of = by_hash[np.maximum.accumulate(np.where(same, 0, np.arange(len(by_hash))))]
    later = np.zeros(len(hashes), bool)
    later[by_hash] = same
    known = np.zeros(len(hashes), bool)  # a repeated row of the same id and position is no later one
    known[by_hash] = same & ((docs[by_hash] != docs[first_of]) | (positions[by_hash] != positions[first_of]))
    sent = np.flatnonzero(~later)
    buckets = (keys[sent] >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(sent), np.int64)
    for bucket, part in _by_bucket(buckets):
        part = sent[part]
        more = _pack(((keys[part] >> _U(64 - bits - finer)) & _U((1 << finer) - 1)).astype(np.uint16)) if finer else b""
        yield bucket, -1, pack_places(docs[part], positions[part]) + more + hashes[part].astype("<u8").tobytes()
    marked = np.flatnonzero(known)
    for to, payload in _marks(docs[marked], positions[marked], doc_buckets):
        yield to & ((1 << bits) - 1), to, payload


def _marks(docs, positions, doc_buckets: int):
    """(bucket of documents, payload) of marked places, which are sorted."""
    to = (xxhash64_of_long(docs) & _U(doc_buckets - 1)).astype(np.int64)
    for bucket, part in _by_bucket(to):
        yield bucket, pack_places(docs[part], positions[part])


def _received(payload: bytes, bucket: int, bits: int, finer: int = 0):
    """(hashes, keys as far as they are known, docs, positions) of a row."""
    docs, positions, at = unpack_places(payload)
    keys = np.full(len(docs), bucket << (64 - bits) if bits else 0, _U)
    if finer:
        more, at = _unpack(payload, at, np.uint16)
        keys |= more.astype(_U) << _U(64 - bits - finer)
    return np.frombuffer(payload, "<u8", len(docs), at), keys, docs, positions


def _later(hashes, docs, positions) -> np.ndarray:
    """True where the same hash stands at an earlier place."""
    by_hash = np.argsort(hashes, kind="stable")
    equal = hashes[by_hash][1:] == hashes[by_hash][:-1]
    some = np.zeros(len(hashes), bool)
    some[by_hash[1:][equal]] = True
    some[by_hash[:-1][equal]] = True
    at = np.flatnonzero(some)
    at = at[np.lexsort((positions[at], docs[at], hashes[at]))]
    fresh = np.concatenate([[True], hashes[at][1:] != hashes[at][:-1]]) if len(at) else np.empty(0, bool)
    first = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))] if len(at) else at
    result = np.zeros(len(hashes), bool)
    result[at] = (docs[at] != docs[first]) | (positions[at] != positions[first])
    return result


def intervals(positions: np.ndarray, window: int) -> np.ndarray:
    """Maximal [start, end) of the words that windows at these positions cover."""
    positions = np.unique(positions)
    if not len(positions):
        return np.empty((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(positions) > window)
    return np.stack([positions[np.concatenate([[0], cut + 1])], positions[np.concatenate([cut, [-1]])] + window], axis=1)


def remove_repeats(documents: DataFrame, window: int = 20, batch_windows: int | None = None, bucket_bytes: int | None = None, single: int = 15, most_partitions: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, the removed word intervals and the kept text
    (its words joined by single spaces).

    A worker holds `batch_windows` windows, or a bucket: some 50 bytes for each of its windows, of which
    12 MB of text have two million.  Both follow the table's size unless they are given; single: as in sizes_for.
    """
    docs = id_and_text(documents, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, coarse, batch_windows = sizes_for(size, bucket_bytes, batch_windows, single)
    # a bucket of hashes sends each bucket of documents at most one row
    doc_buckets = 1 << max(1, bits - 1)
    rows = pa.schema([("bucket", pa.int32()), ("to", pa.int32()), ("payload", pa.binary())])
    spec = "bucket int, to int, payload binary"

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), rows)], schema=rows)

    def hash_windows(batches):
        held: list[tuple] = []
        count = 0

        def flush():
            return batch_of(list(_send(*(np.concatenate(x) for x in zip(*held)), coarse, doc_buckets, bits - coarse)))

        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            texts, first, size = [], 0, 0
            column = batch.column(1)
            for i in range(len(ids)):
                texts.append((column[i].as_py() or "").encode())
                size += len(texts[-1])
                if size > 2_000_000 or i + 1 == len(ids):
                    hashes, keys, of, positions = windows(texts, window)
                    held.append((hashes, keys, ids[first + of], positions))
                    count += len(hashes)
                    texts, first, size = [], i + 1, 0
                    if count >= batch_windows:
                        yield flush()
                        held, count = [], 0
        if count:
            yield flush()

    def each(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "to", "payload")))

    def send_on(batches):
        """From coarse buckets to buckets, in batches of windows again."""
        held: list[tuple] = []
        count = 0

        def flush():
            return batch_of(list(_send(*(np.concatenate(x) for x in zip(*held)), bits, doc_buckets)))

        for bucket, to, payload in each(batches):
            if to >= 0:
                yield batch_of([(to, to, payload)])  # fewer buckets of documents than of hashes
                continue
            held.append(_received(payload, bucket, coarse, bits - coarse))
            count += len(held[-1][0])
            if count >= batch_windows:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    def mark(batches):
        held: list[tuple] = []
        last = None

        def flush():
            hashes, _, ids, positions = (np.concatenate(x) for x in zip(*held))
            late = _later(hashes, ids, positions)
            order = np.lexsort((positions[late], ids[late]))
            return [(to, to, payload) for to, payload in _marks(ids[late][order], positions[late][order], doc_buckets)]

        for bucket, to, payload in each(batches):
            if held and bucket != last:
                if found := flush():
                    yield batch_of(found)
                held = []
            last = bucket
            if to >= 0:
                yield batch_of([(to, to, payload)])
            else:
                held.append(_received(payload, bucket, bits))
        if held and (found := flush()):
            yield batch_of(found)

    def cut(batches):
        marks: dict[int, np.ndarray] = {}
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        last = None
        for batch in batches:
            ids, texts, payloads = batch.column("doc_id"), batch.column("text"), batch.column("payload")
            names, out = ids.to_pylist(), []
            for i, (bucket, payload) in enumerate(zip(batch.column("bucket").to_pylist(), payloads)):
                if bucket != last:
                    marks, waiting, last = {}, [], bucket
                if payload.is_valid:  # all marks of a bucket come before its documents
                    waiting.append(unpack_places(payload.as_py())[:2])
                    continue
                if waiting:
                    of, positions = (np.concatenate(x) for x in zip(*waiting))
                    order = np.argsort(of, kind="stable")
                    of, positions = of[order], positions[order]
                    edges = np.flatnonzero(np.diff(of)) + 1
                    marks = dict(zip(of[np.concatenate([[0], edges])].tolist(), np.split(positions, edges)))
                    waiting = []
                words = (texts[i].as_py() or "").encode().split()
                found = marks.get(NULL_ID if names[i] is None else names[i])
                spans = intervals(found[found + window <= len(words)], window) if found is not None else ()
                kept, at, removed = [], 0, []
                for a, b in spans:
                    kept += words[at:a]
                    removed.append({"start": int(a), "end": int(b)})
                    at = int(b)
                kept += words[at:]
                out.append((names[i], len(words), len(words) - len(kept), removed, b" ".join(kept).decode()))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()))], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    def dealt(df: DataFrame, buckets: int, *order: str) -> DataFrame:
        """A partition for each bucket, or for several, which then come one after another."""
        parts = min(buckets, most_partitions)
        spread = df.repartitionById(parts, "bucket" if parts == buckets else F.pmod("bucket", F.lit(parts)))
        return spread.sortWithinPartitions("bucket", *order) if parts < buckets or order else spread

    sent = docs.mapInArrow(hash_windows, spec)
    if coarse < bits:
        sent = dealt(sent, 1 << coarse).mapInArrow(send_on, spec)
    marked = dealt(sent, 1 << bits).mapInArrow(mark, spec).select("bucket", "payload")
    own = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(NULL_ID))), F.lit(doc_buckets)).cast("int")
    both = docs.select(own.alias("bucket"), F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("payload")).unionByName(marked.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    met = dealt(both, doc_buckets, "kind")
    return met.mapInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string")
