"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a Hamming radius.

1. A worker makes each document's fingerprint; (doc_id, fingerprint) is written once.
2. Distinct fingerprints are dealt out by band keys: the 64 bits are cut into radius + 2 bands,
   and any two fingerprints within the radius agree on at least two of them, so each pair of bands
   is a key.  Keys held by one fingerprint only are dropped after a pre-aggregated count.
3. Within a key, fingerprints are compared bit-sliced: bit b of 64 fingerprints is one machine word
   of plane b; against a query each plane gives a word of differences, which carry-save counters
   add up for all 64 at once; words whose lanes all exceed the radius are abandoned.  A key gives the edges of its spanning forest, never its pairs.
4. A key with more than `most_in_key` fingerprints goes another exact way, without comparing its
   members: two fingerprints within distance 2 have a common point at distance 1 or less from
   both, so each is sent to itself and its 64 neighbours, where at most 65 can meet.
5. Components of the edges; a document's component is the least doc_id in it.

Nulls and ties: a null or wordless text has fingerprint zero and links like any other; exact
copies share a fingerprint, hence a component; a row with a null id keeps its fingerprint, and a
component's id is the least id that is not null; rows that repeat an id come out as often as they
occur.  An empty table gives no rows; columns other than id and text are ignored.  Of a very long
text a worker holds the words and hashes a bounded number of shingles at once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import id_and_text, scratch, written

#: 2^b for each bit, to spread a fingerprint over its planes.
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_MIXES = np.random.default_rng(7).integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z and \\x20 \\x09-\\x0D only
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 14):  # bounded memory for very long texts
        spans = zip(starts[at : at + (1 << 14)].tolist(), ends[at : at + (1 << 14)].tolist())
        hashes = np.array([xxh64_intdigest(whole[a:b], seed) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * counts > len(starts)].sum(dtype=np.uint64))


def fingerprints(documents: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the unsigned fingerprint as a signed long)."""

    def make(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(documents, id_col, text_col).mapInArrow(make, "doc_id long, fp long")


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of 64 * words bits, by as many mixes of each 64-bit hash."""
    counts, bits = np.zeros(64 * words, np.int64), np.zeros(words, np.uint64)
    for at in range(0, len(hashes), 128):
        mixed = hashes[at : at + 128, None] * _MIXES[:words]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        counts += np.unpackbits(mixed.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    if len(hashes):
        bits = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8").astype(np.uint64)
    return bits


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Plane b, word w: bit b of fingerprints 64w to 64w + 63, of an array (fingerprints, words of 64 bits)."""
    n, wide = fps.shape
    padded = np.zeros((-(-n // 64) * 64, wide), "<u8")
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _saved(a, b, c):
    """Carry-save addition of three bits in each lane: (sum, carry)."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def within(queries: np.ndarray, planes: np.ndarray, lanes: np.ndarray, radius: int):
    """Bit-sliced comparison: yields (query, word, lanes within the radius) arrays for a block of queries at a time.

    queries: (n, words of 64 bits); planes: of the fingerprints they are compared with; lanes: those in use in
    each word of a plane.  64 distances are added up at once, eight planes at a time, by carry-save counters that
    start where a distance over `radius` overflows; blocks all of whose lanes have overflowed are abandoned."""
    digits = max(3, int(radius).bit_length())
    offset = (1 << digits) - 1 - radius
    words = planes.shape[1]
    rows = max(1, (1 << 16) // max(1, words))
    for first in range(0, len(queries), rows):
        query, word = (x.ravel() for x in np.meshgrid(np.arange(first, min(len(queries), first + rows)), np.arange(words), indexing="ij"))
        full = ~np.uint64(0)
        count = [np.full(len(query), full if offset >> k & 1 else np.uint64(0)) for k in range(digits)]
        over = np.zeros(len(query), np.uint64)
        for b in range(0, len(planes), 8):
            bits = queries[query, b // 64] >> np.uint64(b % 64)
            d = [planes[b + k][word] ^ (np.uint64(0) - (bits >> np.uint64(k) & np.uint64(1))) for k in range(8)]
            count[0], two_a = _saved(count[0], d[0], d[1])
            count[0], two_b = _saved(count[0], d[2], d[3])
            count[1], four_a = _saved(count[1], two_a, two_b)
            count[0], two_a = _saved(count[0], d[4], d[5])
            count[0], two_b = _saved(count[0], d[6], d[7])
            count[1], four_b = _saved(count[1], two_a, two_b)
            count[2], carry = _saved(count[2], four_a, four_b)
            for k in range(3, digits):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if b % 64 == 56 or radius < 8:
                alive = (~over & lanes[word]) != 0
                if not alive.all():
                    query, word, over = query[alive], word[alive], over[alive]
                    count = [c[alive] for c in count]
                    if not len(query):
                        break
        if len(query):
            yield query, word, ~over & lanes[word]


def used_lanes(n: int) -> np.ndarray:
    """The lanes of n fingerprints in their words."""
    return np.packbits(np.arange(-(-n // 64) * 64) < n, bitorder="little").view("<u8").astype(np.uint64)


def near(fps: np.ndarray, radius: int) -> np.ndarray:
    """All fingerprints (of 64 bits) compared with each other: row i is a bitset of those within `radius` of i."""
    queries = fps.reshape(-1, 1)
    result = np.zeros((len(fps), -(-len(fps) // 64)), np.uint64)
    for query, word, hit in within(queries, bit_planes(queries), used_lanes(len(fps)), radius):
        result[query, word] = hit
    return result


def pairs_within(queries: np.ndarray, others: np.ndarray, radius: int):
    """(query, other) index arrays of the pairs within the radius."""
    for query, word, hit in within(queries, bit_planes(others), used_lanes(len(others)), radius):
        at, lane = np.nonzero(np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield query[at], 64 * word[at] + lane


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least member, member) of the components among `fps`, whose links are within radius."""
    linked = near(fps, radius)
    done, a, b = np.zeros(len(fps), bool), [], []
    for i in range(len(fps)):
        if done[i]:
            continue
        members, fresh = np.zeros(len(fps), bool), np.array([i])
        members[i] = True
        while len(fresh):
            reach = np.bitwise_or.reduce(linked[fresh], axis=0)
            now = np.unpackbits(reach.astype("<u8").view(np.uint8), bitorder="little")[: len(fps)].astype(bool)
            fresh = np.flatnonzero(now & ~members)
            members |= now
        done |= members
        own = np.sort(fps[members].view(np.int64))
        a.append(np.full(len(own) - 1, own[0]))
        b.append(own[1:])
    return np.concatenate(a), np.concatenate(b)


def _edges_within(batches, radius: int, block: int = 512):
    """Sorted (key, fp) rows to forest edges.  Small keys share a block of comparisons."""
    key, run, waiting, held = None, [], [], 0

    def edges():
        fps = np.unique(np.concatenate(waiting)).view(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(fps, radius)], names=["a", "b"])

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for part_key, part in zip(keys[np.concatenate([[0], cuts])] if len(keys) else (), np.split(fps, cuts)):
            if part_key != key and run:
                waiting, held, run = waiting + run, held + sum(map(len, run)), []
                if held >= block:
                    yield edges()
                    waiting, held = [], 0
            key = part_key
            run.append(part)
    waiting += run
    if waiting:
        yield edges()


def links(fps: DataFrame, radius: int = 2, most_in_key: int = 4096) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the distinct fingerprints `fp`."""
    if not 0 <= radius <= 2:
        raise ValueError("radius: 0, 1 or 2")
    n = radius + 2
    cuts = [round(64 * k / n) for k in range(n + 1)]
    band = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]
    pairs = list(combinations(range(n), 2))
    keys = F.array(*(F.xxhash64(F.lit(k), band[i], band[j]) for k, (i, j) in enumerate(pairs)))
    keyed = fps.select("fp", F.explode(keys).alias("key"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(counted, "key").select("key", "fp", "n"), "keyed")

    def compare(batches):
        yield from _edges_within(batches, radius)

    usual = met.where(F.col("n") <= most_in_key).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(compare, "a long, b long")
    # the exact way for larger keys
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(int(np.int64(np.uint64(1 << k).view(np.int64))))) for k in range(64)))
    points = met.where(F.col("n") > most_in_key).select("fp").distinct().select("fp", F.explode(around).alias("point"))
    if radius == 1:  # within 1 of each other: one is a point of the other
        stars = points.join(points.select(F.col("fp").alias("a")).distinct(), F.col("point") == F.col("a")).select("a", F.col("fp").alias("b")).where("a != b")
    else:
        stars = points.join(points.groupBy("point").agg(F.min("fp").alias("a")), "point").select("a", F.col("fp").alias("b")).where("a != b")
    return usual.union(stars) if radius else usual


def near_duplicates(documents: DataFrame, shingle: int = 3, radius: int = 2, most_in_key: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    with scratch(documents.sparkSession) as keep:
        docs = written(fingerprints(documents, shingle, id_col, text_col), "fingerprints")
        fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
        joined = components(links(fps.select("fp"), radius, most_in_key))
        named = joined.select(F.col("node").alias("fp"), "root").union(joined.select(F.col("root").alias("fp"), "root").distinct())
        with_ids = named.join(fps, "fp")
        least = with_ids.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = with_ids.join(least, "root").select("fp", "component_id")
        classes = written(fps.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
        keep(docs, classes)
    return docs.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
