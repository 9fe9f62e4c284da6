"""Phrase collocations: word runs that stand together more often than their parts would by chance.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words `[^\\x20\\x09]+`; phrases are
runs of 2 to `longest` words of one piece.  Everything is counted per language.

1. Every word of every language is counted.  A word's 64-bit hash stands for it from here on; the counted words tell
   that no two share one (else all is done again with another seed), so runs of hashes are exact.
2. Phrases that could be frequent enough: executors count the hashes of all runs of frequent words in up to 2^`most_bits`
   buckets (a packed row for each block of buckets and batch).  A run's bucket holds at least its own count,
   so a run is a candidate only if its bucket and those of all its parts reach `min_count`: no frequent phrase is lost.
3. Executors send the candidates that they meet as hashes and word hashes, each about once a task and packed in a row for
   each shard of the hash range.  A shard's task merges them as they arrive and builds a minimal perfect hash of the
   distinct ones: levels of bit arrays, which give n keys the slots 0 to n - 1 in about 3 bits a key.  Beside each slot
   stands its key, the run of word hashes, against which every lookup is verified.
4. Mappers look all runs with live buckets up, `bincount` their slots, and the arrays are summed in a tree: first in
   groups of tasks, then by shard.
5. The counts of a frequent phrase's parts, for each cut, are read by slot; its text is put together from the counted words.

Memory: a task holds the bitmaps (2^`most_bits` bits for each length) and the shards of one pass (some 55 bytes a
slot); more than `most_slots` candidates are counted in several passes over the texts, so the bound holds at any size.  Texts are cut
after a separator, a megabyte at a time; a longer stretch without any separator is held whole.

Nulls and ties: a null text has no words, a null language counts as `und` (together with a language of that
name); a repeated row counts as often as it occurs; of cuts with equal scores the first counts; ranks are settled by
score, count, then the phrase's bytes.  An empty table, or one without a frequent phrase, gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from hashlib import blake2b
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsieve.operators.positions import numbered_within

from .shared import scratch, store, written
from .substrings import _mix, _Powers, _rolled

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)
#: Buckets of one packed row, and candidates of a shard (about).
BLOCK_BITS, SHARD = 20, 1 << 17
#: Bits of the table that tells frequent words from others.
WORD_BITS = 24

_WHITE, _SEPARATORS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: 0: part of a word, 1: white, 2: separator
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(_WHITE)] = 1
_KINDS[list(_SEPARATORS)] = 2
_TO_SPACES = bytes.maketrans(_WHITE + _SEPARATORS, b" " * (len(_WHITE) + len(_SEPARATORS)))


class Collision(Exception):
    """Two words or phrases share a hash."""


def _language(name: str, seed: int) -> int:
    return int.from_bytes(blake2b(name.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


class _Hasher:
    """Hashes of words of a language, and of runs of words."""

    def __init__(self, seed: int):
        self.seed = seed
        self.powers = _Powers((0x9E3779B97F4A7C15 + 0x51ED2700 * seed) | 1)
        self.languages: dict[str, int] = {}

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, language: np.ndarray) -> np.ndarray:
        hashes = np.empty(len(starts), _U)
        # a megabyte of whole words at a time: the sums take several times a text's memory
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), 1 << 20)))
        for a, b in zip(cuts, [*cuts[1:], len(starts)]):
            if b > a:
                low, high = starts[a], ends[b - 1]
                hashes[a:b] = _rolled(data[low:high].astype(_U) + _U(1), starts[a:b] - low, ends[a:b] - low, self.powers)
        return np.maximum(_mix(hashes ^ language), _U(1))  # 0 stands for no word

    def language(self, names: list[str]) -> np.ndarray:
        for name in set(names) - self.languages.keys():
            self.languages[name] = _language(name, self.seed)
        return np.array([self.languages[n] for n in names], _U)


def longer(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs with one more word."""
    return _mix(run * _STEP + word)


def _chunks(text: bytes, size: int = 1 << 20):
    """A text in parts that end after a separator."""
    at = 0
    while len(text) - at > size:
        ends = np.flatnonzero(_KINDS[np.frombuffer(text, np.uint8, -1, at + size)[: 1 << 16]] == 2)
        if not len(ends):
            ends = np.flatnonzero(_KINDS[np.frombuffer(text, np.uint8, -1, at + size)] == 2)
        if not len(ends):
            break
        to = at + size + int(ends[0]) + 1
        yield text[at:to]
        at = to
    yield text[at:]


def _groups(batches, size: int = 2 << 20):
    """(languages, texts) of a few megabytes each."""
    names, texts, held = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part in _chunks((text.as_py() or "").encode()):
                names.append(lang)
                texts.append(part)
                held += len(part)
                if held >= size:
                    yield names, texts
                    names, texts, held = [], [], 0
    if texts:
        yield names, texts


class _Runs:
    """The words of a group of texts: bytes, edges, hashes and pieces."""

    def __init__(self, names: list[str], texts: list[bytes], hasher: _Hasher):
        joined = b"\n".join(texts).lower() + b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        kinds = _KINDS[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], kinds == 0]).view(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        of = np.searchsorted(text_ends, self.starts, "right")
        self.words = hasher.words(self.data, self.starts, self.ends, hasher.language(names)[of])
        self.pieces = np.searchsorted(np.flatnonzero(kinds == 2), self.starts)

    def within(self, k: int) -> np.ndarray:
        """Whether the run of k words from each place lies in one piece."""
        n = len(self.words) - k + 1
        return self.pieces[:n] == self.pieces[k - 1 :] if n > 0 else np.empty(0, bool)

    def candidates(self, word_bits: np.ndarray, live: list[np.ndarray], bits: int, longest: int):
        """(k, places, hashes) of the runs whose bucket and whose parts' buckets are live, for each length."""
        hashes = self.words
        alive = _bit(word_bits, hashes >> _U(64 - WORD_BITS))
        yield 1, np.flatnonzero(alive), hashes[alive]
        for k in range(2, longest + 1):
            if len(hashes) < 2:
                return
            hashes = longer(hashes[:-1], self.words[k - 1 :])
            alive = alive[:-1] & alive[1:] & self.within(k)
            if live:
                at = np.flatnonzero(alive)
                alive[at] = _bit(live[k - 2], hashes[at] >> _U(64 - bits))
            at = np.flatnonzero(alive)
            yield k, at, hashes[at]


def _bit(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _packed(array: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _unpacked(blob: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(blob), kind)


# ---- tables that every task reads from the shared folder

_HELD: dict[str, object] = {}


def _rows_of(folder: str, columns: list[str]):
    """Rows of a Parquet folder that Spark has written, read by a worker."""
    import pyarrow.parquet as pq

    files, at = store(folder)
    from pyarrow import fs

    for info in sorted(files.get_file_info(fs.FileSelector(at)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            for batch in pq.ParquetFile(files.open_input_file(info.path)).iter_batches(64, columns=columns):
                yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _held(key: str, make):
    """What the last task of this worker has read, if it is the same; one thing of a kind is kept."""
    kind = key.split("|", 1)[0]
    if key not in _HELD:
        for old in [k for k in _HELD if k.startswith(kind + "|")]:
            del _HELD[old]
        _HELD[key] = make()
    return _HELD[key]


def _bitmaps(folder: str, levels: int, bits: int) -> list[np.ndarray]:
    tables = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(levels)]
    for level, block, blob in _rows_of(folder, ["level", "block", "bits"]):
        part = _unpacked(blob, np.uint8)
        tables[level][block * len(part) : (block + 1) * len(part)] = part
    return tables


# ---- minimal perfect hash


def _level(keys: np.ndarray, level: int) -> np.ndarray:
    """Other hashes of the keys for each level."""
    return _mix(keys + _U(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))


def build_slots(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(bits of all levels, sizes of the levels) of a minimal perfect hash of distinct keys.  A key stands at the
    first level at which it is alone in its place; its slot is the number of set bits before it."""
    left, sizes, tables = keys, [], []
    while len(left):
        if len(sizes) > 64:
            raise Collision
        size = -(-2 * len(left) // 64) * 64
        place = (_level(left, len(sizes)) % _U(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        tables.append(np.packbits(alone, bitorder="little"))
        left = left[~alone[place]]
    return (np.concatenate(tables) if tables else np.empty(0, np.uint8)).view(_U), sizes


class Slots:
    """Lookup of keys in the perfect hashes of several shards; slots are numbered through."""

    def __init__(self, shards: list[tuple[int, np.ndarray, list[int]]], shard_bits: int):
        """shards: (number, bits, level sizes) in order; others count as absent."""
        self.shard_bits = shard_bits
        levels = max((len(s[2]) for s in shards), default=0)
        self.row = np.full(1 << shard_bits, -1, np.int32)
        self.sizes = np.zeros((len(shards), levels), _U)
        self.offsets = np.zeros((len(shards), levels), np.int64)
        at = 0
        for i, (number, _, sizes) in enumerate(shards):
            self.row[number] = i
            for j, size in enumerate(sizes):
                self.sizes[i, j], self.offsets[i, j] = size, at
                at += size // 64
        self.bits = np.concatenate([s[1] for s in shards]) if shards else np.empty(0, _U)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key, -1 where certainly none; a slot's own key has to be compared."""
        found = np.full(len(keys), -1, np.int64)
        row = self.row[(keys >> _U(64 - self.shard_bits)).astype(np.int64)] if self.shard_bits else np.full(len(keys), self.row[0])
        open_ = np.flatnonzero(row >= 0)
        for level in range(self.sizes.shape[1]):
            size = self.sizes[row[open_], level]
            open_, size = open_[size > 0], size[size > 0]
            if not len(open_):
                break
            place = _level(keys[open_], level) % size
            word = self.offsets[row[open_], level] + (place >> _U(6)).astype(np.int64)
            shift = place & _U(63)
            held = self.bits[word]
            hit = (held >> shift) & _U(1) == 1
            at = word[hit]
            found[open_[hit]] = self.before[at] + np.bitwise_count(held[hit] & ((_U(1) << shift[hit]) - _U(1)))
            open_ = open_[~hit]
        return found


class _Candidates:
    """The shards of one pass: slots, and beside each slot its key."""

    def __init__(self, folder: str, shards: list[int], shard_bits: int, longest: int):
        wanted, parts = set(shards), {}
        for number, bits, sizes, keys in _rows_of(folder, ["shard", "bits", "sizes", "keys"]):
            if number in wanted:
                parts[number] = (np.frombuffer(bits, _U), sizes, np.frombuffer(keys, _U).reshape(-1, longest + 1))
        numbers = sorted(parts)
        self.slots = Slots([(s, parts[s][0], parts[s][1]) for s in numbers], shard_bits)
        self.keys = np.concatenate([parts[s][2] for s in numbers]) if numbers else np.empty((0, longest + 1), _U)
        self.numbers, self.edges = numbers, np.cumsum([0, *(len(parts[s][2]) for s in numbers)])

    def find(self, hashes: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        """The verified slots of runs, -1 for runs that are none of these candidates; words: of each place in the run."""
        slots = self.slots(hashes)
        at = np.flatnonzero(slots >= 0)
        stored = self.keys[slots[at]]
        meant = stored[:, 0] == hashes[at]
        same = meant.copy()
        for j, column in enumerate(words):
            same &= stored[:, j + 1] == column[at]
        for j in range(len(words), stored.shape[1] - 1):
            same &= stored[:, j + 1] == 0
        if (meant & ~same).any():
            raise Collision
        slots[at[~same]] = -1
        return slots


# ---- steps


def _words(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, n, h) of every word of every language."""

    def count(batches):
        hasher, counted = _Hasher(seed), {}

        def flush():
            for lang, words in counted.items():
                if not (names := list(words)):
                    continue
                ends = np.cumsum([len(w) + 1 for w in names])
                data = np.frombuffer(b" ".join(names) + b" ", np.uint8)
                starts = np.concatenate([[0], ends[:-1]])
                hashes = hasher.words(data, starts, ends - 1, np.repeat(hasher.language([lang]), len(names)))
                for a in range(0, len(names), 50_000):
                    some = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names[some]), pa.string()), pa.array([w.decode() for w in names[some]], pa.string()), pa.array([words[w] for w in names[some]], pa.int64()), pa.array(hashes[some].view(np.int64), pa.int64())], names=["lang", "word", "n", "h"])
            counted.clear()

        for names, texts in _groups(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(names, texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, some in by_lang.items():
                counted.setdefault(lang, Counter()).update(b"\n".join(some).lower().translate(_TO_SPACES).split(b" "))
                counted[lang].pop(b"", None)
            if sum(map(len, counted.values())) > 500_000:
                yield from flush()
        yield from flush()

    parts = docs.mapInArrow(count, "lang string, word string, n long, h long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.first("h").alias("h"))


def _word_bits(words: DataFrame, min_count: int) -> DataFrame:
    """The bitmap of frequent words' hashes, in blocks (level 0)."""
    at = F.shiftrightunsigned("h", 64 - WORD_BITS)
    set_ = words.where(F.col("n") >= min_count).select(F.shiftright(at, BLOCK_BITS).cast("int").alias("block"), at.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("at")).distinct()

    def pack(key, table):
        on = np.zeros(1 << BLOCK_BITS, bool)
        on[table.column("at").to_numpy()] = True
        return pa.table([pa.array([0], pa.int32()), pa.array([key[0].as_py()], pa.int32()), pa.array([_packed(np.packbits(on, bitorder="little"))], pa.binary())], names=["level", "block", "bits"])

    return set_.groupBy("block").applyInArrow(pack, "level int, block int, bits binary")


def _live_bits(docs: DataFrame, word_folder: str, seed: int, bits: int, longest: int, min_count: int, most_places: int = 2_000_000) -> DataFrame:
    """The bitmaps of buckets that reach min_count, a row for each length (level k - 2) and block, and how many do."""
    block_bits = min(bits, BLOCK_BITS)
    lengths = range(2, longest + 1)

    def send(k: int, buckets: np.ndarray):
        """A row for each block: its buckets in order, as gaps, and their counts."""
        buckets, counts = np.unique(buckets, return_counts=True)
        cuts = np.flatnonzero(np.diff(buckets >> _U(block_bits))) + 1
        for a, b in zip([0, *cuts], [*cuts, len(buckets)]):
            at = (buckets[a:b] & _U((1 << block_bits) - 1)).astype(np.uint32)
            yield k - 2, int(buckets[a]) >> block_bits, _packed(np.diff(at, prepend=np.uint32(0))), _packed(np.minimum(counts[a:b], np.iinfo(np.uint32).max).astype(np.uint32))

    def rows(found):
        columns = list(zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["level", "block", "gaps", "counts"])

    def count(batches):
        hasher, word_bits = _Hasher(seed), _held(f"words|{word_folder}", lambda: _bitmaps(word_folder, 1, WORD_BITS)[0])
        held: dict[int, list[np.ndarray]] = {k: [] for k in lengths}
        n = 0

        def flush():
            for k in lengths:
                if held[k] and (found := list(send(k, np.concatenate(held[k])) if sum(map(len, held[k])) else ())):
                    yield rows(found)
                held[k] = []

        for names, texts in _groups(batches):
            runs = _Runs(names, texts, hasher)
            for k, _, hashes in runs.candidates(word_bits, [], bits, longest):
                if k > 1 and len(hashes):
                    held[k].append(hashes >> _U(64 - bits))
            n += len(runs.words)
            if n >= most_places:
                yield from flush()
                n = 0
        yield from flush()

    def live(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for level, block, gaps, counts in zip(*(batch.column(c).to_pylist() for c in ("level", "block", "gaps", "counts"))):
                total = sums.setdefault((level, block), np.zeros(1 << block_bits, np.uint32))
                at, more = np.cumsum(_unpacked(gaps, np.uint32)), _unpacked(counts, np.uint32)
                # enough is enough: sums stop growing before they could overflow
                total[at] = np.minimum(total[at] + np.minimum(more, min_count), min_count)
        found = [(level, block, int((total >= min_count).sum()), _packed(np.packbits(total >= min_count, bitorder="little"))) for (level, block), total in sums.items()]
        if found:
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["level", "block", "n", "bits"])

    counted = docs.mapInArrow(count, "level int, block int, gaps binary, counts binary")
    # a partition for each block of each length: a task sums at most a few arrays of 4 MB
    return counted.repartition(max(1, (longest - 1) << (bits - block_bits)), "level", "block").mapInArrow(live, "level int, block int, n long, bits binary")


def _rows_sent(parts: list[np.ndarray]) -> bytes:
    """Candidates of each length, packed: how many there are, then hash and words of each (a single word is its hash)."""
    return _packed(np.concatenate([np.array([len(p) for p in parts], _U), *(p.reshape(-1) for p in parts)]))


def _rows_received(blob: bytes, longest: int) -> np.ndarray:
    """Hash and words, with 0 for no word, of the candidates in what `_rows_sent` gave."""
    flat = _unpacked(blob, _U)
    sizes, at, done = flat[:longest].astype(np.int64), longest, 0
    rows = np.zeros((int(sizes.sum()), longest + 1), _U)
    for k, n in enumerate(sizes.tolist(), 1):
        width = k + 1 if k > 1 else 1
        rows[done : done + n, :width] = flat[at : at + n * width].reshape(n, width)
        if k == 1:
            rows[done : done + n, 1] = rows[done : done + n, 0]
        at, done = at + n * width, done + n
    return rows


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The rows of all parts by hash, each hash once; two runs of one hash are told."""
    whole = np.concatenate(parts)
    whole = whole[np.argsort(whole[:, 0])]
    again = whole[1:, 0] == whole[:-1, 0]
    if (whole[1:][again] != whole[:-1][again]).any():
        raise Collision
    return whole[np.concatenate([[True], ~again])] if len(whole) else whole


def _candidate_rows(docs: DataFrame, word_folder: str, live_folder: str, seed: int, bits: int, longest: int, shard_bits: int, most_seen: int = 500_000) -> DataFrame:
    """(shard, payload): hashes and words of the candidates that a task has met, each about once, packed by shard.
    Their texts come from the counted words, for frequent phrases only."""

    def find(batches):
        hasher, word_bits = _Hasher(seed), _held(f"words|{word_folder}", lambda: _bitmaps(word_folder, 1, WORD_BITS)[0])
        live = _held(f"live|{live_folder}", lambda: _bitmaps(live_folder, longest - 1, bits))
        seen: dict[int, list[np.ndarray]] = {k: [] for k in range(1, longest + 1)}
        fresh = kept = 0

        def merged(k):
            whole = np.concatenate(seen[k]) if seen[k] else np.empty((0, k + 1 if k > 1 else 1), _U)
            return whole[np.unique(whole[:, 0], return_index=True)[1]]

        def flush():
            found = [merged(k) for k in seen]
            edges = np.arange(1, 1 << shard_bits, dtype=_U) << _U(64 - shard_bits) if shard_bits else np.empty(0, _U)
            cuts = [[0, *np.searchsorted(f[:, 0], edges).tolist(), len(f)] for f in found]
            for number in range(1 << shard_bits):
                some = [f[c[number] : c[number + 1]] for f, c in zip(found, cuts)]
                if any(map(len, some)):
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([_rows_sent(some)], pa.binary())], names=["shard", "payload"])
            for parts in seen.values():
                parts.clear()

        for names, texts in _groups(batches):
            runs = _Runs(names, texts, hasher)
            for k, at, hashes in runs.candidates(word_bits, live, bits, longest):
                once, first = np.unique(hashes, return_index=True)
                at = at[first]
                seen[k].append(np.stack([once, *(runs.words[at + j] for j in range(k if k > 1 else 0))], 1))
                fresh += len(once)
            if fresh > most_seen:
                seen = {k: [merged(k)] for k in seen}
                fresh, kept = 0, sum(len(p) for parts in seen.values() for p in parts)
                if kept > most_seen:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(find, "shard int, payload binary")


def _shards(packed: DataFrame, longest: int, shard_bits: int) -> DataFrame:
    """(shard, n, bits, sizes, keys): the perfect hash of each shard's distinct candidates, and by slot their keys.

    What tasks have sent is merged as it arrives, so a shard's task holds a few times its distinct candidates."""

    def build(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for number, payload in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist()):
                parts = held.setdefault(number, [])
                parts.append(_rows_received(payload, longest))
                if len(parts) > 1 and sum(map(len, parts[1:])) > 2 * len(parts[0]) + SHARD:
                    held[number] = [_distinct(parts)]
        for number in list(held):
            rows = _distinct(held.pop(number))
            bits, sizes = build_slots(rows[:, 0])
            keys = np.empty_like(rows)
            keys[Slots([(0, bits, sizes)], 0)(rows[:, 0])] = rows
            columns = ([number], [len(rows)], [bits.tobytes()], [sizes], [keys.tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()))], names=["shard", "n", "bits", "sizes", "keys"])

    return packed.repartition(1 << shard_bits, "shard").mapInArrow(build, "shard int, n long, bits binary, sizes array<long>, keys binary")


def _slot_counts(docs: DataFrame, word_folder: str, live_folder: str, shard_folder: str, shards: list[int], shard_bits: int, seed: int, bits: int, longest: int, fan: int = 32) -> DataFrame:
    """(shard, counts): occurrences by slot, summed in a tree of tasks."""
    spec = "shard int, counts binary"

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([_packed(c) for _, c in found], pa.binary())], names=["shard", "counts"])

    def count(batches):
        hasher, word_bits = _Hasher(seed), _held(f"words|{word_folder}", lambda: _bitmaps(word_folder, 1, WORD_BITS)[0])
        live = _held(f"live|{live_folder}", lambda: _bitmaps(live_folder, longest - 1, bits))
        table = _held(f"shards|{shard_folder}|{shards[0]}-{shards[-1]}", lambda: _Candidates(shard_folder, shards, shard_bits, longest))
        total, held, n = np.zeros(len(table.keys), np.int64), [], 0
        for names, texts in _groups(batches):
            runs = _Runs(names, texts, hasher)
            for k, at, hashes in runs.candidates(word_bits, live, bits, longest):
                slots = table.find(hashes, [runs.words[at + j] for j in range(k)])
                held.append(slots[slots >= 0])
                n += len(held[-1])
            if n >= 2_000_000:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        for i, number in enumerate(table.numbers):
            part = total[table.edges[i] : table.edges[i + 1]]
            if part.any():
                yield rows([(number, part)])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, blob in zip(batch.column("shard").to_pylist(), batch.column("counts").to_pylist()):
                part = _unpacked(blob, np.int64)
                sums[number] = sums[number] + part if number in sums else part
        for found in sums.items():
            yield rows([found])

    leaves = docs.mapInArrow(count, spec).withColumn("leaf", F.pmod(F.spark_partition_id(), F.lit(fan)))
    n = max(1, min(len(shards), 4096))
    return leaves.repartition(n * fan, "shard", "leaf").select("shard", "counts").mapInArrow(add, spec).repartition(n, "shard").mapInArrow(add, spec)


def _parts_by_slot(shards: DataFrame, every_count: DataFrame, counts_folder: str, some: list[int], shard_bits: int, longest: int, min_count: int) -> DataFrame:
    """(h, words, parts): of each frequent phrase its hash, its words' hashes, and the counts of itself and of the left
    and right part of each cut, -1 for those that the shards `some` don't hold."""

    shard_folder = shards._tarnsieve_folder

    def tables():
        table = _Candidates(shard_folder, some, shard_bits, longest)
        counts = np.zeros(len(table.keys), np.int64)
        place = {s: i for i, s in enumerate(table.numbers)}
        for number, blob in _rows_of(counts_folder, ["shard", "counts"]):
            if number in place:
                counts[table.edges[place[number]] : table.edges[place[number] + 1]] = _unpacked(blob, np.int64)
        return table, counts

    def lists(columns: list[np.ndarray]) -> pa.ListArray:
        n, width = len(columns[0]), len(columns)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(np.stack(columns, 1).reshape(-1).view(np.int64), pa.int64()))

    def read(batches):
        table, counts = _held(f"counts|{counts_folder}|{some[0]}-{some[-1]}", tables)
        for batch in batches:
            for keys, own in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts"))):
                keys, own = np.frombuffer(keys, _U).reshape(-1, longest + 1), _unpacked(own, np.int64)
                lengths = (keys[:, 1:] != 0).sum(1)
                for k in range(2, longest + 1):
                    at = np.flatnonzero((lengths == k) & (own >= min_count))
                    if not len(at):
                        continue
                    words, found = keys[at, 1 : k + 1], []
                    for a, b in [(0, k), *(edges for cut in range(1, k) for edges in ((0, cut), (cut, k)))]:
                        hashes = words[:, a].copy()
                        for j in range(a + 1, b):
                            hashes = longer(hashes, words[:, j])
                        slots = table.find(hashes, [words[:, j] for j in range(a, b)])
                        found.append(np.where(slots >= 0, counts[slots], -1))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at, 0].view(np.int64)), lists([words[:, j] for j in range(k)]), lists(found)], names=["h", "words", "parts"])

    return shards.select("shard", "keys").join(every_count, "shard").select("keys", "counts").mapInArrow(read, "h long, words array<long>, parts array<long>")


def _named(found: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, k, parts): phrases with the texts of their words; a language's words have hashes of their own."""
    texts = words.where(F.col("n") >= min_count).select(F.col("h").alias("word_h"), "lang", "word")
    each = found.select("h", F.posexplode("words").alias("at", "word_h")).join(texts, "word_h")
    named = each.groupBy("h").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("of"))
    return named.join(found.select("h", F.size("words").alias("k"), "parts"), "h").select("lang", F.array_join(F.col("of.word"), " ").alias("phrase"), "k", "parts")


def _mined(docs: DataFrame, min_count: int, longest: int, most_bits: int, most_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(frequent phrases with the counts of their parts, n of each language), both written."""
    words = written(_words(docs, seed), "phrase-words")
    if not words.groupBy("h").count().where("count > 1").isEmpty():
        raise Collision
    sizes = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-languages")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    bits = min(max(ceil(log2(max(n, 1) / 4)), 16), most_bits)
    word_folder = written(_word_bits(words, min_count), "phrase-word-bits")._tarnsieve_folder
    live = written(_live_bits(docs, word_folder, seed, bits, longest, min_count), "phrase-live-bits")
    live_folder = live._tarnsieve_folder
    # a live bucket holds a frequent phrase, or several, or none: twice as many candidates, with the frequent words
    expected = 2 * (live.agg(F.sum("n")).first()[0] or 0) + words.where(F.col("n") >= min_count).count()
    shard_bits = max(0, ceil(log2(max(expected, 1) / SHARD)))
    shards = written(_shards(_candidate_rows(docs, word_folder, live_folder, seed, bits, longest, shard_bits), longest, shard_bits), "phrase-shards")
    # passes: neighbouring shards of at most most_slots candidates together; a row for each 131,072 candidates
    passes, held = [], 0
    for number, size in sorted((r["shard"], r["n"]) for r in shards.select("shard", "n").collect()):
        if not passes or held + size > most_slots:
            passes, held = [*passes, []], 0
        passes[-1].append(number)
        held += size
    counts = [written(_slot_counts(docs, word_folder, live_folder, shards._tarnsieve_folder, some, shard_bits, seed, bits, longest), "phrase-counts") for some in passes]
    if not passes:
        return written(docs.sparkSession.createDataFrame([], "lang string, phrase string, k int, parts array<long>"), "phrase-parts"), sizes
    every_count = reduce(DataFrame.unionByName, counts)
    found = reduce(DataFrame.unionByName, (_parts_by_slot(shards, every_count, own._tarnsieve_folder, some, shard_bits, longest, min_count) for some, own in zip(passes, counts)))
    if len(passes) > 1:  # each pass has told what its shards hold
        merged = [F.max(F.get("parts", i)).alias(f"_{i}") for i in range(2 * longest - 1)]
        found = found.groupBy("h", "words").agg(*merged).select("h", "words", F.filter(F.array(*(f"_{i}" for i in range(2 * longest - 1))), lambda x: x.isNotNull()).alias("parts"))
    found = written(found, "phrase-slots")
    return written(_named(found, words, min_count), "phrase-parts"), sizes


def collocations(documents: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, most_bits: int = 28, most_slots: int = 1 << 22, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    a: the phrase's count, l and r: those of the parts at its lowest-scoring cut, n: the language's words; score:
    floor(1000 a n / (l r)).  Phrases that stand inside a longer one as often as at all are left out.
    """
    docs = documents.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    with scratch(documents.sparkSession) as keep:
        for seed in range(8):
            try:
                found, sizes = _mined(docs, min_count, longest, most_bits, most_slots, seed)
                break
            except Exception as error:  # a worker's exception arrives as Spark's
                if "Collision" not in f"{type(error).__name__} {error}" or seed == 7:
                    raise
        wide = found.join(sizes, "lang").withColumn("a", F.get("parts", 0))
        exact = "decimal(38,0)"

        def cut(i):
            left, right = F.get("parts", 2 * i - 1), F.get("parts", 2 * i)
            score = F.call_function("div", F.lit(1000).cast(exact) * F.col("a").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"), left.cast("decimal(19,0)") * right.cast("decimal(19,0)"))
            return F.struct(score.cast("long").alias("score"), i.cast("int").alias("cut"), left.alias("l"), right.alias("r"))

        best = F.array_min(F.transform(F.sequence(F.lit(1), F.col("k") - 1), cut))
        scored = written(wide.select("lang", "phrase", "k", "a", "n", best.alias("best"), F.get("parts", 2 * F.col("k") - 3).alias("left"), F.get("parts", F.lit(2)).alias("right")), "phrase-scores")
        # counts never rise from a phrase to a longer one, so the two parts that lack one word tell for all shorter ones
        within = scored.where("k > 2")
        gone = within.where("left <= a").select("lang", F.expr("substring_index(phrase, ' ', k - 1)").alias("phrase")).union(within.where("right <= a").select("lang", F.expr("substring_index(phrase, ' ', 1 - k)").alias("phrase"))).distinct()
        kept = scored.join(gone, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
        ranked = numbered_within(kept, "lang", [F.desc("score"), F.desc("a"), F.col("phrase")], "rank").where(F.col("rank") <= top)
        result = written(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases")
        keep(result)
    return result
