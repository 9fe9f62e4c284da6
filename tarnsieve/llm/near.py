"""SimHash near-duplicates at a similarity of word shingles: bit-sliced comparison within shared keys, then an exact check.

Two texts of similarity 0.8 differ in some 10 of 64 SimHash bits, give or take 3: no band of such a fingerprint
finds them without meeting unlike texts as often.  So the keys are others, the fingerprints are wider, and a pair
that they leave is checked:

1. A worker makes each document's set of shingle hashes (XXH64) and writes the set's id (the hash of the
   sorted set), its size and a key for each band of its MinHash signature; the hashes are made again later
   for one document of each candidate set, with a SimHash fingerprint of 64 * `words` bits.  28 bands of
   5 rows miss a pair of similarity 0.8 with a chance of 0.672^28, some 1.5e-5, and more similar pairs less often.
2. Keys held by one set only are dropped after a pre-aggregated minimum and maximum.
3. Each set of a key meets the key's least and greatest set.  A pair whose fingerprints differ in at most
   `radius` bits is a link if the Jaccard similarity of its sets, by array_intersect, is `least` or more.
4. In each key, the sets outside its largest component so far are compared with all sets of other components,
   bit-sliced (`simhash.pairs_within`), in blocks of about `block` numbers (hashes and fingerprints) against
   `others`, each a group of its own that a worker streams in bounded memory.  A worker checks the pairs within
   the radius by the sets themselves, unless earlier ones join their components, and gives the edges of a
   spanning forest, so no list of pairs exists anywhere.
5. Components of the links; a document's component is the least doc_id in it.

`radius` (by default 0.2425 of the bits) is over four standard deviations above what sets of similarity 0.8 differ
in, of 1024 bits: 155 for large sets (arccos(8/9) / pi of them), 192 for a set of 4 in one of 5.  It is the same for sets
of all sizes; radius = 64 * `words` compares all pairs of a key exactly.

Nulls and ties: texts without words have the empty set and form one group; a text of fewer words than
a shingle is one shingle; a row with a null id links others and has their component; a component's id
is the least id that is not null; repeated rows come out as often as they occur; other columns are
ignored; an empty table gives no rows.  Of a very long text a worker holds the words and shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import scratch, written
from .simhash import pairs_within, wide_fingerprint

BANDS, ROWS = 28, 5
_FACTORS, _TERMS = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64) | np.array([[[1]], [[0]]], np.uint64)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # as simhash.fingerprint does
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.unique(np.array([xxh64_intdigest(whole[a:b], 42) for a, b in spans], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):  # bounded memory for very long texts
        least = np.minimum(least, (hashes[at : at + 1024] * _FACTORS + _TERMS).min(axis=1))
    return np.array([xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _columns(documents: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    return documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{row_col or id_col}`").cast("long").alias("row"), F.col(f"`{text_col}`").alias("text"))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))


def _sets(rows: DataFrame, shingle: int, words: int) -> DataFrame:
    """words = 0: doc_id, row, set_id, n (hashes of the set) and keys; else set_id, hashes and fp of `words` words."""

    def make(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                found = [shingles(t, shingle) for t in part.column(2).to_pylist()]
                ids = pa.array(np.array([xxh64_intdigest(h.tobytes(), 42) for h in found], np.uint64).view(np.int64))
                if words:
                    yield pa.RecordBatch.from_arrays([ids, _lists(found), _lists([wide_fingerprint(h, words) for h in found])], names=["set_id", "hashes", "fp"])
                else:
                    sizes = pa.array([len(h) for h in found], pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids, sizes, _lists([band_keys(h) for h in found])], names=["doc_id", "row", "set_id", "n", "keys"])

    return rows.mapInArrow(make, "set_id long, hashes array<long>, fp array<long>" if words else "doc_id long, row long, set_id long, n int, keys array<long>")


def _fits(a, b, least: float):
    """Sets of these sizes can have the similarity."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def _checked(pairs: DataFrame, held: DataFrame, least: float, radius: int) -> DataFrame:
    """Of the distinct pairs (a, b), those of similarity `least` or more.  radius: bits that fingerprints may differ in."""
    fps = [held.select(F.col("set_id").alias(side), F.col("fp").alias(f"fp_{side}")) for side in "ab"]
    apart = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = pairs.join(fps[0], "a").join(fps[1], "b").where(apart <= radius).select("a", "b")
    both = pairs.join(held.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), "a").join(held.select(F.col("set_id").alias("b"), F.col("hashes").alias("y")), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sum"))
    return written(sized.where(F.col("common") >= least * (F.col("sum") - F.col("common")) - 1e-9).select("a", "b"), "near-links")


class _Forest:
    """Components that a group's links join."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[a] = b
        return a != b


def similar(one: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the sets of sorted hashes are similar to `one`."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets)
    at = np.searchsorted(one, every)
    hit = one[np.minimum(at, len(one) - 1)] == every
    common = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(sizes)])])
    return common >= least * (len(one) + sizes - common) - 1e-9


def _compare(words: int, least: float, radius: int, step: int = 1 << 20, at_once: int = 256):
    """mapInArrow function over sorted rows (key, q, o, other, set_id, root, apart, fp, hashes): forest edges of the links
    of each group's queries with its others of another root."""
    import pyarrow.compute as pc

    def numbers(column):
        """The lists of an Arrow column as arrays."""
        flat, ends = pc.list_flatten(column).to_numpy().view(np.uint64), np.cumsum(pc.list_value_length(column).to_numpy())
        return np.split(flat, ends[:-1])

    def edges(queries, others, forest):
        x, y = ({c: np.concatenate([p[c] for p in side]) for c in ("set_id", "root", "apart", "fp")} | {"hashes": [h for p in side for h in p["hashes"]]} for side in (queries, others))
        n, m = (np.fromiter(map(len, z["hashes"]), np.int64, len(z["hashes"])) for z in (x, y))
        found = []
        for i, j in pairs_within(x["fp"], y["fp"], radius):
            # two sets that are both apart meet twice
            keep = (x["root"][i] != y["root"][j]) & (~y["apart"][j] | (x["set_id"][i] < y["set_id"][j])) & (np.minimum(n[i], m[j]) >= least * np.maximum(n[i], m[j]) - 1e-9)
            i, j = i[keep], j[keep]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else ():
                q = int(i[part[0]])
                root = int(x["root"][q])
                for at in range(0, len(part), at_once):
                    rest = [o for o in j[part[at : at + at_once]].tolist() if forest.find(int(y["root"][o])) != forest.find(root)]
                    if not rest:
                        continue
                    alike = similar(x["hashes"][q], [y["hashes"][o] for o in rest], least)
                    for o in np.array(rest)[alike].tolist():
                        if forest.join(root, int(y["root"][o])):
                            found.append((int(x["set_id"][q]), int(y["set_id"][o])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*found)], names=["a", "b"])

    def compare(batches):
        group, queries, others, held, forest = None, [], [], 0, _Forest()
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy() for c in ("key", "q", "o")], axis=1)
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("other", "set_id", "root", "apart")}
            column["fp"] = pc.list_flatten(batch.column("fp")).to_numpy().view(np.uint64).reshape(-1, words)
            hashes = numbers(batch.column("hashes"))
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1) | (column["other"][1:] != column["other"][:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
                part = {c: v[a:b].copy() for c, v in column.items()} | {"hashes": [h.copy() for h in hashes[a:b]]}
                if tuple(names[a]) != group:
                    if queries and others:
                        yield from edges(queries, others, forest)
                    group, queries, others, held, forest = tuple(names[a]), [], [], 0, _Forest()
                if not part["other"][0]:
                    queries.append(part)
                    continue
                others.append(part)
                held += sum(map(len, part["hashes"]))
                if held >= step and queries:
                    yield from edges(queries, others, forest)
                    others, held = [], 0
        if queries and others:
            yield from edges(queries, others, forest)

    return compare


def links(met: DataFrame, held: DataFrame, least: float = 0.8, words: int = 16, radius: int | None = None, block: int = 1 << 19, others: int = 1 << 25) -> DataFrame:
    """Links (a, b) whose components are those of all links among sets that share a key.
    met: key, set_id, n (hashes of the set); held: set_id, hashes, fp."""
    radius = round(0.2425 * 64 * words) if radius is None else radius
    ends = met.groupBy("key").agg(F.min(F.struct("set_id", "n")).alias("low"), F.max(F.struct("set_id", "n")).alias("high"), F.count("*").alias("members"))
    led = met.join(ends, "key").select("set_id", "n", F.explode(F.array("low", "high")).alias("end"))
    led = led.where((F.col("set_id") != F.col("end.set_id")) & _fits("n", "end.n", least))
    found = _checked(led.select(F.least("set_id", "end.set_id").alias("a"), F.greatest("set_id", "end.set_id").alias("b")).distinct(), held, least, radius)
    # a key of up to three sets has had all its pairs
    roots = components(found).select(F.col("node").alias("set_id"), "root")
    large = met.join(ends.where("members > 3").select("key"), "key")
    rooted = written(large.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "rooted")
    # what a set takes: its hashes and fingerprint, and 500 more, so a block's sets are bounded too
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("sets"), F.sum(F.col("n") + words + 500).alias("size"))
    most = F.struct("sets", "root")
    counts = parts.groupBy("key").agg(F.max_by("root", most).alias("most"), F.max_by("size", most).alias("main"), F.sum("size").alias("size"))
    split = counts.where("size > main").select("key", "most", F.ceil((F.col("size") - F.col("main")) / block).cast("int").alias("n_q"), F.ceil(F.col("size") / others).cast("int").alias("n_o"))
    rows = rooted.join(split, "key").withColumn("apart", F.col("root") != F.col("most")).join(held, "set_id")

    def dealt(name: str):
        return F.pmod(F.xxhash64("set_id", F.lit(name)), F.col(f"n_{name}")).cast("int")

    def all_of(name: str):
        return F.explode(F.sequence(F.lit(0), F.col(f"n_{name}") - 1))

    columns = ["set_id", "root", "apart", "fp", "hashes"]
    asked = rows.where("apart").select("key", dealt("q").alias("q"), all_of("o").alias("o"), F.lit(False).alias("other"), *columns)
    met_by = rows.select("key", all_of("q").alias("q"), dealt("o").alias("o"), F.lit(True).alias("other"), *columns)
    sorted_ = asked.union(met_by).repartition("key", "q", "o").sortWithinPartitions("key", "q", "o", "other")
    return found.union(sorted_.mapInArrow(_compare(words, least, radius), "a long, b long"))


def near_duplicates(documents: DataFrame, shingle: int = 5, least: float = 0.8, words: int = 16, radius: int | None = None, block: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, most_broadcast: int = 1_000_000) -> DataFrame:
    """Per document: doc_id, row, component_id, stays (true for the one row of a component with the least doc_id, then row).

    row_col: a number of its own for each row; without it the id serves, and rows that repeat an id stay or go together.
    """
    rows = _columns(documents, id_col, text_col, row_col)
    with scratch(documents.sparkSession) as keep:
        docs = written(_sets(rows, shingle, 0), "sets")
        keyed = docs.select("set_id", "n", F.explode("keys").alias("key"))
        shared = keyed.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low != high").select("key")
        met = written(keyed.join(shared, "key").distinct().select("key", "set_id", "n"), "met")
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        distinct = written(docs.groupBy("set_id").agg(F.min(first).alias("least")), "distinct-sets")
        # the hashes of each set that shares a key, from its first document
        wanted = written(distinct.join(met.select("set_id").distinct(), "set_id", "left_semi").select("set_id", F.col("least.row").alias("at")), "met-ids")
        at = wanted.select("at").distinct()
        if wanted.count() <= most_broadcast:
            at, wanted = F.broadcast(at), F.broadcast(wanted)
        again = rows.join(at, F.col("row").eqNullSafe(F.col("at")), "left_semi")
        found = _sets(again, shingle, words).join(wanted.select("set_id"), "set_id", "left_semi")
        held = written(found.groupBy("set_id").agg(F.first("hashes").alias("hashes"), F.first("fp").alias("fp")), "met-sets")
        joined = components(links(met, held, least, words, radius, block))
        classes = distinct.join(joined.select(F.col("node").alias("set_id"), "root"), "set_id", "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root"))
        named = classes.groupBy("root").agg(F.min("least").alias("first"))
        classes = written(classes.join(named, "root").select("set_id", "first"), "classes")
        keep(docs, classes)
    return docs.select("doc_id", "row", "set_id").join(classes, "set_id").select("doc_id", "row", F.col("first.doc_id").alias("component_id"), F.col("row").eqNullSafe(F.col("first.row")).alias("stays"))
