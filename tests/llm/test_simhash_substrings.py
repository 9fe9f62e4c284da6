"""Near-duplicates (2) and substring dedup (6) against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnsieve.llm import simhash, substrings
from tarnsieve.llm.components import components

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s, n in {s: shingles.count(s) for s in set(shingles)}.items() if len(set(shingles)) < 50 else ((s, 1) for s in shingles):
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += n * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(nodes, linked):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def check(got, rows, radius=2):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    distinct = sorted(set(fps.values()))
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[:k] if (a ^ b).bit_count() <= radius]
    roots = plain_components(distinct, links)
    least = defaultdict(list)
    for i, f in fps.items():
        if i is not None:
            least[roots[f]].append(i)
    want = {i: (f"{f:016x}", min(least[roots[f]], default=None)) for i, f in fps.items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("most_in_key", [4096, 1])
def test_near_duplicates(spark, docs_of, real, odd, most_in_key):
    """most_in_key=1 sends every shared key the exact way for large keys."""
    base = " ".join(f"w{i}" for i in range(300))
    near = [(1000 + k, base.replace(f"w{k} ", f"v{k} ", 1)) for k in range(40)]
    rows = real + odd + near
    got = simhash.near_duplicates(docs_of(rows), most_in_key=most_in_key).collect()
    assert len(got) == len(rows)
    check(got, rows)


def test_near_duplicates_of_nothing(spark, docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    got = simhash.near_duplicates(docs_of([(3, None), (1, ""), (2, " ")])).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, "0" * 16, 1) for i in (1, 2, 3)}


@pytest.mark.parametrize("radius", [0, 1, 2])
@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 700])
def test_bit_sliced_comparison(radius, n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**64, 5, np.uint64)
    flips = np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (n, 3)).astype(np.uint64), axis=1)
    fps = np.unique(centres[rng.integers(0, 5, n)] ^ np.where(rng.random(n) < 0.7, flips, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)))
    got = np.unpackbits(simhash.near(fps, radius).astype("<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")[:, : len(fps)]
    want = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in fps] for a in fps])
    assert np.array_equal(got.astype(bool), want)
    a, b = simhash.forest(fps, radius)
    signed = fps.view(np.int64).tolist()
    linked = [(signed[i], signed[j]) for i, j in zip(*np.nonzero(want)) if i < j]
    assert plain_components(signed, zip(a.tolist(), b.tolist())) == plain_components(signed, linked)
    assert len(a) == len(signed) - len(set(plain_components(signed, linked).values()))


def test_links_of_radius(spark):
    values = [0, 1, 3, 7, 1 << 40, (1 << 40) | 1, -1, -2]
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for radius in (0, 1, 2):
        for most in (4096, 1):
            edges = {(r["a"], r["b"]) for r in simhash.links(frame, radius, most).collect()}
            mask = (1 << 64) - 1
            linked = [(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= radius]
            assert plain_components(values, edges) == plain_components(values, linked)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    want = {n: r for n, r in plain_components(nodes, edges).items() if n != r}
    assert got == want


def test_components_of_a_chain(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(120)], "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(i, 0) for i in range(1, 121)}


# -- substrings


def plain_removed(rows, window):
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(words) - window + 1):
            seen.setdefault(tuple(words[i : i + window]), (doc, i))
    for doc, text in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] != (doc, i):
                gone[i : i + window] = True
        out[doc] = (len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("window,batch,bucket", [(20, 1_000_000, 12 << 20), (3, 50, 12 << 20), (1, 10, 12 << 20), (20, 5000, 20_000)])
def test_remove_repeats(spark, docs_of, real, odd, window, batch, bucket):
    rows = real[:120] + odd
    if window < 20:
        rows = [(i, t[:3000] if t else t) for i, t in rows]
    got = substrings.remove_repeats(docs_of(rows), window, batch, bucket).collect()
    want = plain_removed(rows, window)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]]
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))  # maximal


def test_remove_repeats_in_two_hops_and_few_partitions(spark, docs_of, real, odd):
    rows = [*odd, *real]
    wanted = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(docs_of(rows), 8).collect()}
    got = substrings.remove_repeats(docs_of(rows), 8, 3000, 2000, single=3, most_partitions=5)
    assert substrings.sizes_for(400_000, 2000, 3000, 3)[:2] == (8, 1)
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()} == wanted


def _windows(n, common=0, seed=1):
    draw = np.random.default_rng(seed)
    hashes, keys = draw.integers(0, 1 << 64, (2, n), np.uint64)
    docs = (10**12 + np.cumsum(draw.integers(1, 4, n // 300))).repeat(300)
    positions = np.tile(np.arange(300, dtype=np.int32), n // 300)
    if common:  # one window in every document
        hashes[::300], keys[::300] = hashes[0], keys[0]
    return hashes, keys, docs, positions


@pytest.mark.parametrize("size", [1 << 30, 48 << 30, 768 << 30, 12 << 40, 100 << 40])
def test_bytes_a_window_at_any_size_of_the_table(size):
    bits, coarse, batch = substrings.sizes_for(size)
    assert bits <= 21 and coarse <= 15
    n = batch // 4 // 300 * 300  # a quarter of a batch among a quarter of its buckets
    hashes, keys, docs, positions = _windows(n)
    keys >>= np.uint64(2)
    rows = list(substrings._send(hashes, keys, docs, positions, coarse, 1 << bits - 1, bits - coarse))
    assert sum(len(p) + 8 for _, _, p in rows) / n < 11.6
    for bucket, to, payload in rows[:3]:
        found = substrings._received(payload, bucket, coarse, bits - coarse)
        known = keys >> np.uint64(64 - bits) == found[1][0] >> np.uint64(64 - bits)
        assert to == -1 and {*zip(*(c.tolist() for c in (found[0], found[2], found[3])))} >= {*zip(*(c[known].tolist() for c in (hashes, docs, positions)))}


def test_a_window_of_every_document_goes_to_its_bucket_once_a_batch():
    hashes, keys, docs, positions = _windows(600_000, common=True)
    rows = list(substrings._send(hashes, keys, docs, positions, 6, 32))
    home = int(keys[0] >> np.uint64(58))
    places = [substrings._received(p, b, 6)[0] for b, to, p in rows if to < 0 and b == home]
    assert len(places) == 1 and (places[0] == hashes[0]).sum() == 1
    straight = [(b, to, substrings.unpack_places(p)) for b, to, p in rows if to >= 0]
    assert sum(len(x[2][0]) for x in straight) == 1999 and len(straight) == 32 and max(len(x[2][0]) for x in straight) < 150


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=30), max_size=6))
def test_remove_repeats_of_small_texts(spark, docs_of, texts):
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(docs_of(rows), 2, 4).collect()}
    assert got == plain_removed(rows, 2)


def test_spark_hash(spark):
    values = np.array([0, 1, -5, 2**62, substrings.NULL_ID], np.int64)
    frame = spark.createDataFrame([(int(v),) for v in values], "v long")
    assert {r[0]: r[1] for r in frame.select("v", F.xxhash64("v")).collect()} == dict(zip(values.tolist(), substrings.xxhash64_of_long(values).view(np.int64).tolist()))
