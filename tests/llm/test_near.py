"""Near-duplicates by similarity against brute-force Jaccard."""

import random
from itertools import combinations

import numpy as np
import pytest

from tarnsieve.llm import near, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows, least=0.8):
    found = [(i, plain_set(t)) for i, t in rows]
    label = list(range(len(rows)))
    for (a, (_, x)), (b, (_, y)) in combinations(enumerate(found), 2):
        if label[a] != label[b] and (x == y or len(x & y) >= least * len(x | y)):
            label = [label[a] if v == label[b] else v for v in label]
    ids = {v: min((i for (i, _), w in zip(rows, label) if w == v and i is not None), default=None) for v in set(label)}
    return sorted(((i, ids[v]) for (i, _), v in zip(rows, label)), key=str)


def edited():
    """Copies of texts with 1 to 8 of 100 words changed: similarities on both sides of 0.8, and chains of them."""
    rng, rows = random.Random(5), []
    for k in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((1000 * k + 9000, " ".join(words)))
        for e in range(1, 9):
            copy = list(words)
            for at in rng.sample(range(100), e):
                copy[at] = "x" + copy[at]
            rows.append((1000 * k + 9000 + e, " ".join(copy).upper()))
    return rows


def around_a_base():
    """Copies of one text with 0 to 60 of 150 words changed: many share keys and are not similar."""
    rng = random.Random(8)
    base, rows = [f"b{rng.randrange(10**6)}" for _ in range(150)], []
    for k in range(120):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(60)):
            copy[at] = f"c{rng.randrange(10**6)}"
        rows.append((30_000 + k, " ".join(copy)))
    return rows


def short():
    """Texts of few words, whose fingerprints say least."""
    rng = random.Random(9)
    words = [f"s{k}" for k in range(14)]
    return [(40_000 + 20 * k + n, " ".join([f"k{k}", *words[: n % 10 + rng.randrange(4)]])) for k in range(8) for n in range(12)]


@pytest.mark.parametrize("block,others", [(1 << 19, 1 << 25), (3000, 20_000)])
def test_recall_against_brute_force(spark, docs_of, real, odd, block, others, monkeypatch):
    """Small blocks deal the groups of keys out to many tasks' groups."""
    monkeypatch.setattr(near.links, "__defaults__", (*near.links.__defaults__[:-1], others))
    rows = real + odd + edited() + around_a_base() + short()
    got = near.near_duplicates(docs_of(rows), block=block).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == plain_components(rows)


def test_wide_fingerprints_differ_by_similarity():
    rng = np.random.default_rng(3)
    for n, common, more in [(4, 4, 1), (9, 8, 1), (32, 29, 4), (40, 36, 5), (45, 40, 5), (450, 400, 50)]:  # similarity 0.8 of n and common + more hashes
        for _ in range(50):
            a = rng.integers(0, 2**64, n, np.uint64)
            b = np.concatenate([a[:common], rng.integers(0, 2**64, more, np.uint64)])
            assert int(np.bitwise_count(simhash.wide_fingerprint(a, 16) ^ simhash.wide_fingerprint(b, 16)).sum()) <= (248 if n < 32 else 212)


@pytest.mark.parametrize("n,m,words,radius", [(70, 130, 1, 2), (30, 300, 16, 248), (5, 3, 2, 0), (1, 1, 1, 1)])
def test_pairs_within(n, m, words, radius):
    rng = np.random.default_rng(n)
    others = rng.integers(0, 2**64, (m, words), np.uint64)
    queries = others[rng.integers(0, m, n)].copy()
    for q in queries:
        for bit in rng.integers(0, 64 * words, rng.integers(0, int(1.5 * radius) + 2)):
            q[bit // 64] ^= np.uint64(1 << int(bit) % 64)
    got = sorted(p for i, j in simhash.pairs_within(queries, others, radius) for p in zip(i.tolist(), j.tolist()))
    assert got == [(i, j) for i in range(n) for j in range(m) if int(np.bitwise_count(queries[i] ^ others[j]).sum()) <= radius]


def test_one_row_of_a_group_stays(spark, docs_of):
    from tarnsieve.llm.shared import with_row_key

    rows = [(3, "a b c"), (3, "a b c"), (None, "a b c"), (7, "d"), (None, "e"), (None, "e")]
    got = near.near_duplicates(with_row_key(docs_of(rows), "_row"), row_col="_row").where("stays").collect()
    assert sorted((r["doc_id"] for r in got), key=str) == [3, 7, None]


def test_nothing(spark, docs_of):
    assert near.near_duplicates(docs_of([])).count() == 0


def test_stage_reaches_similarity(spark, docs_of, sf):
    """Two of 100 words changed: similarity 0.8 or more, but 64-bit fingerprints far apart."""
    import corpus_pipeline as pipeline

    words = [f"w{i * i}" for i in range(100)]
    other = ["x" if i in (20, 60) else w for i, w in enumerate(words)]
    docs = docs_of([(1, " ".join(words)), (2, " ".join(other)), (3, "something else")])
    assert {r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, sf).collect()} == {1, 3}
