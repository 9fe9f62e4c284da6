"""Packing (1) and token files (7): exact round trips against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnsieve.llm import packing, token_files, tokens
from tarnsieve.llm.shared import new_folder
from tarnsieve.llm.tokens import WordTokenizer, blocks


@pytest.fixture(scope="session")
def encode(bpe):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe)
    return lambda text: [*whole.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_cache_equals_library(bpe, real, odd, encode):
    texts = [t for _, t in real[:60] + odd] + ["It's <|endoftext|> a<|startoftext|>b", "I'LL don't 'S", "İstanbul ΣΑΣ ǅ é ½ Å", "a,b ..x!! ?,", "tab\tnew\nline nbsp　wide", "ﬁ ß ẞ ª º µ 1st 22nd x²"]
    fast = WordTokenizer(bpe)
    assert fast._direct
    for _ in range(2):  # the second time from the cache
        got = []
        for _, run in blocks(pa.array(texts, pa.string()), 5000):
            ids, lens = fast.encode(run)
            got += [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])]
        assert got == [encode(t)[:-1] for t in texts]


def test_end_ids(bpe, encode):
    fast = WordTokenizer(bpe)
    for end in (2, 3, None, 2):
        ids, lens = fast.encode(["a\nb", "", "c"], end)
        want = [encode(t)[:-1] + [end] * (end is not None) for t in ("a\nb", "", "c")]
        assert ids.tolist() == sum(want, []) and lens.tolist() == [len(w) for w in want]


def test_full_cache_is_cleared(bpe, encode):
    small = WordTokenizer(bpe, cache_bytes=10)
    for text in ("one two three four five six seven", "eight nine ten eleven twelve", "one two nine"):
        assert small.encode([text])[0].tolist() == encode(text)[:-1]


def test_cache_stays_within_its_bytes(bpe, encode, monkeypatch):
    monkeypatch.setattr(tokens, "_AT_ONCE", 500)
    monkeypatch.setattr(tokens, "_SLICE", 3000)
    text = "  ".join(map(str, range(10_000, 30_000))) + "\n" + "y" * 5000 + " end"
    small = WordTokenizer(bpe, cache_bytes=300_000)
    most, look_up = 0, small._look_up

    def watched(*args):
        nonlocal most
        found = look_up(*args)
        most = max(most, small.held)
        return found

    small._look_up = watched
    ids, lens = small.encode(["a b", text, ""], 2)
    assert ids.tolist() == encode("a b") + encode(text) + encode("") and lens.tolist() == [3, len(encode(text)), 1]
    assert most < 300_000 + 1500 * 300


def test_tokenizers_that_keep_white_space_get_whole_texts(encode):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, whole = WordTokenizer(path), Tokenizer.from_file(path)
    assert not other.by_pieces
    texts = [" a  b\nc", "", "It's  12 "]
    ids, lens = other.encode(texts, 7)
    want = [[*whole.encode(t).ids, 7] for t in texts]
    assert ids.tolist() == sum(want, []) and lens.tolist() == [len(w) for w in want]


def test_first_fit(hyp_seed=3):
    rng = random.Random(hyp_seed)
    tree, free = packing.CapacityTree(100, bins=2), []
    for _ in range(2000):
        size = rng.randint(1, 100)
        k = next((i for i, f in enumerate(free) if f >= size), len(free))
        if k == len(free):
            free.append(100)
        assert tree.place(size) == (k, 100 - free[k])
        free[k] -= size


@pytest.mark.parametrize("n_groups", [None, 3])
def test_pack_is_a_partition_of_all_ids(spark, docs_of, bpe, real, odd, encode, n_groups):
    rows = [r for r in real + odd if r[0] not in (4,)] + [(4, "again and again")]
    packed = packing.pack(docs_of(rows), bpe, capacity=512, n_groups=n_groups, keep_ids=True).collect()
    texts, got, bins = dict(rows), defaultdict(list), defaultdict(list)
    for p in packed:
        assert crc(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == p["length"]
        got[p["doc_id"]].append(p)
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(got) == set(texts)
    for doc, pieces in got.items():
        pieces.sort(key=lambda p: p["start"])
        ids = [i for p in pieces for i in p["ids"]]
        assert ids == encode(texts[doc]) and {p["doc_tokens"] for p in pieces} == {len(ids)}
        assert [p["start"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces)])[:-1].tolist()
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= 512
    used = sum(n for s in bins.values() for _, n in s)
    assert used > 0.97 * 512 * (len(bins) - (n_groups or 1))


def test_pack_repeated_rows_and_empty_table(spark, docs_of, bpe):
    assert packing.pack(docs_of([(1, "a b"), (1, "a b"), (1, "a b")]), bpe).count() == 3
    assert packing.pack(docs_of([]), bpe).count() == 0


def test_rows_that_share_an_id_are_dealt_out(spark, docs_of, bpe):
    rows = [(None, "same text")] * 500 + [(9, "another text")] * 500
    groups = {p["sequence_id"] >> 32 for p in packing.pack(docs_of(rows), bpe, n_groups=20).collect()}
    assert len(groups) == 20
    long = packing.pack(docs_of([(1, "word " * 3000)]), bpe, capacity=64, n_groups=50).collect()
    assert len({p["sequence_id"] >> 32 for p in long}) == 1  # a document has one group


def test_sequences_are_padded_except_at_powers_of_two(spark, docs_of, bpe):
    packed = packing.pack(docs_of([(1, "a b c"), (2, "d e f g")]), bpe, capacity=16, keep_ids=True)
    whole = packing.sequences(packed, 16, pad_id=0).first()
    assert whole["used"] == 9 and len(whole["ids"]) == 16 and whole["ids"][9:] == [0] * 7
    exact = packing.sequences(packing.pack(docs_of([(1, "a b c")]), bpe, capacity=16, keep_ids=True), 16).first()
    assert exact["used"] == 4 == len(exact["ids"])


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_planes(mode):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 49408, n).astype(np.uint32)
        planes = token_files.to_planes(ids, mode)
        assert len(planes) == {"bit": 32, "byte": 4}[mode] and np.array_equal(token_files.from_planes(planes, n, mode), ids)
        assert not any(planes[16 if mode == "bit" else 2 :])  # ids below 2^16 leave the others empty


def test_runs_of_ids():
    for top in (1, 255, 256, 65535, 65536, 2**32 - 1):
        ids = np.array([0, top, top // 2, 1], np.uint32)
        assert np.array_equal(token_files.unpack_run(token_files.pack_run(ids), 4), ids)
        assert len(token_files.pack_run(ids)) == 4 * max(1, (top.bit_length() + 7) // 8)


@pytest.mark.parametrize("mode,chunk", [("bit", 1000), ("byte", 64), ("byte", 1 << 20)])
def test_files_round_trip(spark, docs_of, bpe, real, odd, encode, mode, chunk):
    rows = real + odd
    folder = new_folder(spark, "test")
    index = token_files.write_token_files(docs_of(rows), folder, bpe, mode=mode, chunk_ids=chunk)
    assert index.agg(F.sum("n_docs")).first()[0] == len(rows)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, folder).collect()))
    want, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, crc(encode(r[1])))):
        ids = encode(text)
        want.append((start, doc, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_many_shards_and_hot_ids(spark, docs_of, bpe, encode):
    rows = [(None, f"text {i % 3}") for i in range(300)] + [(5, "hot " * (i % 50)) for i in range(300)] + [(i, "w " * 900) for i in range(6, 20)]
    folder = new_folder(spark, "test")
    index = token_files.write_token_files(docs_of(rows), folder, bpe, shard_ids=500, chunk_ids=100)
    assert index.count() > 10 and index.agg(F.max("n_ids")).first()[0] < 500 + 901
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, folder).collect())
    want, start = [], 0
    for doc, ids in sorted(((d, encode(t)) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, crc(r[1]))):
        want.append((start, doc, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_files_of_an_empty_table(spark, docs_of, bpe):
    folder = new_folder(spark, "test")
    assert token_files.write_token_files(docs_of([]), folder, bpe).count() == 0
    assert token_files.read_token_files(spark, folder).count() == 0
