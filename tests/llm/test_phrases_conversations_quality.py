"""Phrases against plain counting, repairs against a search through all edits, the classifier on held-out rows."""

from collections import Counter, defaultdict
from hashlib import sha256
from itertools import product
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnsieve.llm import conversations, phrases, quality_model

DOCS = "doc_id long, text string, lang string, Text2 string"


# ---- phrases


def plain_phrases(rows, least, longest, top):
    counted, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counted[lang or "und"][tuple(words[i : i + k])] += 1
    result = []
    for lang, counts in counted.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in some.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= counts[p[i:j]]}
        found = []
        for p, a in some.items():
            if p not in gone:
                score, k = min((1000 * a * sizes[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(result)


def phrase_rows(seed=3, n=150):
    draw = random.Random(seed)
    words = ["the", "The", "of", "é", "naïve", "x#", "a" * 40, " b", "it's", "日本"]
    rows = [(i, "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(draw.randrange(40))), draw.choice(["en", "fr", None])) for i in range(n)]
    return [*rows, (n, None, "en"), (n, "", None), (n + 2, " \t.,", "de"), (0, rows[0][1], rows[0][2])]


@pytest.mark.parametrize("slots", [1 << 22, 7])
def test_phrases_are_those_of_plain_counting(spark, slots, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 64)  # several shards, and with few slots several passes
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, lang, "other") for i, t, lang in rows], DOCS).repartition(3)
    found = phrases.collocations(docs, min_count=4, longest=4, top=25, most_slots=slots)
    assert sorted(map(tuple, found.collect())) == plain_phrases([r[1:] for r in rows], 4, 4, 25)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "once only", "en", "")], DOCS)).count() == 0


def test_slots_are_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2))
    shards = [(s, *phrases.build_slots(keys[keys >> np.uint64(62) == s])) for s in range(4)]
    slots = phrases.Slots(shards, 2)
    assert sorted(slots(keys).tolist()) == list(range(len(keys)))
    assert sum(8 * len(s[1]) for s in shards) < len(keys)  # under a byte a key


def test_equal_hashes_of_two_keys_are_told():
    with pytest.raises(phrases.Collision):
        phrases.build_slots(np.array([5, 5], np.uint64))


def test_all_is_done_again_with_another_seed(spark, monkeypatch):
    tried, mined = [], phrases._mined

    def at_first_not(*args):
        tried.append(args[-1])
        if len(tried) == 1:
            raise phrases.Collision
        return mined(*args)

    monkeypatch.setattr(phrases, "_mined", at_first_not)
    rows = [("a b. " * 5, "en")]
    found = phrases.collocations(spark.createDataFrame([(1, *rows[0], "")], DOCS), min_count=5)
    assert tried == [0, 1] and sorted(map(tuple, found.collect())) == plain_phrases(rows, 5, 5, 2000)


def test_what_is_sent_of_a_candidate_does_not_grow_with_its_text(spark, monkeypatch):
    made, sent = phrases._shards, []

    def weighed(packed, *args):
        sent.append(packed.agg(F.sum(F.length("payload"))).first()[0])
        return made(packed, *args)

    monkeypatch.setattr(phrases, "_shards", weighed)
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=400)) for _ in range(40)]
    rows = [(" ".join(words[i : i + 5]), "en") for i in range(0, 40, 5)] * 3
    found = phrases.collocations(spark.createDataFrame([(i, t, lang, "") for i, (t, lang) in enumerate(rows)], DOCS).coalesce(1), min_count=3)
    assert sorted(map(tuple, found.collect())) == plain_phrases(rows, 3, 5, 2000)
    # 8 pieces of 5 words have 15 runs each: 5, 4, 3, 2 and 1 by length, with at most a hash and one for each word
    assert sent[0] < 8 * 8 * (5 + 4 * 3 + 3 * 4 + 2 * 5 + 6) + 200


def test_candidates_of_many_tasks_are_merged_by_hash():
    rows = [np.array(r, np.uint64) for r in ([[9, 1, 2], [4, 4, 0]], [[4, 4, 0], [7, 5, 0]], [[9, 1, 2]])]
    assert phrases._distinct(rows).tolist() == [[4, 4, 0], [7, 5, 0], [9, 1, 2]]
    with pytest.raises(phrases.Collision):
        phrases._distinct([*rows, np.array([[9, 1, 3]], np.uint64)])
    some = [np.array([[3], [8]], np.uint64), np.array([[6, 3, 8]], np.uint64)]
    assert phrases._rows_received(phrases._rows_sent(some), 2).tolist() == [[3, 3, 0], [8, 8, 0], [6, 3, 8]]


def test_long_texts_are_cut_after_separators():
    text = b"word " * 300_000 + b". " + b"more " * 300_000
    parts = list(phrases._chunks(text))
    assert b"".join(parts) == text and len(parts) == 2 and parts[0].endswith(b".")


# ---- conversations


def plain_repair(rows):
    """rows: (turn, role, text) in order.  Tries all edits, shortest-cost first, one row after another."""
    faults, seen = [], set()
    for _, role, text in rows:
        shown = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None
    choices = []
    for (_, role, _), fault in zip(rows, faults):
        ways = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            ways += [("K", extra, role), *(("R", 1 + extra, r) for r in ("user", "assistant"))]
        choices.append(ways)
    # inserted runs before each row and at the end
    runs = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for some in product(*choices, repeat=1):
        if best and sum(c for _, c, _ in some) > best[0]:
            continue
        states = {"": (0, "", [])}
        for k in range(len(rows) + 1):
            nxt = {}
            for initials, (cost, audit, lines) in states.items():
                for run in runs:
                    made = initials + "".join(r[0] for r in run)
                    entry = (cost + 5 * len(run), audit + "I" * len(run), lines + [f"{r}:" for r in run])
                    if k < len(rows):
                        letter, c, role = some[k]
                        entry = (entry[0] + c, entry[1] + letter, entry[2] + ([f"{role}:{rows[k][2]}"] if role is not None else []))
                        made += (role[:1] or "?") if role is not None else ""
                    if re.fullmatch("(s|s?(ua)*u?)", made) and (made not in nxt or entry[:2] < nxt[made][:2]):
                        nxt[made] = entry
            states = nxt
        for made, entry in states.items():
            if re.fullmatch("(s?(ua)+)?", made) and (best is None or entry[:2] < best[:2]):
                best = entry
    cost, audit, lines = best
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip([r[:1] for _, r, _ in rows], [r[:1] for _, r, _ in rows][1:])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    """The damage by its definition: {conv_id: rows}."""
    result = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        result[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(some, key=lambda r: (r[0] is not None, r[0] or 0)) for c, some in result.items()}


def conversation_rows(seed, n, longest=5):
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "agent"]
    texts = ["Hi.", "No", "", " \t", None, "Hi.", "Why?\n", "Ünd! ", "a.b"]
    rows = []
    for conv in [*range(n), None]:
        turns = draw.sample([None, *range(9)], draw.randrange(1, longest))
        rows += [(conv, t, draw.choice(roles), draw.choice(texts)) for t in turns]
    draw.shuffle(rows)
    return rows


ROWS = "conv_id long, turn long, role string, text string, Extra string"


def test_repairs_are_the_cheapest_of_all(spark):
    rows = conversation_rows(5, 220)
    found = conversations.repair(conversations.damage(spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(5)))
    expected = {c: plain_repair(some) for c, some in damaged(rows).items()}
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == expected


def test_repaired_rows_give_the_hash(spark):
    rows = spark.createDataFrame([(*r, "x") for r in conversation_rows(6, 40)], ROWS)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in conversations.repair(rows).collect()}
    made = defaultdict(list)
    for r in sorted(conversations.repair(rows, "rows").collect(), key=lambda r: r["place"]):
        made[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert hashes == {c: sha256("\n".join(made[c]).encode()).hexdigest() for c in hashes}


def test_repairs_of_nothing_and_of_dropped_rows(spark):
    assert conversations.repair(conversations.damage(spark.createDataFrame([], ROWS))).count() == 0
    conv = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversations.repair(conversations.damage(spark.createDataFrame([(conv, 0, "user", "Hi.", "")], ROWS))).first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())


def test_rows_of_one_turn_and_equal_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Yes."), (1, 1, "user", "Hi."), (1, 1, "assistant", "Oh.")]
    row = conversations.repair(spark.createDataFrame([(*r, "") for r in rows], ROWS)).first()
    assert (row["duplicate"], row["gaps"], row["cost"], row["audit"]) == (2, 0, 6, "DKDKD")


def test_shared_prefixes_are_worked_out_once():
    draw = random.Random(2)
    signatures = sorted({"".join(draw.choice("uaUA-s") for _ in range(draw.randrange(12))) for _ in range(3000)})
    trie = conversations.Trie()
    answers = [trie.answer(s) for s in signatures]
    assert trie.layers_made == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})
    assert answers == [conversations.Trie().answer(s) for s in signatures]


def test_a_long_conversation(spark):
    rows = spark.range(30_000).selectExpr("7 AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('Say ', id, '.') AS text")
    row = conversations.repair(rows.union(rows.where("turn = 29999").selectExpr("conv_id", "30000L", "role", "'more.'"))).first()
    assert row["cost"] == 2 and row["audit"] == "K" * 29_999 + "DK"


# ---- quality


def test_held_out_rows_are_told_apart(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in quality_model.score(docs, quality_model.fit(docs, labels)).collect()}
    held = [(found[r["doc_id"]], r["quality"]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in found and found[r["doc_id"]]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in found.items())
    good, bad = [r["score"] for r, q in held if q == 1], [r["score"] for r, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_isotonic_steps_are_the_nearest_rising_ones():
    draw = np.random.default_rng(4)
    total = draw.integers(1, 9, 60).astype(float)
    positive = np.floor(total * draw.random(60))
    steps = quality_model.isotonic(positive, total)
    shares = positive / total
    # the min-max formula over all runs of bins
    sums, weights = np.concatenate([[0], positive.cumsum()]), np.concatenate([[0], total.cumsum()])
    plain = [max(min((sums[j + 1] - sums[i]) / (weights[j + 1] - weights[i]) for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert np.allclose(steps, plain) and (np.diff(steps) >= 0).all() and len(shares) == 60


def test_fourier_features_approach_the_kernel():
    draw = np.random.default_rng(1)
    model = quality_model.Model(0.5, np.zeros(5), np.ones(5), draw.standard_normal((5, 20_000)) / 2.0, draw.uniform(0, 2 * np.pi, 20_000))
    x = draw.standard_normal((8, 5))
    z = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 8)
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_ridge_weights_are_those_of_the_whole_table(spark):
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["good", "text", "Is", "here."]) for _ in range(30)) if i % 2 else "$$ !! " * draw.randrange(3, 30) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "en", "") for i, t in enumerate(texts)], DOCS).repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality_model.fit(docs, labels, features=32, ridge=1e-2)
    fold = {r[0]: r[1] for r in spark.range(120).selectExpr("id", "pmod(xxhash64(id, 13), 5) = 0").collect()}
    ids = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 != 2]
    fit, x = [i for i in ids if not fold[i]], np.array([quality_model.statistics(t) for t in texts])
    share = np.mean([i % 2 for i in ids])
    w = np.array([0.5 / share if i % 2 else 0.5 / (1 - share) for i in fit])
    assert np.allclose(model.mean, x[ids].mean(0)) and np.allclose(model.scale, np.where(x[ids].std(0) > 1e-9, x[ids].std(0), 1))
    z, y = model.features(x[fit]), np.array([i % 2 for i in fit])
    penalty = np.diag([1e-2 * w.sum()] * 32 + [0.0])
    weights = np.linalg.solve(z.T @ (w[:, None] * z) + penalty + 1e-9 * np.eye(33), z.T @ (w * y))
    assert np.allclose(model.features(x) @ weights, model.raw(x), atol=1e-6)


def test_quality_of_odd_tables(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, None, "en", ""), (None, "", "fr", ""), (3, "x" * 3_000_000, None, "")], DOCS)
    assert [r["score"] for r in quality_model.score(docs, quality_model.fit(docs, none)).collect()] == [0.0] * 3
    some = spark.createDataFrame([(1, 1), (3, 0), (3, None), (9, 1), (None, 0)], "doc_id long, quality int")
    scores = quality_model.score(docs, quality_model.fit(docs, some)).collect()
    assert len(scores) == 3 and all(0 <= r["score"] <= 1 for r in scores) and scores[0]["score"] == scores[1]["score"]
    assert quality_model.score(empty, quality_model.fit(empty, some)).count() == 0
