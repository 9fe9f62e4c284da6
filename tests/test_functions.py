import hashlib
import os
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnsieve import schema
from tarnsieve.functions import display, hashing, names


def column(spark, values, kind, expression):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in frame.coalesce(1).orderBy("k").select(expression(F.col("v"))).collect()]


def test_extension(spark):
    given_ = ["a.JPG", ".jpg", "..jpg", "a.", "x.tar.gz", "none", "new\nline.txt", "a.b\n", "", ".a.b", "é.PnG"]
    assert column(spark, given_, "string", names.extension) == [os.path.splitext(n)[1].lower() for n in given_]


def test_categories(spark):
    assert column(spark, [".jpg", ".webm", ".csv", ".log", ""], "string", schema.category) == ["image", "video", "doc", None, None]


def test_normalized(spark):
    given_ = ["/a/b", "/a//b/", "/a/./b/../c", "/..", "//a/b", "///a", "a/../..", "", ".", "/", "../x", "/a/../../b", "a/b/.."]
    assert column(spark, given_, "string", names.normalized) == [os.path.normpath(p) for p in given_]


def test_ancestors(spark):
    assert column(spark, ["/a/b/c", "/", "x/y", "/a"], "string", names.ancestors) == [["/a", "/a/b", "/a/b/c"], ["/"], ["x", "x/y"], ["/a"]]


#: Names in natural order, written by hand: numbers by value, letters without case, equal keys by bytes.
IN_ORDER = ["", "a", "a1", "A01", "a2", "a9z", "A10", "a10b", "ab", "b", "b1c2", "b1c10", "b02c1", "~"]


def test_natural_order(spark):
    listed = ["a10b", "b02c1", "~", "A10", "b1c10", "a", "a9z", "", "b", "a1", "ab", "b1c2", "a2", "A01"]
    frame = spark.createDataFrame([(n,) for n in listed], "v string")
    got = [r[0] for r in frame.orderBy(names.natural_key(F.col("v")), F.desc("v")).collect()]
    assert got == IN_ORDER


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "a", "File ", "x.y-"]), st.integers(0, 2**70), st.sampled_from(["", "b", ".txt"])), min_size=1, max_size=8))
def test_natural_order_is_that_of_numbers(spark, listed):
    """Of names that differ in one number the smaller comes first, however it is written; case doesn't count."""
    pairs = [(f"{head}{n}{tail}", f"{head.upper()}0{n + 1}{tail}") for head, n, tail in listed]
    frame = spark.createDataFrame(pairs, "low string, high string")
    assert all(r[0] for r in frame.select(names.natural_key(F.col("low")) < names.natural_key(F.col("high"))).collect())


def test_natural_key_equal_numbers(spark):
    a, b = column(spark, ["1a", "01A"], "string", names.natural_key)
    assert a == b


def test_size_text(spark):
    want = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1434: "1.4 KB", 1048575: "1024.0 KB", 1048576: "1.0 MB", 5 * 2**30 + 7: "5.0 GB", 2**40: "1.0 TB", 2**50: "1.0 PB", 2**60: "1024.0 PB"}
    assert column(spark, list(want), "long", display.size_text) == list(want.values())


def test_time_text(spark):
    given_ = [None, 0.0, 1.9999999, 1700000000.25, -1.0]
    want = ["-", "-", *(datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") for t in given_[2:])]
    assert column(spark, given_, "double", display.time_text) == want
    assert column(spark, [1e15], "double", display.time_text) == ["1.0E15"]


def test_detail_text(spark):
    row = spark.sql("SELECT 'n' name, '/d' dir, '/d/n' path, 'doc' category, 5L size, 0D mtime, CAST(NULL AS DOUBLE) ctime, CAST(NULL AS STRING) full_hash, 'p' partial_hash, 'bad' error")
    text = row.select(display.detail_text({c: F.col(c) for c in row.columns})).first()[0].split("\n")
    assert text[0] == "Name:          n" and text[4] == "Size:          5 B" and text[6] == "Created (fs):  -"
    assert text[8:] == ["Full hash:     (not computed)", "Partial hash:  p", "", "Warning: bad"]


@pytest.mark.parametrize("query,hits", [("", [True, True, True]), ("  A%B ", [True, False, False]), ("_", [False, True, False]), ("txt /d", [True, True, True])])
def test_search_is_literal(spark, query, hits):
    frame = spark.createDataFrame([(0, "a%b.txt"), (1, "a_b.txt"), (2, "axb.txt")], "k int, name string").withColumn("path", F.concat(F.lit("/d/"), "name"))
    assert [r[0] for r in frame.orderBy("k").select(names.matches(query, F.col("name"), F.col("path"))).collect()] == hits


def test_file_hashes(spark, tmp_path):
    sizes = [0, 1, 65536, 65537, 131071, 131072, 131073, 3_000_000]
    rows = []
    for n in sizes:
        data = os.urandom(n)
        (tmp_path / f"f{n}").write_bytes(data)
        ends = data[:65536] + (data[-65536:] if n > 65536 else b"")
        rows.append((str(tmp_path / f"f{n}"), n, hashlib.blake2b(ends, digest_size=16).hexdigest(), hashlib.blake2b(data, digest_size=32).hexdigest()))
    frame = spark.createDataFrame([(p, n) for p, n, *_ in rows] + [(str(tmp_path / "gone"), 1)], "path string, size long")
    for kind, at in (("partial", 2), ("full", 3)):
        got = {r["path"]: (r["hash"], r["error"]) for r in hashing.hash_files(frame, kind, 3).collect()}
        assert {p: got[p] for p, *_ in rows} == {r[0]: (r[at], None) for r in rows}
        assert got[str(tmp_path / "gone")][0] is None and "No such file" in got[str(tmp_path / "gone")][1]


def test_case_folding_of_every_character(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    given_ = ["".join(every[i : i + 997]) for i in range(0, len(every), 997)] + ["Straße", "ΣΊΣΥΦΟΣ ς", "ﬁ İ", "plain ASCII", ""]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(given_)], "k int, v string")
    got = [r[0] for r in frame.orderBy("k").select(names.casefold(F.col("v"))).collect()]
    assert got == [v.casefold() for v in given_]


def test_lists_that_are_tables_move_as_short_ones_do(spark):
    from tarnsieve.operators import ordering

    for picked in [(0, 1, 1, 0, 1), (1, 1, 0, 0, 1), (0, 0, 0, 0, 0), (1, 1, 1, 1, 1), (0, 1, 0, 1, 1)]:
        rows = spark.createDataFrame([(k + 1, "abcde"[k], bool(c)) for k, c in enumerate(picked)], "place long, item string, chosen boolean")
        moved = "".join(r["item"] for r in ordering.nudged(rows, "place", "chosen").orderBy("place").collect())
        assert moved == "".join(ordering.nudge("abcde", {k for k, c in enumerate(picked) if c}, -1))
        for top in (True, False):
            edge = ordering.with_places(rows, ordering.edge_order(F.col("chosen"), F.col("place"), top)).orderBy("rank")
            assert "".join(r["item"] for r in edge.collect()) == "".join(ordering.to_edge("abcde", {k for k, c in enumerate(picked) if c}, top))
