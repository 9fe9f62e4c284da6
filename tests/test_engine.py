import os
import re
import threading
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnsieve import schema
from tarnsieve.functions.hashing import dealt
from tarnsieve.operators import candidates, groups, merge, ordering, policy
from tarnsieve.operators.positions import numbered, numbered_within
from tarnsieve.plans.engine import Engine
from tarnsieve.sources import files as tree
from tarnsieve.sources import removals
from tarnsieve.sources.snapshots import CatalogTable, SnapshotTable
from tarnsieve.streaming.control import Scan, in_background, task_count
from tarnsieve.streaming.observations import EPOCH_ROWS, merge_batches, merge_epochs


def make(root: Path, **content: str) -> None:
    for name, text in content.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib"
    make(root, a__one_dot_txt="same text", b__one_copy_dot_txt="same text", b__c__other_dot_jpg="else", b__c__empty_dot_csv="", a__empty_dot_pdf="", skip_dot_log="same text")
    (root / ".hidden").mkdir()
    (root / ".hidden" / "_u.PDF").write_text("same text")
    (root / "link.txt").symlink_to(root / "a" / "one.txt")
    (root / "loop").symlink_to(root)
    return root


@pytest.mark.parametrize("tasks,small", [(1, 1), (2, 64), (7, 1)])
def test_walk(spark, library, tasks, small):
    got = {r["path"]: (r["ext"], r["category"], r["size"], r["dir"]) for r in tree.walk(spark, str(library), tasks, small).collect()}
    want = {}
    for folder, _, found in os.walk(library):
        for name in found:
            ext = os.path.splitext(name)[1].lower()
            path = os.path.join(folder, name)
            if not os.path.islink(path) and ext != ".log":
                want[path] = (ext, {".txt": "doc", ".pdf": "doc", ".csv": "doc", ".jpg": "image"}[ext], os.path.getsize(path), folder)
    assert got == want and len(got) == 6


def test_an_uneven_tree_is_dealt_out_anew(spark, tmp_path):
    """A chain, a folder with half of all files and many small ones: no task lists over twice the mean of its round."""
    deep = tmp_path / "lib"
    for k in range(150):
        deep = deep / f"d{k % 10}"
    deep.mkdir(parents=True)
    make(tmp_path / "lib", **{f"flat__{k}_dot_txt": "x" for k in range(400)}, **{f"wide__{k // 20}__{k}__f_dot_txt": "y" for k in range(400)})
    (deep / "end.txt").write_text("z")
    rounds = []
    got = {(r["path"], r["size"]) for r in tree.walk(spark, str(tmp_path / "lib"), 8, 16, rounds.append).collect()}
    assert got == {(os.path.join(d, f), 1) for d, _, names in os.walk(tmp_path / "lib") for f in names} and len(got) == 801
    assert all(max(r) <= max(16, 2 * sum(r) / len(r) + 2) for r in rounds) and any(len(r) == 8 for r in rounds)
    assert sum(map(sum, rounds)) == sum(1 for _ in os.walk(tmp_path / "lib"))


def test_root_is_checked(spark, tmp_path):
    for bad in ("", "  ", str(tmp_path / "none")):
        with pytest.raises(ValueError):
            tree.checked_root(bad)


def test_scan_results_rescan(spark, library, tmp_path):
    engine, said = Engine(spark, str(tmp_path / "catalog")), []
    first = engine.scan(str(library), progress=lambda *x: said.append(x))
    assert first == {"root": str(library), "total_files": 6, "removed": 0, "exact_group_count": 2, "cancelled": False}
    assert said[-1] == ("done", 1, 1)
    # files done of files known, up to the total
    assert [max(x[1:] for x in said if x[0] == stage) for stage in ("walk", "partial_hash", "full_hash")] == [(6, 6), (5, 5), (5, 5)]
    assert all([x[1] for x in said if x[0] == stage] == sorted(x[1] for x in said if x[0] == stage) for stage in ("partial_hash", "full_hash"))
    shown = engine.results(str(library)).collect()
    assert [sorted(os.path.basename(f["path"]) for f in g["files"]) for g in shown] == [["_u.PDF", "one.txt", "one_copy.txt"], ["empty.csv", "empty.pdf"]]
    assert shown[0]["header"] == "Exact duplicates — 3 files, 9 B each"
    # unchanged: no file is hashed again, even one whose content changed behind equal size and time
    target = library / "a" / "one.txt"
    times = target.stat()
    target.write_text("SAME TEXT")
    os.utime(target, ns=(times.st_atime_ns, times.st_mtime_ns))
    assert engine.scan(str(library))["exact_group_count"] == 2
    # a changed time drops its hashes, and a missing file its row
    os.utime(target, (1, 1))
    (library / "b" / "c" / "other.jpg").unlink()
    again = engine.scan(str(library))
    assert again["removed"] == 1 and again["total_files"] == 5
    assert [len(g["files"]) for g in engine.results(str(library)).collect()] == [2, 2]
    assert engine.lookup(str(target)).first()["size"] == 9


def test_cancelled_scan_publishes_nothing(spark, library, tmp_path):
    engine, stop = Engine(spark, str(tmp_path / "catalog")), threading.Event()
    stop.set()
    assert engine.scan(str(library), stop=stop) == {"cancelled": True}
    assert engine.catalog.version() == 0
    late = threading.Event()
    assert engine.scan(str(library), progress=lambda *_: late.set(), stop=late)["cancelled"] in (True, False)


def test_nested_root_takes_its_rows(spark, library, tmp_path):
    engine = Engine(spark, str(tmp_path / "catalog"))
    engine.scan(str(library))
    engine.scan(str(library / "b"))
    assert engine.files(str(library)).count() == 3 and engine.files(str(library / "b")).count() == 3


def test_snapshots(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), schema.RULES)
    assert table.version() == 0 and table.read().count() == 0
    one = spark.createDataFrame([("/a", True, 0, 0)], schema.RULES)
    assert table.publish(one) == 1 and table.publish(one.union(one)) == 2
    assert table.read().count() == 2 and table.read(1).count() == 1
    with pytest.raises(Exception, match="exist"):
        table.publish(one, after=1)


def test_suggest_and_apply(spark, library, tmp_path):
    engine = Engine(spark, str(tmp_path / "catalog"))
    engine.scan(str(library))
    engine.save_rules([(str(library / "b"), True), (str(library / "a"), False)])
    plan = engine.suggest(str(library))
    got = {(os.path.relpath(r["path"], library), r["why"]) for r in plan.collect()}
    assert got == {("a/one.txt", "lower"), (".hidden/_u.PDF", "lower"), ("a/empty.pdf", "lower")}
    assert engine.apply(plan, str(library), str(tmp_path / "trash")).count() == 0 and (library / "a" / "one.txt").exists()
    # the keeper of one group is removed meanwhile: its last copy stays
    actions = spark.createDataFrame([(str(library / "b" / "c" / "empty.csv"),)], "path string")
    told = []
    done = engine.apply(plan, str(library), str(tmp_path / "trash"), actions, confirm=True, progress=lambda *x: told.append(x)).collect()
    assert told[-1] == ("remove", 2, 2) and len(done) == 2 and engine.resume(str(tmp_path / "trash")) == []
    assert {os.path.relpath(r["path"], library) for r in done if r["removed"]} == {"a/one.txt", ".hidden/_u.PDF"}
    assert (library / "a" / "empty.pdf").exists() and sorted(os.listdir(tmp_path / "trash")) == ["_u.PDF", "one.txt"]
    # one file at a time: never the last, never one without copies
    last = engine.delete(str(library / "a" / "empty.pdf"), str(library), str(tmp_path / "trash"), actions, confirm=True).first()
    assert not last["removed"] and "last copy" in last["error"]
    assert "not in a group" in engine.delete(str(library / "b" / "c" / "other.jpg"), str(library), str(tmp_path / "trash"), confirm=True).first()["error"]
    assert engine.delete(str(library / "a" / "empty.pdf"), str(library), str(tmp_path / "trash"), confirm=True).first()["removed"]
    assert engine.arm(plan).count() == 3 and engine.plan_table.read().count() == 3
    engine.disarm()
    assert engine.plan_table.read().count() == 0
    assert engine.folders_to_rank(str(library)) == [(str(library / "b"), True), (str(library / "a"), False), (str(library / ".hidden"), False), (str(library / "b" / "c"), False)]
    engine.save_rules([(str(library / "a"), True)])
    assert {(os.path.basename(r["path"]), r["recursive"], r["rank"]) for r in engine.rules().collect()} == {("a", True, 0), ("b", True, 0)}


# -- operators against plain definitions


def dups(spark, rows):
    """rows: (group, path)"""
    return spark.createDataFrame([(g, p, os.path.dirname(p), os.path.basename(p), 10) for g, p in rows], "full_hash string, path string, dir string, name string, size long")


def rules(spark, listed):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(listed)], schema.RULES)


FOLDERS = ["/a", "/a/b", "/a/b/c", "/ab", "/b", "/", "/a/bc"]
NONE = float("inf")


@pytest.mark.parametrize("listed,want", [
    ([], [NONE] * 7),
    ([("/a", True, 2)], [2, 2, 2, NONE, NONE, NONE, 2]),
    ([("/a", False, 2)], [2, NONE, NONE, NONE, NONE, NONE, NONE]),
    ([("/a", True, 2), ("/a/b", True, 0)], [2, 0, 0, NONE, NONE, NONE, 2]),
    ([("/a/b", True, 3), ("/a", True, 0)], [0, 3, 3, NONE, NONE, NONE, 0]),  # the nearest counts, not the best
    ([("/a", True, 1), ("/a/b/c", False, 5)], [1, 1, 5, NONE, NONE, NONE, 1]),  # an exact one before all
    ([("/a//b/", True, 1), ("/a/./b", True, 2)], [NONE, 1, 1, NONE, NONE, NONE, NONE]),  # of equal ones the first
])
def test_folder_ranks(spark, listed, want):
    frame = spark.createDataFrame([(f,) for f in FOLDERS], "dir string")
    got = {r["dir"]: r["rank"] for r in policy.folder_ranks(frame, rules(spark, listed)).collect()}
    assert got == dict(zip(FOLDERS, want))


@settings(max_examples=10, deadline=None)
@given(st.sets(st.sampled_from(["/a", "/a/b", "/a/b/c", "/b"]), min_size=1), st.booleans())
def test_folder_ranks_of_chains(spark, named, recursive):
    """A folder with a rule has that rule's rank; another one that of its parent, if rules go down."""
    order = sorted(named)
    frame = spark.createDataFrame([(f,) for f in FOLDERS], "dir string")
    got = {r["dir"]: r["rank"] for r in policy.folder_ranks(frame, rules(spark, [(f, recursive, k) for k, f in enumerate(order)])).collect()}
    assert all(got[f] == k for k, f in enumerate(order))
    for child, parent in [("/a/b", "/a"), ("/a/b/c", "/a/b"), ("/a/bc", "/a")]:
        if child not in named:
            assert got[child] == (got[parent] if recursive else NONE)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_tie_takes_one(spark, k):
    frame = dups(spark, [("g", f"/top/file{n}.txt") for n in range(9, 9 + k)] + [("g", "/low/x.txt"), ("g", "/low/y.txt")])
    listed = rules(spark, [("/top", False, 0)])
    plan = {(r["path"], r["why"]) for r in policy.suggest(frame, listed).collect()}
    want = {("/low/x.txt", "lower"), ("/low/y.txt", "lower")} | ({(f"/top/file{8 + k}.txt", "tie")} if k > 1 else set())
    assert plan == want
    one = policy.suggest(frame, listed, keep="one").count()
    assert one == k + 1  # all but one go


def test_unranked_equal_names_and_removed(spark):
    frame = dups(spark, [("g", "/b/same.txt"), ("g", "/a/same.txt"), ("h", "/a/1"), ("h", "/b/1")])
    none = rules(spark, [])
    actions = spark.createDataFrame([("/a/1",)], "path string")
    assert [r["path"] for r in policy.suggest(frame, none, actions).collect()] == ["/a/same.txt"]
    assert {r["path"]: r["can_delete"] for r in policy.can_delete(frame, actions).collect()} == {"/b/same.txt": True, "/a/same.txt": True, "/a/1": False, "/b/1": False}
    assert policy.suggest(frame.limit(0), none).count() == 0
    assert policy.live_folders(frame.limit(0)).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("gh"), st.sampled_from(["/a", "/a/b", "/c"]), st.sampled_from(["f1", "f10", "f2", "longer"])), unique=True, min_size=1, max_size=10), st.lists(st.tuples(st.sampled_from(["/a", "/c"]), st.booleans(), st.integers(0, 2)), max_size=3, unique_by=lambda r: r[0]))
def test_every_group_keeps_one(spark, files, listed):
    frame = candidates.repeated(dups(spark, [(g, f"{d}/{n}") for g, d, n in files]), "full_hash")
    held = {(r["full_hash"], r["path"]) for r in frame.collect()}
    for keep in ("code", "one"):
        gone = {(r["full_hash"], r["path"]) for r in policy.suggest(frame, rules(spark, listed), keep=keep).collect()}
        assert gone <= held and {g for g, _ in held - gone} == {g for g, _ in held}
        if keep == "one":
            assert all(sum(g == x for g, _ in held - gone) == 1 or len({python_rank(os.path.dirname(p), listed) for g, p in held if g == x}) > 1 for x in {g for g, _ in held})


def test_staged_equals_full_hash_alone(spark):
    rows = [("a", 1, "p", "x"), ("b", 1, "p", "x"), ("c", 1, "p", "y"), ("d", 1, "q", "z"), ("e", 2, "p", "w"), ("f", 0, "n", "o"), ("g", 0, "n", "o")]
    frame = spark.createDataFrame(rows, "path string, size long, partial_hash string, full_hash string")
    for plan in ("join", "window"):
        staged = candidates.partial_candidates(candidates.size_candidates(frame, plan), plan)
        assert {r["path"] for r in staged.collect()} == {"a", "b", "c", "f", "g"}
        assert {(r["full_hash"], r["n"]) for r in candidates.group_keys(staged).collect()} == {("x", 2), ("o", 2)} == {(r["full_hash"], r["n"]) for r in candidates.group_keys(frame).collect()}
    assert groups.reclaimable(frame).first()[0] == 1


def test_merge_keeps_error_until_change(spark):
    old = spark.createDataFrame([("/r/a", "/r", "/r", "a", ".txt", "doc", 1, 1.0, None, "p", "f", "bad")], schema.CATALOG)
    same = spark.createDataFrame([("/r/a", "/r", "a", ".txt", "doc", 1, 1.0, None)], schema.SEEN)
    kept = merge.merge_scan(old, same, "/r")
    assert kept.first()["error"] == "bad" and kept.first()["full_hash"] == "f"
    success = spark.createDataFrame([("/r/a", "new", None)], schema.HASHED)
    hashed = merge.with_hashes(kept, success, "full_hash").first()
    assert (hashed["full_hash"], hashed["error"]) == ("new", "bad")
    changed = merge.merge_scan(old, same.withColumn("mtime", F.lit(2.0)), "/r").first()
    assert (changed["partial_hash"], changed["full_hash"], changed["error"]) == (None, None, None)
    assert merge.merge_scan(old, same.limit(0), "/r").count() == 0
    assert merge.merge_scan(merge.merge_scan(old, same, "/r"), same, "/r").collect() == kept.collect()


def test_positions(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("v"))
    got = sorted((r["v"], r["pos"]) for r in numbered(frame, [F.col("v")]).collect())
    assert [p for _, p in got] == list(range(1, 1001))
    inside = {}
    for r in numbered_within(frame, "g", [F.desc("v")]).collect():
        inside.setdefault(r["g"], []).append((-r["v"], r["pos"]))
    assert all([p for _, p in sorted(x)] == list(range(1, len(x) + 1)) for x in inside.values())


@pytest.mark.parametrize("chosen,step,want", [({0, 1}, -1, "abcde"), ({1, 2}, -1, "bcade"), ({0, 2}, -1, "acbde"), ({3, 4}, 1, "abcde"), ({1, 3}, 1, "acbed"), ({2}, 1, "abdce"), (set(), 1, "abcde")])
def test_nudge(chosen, step, want):
    assert "".join(ordering.nudge("abcde", chosen, step)) == want


def test_edges_and_numbers():
    assert "".join(ordering.to_edge("abcde", {1, 3}, True)) == "bdace" and "".join(ordering.to_edge("abcde", {1, 3}, False)) == "acebd"
    assert ordering.numbered(["x", "y"]) == ["1. x", "2. y"] and ordering.ranked([("x", True)]) == [("x", True, 0)]


def test_task_count():
    assert task_count(0, 8) == 1 and task_count(10, 8) == 10 and task_count(100_000, 8) == 1563
    assert task_count(10**9, 8) == 16_384 and task_count(10**9, 8, most=500) == 500


def test_files_are_dealt_out_by_bytes(spark):
    files = spark.range(20_000).selectExpr("concat('/f', id) AS path", "IF(id = 77, 40000L, 1 + id % 50) AS size")
    found = dealt(files, 12).groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    mean = sum(r["bytes"] for r in found) / 12
    assert len(found) == 12 and max(r["n"] for r in found) - min(r["n"] for r in found) <= 1 and max(r["bytes"] for r in found) <= 2 * mean


def test_background_error():
    got = []
    in_background(lambda: 1 / 0, got.append).join()
    assert got == [{"error": "division by zero"}]


def test_stage_progress(spark):
    """What is said while a stage runs: its name, and tasks done out of those known."""
    import time

    def slow(batches):
        for batch in batches:
            time.sleep(0.3)
            yield batch

    said = []
    control = Scan(spark, lambda *x: said.append(x), poll=0.02)
    assert control.stage("count", lambda: spark.range(0, 100, 1, 8).mapInArrow(slow, "id long").count()) == 100
    assert {name for name, _, _ in said} == {"count"} and all(0 <= done <= known for _, done, known in said)
    assert max(known for _, _, known in said) >= 8 and any(0 < done < known for _, done, known in said)


def test_batches_of_observations(spark, tmp_path):
    table = CatalogTable(spark, str(tmp_path / "catalog"), buckets=4)
    arrivals = str(tmp_path / "arrivals")
    for k in (1, 2):
        rows = [("/r/a", "/r", "a", ".txt", "doc", k, 1.0, None), (f"/r/{k}", "/r", str(k), ".txt", "doc", 1, 1.0, None)]
        spark.createDataFrame(rows, schema.SEEN).write.mode("append").parquet(arrivals)
        merge_batches(spark, arrivals, table, "/r", str(tmp_path / "checkpoint")).awaitTermination()
    assert {(r["path"], r["size"]) for r in table.read().collect()} == {("/r/a", 2), ("/r/1", 1), ("/r/2", 1)}


def test_batch_with_a_path_twice(spark, tmp_path):
    """One batch of two files that both name a path: the later observation counts."""
    table = CatalogTable(spark, str(tmp_path / "catalog"), buckets=4)
    names = [f.name for f in schema.SEEN]
    for size, mtime in ((1, 5.0), (2, 9.0), (3, 7.0)):
        row = {"path": "/r/a.txt", "dir": "/r", "name": "a.txt", "ext": ".txt", "category": "doc", "size": size, "mtime": mtime, "ctime": 0.0}
        spark.createDataFrame([tuple(row[n] for n in names)], schema.SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    merge_batches(spark, str(tmp_path / "in"), table, "/r", str(tmp_path / "state")).awaitTermination()
    assert [(r["path"], r["size"]) for r in table.read().collect()] == [("/r/a.txt", 2)]


def test_pointer_appears_whole(spark, tmp_path, monkeypatch):
    """A writer that fails before its pointer is whole leaves the old snapshot in force, and the next one works."""
    table = SnapshotTable(spark, str(tmp_path / "t"), schema.RULES)
    one = spark.createDataFrame([("/a", True, 0, 0)], schema.RULES)
    table.publish(one)
    with monkeypatch.context() as patched:
        patched.setattr(os, "link", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.publish(one.union(one))
    assert table.version() == 1 and table.read().count() == 1
    assert table.publish(one.union(one)) == 2 and table.read().count() == 2
    with pytest.raises(Exception):
        table.publish(one, after=1)
    assert {n for n in os.listdir(tmp_path / "t" / "_versions") if not n.startswith(".")} == {"1", "2"}


@pytest.mark.parametrize("name", ["W2_suggest_delete", "F7_suggest_live", "A12_plan_totals", "O6_plan_preview"])
def test_plans_read_the_groups_not_the_documents(spark, sf, name):
    """The files of groups are written once; only removed files (F7) are looked up in the documents again."""
    from tarnsieve.plans import catalog_queries

    plan = catalog_queries.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") <= (name == "F7_suggest_live") and plan.count("Relation [") <= 4


def test_default_location(monkeypatch):
    from tarnsieve.sources.snapshots import default_location

    monkeypatch.delenv("LOCALAPPDATA", raising=False)
    assert default_location() == os.path.expanduser("~/.local/share/tarnsieve/catalog")
    monkeypatch.setenv("LOCALAPPDATA", "/data/of/user")
    assert default_location() == "/data/of/user/tarnsieve/catalog"


# -- the catalog's leaves


def rows_of(spark, root, paths, size=1):
    return spark.createDataFrame([(p, root, os.path.dirname(p), os.path.basename(p), ".txt", "doc", size + k, 1.0, None, None, None, None) for k, p in enumerate(paths)], schema.CATALOG)


def test_a_change_writes_the_leaves_it_touches(spark, tmp_path):
    table = CatalogTable(spark, str(tmp_path / "c"), buckets=16)
    table.publish(rows_of(spark, "/r", [f"/r/{k}" for k in range(4000)]).union(rows_of(spark, "/s", [f"/s/{k}" for k in range(4000)])))
    def written_bytes():
        return {str(f): f.stat().st_size for f in (tmp_path / "c" / "data").rglob("*.parquet")}
    before = written_bytes()
    changed = rows_of(spark, "/r", ["/r/5", "/s/7", "/r/new"], size=99)
    gone = spark.createDataFrame([("/r/9", "/r"), ("/s/7", "/s")], "path string, root string")
    table.replace(changed, gone)
    fresh = {f: n for f, n in written_bytes().items() if f not in before}
    assert 0 < len(fresh) <= 5 and sum(fresh.values()) < 6 / 32 * sum(before.values())
    now = {r["path"]: (r["root"], r["size"]) for r in table.read().collect()}
    assert len(now) == 8000 and "/r/9" not in now and now["/s/7"] == ("/r", 100) and now["/r/5"] == ("/r", 99) and now["/r/new"] == ("/r", 101)
    assert table.read(1).count() == 8000 and table.read(root="/s").count() == 3999
    # old snapshots go when they are told to
    assert table.expire(keep=1, older_than=3600) == 0 and 0 < table.expire(keep=1, older_than=-60) <= 5 and table.read().count() == 8000
    with pytest.raises(Exception, match="exist"):
        table.replace(changed, gone, after=1)


def scanned(frame):
    """(files read, rows that the scan gave) of a plan that has run."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    scans = plan.collectLeaves()
    found = [scans.apply(i).metrics() for i in range(scans.size())]
    return [(m.apply("numFiles").value(), m.apply("numOutputRows").value()) for m in found if m.contains("numFiles")]


def test_reads_are_pruned(spark, tmp_path):
    table = CatalogTable(spark, str(tmp_path / "c"), buckets=4, options={"parquet.block.size": "4096", "parquet.page.size": "1024", "parquet.block.row.check.min": "10"})
    table.publish(rows_of(spark, "/r", [f"/r/{k:06d}" for k in range(20_000)]).union(rows_of(spark, "/s", [f"/s/{k}" for k in range(300)])))
    of_root = table.read(root="/s")
    assert "PartitionFilters: [isnotnull(root_id" in re.sub(r"#\d+", "", of_root._jdf.queryExecution().toString())
    assert scanned(of_root)[0][1] == 300
    some = table.read(root="/r").where("size BETWEEN 5000 AND 5009")
    assert some.count() == 10 and scanned(some)[0][1] < 4000  # row groups of other sizes are skipped
    found = table.lookup("/r/000123")
    assert [r["size"] for r in found.collect()] == [124]
    files, rows = scanned(found)[0]
    assert files <= 2 and rows < 3000  # one bucket's files, and of them the row groups whose bloom filter knows the path
    missing = table.lookup("/r/none")
    assert missing.count() == 0 and scanned(missing)[0][1] < 3000


def test_a_large_group_page_by_page(spark):
    rows = spark.range(50_000).selectExpr("concat('/r/', lpad(id, 6, '0')) AS path", "IF(id < 49000, 'big', concat('h', id DIV 2)) AS full_hash", "7L AS size")
    shown = groups.pages(rows, 1000)
    got = shown.select("full_hash", "page", "n", "total", "header", F.size("files").alias("k"), F.col("files")[0]["path"].alias("first")).collect()
    assert [(r["page"], r["k"], r["first"]) for r in got[:49]] == [(p, 1000, f"/r/{1000 * p:06d}") for p in range(49)]
    assert got[0]["n"] == 49_000 and got[0]["total"] == 343_000 and got[0]["header"] == "Exact duplicates — 49000 files, 7 B each"
    assert len(got) == 49 + 500 and all(r["k"] == 2 for r in got[49:])


# -- removals that are stopped


def test_a_removal_that_is_stopped_is_ended(spark, library, tmp_path, monkeypatch):
    engine, trash = Engine(spark, str(tmp_path / "catalog")), str(tmp_path / "trash")
    make(library, **{f"copies__{k}__same_dot_txt": "many" for k in range(6)})
    engine.scan(str(library))
    plan = engine.suggest(str(library), keep="one")
    total = plan.count()
    with monkeypatch.context() as patched:  # intents are written, and a few files moved, then the run dies
        def half(spark_, journal, tasks=None):
            for r in spark_.read.parquet(f"{journal}/intents").orderBy("path").limit(3).collect():
                assert removals.move(r["path"], r["target"], r["keeper"]) is None
            raise RuntimeError("lost")
        patched.setattr(removals, "replay", half)
        with pytest.raises(RuntimeError):
            engine.apply(plan, str(library), trash, confirm=True)
    assert len(os.listdir(trash)) == 3
    (ended,) = engine.resume(trash)
    rows = ended.collect()
    assert len(rows) == total and all(r["removed"] for r in rows) and len(os.listdir(trash)) == total
    assert engine.resume(trash) == []
    left = [p for p in library.rglob("*") if p.is_file() and not p.is_symlink() and p.suffix != ".log"]
    assert sorted(p.read_text() for p in left) == ["", "else", "many", "same text"]


def test_the_last_copy_stays_whatever_a_journal_says(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("x")
    a, b, t = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "t")
    os.unlink(b)
    assert "was to stay" in removals.move(a, t, b) and os.path.exists(a)
    assert "was to stay" in removals.move(a, t, a) and os.path.exists(a)
    (tmp_path / "b").write_text("x")
    assert removals.move(a, t, b) is None and removals.move(a, t, b) is None and not os.path.exists(a)
    assert "no such file" in removals.move(str(tmp_path / "c"), str(tmp_path / "u"), b)


# -- epochs


def test_epochs_sweep_when_they_close(spark, tmp_path):
    table = CatalogTable(spark, str(tmp_path / "c"), buckets=4)
    arrivals, state = str(tmp_path / "in"), str(tmp_path / "state")

    def arrive(epoch, names, n=None, root="/r"):
        rows = [(f"{root}/{x}", root, x, ".txt", "doc", 1, float(epoch), None, root, epoch, None) for x in names]
        rows += [(None,) * 8 + (root, epoch, n)] if n is not None else []
        spark.createDataFrame(rows, EPOCH_ROWS).coalesce(1).write.mode("append").parquet(arrivals)
        merge_epochs(spark, arrivals, table, state, str(tmp_path / "ck")).awaitTermination()
        return sorted(r["path"] for r in table.read().collect())

    assert arrive(1, "abc", 3) == ["/r/a", "/r/b", "/r/c"]
    assert arrive(1, "x", 1, "/s") == ["/r/a", "/r/b", "/r/c", "/s/x"]
    assert arrive(2, "a") == ["/r/a", "/r/b", "/r/c", "/s/x"]  # open
    assert arrive(2, "", 2) == ["/r/a", "/r/b", "/r/c", "/s/x"]  # the marker is here before the rows
    assert arrive(3, "d") == ["/r/a", "/r/b", "/r/c", "/r/d", "/s/x"]
    assert arrive(2, "b") == ["/r/a", "/r/b", "/r/d", "/s/x"]  # closed: c is gone, and d, seen later, stays
    assert arrive(3, "", 1) == ["/r/d", "/s/x"]
