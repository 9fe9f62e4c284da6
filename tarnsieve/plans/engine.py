"""The engine: scan a tree into the catalog, show groups, suggest and apply removals."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve import schema
from tarnsieve.functions.hashing import hash_files
from tarnsieve.operators import candidates, groups, merge, ordering, policy
from tarnsieve.sources import files as tree
from tarnsieve.sources import removals
from tarnsieve.sources.snapshots import CatalogTable, SnapshotTable, default_location
from tarnsieve.storage import written
from tarnsieve.streaming.control import Cancelled, Scan, task_count


class Engine:
    """Catalog and rules at a location, and the operations on them."""

    def __init__(self, spark: SparkSession, location: str | None = None):
        location = location or default_location()
        self.spark = spark
        self.catalog = CatalogTable(spark, f"{location}/files")
        self.rules_table = SnapshotTable(spark, f"{location}/rules", schema.RULES)
        self.plan_table = SnapshotTable(spark, f"{location}/plan", schema.PLAN)

    # -- scan

    def scan(self, root: str, progress: Callable[[str, int, int], None] | None = None, stop: threading.Event | None = None, seen: DataFrame | None = None) -> dict:
        """Walks the root (or takes `seen`), merges it into the catalog, and hashes what may be a copy and
        has no hash yet.  A cancelled scan publishes nothing."""
        root = tree.checked_root(root) if seen is None else root
        control = Scan(self.spark, progress, stop)
        try:
            return self._scan(root, control, seen)
        except Cancelled:
            return {"cancelled": True}

    def _scan(self, root: str, control: Scan, seen: DataFrame | None) -> dict:
        """Rows that didn't change are neither written nor hashed again: `changed` holds those that did, by path."""
        version = self.catalog.version()
        previous = self.catalog.read(version)
        files = self.spark.sparkContext.accumulator(0)
        found = control.stage("walk", lambda: written(tree.walk(self.spark, root, done=files) if seen is None else merge.last_wins(seen.withColumn("seq", F.monotonically_increasing_id())).drop("seq"), "seen"), count=lambda: files.value)
        control.progress("walk", n := found.count(), n)
        with_old = control.stage("merge", lambda: written(merge.changes(previous, found, root), "changed"))
        gone = written(merge.leaving(previous, found, with_old, root), "gone")
        removed = gone.where(F.col("root") == root).count()
        changed = with_old.drop("was_root")
        for stage, missing, column in (("partial_hash", candidates.missing_partial, "partial_hash"), ("full_hash", candidates.missing_full, "full_hash")):
            now = self._now(version, root, changed, gone)
            changed = self._hashed(control, stage, now, missing(now), changed, column)
        control.check()
        self.catalog.replace(changed, gone, version)
        control.progress("done", 1, 1)
        return groups.summary(self.files(root), root, removed).first().asDict()

    def _now(self, version: int, root: str, changed: DataFrame, gone: DataFrame) -> DataFrame:
        """The root's rows as they will be."""
        before = self.catalog.read(version, root)
        return before.join(changed.select("path").union(gone.select("path")), "path", "left_anti").select(*changed.columns).unionByName(changed)

    def _hashed(self, control: Scan, stage: str, now: DataFrame, wanted: DataFrame, changed: DataFrame, column: str) -> DataFrame:
        """The changed rows with the missing hashes put in, and the rows that get a hash without having changed
        otherwise.  The results are written, so that no later stage reads a file a second time."""
        wanted = written(wanted, "wanted")
        total = wanted.count()
        if not total:
            return changed
        tasks, done = task_count(total, self.spark.sparkContext.defaultParallelism), self.spark.sparkContext.accumulator(0)
        results = control.stage(stage, lambda: written(hash_files(wanted, column.removesuffix("_hash"), tasks, done), column), total, lambda: done.value)
        fresh = merge.with_hashes(now.join(results.select("path"), "path", "left_semi").select(*changed.columns), results, column)
        return written(changed.join(results.select("path"), "path", "left_anti").select(*changed.columns).unionByName(fresh), "changed")

    # -- results

    def files(self, root: str) -> DataFrame:
        return self.catalog.read(root=root)

    def results(self, root: str, page: int = 1000) -> DataFrame:
        """Groups, largest first, in pages of at most `page` files."""
        return groups.pages(self.files(root), page)

    def lookup(self, path: str) -> DataFrame:
        return self.catalog.lookup(path)

    # -- rules

    def rules(self) -> DataFrame:
        return self.rules_table.read()

    def save_rules(self, ordered: list[tuple[str, bool]]) -> None:
        """Puts an ordered list in: ranks are its places; rules of other folders stay as they are."""
        version, old = self.rules_table.version(), self.rules()
        entries = self.spark.createDataFrame(ordering.ranked(ordered), "path string, recursive boolean, rank int")
        seqs = old.select("path", "rule_seq")
        merged = merge.upsert_rules(old, entries).join(seqs, "path", "left")
        # a rule keeps its place; new ones follow
        last = old.agg(F.coalesce(F.max("rule_seq"), F.lit(-1))).first()[0]
        self.rules_table.publish(merged.withColumn("rule_seq", F.coalesce("rule_seq", F.col("rank") + last + 1)), version)

    # -- removals

    def suggest(self, root: str, actions: DataFrame | None = None, keep: str = "code") -> DataFrame:
        return policy.suggest(groups.duplicates(self.files(root)), self.rules(), actions, keep)

    def folders_to_rank(self, root: str, actions: DataFrame | None = None) -> list[tuple[str, bool]]:
        """The list that a person puts in order: folders of live groups, those ranked before first."""
        listed = policy.prefill(policy.live_folders(groups.duplicates(self.files(root)), actions), self.rules())
        return [(r["dir"], r["recursive"]) for r in listed.orderBy(*policy.prefill_order()).toLocalIterator()]

    def arm(self, plan: DataFrame) -> DataFrame:
        """Keeps a plan as the manifest to be confirmed and returns it as it was kept."""
        self.plan_table.publish(plan)
        return self.plan_table.read()

    def disarm(self) -> None:
        """Drops the manifest."""
        self.plan_table.publish(self.spark.createDataFrame([], schema.PLAN))

    def delete(self, path: str, root: str, trash: str, actions: DataFrame | None = None, confirm: bool = False) -> DataFrame:
        """Removes one file of a group, unless it is the group's last: (path, removed, error)."""
        dups = groups.duplicates(self.files(root))
        row = policy.can_delete(dups, actions).where(F.col("path") == path).select("can_delete").first()
        if row is None or not row["can_delete"]:
            why = "not in a group of copies" if row is None else "removed already, or the last copy of its group"
            return self.spark.createDataFrame([(path, False, why)], "path string, removed boolean, error string")
        return self.apply(dups.where(F.col("path") == path), root, trash, actions, confirm)

    def apply(self, plan: DataFrame, root: str, trash: str, actions: DataFrame | None = None, confirm: bool = False, progress: Callable[[str, int, int], None] | None = None) -> DataFrame:
        """Moves the planned files to the folder `trash` and returns (path, removed, error).

        Without confirm nothing is touched.  Groups are looked at again first, so that each keeps a file.  What is to be
        moved is written to a journal beside the trash (`<trash>.journal`), then the tasks move it and note
        each outcome as it happens; progress("remove", done, total) is told meanwhile.  A run that was stopped
        is ended by `resume`.
        """
        if not confirm:
            return self.spark.createDataFrame([], "path string, removed boolean, error string")
        dups = groups.duplicates(self.files(root))
        journal = removals.open_journal(written(policy.with_keepers(policy.safe_to_apply(plan, dups, actions), dups, actions), "removals"), trash)
        return self._replayed(journal, progress)

    def resume(self, trash: str, progress: Callable[[str, int, int], None] | None = None) -> list[DataFrame]:
        """Ends the removals to this trash that were stopped half-way; the outcomes of each."""
        return [self._replayed(journal, progress) for journal in removals.open_journals(trash)]

    def _replayed(self, journal: str, progress: Callable[[str, int, int], None] | None) -> DataFrame:
        total = removals.outcomes(self.spark, journal).count()
        Scan(self.spark, progress).stage("remove", lambda: removals.replay(self.spark, journal), total, lambda: removals.noted(journal))
        return removals.outcomes(self.spark, journal)
