"""Retention policy: folder ranks, the removal plan and its guards.

A group of copies may hold any share of the files, so groups are only ever aggregated (with map-side
combining) and joined, never gathered in a window or an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsieve.functions.names import ancestors, casefold, natural_key, normalized
from tarnsieve.storage import written

#: Above so many rules they are joined by a shuffle rather than broadcast.
MOST_BROADCAST_RULES = 50_000


def live(dups: DataFrame, actions: DataFrame | None) -> DataFrame:
    """Files of groups without those already removed (`path` in actions)."""
    return dups if actions is None else dups.join(actions.select("path"), "path", "left_anti")


def folder_ranks(dirs: DataFrame, rules: DataFrame, ignore_case: bool = False) -> DataFrame:
    """(dir, rank) of each distinct dir: an exact rule's rank, else that of the longest recursive rule
    above it, else infinity.  Of equally good rules the first by rule_seq counts.

    Every folder is exploded into its ancestors, a handful, and met with the rules by equality; an
    OR of prefix conditions would compare every folder with every rule.
    """
    named = rules.select(normalized(F.col("path"), ignore_case).alias("_at"), "recursive", F.col("rank").cast("double").alias("_rank"), "rule_seq")
    if named.count() <= MOST_BROADCAST_RULES:
        named = F.broadcast(named)
    folders = dirs.select("dir").distinct().withColumn("_dir", normalized(F.col("dir"), ignore_case))
    met = folders.select("dir", "_dir", F.explode(ancestors(F.col("_dir"))).alias("_at")).join(named, "_at")
    exact = F.col("_at") == F.col("_dir")
    best = F.max(F.struct(exact.alias("exact"), F.length("_at").alias("length"), (-F.col("rule_seq")).alias("first"), F.col("_rank").alias("rank")))
    ranked = met.where(exact | F.col("recursive")).groupBy("dir").agg(best.alias("best")).select("dir", F.col("best.rank").alias("rank"))
    return folders.select("dir").join(ranked, "dir", "left").select("dir", F.coalesce("rank", F.lit(float("inf"))).alias("rank"))


def can_delete(dups: DataFrame, actions: DataFrame | None) -> DataFrame:
    """Each file of a group with can_delete: it isn't removed and another of its group isn't either."""
    gone = dups.withColumn("_gone", F.lit(False)) if actions is None else dups.join(actions.select("path").distinct().withColumn("_flag", F.lit(True)), "path", "left").withColumn("_gone", F.coalesce("_flag", F.lit(False))).drop("_flag")
    left = gone.groupBy("full_hash").agg(F.count_if(~F.col("_gone")).alias("live_siblings"))
    return gone.join(left, "full_hash").withColumn("can_delete", ~F.col("_gone") & (F.col("live_siblings") > 1)).drop("_gone")


def live_folders(dups: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Folders with a file of a group that still has two or more."""
    left = live(dups, actions)
    several = left.groupBy("full_hash").agg(F.count("*").alias("n")).where("n > 1")
    return left.join(several, "full_hash", "left_semi").select("dir").distinct()


def suggest(dups: DataFrame, rules: DataFrame, actions: DataFrame | None = None, keep: str = "code") -> DataFrame:
    """The removal plan: full_hash, path, size, dir, name and why.

    why = lower: the file's folder ranks below the best of its group.  why = tie: the group's best rank
    has several files, and of these the one of longest name goes, of equally long ones the last in
    natural order, then the first by path.  keep="code" takes one file from a tie, so of k tied ones
    k - 1 stay; keep="one" takes all but one.
    """
    if keep not in ("code", "one"):
        raise ValueError("keep: code or one")
    left = live(dups, actions)
    # used by every aggregate below: written once
    ranked = written(left.select("full_hash", "path", "dir", "name", "size").join(folder_ranks(left, rules), "dir"), "ranked")
    # the last of each (group, rank): names first, so that the least path among equals is an aggregate too
    named = ranked.groupBy("full_hash", "rank", F.length("name").alias("length"), natural_key(F.col("name")).alias("natural")).agg(F.min("path").alias("first"), F.max("path").alias("last"), F.count("*").alias("n"))
    tiers = named.groupBy("full_hash", "rank").agg(F.max(F.struct("length", "natural", "first")).alias("goes"), F.min(F.struct("length", "natural", "last")).alias("stays"), F.sum("n").alias("n"))
    groups = tiers.groupBy("full_hash").agg(F.min_by(F.struct("rank", "n", F.col("goes.first").alias("goes"), F.col("stays.last").alias("stays")), "rank").alias("top"), F.sum("n").alias("n")).where("n > 1")
    met = ranked.join(groups.select("full_hash", "top"), "full_hash")
    lower = F.col("rank") != F.col("top.rank")
    tied = F.col("path") == F.col("top.goes") if keep == "code" else F.col("path") != F.col("top.stays")
    tie = ~lower & (F.col("top.n") > 1) & tied
    return met.where(lower | tie).select("full_hash", "path", "size", "dir", "name", F.when(lower, "lower").otherwise("tie").alias("why"))


def totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))


def plan_order(plan: DataFrame, dups: DataFrame) -> DataFrame:
    """The plan with `total`, its group's bytes.  Groups are shown by falling total, then by hash; of one
    group the lower-ranked files come first, then the one from a tie, each by path."""
    return plan.join(dups.groupBy("full_hash").agg(F.sum("size").alias("total")), "full_hash")


def preview(plan: DataFrame, dups: DataFrame, n: int = 20) -> DataFrame:
    """The first n paths of a plan in the order shown, each with how many more there are."""
    plan = written(plan, "plan")
    first = plan_order(plan, dups).orderBy(F.desc("total"), "full_hash", "why", "path").limit(n)
    more = plan.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("n_more")).withColumn("_one", F.lit(1))
    return first.select("path", F.lit(1).alias("_one")).join(F.broadcast(more), "_one").select("path", "n_more")  # one row


def prefill(folders: DataFrame, rules: DataFrame) -> DataFrame:
    """Folders with their cached recursive flag and rank, in the order of the ranking list: cached ones
    by rank, then the others by name without case."""
    cached = rules.select(F.col("path").alias("dir"), "recursive", "rank")
    met = folders.select("dir").join(cached, "dir", "left")
    return met.select("dir", F.coalesce("recursive", F.lit(False)).alias("recursive"), "rank")


def prefill_order():
    return [F.col("rank").isNull(), F.col("rank"), casefold(F.col("dir")), F.col("dir")]


def safe_to_apply(plan: DataFrame, dups: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """The planned removals that still leave a file of their group: a plan made before other removals
    must not take a group's last copy.  Of a group that it would empty, the last file by path stays."""
    left = live(dups, actions).select("full_hash", "path")
    wanted = plan.select("path", F.lit(True).alias("_planned"))
    marked = left.join(wanted, "path", "left").withColumn("_planned", F.coalesce("_planned", F.lit(False)))
    groups = marked.groupBy("full_hash").agg(F.count("*").alias("_n"), F.count_if("_planned").alias("_goes"), F.max("path").alias("_last"))
    met = marked.where("_planned").join(groups, "full_hash")
    return plan.join(met.where((F.col("_goes") < F.col("_n")) | (F.col("path") != F.col("_last"))).select("path"), "path", "left_semi")


def with_keepers(planned: DataFrame, dups: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """(path, keeper) of planned removals that leave a file of their group (safe_to_apply): keeper is the first of
    its group, by path, that stays."""
    left = live(dups, actions).select("full_hash", "path")
    keepers = left.join(planned.select("path"), "path", "left_anti").groupBy("full_hash").agg(F.min("path").alias("keeper"))
    return left.join(planned.select("path"), "path", "left_semi").join(keepers, "full_hash").select("path", "keeper")
