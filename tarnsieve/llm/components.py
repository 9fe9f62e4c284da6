"""Connected components of an edge table, by alternating large and small stars.

Every round replaces each node's edges by edges to the least node known to it; the number of
rounds grows with the logarithm of the longest chain.  A round is two joins on a node and two
minima (pre-aggregated where the edges are), so a node with very many edges is dealt out by the
adaptive skew join.  Each round's edges are written to the shared folder in place of the last ones; nothing is
collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def _starred(edges: DataFrame, keep) -> DataFrame:
    """edges (u, v): each v that `keep` names gets an edge to the least node of u's star."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", "m").where(keep)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the least node reachable.  Loops and null ends are no edges."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    now = written(now, "edges")
    before = _state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the lower neighbours and u itself go to the least of them
        small = _starred(large, F.lit(True))
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        last, now = now, written(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        discard(last)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
