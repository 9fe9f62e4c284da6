"""Positions in a sorted order, of a whole table or within groups, without a single sorting task.

A row_number over one window sorts everything (or everything of a group) in one task.  Here rows are
range-partitioned and sorted, numbered within their partitions, and written; the partitions' sizes,
one row each, then give every partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnsieve.storage import written

_WITHIN = 33  # bits of monotonically_increasing_id that number the rows of a partition


def numbered(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """rows with their place, from 1, in the order; it has to be total for a definite result."""
    keyed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    held = written(keyed, "sorted")
    sizes = held.groupBy(F.shiftright("_id", _WITHIN).alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _WITHIN) - 1)) + 1
    # one row for each partition of the range exchange: broadcast
    return held.join(F.broadcast(before), F.shiftright("_id", _WITHIN) == F.col("_part")).withColumn(name, place).drop("_id", "_part", "_n", "_before")


def numbered_within(rows: DataFrame, group: str, order: list[Column], name: str = "pos") -> DataFrame:
    """rows with their place in their group; a group may spread over any number of tasks."""
    placed = written(numbered(rows, [F.col(group), *order], "_all"), "numbered")
    first = placed.groupBy(group).agg(F.min("_all").alias("_first"))
    return placed.join(first, group).withColumn(name, F.col("_all") - F.col("_first") + 1).drop("_all", "_first")
