"""Reordering of the ranking list: plain functions for the short list that a person edits, and the same for lists
that are tables, of any length."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import numbered as placed

T = TypeVar("T")


def nudge(items: Sequence[T], chosen: Collection[int], step: int) -> list[T]:
    """Moves every chosen place by one (step -1: up, 1: down).  Chosen items at the edge stay, and so do
    chosen ones right behind them."""
    order = list(range(len(items)))
    picked = {i for i in chosen if 0 <= i < len(items)}
    # seen from the edge they move to, each chosen item may pass one that isn't chosen
    places = range(len(order)) if step < 0 else range(len(order) - 1, -1, -1)
    for at in places:
        to = at + (-1 if step < 0 else 1)
        if order[at] in picked and 0 <= to < len(order) and order[to] not in picked:
            order[at], order[to] = order[to], order[at]
    return [items[i] for i in order]


def to_edge(items: Sequence[T], chosen: Collection[int], top: bool) -> list[T]:
    """Moves the chosen items to the top or bottom; they and the others keep their order."""
    block = [x for i, x in enumerate(items) if i in chosen]
    rest = [x for i, x in enumerate(items) if i not in chosen]
    return block + rest if top else rest + block


def ranked(items: Sequence[tuple[str, bool]]) -> list[tuple[str, bool, int]]:
    """(path, recursive, rank) of an ordered list: rank is the place from 0."""
    return [(path, recursive, rank) for rank, (path, recursive) in enumerate(items)]


def numbered(items: Sequence[str]) -> list[str]:
    return [f"{place}. {item}" for place, item in enumerate(items, 1)]


def with_places(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows of a list with their rank, from 0, and `shown`, their place from 1."""
    found = placed(rows, order, "_place")
    return found.select("*", (F.col("_place") - 1).cast("int").alias(name), F.col("_place").cast("int").alias("shown")).drop("_place")


def edge_order(chosen: Column, place: Column, top: bool) -> list[Column]:
    """The order of a list whose chosen rows go to the top or bottom."""
    return [(~chosen if top else chosen), place]


def nudged(rows: DataFrame, place: str, chosen: str) -> DataFrame:
    """A list whose chosen rows go up by one, with their new places.  A row that isn't chosen goes behind the chosen
    ones that follow it, and each of these up by one; chosen rows with none before them stay."""
    others = placed(rows.where(~F.col(chosen)).select(place), [F.col(place)], "_k")
    following = others.select((F.col("_k") - 1).alias("_k"), F.col(place).alias("_next"))
    last = rows.agg((F.max(place) + 1).alias("_last"), F.min(F.when(~F.col(chosen), F.col(place))).alias("_first"))
    # one row
    met = others.join(following, "_k", "left").select(place, "_next").join(rows, place, "right").crossJoin(F.broadcast(last))
    behind = F.coalesce("_next", "_last") - 1
    new = F.when(~F.col(chosen), behind).when(F.col("_first") < F.col(place), F.col(place) - 1).otherwise(F.col(place))
    return met.withColumn("_new", new).drop(place, "_next", "_last", "_first").withColumnRenamed("_new", place).select(*rows.columns)
