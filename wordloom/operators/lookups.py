"""Lookups by an ordered key, one at a time or many at once.

A single lookup is a filtered aggregate, whose filter a sorted Parquet file
answers from row-group statistics.  Many lookups are one as-of join: targets
and keys are laid on one line and a window carries the last key seen, by
range partition and not in one task.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.order import Pages, numbered, paged, ranged
from wordloom.sources.kept import kept

MODES = ("exact", "last_before", "first_after", "exact_or_before", "exact_or_after")


def _condition(key: Column, target: Column, mode: str) -> Column:
    return {"exact": key == target, "last_before": key < target, "first_after": key > target, "exact_or_before": key <= target, "exact_or_after": key >= target}[mode]


def lookup(table: DataFrame, key: str, rid: str, target, mode: str = "exact") -> DataFrame:
    """One row (key, rid) of the key found; none if there is none.  Of rows
    with equal keys the smallest rid is found.  An empty text key is refused."""
    if mode not in MODES:
        raise ValueError(f"no lookup mode {mode!r}")
    if target == "":
        raise ValueError("an empty text key")
    found = table.where(_condition(F.col(key), F.lit(target), mode))
    best = F.max(key) if mode in ("last_before", "exact_or_before") else F.min(key)
    return found.groupBy().agg(best.alias("_k")).where("_k is not null").join(found.select(key, rid), F.col("_k") == F.col(key)).groupBy(key).agg(F.min(rid).alias(rid))


def lookup_many(table: DataFrame, key: str, rid: str, targets: DataFrame, target: str, mode: str = "exact") -> DataFrame:
    """(target, rid or null) for each different target.

    Exact lookups are an equi-join.  For the others, keys and targets are dealt
    out by ranges of the key; a window carries the last key seen inside each
    partition, and a target before its partition's first key takes the last
    key of an earlier partition, of which there is one row each.
    """
    if mode not in MODES:
        raise ValueError(f"no lookup mode {mode!r}")
    keys = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(rid).alias("_r"))
    wanted = targets.where(F.col(target).isNotNull()).select(F.col(target).alias("_k")).distinct()
    if mode == "exact":
        return wanted.join(keys, "_k", "left").select(F.col("_k").alias(target), F.col("_r").alias(rid))
    after = mode in ("first_after", "exact_or_after")
    strict = mode in ("last_before", "first_after")
    line = keys.select("_k", "_r", F.lit(1 if strict else 0).alias("_side")).unionByName(wanted.select("_k", F.lit(None).cast(table.schema[rid].dataType).alias("_r"), F.lit(0 if strict else 1).alias("_side")))
    line = line.withColumn("_key", F.col("_side") == (1 if strict else 0))
    order = [F.col("_k").desc() if after else F.col("_k").asc(), F.col("_side").asc()]
    line = ranged(line, order)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = line.withColumn("_found", F.last(F.when(F.col("_key"), F.col("_r")), ignorenulls=True).over(inside))
    last = line.groupBy("_part").agg((F.min_by if after else F.max_by)("_r", F.when(F.col("_key"), F.col("_k"))).alias("_last"))
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("_part").alias("_of"), F.last("_last", ignorenulls=True).over(over).alias("_carry"))
    seen = seen.join(carried, F.col("_part") == F.col("_of")).withColumn("_found", F.coalesce("_found", "_carry"))
    return seen.where(~F.col("_key")).select(F.col("_k").alias(target), F.col("_found").alias(rid))


def list_position(table: DataFrame, key: str, target: str) -> DataFrame:
    """The row where a list opens for a typed word: how many keys are smaller,
    at most the last row's number."""
    smaller = F.count(F.when(F.col(key) < target, 1)) if target else F.lit(0).cast("long")
    return table.agg(F.greatest(F.lit(0), F.least(smaller, F.count(F.lit(1)) - 1)).cast("long").alias("position"))


@dataclass(frozen=True)
class Ranks:
    """A sorted key in files with a directory: the first key of each range and
    how many keys stand before it."""

    pages: Pages
    key: str
    parts: list[int]
    firsts: list[str]


def ranks(table: DataFrame, key: str, path: str | None = None) -> Ranks:
    """Sorts the different keys of a table once, for any number of lists to
    open.  The directory has one entry for each range."""
    pages = paged(table.where(F.col(key).isNotNull()).select(key).distinct(), [F.col(key).asc()], path)
    held = pages.rows.groupBy("_part").agg(F.min(key).alias("first")).orderBy("_part").collect()
    return Ranks(pages, key, [r["_part"] for r in held], [r["first"] for r in held])


def position_in(held: Ranks, target: str) -> DataFrame:
    """``list_position`` by the directory: one range of the key is read."""
    at = bisect_left(held.firsts, target) - 1  # the last range that begins below the target
    part = held.parts[max(at, 0)] if held.parts else -1
    smaller = F.count(F.when(F.col(held.key) < target, 1)) + (held.pages.starts[part] if at >= 0 else 0)
    read = held.pages.rows.where(F.col("_part") == part)
    return read.agg(F.greatest(F.lit(0), F.least(smaller, F.lit(held.pages.total - 1))).cast("long").alias("position"))


def list_positions(table: DataFrame, key: str, targets: DataFrame, target: str) -> DataFrame:
    """(target, ``position``) of each different typed word: the keys are
    numbered over range partitions, and one as-of pass finds the first key
    that isn't smaller."""
    keys = numbered(table.where(F.col(key).isNotNull()).select(key).distinct(), [F.col(key).asc()], "position")
    keys = kept(keys)
    last = max(keys.count() - 1, 0)
    found = lookup_many(keys, key, "position", targets, target, "exact_or_after")
    return found.select(target, F.coalesce("position", F.lit(last)).cast("long").alias("position"))


def lower_bound(values: Column, target: Column) -> Column:
    """Where ``target`` goes into a sorted array (from 0)."""
    return F.size(F.filter(values, lambda v: v < target))
