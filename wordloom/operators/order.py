"""Orders, pages and ranks.  The row id always ends an order, so that ties
are settled."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.sources.kept import kept, shared_folder


def chain(*keys: tuple[str, bool], reverse: bool = False, rid: str = "rid") -> list[Column]:
    """Sort keys (column, ascending) one after another; ``reverse`` turns the
    whole chain round, but for the row id."""
    turned = [F.col(c).asc() if up != reverse else F.col(c).desc() for c, up in keys]
    return [*turned, F.col(rid).asc()]


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows dealt out by ranges of an order, with their partition's number
    ``_part``, written once: range bounds come from a sample, so a second
    evaluation might draw them elsewhere."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that no read joins partitions
    return kept(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Adds each row's place (from 0) in an order, in parallel.

    Rows are sorted over range partitions; a partition's first place is the
    number of rows in those before it, of which there is one count each."""
    rows = ranged(df, order)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    placed = rows.withColumn("_n", F.row_number().over(inside) - 1).join(first, F.col("_part") == F.col("_of"))
    return placed.withColumn(name, (F.col("_before") + F.col("_n")).cast("long")).drop("_part", "_n", "_of", "_before")


def top(df: DataFrame, order: list[Column], begin: int, count: int, name: str = "pos") -> DataFrame:
    """Rows begin to begin + count - 1 of an order with their places.  Each
    task keeps its first begin + count rows, and only these are merged."""
    first = df.orderBy(*order).limit(begin + count)
    return first.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")).where(F.col(name) >= begin)


def page(df: DataFrame, order: list[Column], at: int, size: int) -> DataFrame:
    """The page that holds place ``at``."""
    return top(df, order, at - at % size, size)


@dataclass(frozen=True)
class Pages:
    """An ordered result in files, a folder ``_part`` for each range of the
    order.  ``starts``: how many rows stand before each range, and ``total``."""

    rows: DataFrame
    order: list[Column]
    starts: dict[int, int]
    total: int


def paged(df: DataFrame, order: list[Column], path: str | None = None) -> Pages:
    """Sorts once, for any number of pages.  ``order`` should end in a row id,
    so that no range grows with the number of equal keys.  ``path``: a new
    folder of the shared one if None."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    dealt.sortWithinPartitions("_part", *order).write.partitionBy("_part").parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    starts, total = {}, 0
    for r in rows.groupBy("_part").count().orderBy("_part").collect():  # one number for each range
        starts[r["_part"]] = total
        total += r["count"]
    return Pages(rows, order, starts, total)


def page_at(pages: Pages, begin: int, size: int, name: str = "pos") -> DataFrame:
    """Rows begin to begin + size - 1 with their places: only the ranges that
    hold some of them, one or two for a short page, are read and sorted."""
    ends = dict(zip(pages.starts, [*list(pages.starts.values())[1:], pages.total], strict=False))
    held = {p: start for p, start in pages.starts.items() if start < begin + size and ends[p] > begin}
    before = F.create_map(*(F.lit(v) for pair in held.items() for v in pair)) if held else F.create_map(F.lit(0), F.lit(0))
    inside = Window.partitionBy("_part").orderBy(*pages.order)
    placed = pages.rows.where(F.col("_part").isin(list(held))).withColumn(name, (before[F.col("_part")] + F.row_number().over(inside) - 1).cast("long"))
    return placed.where(F.col(name).between(begin, begin + size - 1)).drop("_part")


def with_neighbours(df: DataFrame, order: list[Column], columns: list[str], before: int = 1, after: int = 1) -> DataFrame:
    """Adds ``<column>_m<k>`` and ``<column>_p<k>``: a column's value in the
    row k places before or after, null beyond the ends, for any condition on a
    row and its neighbours.

    Rows are dealt out by ranges of the order; each range borrows the rows
    next to it, which are among the first or last few of the other ranges."""
    rows = ranged(df, order)
    inside = Window.partitionBy("_part").orderBy(*order)
    sizes = rows.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_size"))
    counted = rows.withColumn("_n", F.row_number().over(inside)).join(sizes, F.col("_part") == F.col("_of")).withColumn("_r", F.col("_size") - F.col("_n") + 1)
    along = Window.orderBy("_part", "_n")
    halo = None
    for own, reach, side in (("_n", after, 1), ("_r", before, -1)):
        if not reach:
            continue
        # The edge rows of all ranges on one line: a few for each range.
        edge = counted.where(F.col(own) <= reach).withColumn("_i", F.row_number().over(along))
        limits = edge.groupBy("_part").agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"))
        start = F.col("_hi") + 1 if side > 0 else F.col("_lo") - reach
        wanted = limits.select(F.col("_part").alias("_to"), F.explode(F.sequence(start, start + reach - 1)).alias("_j"))
        lent = edge.join(wanted, F.col("_i") == F.col("_j")).drop("_part").withColumnRenamed("_to", "_part").select(*df.columns, "_part")
        halo = lent if halo is None else halo.unionByName(lent)
    own = rows.select(*df.columns, "_part", F.lit(False).alias("_lent"))
    every = own if halo is None else own.unionByName(halo.withColumn("_lent", F.lit(True)))
    moved = {f"{c}_m{k}": F.lag(c, k).over(inside) for c in columns for k in range(1, before + 1)} | {f"{c}_p{k}": F.lead(c, k).over(inside) for c in columns for k in range(1, after + 1)}
    return every.withColumns(moved).where("not _lent").drop("_part", "_lent")


def slice_rows(df: DataFrame, rid: str, start: int, count: int, within: int | None = None) -> DataFrame:
    """Rows by dense row id: a range filter that reaches the scan.  ``within``:
    the number of rows; a slice that ends beyond them is refused."""
    if within is not None and (start < 0 or count < 0 or start + count > within):
        raise IndexError(f"rows {start} to {start + count} of {within}")
    return df.where(F.col(rid).between(start, start + count - 1))


def through_link(df: DataFrame, key: str, target: DataFrame, target_key: str, field: str, name: str) -> DataFrame:
    """Adds a linked row's field to sort by."""
    return df.join(target.select(F.col(target_key).alias("_k"), F.col(field).alias(name)), F.col(key) == F.col("_k"), "left").drop("_k")


def by_score() -> list[Column]:
    return [F.col("score").desc(), F.col("id").asc()]


def by_result() -> list[Column]:
    return [F.col("type").asc(), F.col("clid").asc(), F.col("rid").asc()]
