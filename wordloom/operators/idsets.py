"""Algebra of id sets: DataFrames with one BIGINT column ``id``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.operators.order import ranged


def ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("long").alias("id"))


def any_of(*sets: DataFrame) -> DataFrame:
    """Union without repeats, for any number of sets: one shuffle."""
    return reduce(DataFrame.unionByName, sets).distinct()


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().join(right, "id", "left_semi")


def but(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().join(right, "id", "left_anti")


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """One after the other, with repeats; ``side`` tells the order."""
    return left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))


def combine(operator: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """By the operator's name; ``seqand`` and unknown ones are refused."""
    known = {"or": any_of, "and": both, "not": but, "append": append}
    if operator not in known:
        raise ValueError(f"no set operator {operator!r}")
    return known[operator](left, right)


def id_range(spark: SparkSession, start: int, count: int) -> DataFrame:
    return spark.range(start, start + count)


#: Fixed value: the ids of one bitmap.
BITS = 32768


def as_bitmap(ids: DataFrame) -> DataFrame:
    """(``bucket``, ``bits``): the set as bitmaps of 32,768 ids each.

    Different ids are dealt out by bucket before bitmaps are built: ids that
    lie far apart would else make a bitmap of 4 KB for each bucket and task."""
    own = ids.select(F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("at"))
    return own.distinct().repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def bitmap_count(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def _bucket_wise(left: DataFrame, right: DataFrame, operator: str) -> DataFrame:
    turned = right.withColumn("bits", F.unhex(F.translate(F.hex("bits"), "0123456789ABCDEF", "FEDCBA9876543210"))) if operator == "not" else right
    sides = left.withColumn("_left", F.lit(1)).unionByName(turned.withColumn("_left", F.lit(0)))
    merge = F.bitmap_or_agg if operator == "or" else F.bitmap_and_agg
    found = sides.groupBy("bucket").agg(merge("bits").alias("bits"), F.sum("_left").alias("_l"), F.count(F.lit(1)).alias("_n"))
    kept = {"or": F.lit(True), "and": F.col("_n") == 2, "not": F.col("_l") == 1}[operator]
    return found.where(kept).select("bucket", "bits").where(F.bitmap_count("bits") > 0)


def bitmap_combine(operator: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """``or``, ``and`` or ``not`` (left without right) of two sets kept as
    bitmaps, bucket by bucket: one shuffle of bitmaps, no ids.  Each side has
    one row for a bucket.  Empty buckets are left out."""
    if operator not in ("or", "and", "not"):
        raise ValueError(f"no bitmap operator {operator!r}")
    return _bucket_wise(left, right, operator)


def from_bitmap(bitmaps: DataFrame) -> DataFrame:
    """The ids of a set kept as bitmaps; numbers up to 0 count backwards in
    their buckets, as ``as_bitmap`` puts them there."""
    pairs = F.regexp_extract_all(F.hex("bits"), F.lit("(..)"), F.lit(1))
    filled = F.filter(F.transform(pairs, lambda h, i: F.struct(F.conv(h, 16, 10).cast("int").alias("byte"), i.alias("i"))), lambda x: x["byte"] > 0)
    bits = bitmaps.select("bucket", F.explode(filled).alias("x")).select("bucket", "x.i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(F.col("x.byte"), k) == 1)).alias("k"))
    at = F.col("i") * 8 + F.col("k")
    return bits.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BITS + at + 1).otherwise(F.col("bucket") * BITS - at).cast("long").alias("id"))


def drop_adjacent(df: DataFrame, order: list[str], value: str, within: list[str]) -> DataFrame:
    """Rows whose value differs from the one before them, in each ``within``
    group; the first row of a group stays.  Rows are dealt out by ranges of
    group and order, so one large group is many tasks; the last row of each
    partition is carried to the next."""
    keys = [*within, *order]
    here = F.struct(*within, F.col(value).alias("_value"))
    rows = ranged(df, [F.col(c).asc() for c in keys]).withColumn("_here", here)
    inside = Window.partitionBy("_part").orderBy(*keys)
    last = rows.groupBy("_part").agg(F.max_by("_here", F.struct(*keys)).alias("_last"))
    carried = last.select(F.col("_part").alias("_of"), F.lag("_last").over(Window.orderBy("_part")).alias("_carry"))
    rows = rows.withColumn("_before", F.lag("_here").over(inside)).withColumn("_n", F.row_number().over(inside))
    rows = rows.join(carried, F.col("_part") == F.col("_of")).withColumn("_before", F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_before")))
    return rows.where(~F.col("_here").eqNullSafe(F.col("_before"))).select(*df.columns)


def merge_records(a: DataFrame, b: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Rows of both tables, one for each key: the one with the smallest ``tie``."""
    names = [c for c in a.columns if c not in keys]
    first = F.min_by(F.struct(*names), tie).alias("_row")
    return a.unionByName(b).groupBy(*keys).agg(first).select(*keys, "_row.*")


def merge_scored(inputs: list[DataFrame], result: Column | None = None) -> DataFrame:
    """(id, score) sets merged by id.  ``s0``, ``s1``... hold each input's
    score, null where it lacks the id; ``result`` is an expression over them,
    their sum by default."""
    tagged = reduce(DataFrame.unionByName, [d.select("id", "score", F.lit(k).alias("_k")) for k, d in enumerate(inputs)])
    each = [F.max(F.when(F.col("_k") == k, F.col("score"))).alias(f"s{k}") for k in range(len(inputs))]
    total = reduce(lambda x, y: x + y, [F.coalesce(F.col(f"s{k}"), F.lit(0)) for k in range(len(inputs))])
    return tagged.groupBy("id").agg(*each).withColumn("score", result if result is not None else total)
