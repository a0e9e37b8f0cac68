"""Steps of a path of links, on id sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_key(ids: DataFrame, table: DataFrame, rid: str, fk: str) -> DataFrame:
    """The foreign keys of the rows named by ``ids``, repeats included."""
    return ids.join(table.select(F.col(rid).alias("_r"), F.col(fk).cast("long").alias("_f")), F.col("id") == F.col("_r")).select(F.col("_f").alias("id"))


def resolve_link(ids: DataFrame, children: DataFrame, parent: str, value: str) -> DataFrame:
    """The different values of the rows that ``ids`` link to."""
    rows = children.join(ids.select(F.col("id").alias("_i")), F.col(parent) == F.col("_i"), "left_semi")
    return rows.select(F.col(value).cast("long").alias("id")).distinct()


@dataclass(frozen=True)
class Hop:
    """One step of a path.  With ``many`` the table is a child table and
    results are different values; without, a foreign key is followed and
    repeats stay.  ``merge`` adds the ids that came in."""

    table: DataFrame
    key: str
    value: str
    many: bool = False
    merge: bool = False


def follow(ids: DataFrame, path: list[Hop]) -> DataFrame:
    for hop in path:
        found = (resolve_link if hop.many else resolve_key)(ids, hop.table, hop.key, hop.value)
        ids = found.unionByName(ids.select("id")).distinct() if hop.merge else found
    return ids
