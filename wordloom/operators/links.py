"""Following links between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import wildcard
from wordloom.operators.hops import Hop, follow, resolve_key, resolve_link  # noqa: F401  (one name for all links)
from wordloom.operators.index import matches
from wordloom.operators.search import EXACT_MODES


def link_count(parents: DataFrame, key: str, children: DataFrame, parent: str, name: str = "n_links") -> DataFrame:
    """(key, number of linked rows), 0 where there are none."""
    counted = children.groupBy(F.col(parent).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    return parents.select(key).join(counted, F.col(key) == F.col("_p"), "left").select(key, F.coalesce("_n", F.lit(0)).alias(name))


def expand_forms(ids: DataFrame, forms: DataFrame, condition: Column, links: str) -> DataFrame:
    """Adds what inflected forms link to: rows of ``forms`` that meet the
    condition, their arrays of ids opened."""
    return ids.select("id").unionByName(forms.where(condition).select(F.explode(F.col(links).cast("array<bigint>")).alias("id"))).distinct()


def search_inflected(rows: DataFrame, key: str, words: list[str], forms: DataFrame, links: str, mode: str = "all") -> DataFrame:
    """Ids of the rows of ``rows`` (key, word) with one of the words, and of
    those that inflected forms (``form`` and an array of ids) link to.

    A word with a wildcard is looked up as a pattern among the forms, any
    other by its exact key.  The exact modes leave forms out.
    """
    plans = [wildcard(w) for w in words]

    def any_of(column: str) -> Column:
        found = matches(plans[0], False, F.col(column))
        for p in plans[1:]:
            found = found | matches(p, False, F.col(column))
        return found

    direct = rows.where(any_of("word")).select(F.col(key).alias("id")).distinct()
    return direct if mode in EXACT_MODES else expand_forms(direct, forms, any_of("form"), links)
