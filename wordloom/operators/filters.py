"""Row filters, as conditions for ``where``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import bits


@dataclass(frozen=True)
class BitRule:
    """Accepts or rejects if ``(value >> shift) & mask`` is in [low, high]."""

    accept: bool
    low: int
    high: int
    shift: int = 0
    mask: int = (1 << 32) - 1


def bit_rules(value: Column, rules: list[BitRule], default: bool = True) -> Column:
    """The first rule that fits decides; else ``default``."""
    out = None
    for r in rules:
        fits = bits(value, r.shift, r.mask).between(r.low, r.high)
        out = F.when(fits, F.lit(r.accept)) if out is None else out.when(fits, F.lit(r.accept))
    return F.lit(default) if out is None else F.coalesce(out.otherwise(F.lit(default)), F.lit(default))


def accept_values(value: Column, *values: int) -> Column:
    return bit_rules(value, [BitRule(True, v, v) for v in values], default=False)


def reject_range(value: Column, low: int, high: int) -> Column:
    return bit_rules(value, [BitRule(False, low, high)])


def type_mask(kind: Column, mask: int) -> Column:
    """Whether bit number ``kind`` (0 to 7) of an 8-bit mask is set."""
    return kind.cast("int").isin([k for k in range(8) if mask >> k & 1])


def title_level(structure: Column) -> Column:
    return bits(structure, 2, 7)


def titles_only(structure: Column, main: bool = True, most: int = 7) -> Column:
    """Level 0 if the main title is wanted, and levels 1 to ``most``."""
    level = title_level(structure)
    return ((level == 0) & F.lit(main)) | level.between(1, most)


def in_set(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose value is in an id set."""
    return df.join(ids.select(F.col("id").alias("_id")), F.col(column) == F.col("_id"), "left_semi")


def not_in_set(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col("id").alias("_id")), F.col(column) == F.col("_id"), "left_anti")


def through_link(df: DataFrame, column: str, target: DataFrame, key: str, condition: Column) -> DataFrame:
    """Rows whose linked row in ``target`` meets a condition."""
    return df.join(target.where(condition).select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_semi")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: an expression named inside a
    lambda is computed anew at each of its calls."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def near_positions(positions: Column, others: Column, before: int, after: int) -> Column:
    """Positions p with some other position in [p - before, p + after], in
    order; a negative reach admits none on that side.

    Both lists are merged once.  A position's place on the merged line less
    its place among its own kind is the number of others up to it, so its two
    neighbours among them are read directly, whatever the reach."""

    def merged(v: Column) -> Column:
        tagged = lambda name, own: F.transform(v[name], lambda x: F.struct(x.alias("at"), F.lit(own).alias("own")))
        line = F.sort_array(F.concat(tagged("others", 0), tagged("positions", 1)))
        placed = F.filter(F.transform(line, lambda x, i: F.struct(x["at"].alias("at"), x["own"].alias("own"), i.alias("i"))), lambda x: x["own"] == 1)

        def meets(x: Column, k: Column) -> Column:
            last, following = (F.get(v["others"], x["i"] - k - back) for back in (1, 0))
            return (x["at"] - last <= before) | (following - x["at"] <= after)

        return F.transform(F.filter(placed, meets), lambda x: x["at"])

    return let(F.struct(F.sort_array(positions).alias("positions"), F.sort_array(others).alias("others")), merged)
