"""Named tables, single rows, slices and word lists."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.settings import pairs, register


def _native(spark: SparkSession, name: str, base: str) -> DataFrame:
    path = f"{base}/{name}" if base and not re.match(r"^(/|\w+://)", name) else name
    return spark.read.parquet(path if path.endswith(".parquet") else f"{path}.parquet")


def _settings(spark: SparkSession, name: str, base: str) -> DataFrame:
    register(spark)
    return spark.read.format("settings").load(f"{base}/{name}" if base and not re.match(r"^(/|\w+:)", name) else name)


#: How each kind of table is opened: (session, name, base folder) to a DataFrame.
KINDS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {"native": _native, "cursor": lambda spark, name, base: spark.table(name), "settings": _settings}


def add_kind(kind: str, opener: Callable[[SparkSession, str, str], DataFrame]) -> None:
    """Makes another kind known; a known one isn't replaced."""
    if kind in KINDS:
        raise ValueError(f"the kind {kind!r} is taken")
    KINDS[kind] = opener


def open_table(spark: SparkSession, url: str, base: str = "") -> DataFrame:
    """``<kind>:<name>``: ``native`` is a Parquet table (with or without the
    ending), ``cursor`` a registered view, ``settings`` a folder of sections
    with pairs; ``add_kind`` adds others."""
    kind, _, name = url.partition(":")
    if kind not in KINDS:
        raise ValueError(f"no kind of table {kind!r}")
    return KINDS[kind](spark, name, base)


def fields(df: DataFrame) -> list[tuple[int, str, str]]:
    """A table's fields: place, name and type."""
    return [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]


def point_read(table: DataFrame, rid: str, value: int, must_exist: bool = False) -> DataFrame:
    """The row of an id.  ``must_exist`` looks at once and refuses an id that
    isn't there."""
    found = table.where(F.col(rid) == value)
    if must_exist and found.isEmpty():
        raise LookupError(f"no row {value}")
    return found


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file without their ends, as ``line``."""
    return spark.read.text(path).select(F.rtrim(F.col("value"), F.lit("\r\n")).alias("line"))


def word_set(rows: DataFrame, line: str = "line") -> DataFrame:
    """Different words of a list, compared without regard to case."""
    return rows.select(F.lower(F.trim(line)).alias("word")).where("word <> ''").distinct()


def settings(text: str) -> dict[str, dict[str, str]]:
    """Sections of ``key=value`` lines by the rules of ``settings.pairs``; of
    equal keys the last one counts."""
    out: dict[str, dict[str, str]] = {"": {}}
    for _, section, key, value in pairs(text.splitlines()):
        out.setdefault(section, {})[key] = value
    return out


def code_points(text: Column) -> Column:
    """A text's different code points in order, as an integer list."""
    return F.array_sort(F.array_distinct(F.transform(F.split(text, ""), lambda c: F.ascii(c))))


def search_path(name: str, folders: str, exists=os.path.exists) -> str | None:
    """The first of ``;``-separated folders of the driver that has a file."""
    return next((f"{d}/{name}" for d in folders.split(";") if exists(f"{d}/{name}")), None)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(``name``, ``data``) of stored byte strings."""
    return spark.read.parquet(path)


def integers(raw: Column) -> Column:
    """The different unsigned 32-bit little-endian numbers of a byte string in
    order; bytes that fill no number are left out."""
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("(.{8})"), F.lit(1))
    turned = F.transform(pairs, lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))
    return F.array_sort(F.array_distinct(F.transform(turned, lambda h: F.conv(h, 16, 10).cast("long"))))


def hex_integers(text: Column) -> Column:
    """The different hexadecimal numbers of a text in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([0-9A-Fa-f]+)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))))
