"""Range partitions whose bounds are drawn from a bounded sample.

Bounds are drawn once and shipped with the tasks, so that every row's
partition is a fixed function of its key, however often a lost task is run
again.  Keys are compared as Python compares tuples, which for strings and
binaries is Spark's own order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows drawn for each partition, and the length that a drawn key is cut to (a bound need not be a key that exists).
DRAWN, LONGEST = 20, 1024


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounds(rows: DataFrame, keys: list[str], parts: int) -> list[tuple]:
    """At most ``parts - 1`` key tuples that cut ``rows`` into ranges of about
    one size.  The last key has to tell equal rows apart (an id), or a group
    of them stays whole.  About ``DRAWN * parts`` rows reach the driver, by a
    hash and never more than twice as many; keys hold no null."""
    wanted = DRAWN * parts
    total = rows.count()
    scale = 1 << 30
    cut = [F.substring(k, 1, LONGEST).alias(k) if rows.schema[k].dataType.typeName() in ("string", "binary") else F.col(k) for k in keys]
    drawn = rows.where(F.pmod(F.xxhash64(*keys), F.lit(scale)) < min(scale, wanted * scale // max(1, total) + 1)).select(*cut).limit(2 * wanted).collect()
    found = sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in drawn)
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def dealt(rows: DataFrame, keys: list[str], cuts: list[tuple]) -> DataFrame:
    """``rows`` with the number of their range as ``part``; no shuffle."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            values = [frame.column(frame.schema.get_field_index(k)).to_pylist() for k in keys]
            part = [bisect_right(cuts, v) for v in zip(*values, strict=True)]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(part, pa.int32())], [*frame.schema.names, "part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, part int")
