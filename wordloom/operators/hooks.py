"""Where a caller's own code takes part: filters of records, results of a
merge, and changes of byte strings.

All three hand Arrow batches to a function inside tasks, never single rows,
and shuffle no more than the plain operator does.  Expressions are faster
where they can say the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of the byte strings in one batch that goes back to Spark.
HELD = 8 << 20


def keep_records(df: DataFrame, check: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """Rows for which ``check`` says true: it gets a batch and returns a
    boolean for each row (null: dropped)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield frame.filter(check(frame))

    return df.mapInArrow(run, df.schema)


def merge_with(inputs: list[DataFrame], order: str, compute: Callable[[pa.RecordBatch], list[pa.Array]], result: str) -> DataFrame:
    """Merges sets of ids; for each id ``compute`` makes the result.

    Every input has different ids and a column ``order``.  ``compute`` gets
    batches of (``id``, ``rank<k>``, ``match<k>``): whether input k holds the
    id, and at which place of its order (from 0; null if it doesn't).
    ``result`` names the columns that it returns, as in a schema.  Inputs are
    ranked over range partitions and meet in one shuffle.
    """
    from wordloom.operators.order import numbered

    ranked = [numbered(d.select("id", F.col(order).alias("_o")), [F.col("_o").asc(), F.col("id").asc()], "rank").select("id", "rank", F.lit(k).alias("k")) for k, d in enumerate(inputs)]
    each = [F.max(F.when(F.col("k") == k, F.col("rank"))).alias(f"rank{k}") for k in range(len(inputs))]
    merged = reduce(DataFrame.unionByName, ranked).groupBy("id").agg(*each)
    merged = merged.select("*", *(F.col(f"rank{k}").isNotNull().alias(f"match{k}") for k in range(len(inputs))))
    fields = StructType.fromDDL(result)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield pa.RecordBatch.from_arrays([frame.column(0), *compute(frame)], ["id", *fields.names])

    return merged.mapInArrow(run, StructType([merged.schema["id"], *fields]))


def change_blobs(df: DataFrame, column: str, change: Callable[[bytes], bytes]) -> DataFrame:
    """Rows with a byte string put through ``change``; null stays.  Results go
    back in batches of ``HELD`` bytes, so a task holds few large ones."""
    fields = StructType([f if f.name != column else StructType.fromDDL(f"`{column}` binary")[0] for f in df.schema])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            at = frame.schema.get_field_index(column)
            held, size, begun = [], 0, 0
            for i in range(frame.num_rows):
                value = frame.column(at)[i].as_py()
                held.append(None if value is None else change(value))
                size += len(held[-1] or b"")
                if size >= HELD or i == frame.num_rows - 1:
                    part = frame.slice(begun, i + 1 - begun)
                    columns = [pa.array(held, pa.binary()) if k == at else c for k, c in enumerate(part.columns)]
                    yield pa.RecordBatch.from_arrays(columns, frame.schema.names)
                    held, size, begun = [], 0, i + 1

    return df.mapInArrow(run, fields)
