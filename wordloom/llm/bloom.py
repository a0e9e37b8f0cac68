"""Bloom filters filled by all tasks and merged piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

from wordloom.llm.textcols import give_back, mix

#: Bits of one piece of a filter; merging holds one piece of each number.
PIECE_BITS = 1 << 19


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)


class Bloom:
    """A Bloom filter of two hash functions over a bit array."""

    def __init__(self, bits: int, packed: bytes | None = None):
        self.bits = bits
        self.array = np.zeros(bits >> 3, np.uint8) if packed is None else np.frombuffer(packed, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for p in _places(hashes, self.bits):
            np.bitwise_or.at(self.array, p >> np.uint64(3), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for p in _places(hashes, self.bits):
            found &= (self.array[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _fill_ids(bits: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = Bloom(bits)
        for frame in frames:
            filled.add(mix(frame.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        step = min(PIECE_BITS, bits) >> 3
        pieces = [(k // step, filled.array[k : k + step]) for k in range(0, bits >> 3, step)]
        pieces = [(k, zstandard.ZstdCompressor(3).compress(p.tobytes())) for k, p in pieces if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.int32()), pa.array([p for _, p in pieces], pa.binary())], ["piece", "bits"])

    return run


def _union(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for frame in frames:
        for piece, raw in zip(*(c.to_pylist() for c in frame.columns), strict=True):
            bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
            held[piece] = held[piece] | bits if piece in held else bits
    packed = [zstandard.ZstdCompressor(3).compress(v.tobytes()) for v in held.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], ["piece", "bits"])


def id_filter(ids: DataFrame, max_bits: int = 1 << 28) -> Broadcast:
    """A broadcast filter (packed bits) of a column of integer ids: 16 bits
    for each, at most ``max_bits`` (32 MB).  No id that is in it is missed; a
    fuller filter lets more others through, which an exact join has to drop."""
    n, bits = ids.count(), 1 << 16
    while bits < min(max_bits, 16 * n):
        bits *= 2
    step = min(PIECE_BITS, bits) >> 3
    merged = ids.mapInArrow(_fill_ids(bits), "piece int, bits binary").repartition(min(64, max(1, bits // PIECE_BITS)), "piece").mapInArrow(_union, "piece int, bits binary")
    array = np.zeros(bits >> 3, np.uint8)
    for row in merged.toLocalIterator():
        array[row["piece"] * step : (row["piece"] + 1) * step] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["bits"])), np.uint8)
    return ids.sparkSession.sparkContext.broadcast(array.tobytes())


def may_hold(packed: bytes, ids: np.ndarray) -> np.ndarray:
    return Bloom(8 * len(packed), packed).has(mix(ids.astype(np.int64).view(np.uint64)))


def _maybe(shared):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what a task of another kind has left
        for frame in frames:
            # In slices, so that no whole batch of texts is held twice.
            for at in range(0, frame.num_rows, 256):
                part = frame.slice(at, 256)
                names = part.column(part.schema.get_field_index("name")).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(may_hold(shared.value, names), pa.bool_())], [*part.schema.names, "maybe"])
                del part
            del frame
            pa.default_memory_pool().release_unused()
        give_back()

    return run


def split_by_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (with a 64-bit ``name``) and whether each one's name may be in
    ``names``, by a filter: what surely isn't there need not be shuffled."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_maybe(id_filter(names)), f"{fields}, maybe boolean")
