"""Vectorised access to the words and lines of an Arrow text column.

A batch of texts is looked at as one byte array.  White space is the ASCII
set ``[\\x20\\x09-\\x0D]``; a word is a longest run of other bytes inside one
text.  Null texts count as empty ones.  Everything here works on one Arrow
batch inside a task; Spark does the partitioning.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The 64-bit finalizer of SplitMix64, over an array."""
    x = x + np.uint64((seed * int(GOLD)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the n + 1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data - np.uint8(9)) <= 4)


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n + 1 bounds into ``starts`` (sorted byte positions) for the texts."""
    return np.searchsorted(starts, offsets)


class Words:
    """The words of a batch.

    ``start`` and ``end`` are byte positions, ``bounds`` the n + 1 limits of
    each text's words, ``codes`` the index of each word in ``vocabulary``
    (the batch's different words as an Arrow binary array).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, encode: bool = True):
        self.data, self.offsets = data, offsets
        self.space = space = is_space(data)
        begins = ~space
        if len(data):
            first = np.zeros(len(data), bool)
            first[offsets[:-1][offsets[:-1] < len(data)]] = True
            after = np.empty(len(data), bool)
            after[0] = True
            after[1:] = space[:-1]
            starts = begins & (after | first)
            self.start = np.flatnonzero(starts)
            kept = np.cumsum(begins, dtype=np.int32)
            self._flat = np.append(kept[self.start] - 1, kept[-1])
            self.end = self.start + np.diff(self._flat)
        else:
            self.start = self.end = np.zeros(0, np.int64)
            self._flat = np.zeros(1, np.int64)
        self.bounds = per_text(self.start, offsets)
        if encode:
            self._encode(data[begins])

    def _encode(self, flat: np.ndarray) -> None:
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.start), [None, pa.py_buffer(self._flat.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]
        )
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.vocabulary = coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def text_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(texts)
    if lower:
        data = lower_ascii(data)
    return Words(data, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data - np.uint8(65)) < 26, data | np.uint8(32), data)


def hash_binary(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each value of a binary array (dictionaries only)."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(v, seed) for v in values.to_pylist()), np.uint64, len(values))


#: What the tasks of one kind remember in a worker for the next of their kind, by the kind's name.
REMEMBERED: dict[str, dict] = {}


def batches(frames, rows: int = 1 << 30, size: int = 24 << 20, text: str = "text", kind: str = ""):
    """Joins small Arrow batches until they hold ``size`` bytes of text, and
    cuts large ones, so that vectorised work has enough rows and memory stays
    bounded (one text may exceed the size by itself).  ``kind``: whose memory
    in ``REMEMBERED`` stays."""
    give_back(kind)  # what a task of another kind has left
    held: list[pa.RecordBatch] = []
    held_rows = held_size = 0
    for frame in frames:
        at = 0
        while at < frame.num_rows:
            step = min(frame.num_rows - at, 64)
            part = frame.slice(at, step)
            held.append(part)
            held_rows += step
            column = part.column(part.schema.get_field_index(text))
            held_size += pc.sum(pc.binary_length(column)).as_py() or 0
            at += step
            if held_rows >= rows or held_size >= size:
                whole = pa.Table.from_batches(held).combine_chunks()
                held, held_rows, held_size = [], 0, 0
                yield whole
                del whole
                pa.default_memory_pool().release_unused()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    give_back(kind)


def give_back(kind: str = "") -> None:
    """Returns memory to the machine: Spark keeps Python workers between tasks,
    and one should hold no more than its present kind of task needs."""
    for name, own in REMEMBERED.items():
        if name != kind:
            own.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
