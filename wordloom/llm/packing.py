"""Best-fit packing of documents into token sequences, certified by bounds.

Documents are cut into pieces of at most ``capacity`` tokens, dealt to
partitions of a bounded number of pieces and packed there by best-fit
decreasing.  Dual feasible functions give a lower bound on the bins that the
pieces of a partition need; one whose count equals its bound is certified and
lets go of its least filled bin only.  A partition with a gap lets go of more
of its least filled bins, in proportion to the gap.  The documents let go are
dealt anew to fewer partitions, where best-fit decreasing runs again, until
one partition holds the last exchange.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import materialize
from wordloom.llm.textcols import REMEMBERED as REMEMBERED_BY_KIND
from wordloom.llm.textcols import Words, batches, lower_ascii, text_bytes

#: Pieces in a partition, and words that a worker remembers.
PIECES, REMEMBERED = 50_000, 600_000


class WordTokens:
    """Token ids of white-space delimited words.

    The tokenizer's pattern never crosses ASCII white space and drops it, so a
    text's ids are those of its words one after another; each different word
    of a batch is tokenized once and common ones are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Where the tokenizer lowers all letters anyway, words that differ in case are one.
        self.lower = '"type":"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"], separators=(",", ":"))
        self.known: dict[bytes, int] = {}
        # The ids of words one after another, and where each word's begin; both
        # grow in place, and words beyond those remembered are overwritten.
        self.flat = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32)
        self.limits = np.zeros(1 << 14, np.int64)
        self.held = 0

    @staticmethod
    def _room(values: np.ndarray, size: int) -> np.ndarray:
        if size <= len(values):
            return values
        wider = np.zeros(max(size, len(values) + len(values) // 2), values.dtype)
        wider[: len(values)] = values
        return wider

    def _add(self, at: int, words: list[bytes]) -> None:
        """Puts the ids of new words at place ``at``."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        ends = self.limits[at] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        self.limits = self._room(self.limits, at + len(got) + 1)
        self.limits[at + 1 : at + 1 + len(got)] = ends
        self.flat = self._room(self.flat, int(ends[-1]))
        self.flat[self.limits[at] : ends[-1]] = np.fromiter(chain.from_iterable(got), self.flat.dtype, int(ends[-1] - self.limits[at]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their n + 1 offsets."""
        data, offsets = text_bytes(texts)
        if self.lower:  # but for letters that a mark may be composed with
            data = np.where(np.append(data[1:] < 128, True)[: len(data)], lower_ascii(data), data)
        words = Words(data, offsets)
        n = len(words.bounds) - 1
        if not len(words.start):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        forms = words.vocabulary.to_pylist()
        known = self.known
        at = np.fromiter((known.get(f, -1) for f in forms), np.int64, len(forms))
        new = np.flatnonzero(at < 0)
        at[new] = self.held + np.arange(len(new))
        for k in range(0, len(new), 10_000):
            self._add(self.held + k, [forms[i] for i in new[k : k + 10_000].tolist()])
        kept = max(0, min(len(new), REMEMBERED - self.held))
        known.update(zip((forms[i] for i in new[:kept].tolist()), range(self.held, self.held + kept), strict=True))
        self.held += kept
        begin = self.limits[at]
        size = self.limits[at + 1] - begin
        per_word = size[words.codes]
        total = np.concatenate([[0], np.cumsum(per_word)])
        place = np.repeat(begin[words.codes] - total[:-1], per_word)
        place += np.arange(total[-1])
        return self.flat[place].astype(np.uint32), total[words.bounds]


_HELD: dict[str, WordTokens] = REMEMBERED_BY_KIND.setdefault("packing", {})


def _tokens(path: str) -> WordTokens:
    if path not in _HELD:
        _HELD[path] = WordTokens(path)
    return _HELD[path]


def _cut(tokenizer: str, end_id: int, capacity: int, with_ids: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        for table in batches(frames, size=1 << 20, kind="packing"):
            flat, bounds = tokens.encode(table["text"].combine_chunks())
            rows: list[tuple[int, int, int, int, int, bytes | None]] = []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                for start in range(0, len(own), capacity):
                    raw = own[start : start + capacity].tobytes()
                    rows.append((i, start // capacity, start, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            arrays = [table["doc_id"].combine_chunks().take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin.  Pieces come in
    descending order; each goes to the fullest bin that takes it."""
    free: dict[int, list[int]] = {}
    mask, fill = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = free[room]
            b = held.pop()
            if not held:
                mask &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            free.setdefault(room, []).append(b)
            mask |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound among two families of dual feasible functions: large
    pieces rounded up to whole bins at every threshold, and k-fold roundings."""
    if not len(lengths):
        return 0
    sizes = np.arange(capacity + 1)
    count = np.bincount(lengths, minlength=capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * sizes)
    best = -(-int(total[-1]) // capacity)
    cut = np.arange(1, capacity // 2 + 1)
    if len(cut):
        middle = total[capacity - cut] - total[cut - 1]
        best = max(best, int((n[capacity] - n[capacity - cut] - (-middle // capacity)).max()))
    for k in range(1, 64):
        rounded = np.where((k + 1) * sizes % capacity == 0, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((count * rounded).sum()) // (k * capacity)))
    return best


def _pack(capacity: int, round_no: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        release = np.zeros(len(fill), bool)
        if not last:
            slack = np.flatnonzero(fill < capacity)
            emptiest = slack[np.argsort(fill[slack], kind="stable")][: 1 + 8 * gap]
            # At most half of the pieces, so that rounds shrink to the last exchange.
            held = np.cumsum(np.bincount(bins, minlength=len(fill))[emptiest])
            release[emptiest[held * 2 <= len(lengths)]] = True
        out = pdf.drop(columns="part")
        out["sequence_id"] = (round_no << 56) + (pdf["part"].to_numpy().astype(np.int64) << 24) + bins
        out["offset"] = offsets
        out["open"] = release[bins]
        out["gap"] = gap
        return out

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Packs the token ids of all documents (each ended by ``end_id``).

    ``tokenizer`` is the path of a tokenizer file that every machine has.
    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``, ``gap`` (sequences of its partition above the certified lower
    bound of the last packing; 0: certified as the fewest) and, with
    ``with_ids``, the ids as little-endian 32-bit bytes.  Equal lengths are
    packed by doc_id and piece.

    Null or empty text is a document of the end id alone.  A document of any
    length is cut into pieces of ``capacity`` ids, the last one shorter, by the
    task that holds its text.  Repeated rows are
    packed each for itself; null doc_ids are packed and returned as null; an
    empty table gives an empty one; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    left = materialize(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, end_id, capacity, with_ids), schema), "pieces")
    done: DataFrame | None = None
    names = [c.split()[0] for c in schema.split(", ")] + ["sequence_id", "offset", "gap"]
    round_no, pieces = 0, left.count()
    while True:
        parts = -(-pieces // PIECES)
        last = parts <= 1
        dealt = left.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(round_no)), F.lit(max(parts, 1))))
        packed = materialize(dealt.groupBy("part").applyInPandas(_pack(capacity, round_no, last), f"{schema}, sequence_id long, offset long, open boolean, gap long"), "packed")
        closed = packed.where("not open").select(*names)
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        left = packed.where("open").select(*names[:-3])
        pieces = left.count()
        round_no += 1
