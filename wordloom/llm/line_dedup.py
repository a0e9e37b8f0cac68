"""Removal of lines that many documents share.

Two Bloom filters find suspects without a shuffle of lines: the first holds
the keys seen in a document, the second those seen again.  Every task fills a
pair for its own rows; pairs are merged piece by piece (``seen twice`` is the
union of both second filters and of what the two first ones have in common).
Only keys that the merged second filter knows are shuffled, as SHA-256
digests, for the exact count of documents and the choice of the document that
keeps the line; and only texts whose ids a third filter knows as losing a line
are shuffled to meet what they lose.  A filter has no false negatives, so the result is exact at
every size; a fuller filter only lets more suspects through.

The filter that is broadcast has ``bits`` bits: eight for each line of the
corpus, at most ``max_bits`` (32 MB by default).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.bloom import PIECE_BITS, Bloom, split_by_names
from wordloom.llm.shared import materialize
from wordloom.llm.textcols import batches, is_space, lower_ascii, text_bytes


class Lines:
    """The lines of a batch of texts and the keys of the long ones.

    ``begin``/``end``: byte limits of every line; ``bounds``: n + 1 limits of
    each text's lines; ``long``: the indices of lines whose key has at least
    ``min_chars`` code points; ``keys()``: their keys as bytes.
    """

    def __init__(self, texts: pa.Array, min_chars: int):
        self.data, self.offsets = data, offsets = text_bytes(texts)
        breaks = np.flatnonzero(data == 10)
        n = len(offsets) - 1
        of_text = np.searchsorted(offsets, breaks, side="right") - 1
        per = np.bincount(of_text, minlength=n) + 1 if n else np.zeros(0, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        self.begin = np.empty(self.bounds[-1], np.int64)
        self.end = np.empty(self.bounds[-1], np.int64)
        if n:
            first = np.zeros(len(self.begin), bool)
            first[self.bounds[:-1]] = True
            last = np.zeros(len(self.begin), bool)
            last[self.bounds[1:] - 1] = True
            self.begin[first] = offsets[:-1]
            self.begin[~first] = breaks + 1
            self.end[last] = offsets[1:]
            self.end[~last] = breaks
        solid = np.flatnonzero(~is_space(data))
        a, b = np.searchsorted(solid, self.begin), np.searchsorted(solid, self.end)
        some = b > a
        self.key_begin = np.where(some, solid[np.minimum(a, max(len(solid) - 1, 0))] if len(solid) else 0, 0)
        self.key_end = np.where(some, solid[np.maximum(b - 1, 0)] + 1 if len(solid) else 0, 0)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.long = np.flatnonzero(points[self.key_end] - points[self.key_begin] >= min_chars)

    def keys(self, which: np.ndarray) -> list[bytes]:
        data = lower_ascii(self.data).tobytes()
        return [data[a:b] for a, b in zip(self.key_begin[which].tolist(), self.key_end[which].tolist(), strict=True)]

    def text_of(self, which: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, which, side="right") - 1


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _fill(bits: int, min_chars: int):
    """Each task's filters, in compressed pieces."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(bits), Bloom(bits)
        for table in batches(frames, size=4 << 20):
            lines = Lines(table["text"], min_chars)
            found = _hashes(lines.keys(lines.long))
            pairs = np.unique(np.stack([found, lines.text_of(lines.long).astype(np.uint64)]), axis=1)[0] if len(found) else found
            known, count = np.unique(pairs, return_counts=True)
            twice.add(known[(count > 1) | once.has(known)])
            once.add(known)
        pack = zstandard.ZstdCompressor(3).compress
        step = min(PIECE_BITS, bits) >> 3
        rows = []
        for k in range(0, bits >> 3, step):
            a, b = once.array[k : k + step], twice.array[k : k + step]
            if a.any():
                rows.append((k // step, pack(a.tobytes()), pack(b.tobytes())))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["piece", "once", "twice"])

    return run


def _merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the pieces that arrive, holding one pair for each piece."""
    unpack = zstandard.ZstdDecompressor().decompress
    held: dict[int, list[np.ndarray]] = {}
    for frame in frames:
        for piece, a, b in zip(*(c.to_pylist() for c in frame.columns), strict=True):
            once, twice = (np.frombuffer(unpack(x), np.uint8) for x in (a, b))
            if piece in held:
                first, second = held[piece]
                held[piece] = [first | once, second | twice | (first & once)]
            else:
                held[piece] = [once, twice]
    pack = zstandard.ZstdCompressor(3).compress
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pack(v[1].tobytes()) for v in held.values()], pa.binary())], ["piece", "twice"])


def _suspects(shared, bits: int, min_chars: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Bloom(bits, zstandard.ZstdDecompressor().decompress(shared.value))
        for table in batches(frames, size=4 << 20):
            lines = Lines(table["text"], min_chars)
            keys = lines.keys(lines.long)
            hit = np.flatnonzero(twice.has(_hashes(keys))) if keys else np.zeros(0, np.int64)
            rows = lines.text_of(lines.long[hit])
            digests = pa.array([hashlib.sha256(keys[i]).digest() for i in hit.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([digests, table["doc_id"].combine_chunks().take(pa.array(rows))], ["digest", "doc_id"])

    return run


def _clean(min_chars: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(frames, size=4 << 20):
            lines = Lines(table["text"], min_chars)
            drops = table["drops"].combine_chunks().to_pylist()
            hit = np.array([i for i, d in enumerate(drops) if d], np.int64)
            drop = np.zeros(len(lines.begin), bool)
            if len(hit):
                mine = lines.long[np.isin(lines.text_of(lines.long), hit)]
                sets = {i: set(drops[i]) for i in hit.tolist()}
                drop[mine] = [hashlib.sha256(k).digest() in sets[t] for k, t in zip(lines.keys(mine), lines.text_of(mine).tolist(), strict=True)]
            dropped = np.concatenate([[0], np.cumsum(drop)])
            n_dropped = dropped[lines.bounds[1:]] - dropped[lines.bounds[:-1]]
            data = lines.data.tobytes()
            out = []
            for i in range(len(n_dropped)):
                a, b = lines.bounds[i], lines.bounds[i + 1]
                if n_dropped[i]:
                    out.append(b"\n".join(data[lines.begin[j] : lines.end[j]] for j in (a + np.flatnonzero(~drop[a:b])).tolist()))
                else:
                    out.append(data[lines.offsets[i] : lines.offsets[i + 1]])
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), table["carried"].combine_chunks(), pa.array(np.diff(lines.bounds), pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "carried", "n_lines", "n_dropped", "kept_text"],
            )

    return run


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, max_bits: int = 1 << 28, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drops the lines that at least ``min_docs`` documents share, except in
    the document of the largest ``doc_id`` among them.

    A line's key is the line without ASCII white space at its ends and with
    A-Z lower-cased; keys under ``min_chars`` code points are never dropped.
    Returns ``doc_id``, ``carried`` (a struct of the columns in ``carry``),
    ``n_lines``, ``n_dropped`` and ``kept_text``.

    Null or empty text: one empty line.  Rows with one doc_id are one document
    that has the lines of all of them, and each row is returned.  Null doc_ids
    are one document, smaller than all others.  Rows that tie for the largest
    doc_id of a line all keep it.  Texts and lines may have any length: a task
    holds one text, and digests of lines are shuffled.  An empty table gives
    an empty one.  Columns not named are ignored, whatever their names.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    n_lines = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = 1 << 16
    while bits < min(max_bits, 8 * n_lines):
        bits *= 2
    pieces = max(1, bits // PIECE_BITS)
    merged = texts.mapInArrow(_fill(bits, min_chars), "piece int, once binary, twice binary").repartition(min(pieces, 64), "piece").mapInArrow(_merge, "piece int, twice binary")
    filled = np.zeros(bits >> 3, np.uint8)
    step = min(PIECE_BITS, bits) >> 3
    unpack = zstandard.ZstdDecompressor().decompress
    for row in merged.toLocalIterator():
        filled[row["piece"] * step : (row["piece"] + 1) * step] = np.frombuffer(unpack(bytes(row["twice"])), np.uint8)
    shared = spark.sparkContext.broadcast(zstandard.ZstdCompressor(3).compress(filled.tobytes()))
    suspects = materialize(texts.mapInArrow(_suspects(shared, bits, min_chars), f"digest binary, doc_id {id_type}").distinct(), "line-suspects")
    repeated = suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("digest", "keeper")
    drops = (
        suspects.join(repeated, "digest")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id")
        .agg(F.collect_set("digest").alias("drops"))
        .select(F.col("doc_id").alias("drop_id"), "drops")
    )
    drops = materialize(drops, "line-drops")
    # Only texts that may lose a line meet the lines to drop; a filter of ids tells them from the others.
    whole = docs.select("doc_id", "text", (F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))).alias("carried"), F.xxhash64("doc_id").alias("name"))
    split = split_by_names(whole, drops.select(F.xxhash64("drop_id").alias("name")))
    text = F.coalesce("text", F.lit(""))
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    stay = split.where("not maybe").select("doc_id", "carried", lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), text.alias("kept_text"))
    open_rows = split.where("maybe").select("doc_id", "text", "carried")
    joined = open_rows.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left").select("doc_id", "text", "carried", "drops")
    carried = joined.schema["carried"].dataType.simpleString()
    cleaned = joined.mapInArrow(_clean(min_chars), f"doc_id {id_type}, carried {carried}, n_lines long, n_dropped long, kept_text string")
    return stay.unionByName(cleaned)
