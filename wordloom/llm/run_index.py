"""Long repeated passages by a run-length index.

A passage counts where ``width`` bytes of it also start anywhere else.

1. Anchors.  In every window of ``width`` bytes the k-byte string with the
   smallest hash is an anchor, so equal windows have equal anchors at equal
   offsets.  A window is inside the region of its anchor, the ``width - k``
   bytes to its left and ``width`` bytes to its right; regions of one hash
   that overlap in a text are joined.  A repeated window shares 124 bytes to
   the right of its anchor's first byte, or 124 bytes from 76 to its left on.
   Hashes of both are counted over the corpus, and a bounded filter of those
   found in two places lets only such anchors and sides through.
2. Regions of one anchor hash and one content are a class, counted before
   anything is sent.  A hash with one plain region repeats nothing; a class found
   twice is repeated as a whole; hashes with several classes are indexed.
3. For each bucket of hashes a task takes one region of each class, sorts
   their suffixes, builds the Burrows-Wheeler transform and run-compresses it.
   Text positions are sampled at the first and last row of each run only:
   these have an irreducible longest common prefix with the row before (after)
   them, and the value of every other position follows from the last sample
   to its left.  Streaming over the regions from sample to sample gives each
   position's matching statistic, the longest match with any other place, and
   statistics of at least ``width`` mark their bytes.
4. The marked intervals go back to all places of their class and are joined
   for each different text.

Suffixes are compared inside one anchor hash only, where no byte of a text
occurs twice, so a match is never a place matched with itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.bloom import id_filter, may_hold, split_by_names
from wordloom.llm.shared import materialize
from wordloom.llm.textcols import batches, mix, text_bytes

WIDTH, ANCHOR = 200, 48
TURN = (WIDTH - ANCHOR) // 2
FLANK = WIDTH - TURN
#: Bytes of text whose hashes are looked at together; their arrays fit a core's cache.
BATCH = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(256, dtype=np.uint64), 9)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Rolling:
    """Hashes of the k bytes from any place: differences of one running sum
    of bytes times powers of an odd base, shifted back to power zero."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(_POWERS[0]) < n:
            for k, base in enumerate((BASE, _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _POWERS[0][:n], dtype=np.uint64, out=self.sums[1:])

    def everywhere(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * _POWERS[1][:n], k)

    def at(self, places: np.ndarray, k: int, salt: int) -> np.ndarray:
        return mix((self.sums[places + k] - self.sums[places]) * _POWERS[1][places], salt)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of each window of ``width`` values: minima of 2, 4,
    8... values, and then of the two that a window ends with."""
    low, step = values, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = width - step
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchors(data: np.ndarray, offsets: np.ndarray, rolling: Rolling, width: int = WIDTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and hash of all anchors of a batch.  Every place of a
    window's smallest hash is one, so ties are kept."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, np.zeros(0, np.uint64)
    h = rolling.everywhere(k)
    span = width - k + 1
    low = window_minima(h, span)
    # Windows inside one text.
    size = np.diff(offsets)
    inside = np.zeros(len(data) + 1, np.int64)
    ok = size >= width
    np.add.at(inside, offsets[:-1][ok], 1)
    np.add.at(inside, offsets[1:][ok] - width + 1, -1)
    valid = np.cumsum(inside)[: len(low)] > 0
    # A position is an anchor if some valid window over it has its hash as minimum:
    # the largest minimum of the windows that cover it.
    most = np.where(valid, ~low, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded = np.concatenate([np.full(span - 1, np.uint64(0xFFFFFFFFFFFFFFFF)), most, np.full(span - 1, np.uint64(0xFFFFFFFFFFFFFFFF))])
    largest = window_minima(padded, span)[: len(h)]
    at = np.flatnonzero((~largest == h) & (largest != np.uint64(0xFFFFFFFFFFFFFFFF)))
    return np.searchsorted(offsets, at, side="right") - 1, at, h[at]


class Places:
    """The anchors of a batch with their two sides.

    ``left`` and ``right``: hashes of the 124 bytes that all windows share
    which begin ``TURN`` bytes or more, or fewer, before the anchor; ``has_*``:
    whether the text has room for such a window.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rolling = Rolling(data)
        self.text, self.at, self.hash = anchors(data, offsets, rolling)
        self.low, self.high = offsets[self.text], offsets[self.text + 1]
        if not len(self.at):
            self.has_left = self.has_right = np.zeros(0, bool)
            self.left = self.right = np.zeros(0, np.uint64)
            return
        room = self.at - self.low
        self.back_right, self.back_left = np.minimum(TURN - 1, room), np.minimum(WIDTH - ANCHOR, room)
        self.has_right = self.at - self.back_right + WIDTH <= self.high
        self.has_left = (room >= TURN) & (self.at - self.back_left + WIDTH <= self.high)
        self.left, self.right = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.uint64)
        self.right[self.has_right] = rolling.at(self.at[self.has_right], FLANK, 1)
        self.left[self.has_left] = rolling.at(self.at[self.has_left] - TURN, FLANK, 2)

    def regions(self, left: np.ndarray, right: np.ndarray):
        """Text, hash, begin and end of the regions of the sides chosen, and
        whether several anchors were joined, so that one may repeat itself."""
        on = np.flatnonzero(left | right)
        left, right = left[on], right[on]
        at, text, h = self.at[on], self.text[on], self.hash[on]
        if not len(on):
            return text, h, at, at, np.zeros(0, bool)
        begin = at - np.where(left, self.back_left[on], self.back_right[on])
        end = np.minimum(at + np.where(right, WIDTH, FLANK), self.high[on])
        order = np.lexsort((at, h, text))
        text, h, begin, end = text[order], h[order], begin[order], end[order]
        new = np.ones(len(on), bool)
        new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (begin[1:] >= end[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(on)) - 1
        return text[first], h[first], np.minimum.reduceat(begin, first), np.maximum.reduceat(end, first), last > first


def _sides(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each side's hash with the smallest and largest text that has it; one
    that a text has twice spans all texts."""
    for table in batches(frames, size=BATCH):
        p = Places(*text_bytes(table["text"]))
        key = np.concatenate([p.left[p.has_left], p.right[p.has_right]])
        text = np.concatenate([p.text[p.has_left], p.text[p.has_right]])
        order = np.lexsort((text, key))
        key, text = key[order], text[order]
        name = table["name"].to_numpy()[text]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        low, high = (np.minimum.reduceat(name, start), np.maximum.reduceat(name, start)) if len(key) else (name, name)
        twice = np.flatnonzero((key[1:] == key[:-1]) & (text[1:] == text[:-1]))
        of = np.searchsorted(start, twice, side="right") - 1
        low, high = low.copy(), high.copy()
        low[of], high[of] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(key[start].view(np.int64)), pa.array(low), pa.array(high)], ["key", "low", "high"])


def _find(shared):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(frames, size=BATCH):
            data, offsets = text_bytes(table["text"])
            p = Places(data, offsets)
            live = [has & may_hold(shared.value, side.view(np.int64)) for has, side in ((p.has_left, p.left), (p.has_right, p.right))]
            text, h, begin, end, inner = p.regions(*live)
            raw = data.tobytes()
            content = [hashlib.md5(raw[a:b]).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            base = offsets[text]
            yield pa.RecordBatch.from_arrays(
                [table["text_id"].combine_chunks().take(pa.array(text)), table["row"].combine_chunks().take(pa.array(text)), pa.array(h.view(np.int64)), pa.array(begin - base, pa.int64()), pa.array(end - begin, pa.int32()), pa.array(content, pa.binary()), pa.array(inner)],
                ["text_id", "row", "anchor", "at", "size", "content", "inner"],
            )

    return run


def _fetch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        texts, places = frame.column("text"), frame.column("places")
        for i in range(frame.num_rows):
            raw = texts[i].as_py().encode()
            own = places[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([p["anchor"] for p in own], pa.int64()), pa.array([p["content"] for p in own], pa.binary()), pa.array([raw[p["at"] : p["at"] + p["size"]] for p in own], pa.binary())],
                ["anchor", "content", "region"],
            )


class RunIndex:
    """A run-length index over the regions of several groups.

    ``data``: the regions one after another; ``starts``: their n + 1 limits;
    ``group``: the group of each.  ``runs`` counts the runs of the transform.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, group: np.ndarray):
        self.data, self.starts = data, starts
        n = len(data)
        size = np.diff(starts)
        # Places fit 32 bits (a bucket is far below 2 GB), which halves the memory.
        region = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.end = np.repeat(starts[1:].astype(np.int32), size)
        self.group = np.repeat(group.astype(np.int32), size)
        self.order = self._sort()
        before = np.full(n, -1, np.int16)
        before[1:] = data[:-1]
        before[starts[:-1]] = -1
        self.bwt = before[self.order]
        other = np.ones(n, bool)
        g = self.group[self.order]
        same_group = np.zeros(n, bool)
        same_group[1:] = g[1:] == g[:-1]
        other[1:] = ~same_group[1:] | (self.bwt[1:] != self.bwt[:-1]) | (self.bwt[1:] < 0)
        self.first = np.flatnonzero(other)
        self.last = np.append(self.first[1:], n) - 1
        self.runs = len(self.first)
        self.same_group = same_group
        self.region = region

    def _sort(self) -> np.ndarray:
        """Suffix order by ranks of prefixes, each round three times as long; a
        region's end sorts before all bytes and ends are told apart by place.
        Only rows whose rank is still shared are sorted again, by one packed
        number each."""
        n = len(self.data)
        bits = n.bit_length()
        far = np.int32 if n < 1 << 28 else np.int64  # holds three times a place
        place = np.arange(n, dtype=np.int32)
        left = self.end - place
        # As many bytes as fit beside the group.
        span = max(1, min(7, (64 - int(self.group.max()).bit_length()) // 8)) if n else 1
        key = self.group.astype(np.uint64)
        padded = np.concatenate([self.data, np.zeros(span, np.uint8)])
        for j in range(span):
            key = (key << np.uint64(8)) | np.where(left > j, padded[j : j + n], np.uint8(0))
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        head = np.ones(n, bool)
        head[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, place, 0))
        del key, padded
        shared = np.zeros(n, bool)
        shared[:-1] = ~head[1:]
        shared[1:] |= ~head[1:]
        rows = np.flatnonzero(shared)
        ahead = 2 if 3 * bits + 2 <= 64 else 1  # ranks that fit beside a row's own
        while len(rows):
            items = order[rows].astype(far)
            stop = self.end[items]
            both = rank[items].astype(np.uint64)
            for k in range(1, ahead + 1):
                nxt = items + far(k * span)
                # Past the end: by place, below all ranks.
                follow = np.where(nxt < stop, rank[np.minimum(nxt, n - 1)] + far(n), items)
                both = (both << np.uint64(bits + 1)) | follow.astype(np.uint64)
            sub = np.argsort(both)
            items, both = items[sub], both[sub]
            order[rows] = items
            lead = np.ones(len(rows), bool)
            lead[1:] = both[1:] != both[:-1]
            rank[items] = np.maximum.accumulate(np.where(lead, rows, 0))
            again = np.zeros(len(rows), bool)
            again[:-1] = ~lead[1:]
            again[1:] |= ~lead[1:]
            rows = rows[again]
            span *= ahead + 1
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of pairs of suffixes, eight bytes a step."""
        n = len(self.data)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)]).astype(np.uint64)
        words = np.zeros(n + 1, np.uint64)
        for j in range(8):
            words |= padded[j : j + n + 1] << np.uint64(8 * j)
        limit = np.minimum(self.end[a] - a, self.end[b] - b).astype(np.int64)
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x = words[a[live] + out[live]] ^ words[b[live] + out[live]]
            low = x & (~x + np.uint64(1))  # the lowest bit that differs
            equal = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
            out[live] = np.minimum(out[live] + equal, limit[live])
            live = live[(equal == 8) & (out[live] < limit[live])]
        return out

    def _stream(self, samples: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Carries sampled values along the text: one less at each byte."""
        n = len(self.data)
        held = np.full(n, -1, np.int32)
        held[samples] = samples
        last = np.maximum.accumulate(held)
        value = np.zeros(n, np.int32)
        value[samples] = values
        here = np.arange(n, dtype=np.int32)
        return np.where(last >= self.starts[self.region], np.maximum(value[last] - (here - last), 0), 0)

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match with another place."""
        up = np.zeros(len(self.first), np.int64)
        has = self.same_group[self.first] & (self.first > 0)
        up[has] = self._common(self.order[self.first[has]], self.order[self.first[has] - 1])
        # A run's last row and the next run's first row are one pair.
        down = np.append(up[1:], 0)
        return np.maximum(self._stream(self.order[self.first], up), self._stream(self.order[self.last], down))


def marked(index: RunIndex, statistics: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of bytes that matches cover."""
    long = np.flatnonzero(statistics >= width)
    cover = np.zeros(len(statistics) + 1, np.int64)
    np.add.at(cover, long, 1)
    np.add.at(cover, long + statistics[long], -1)
    on = np.cumsum(cover)[:-1] > 0
    edge = np.ones(len(on), bool)
    edge[1:] = ~on[:-1] | (index.region[1:] != index.region[:-1])
    begin = np.flatnonzero(on & edge)
    stop = np.ones(len(on), bool)
    stop[:-1] = ~on[1:] | (index.region[1:] != index.region[:-1])
    return begin, np.flatnonzero(on & stop) + 1


def _index(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Repeated rows of one class would match themselves.
        pdf = pdf.drop_duplicates(["anchor", "content"]).sort_values("anchor", kind="stable", ignore_index=True)
        raws = pdf["region"].tolist()
        data = np.frombuffer(b"".join(raws), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
        group = np.unique(pdf["anchor"].to_numpy(), return_inverse=True)[1]
        index = RunIndex(data, starts, group)
        begin, end = marked(index, index.matching_statistics(), width)
        of = index.region[begin] if len(begin) else np.zeros(0, np.int64)
        return pd.DataFrame({"anchor": pdf["anchor"].to_numpy()[of], "content": pdf["content"].to_numpy()[of], "lo": begin - starts[of], "hi": end - starts[of]})

    return run


def _remove(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in batches(frames, size=1 << 20):
        data, offsets = text_bytes(table["text"])
        raw = data.tobytes()
        spans, again = table["spans"].combine_chunks(), table["again"].combine_chunks().to_pylist()
        rows = []
        for i in range(table.num_rows):
            own = raw[offsets[i] : offsets[i + 1]]
            found = spans[i].as_py() or []
            if again[i] and len(own) >= WIDTH:
                found = [{"lo": 0, "hi": len(own)}]
            joined: list[list[int]] = []
            for lo, hi in sorted((s["lo"], s["hi"]) for s in found):
                if joined and lo <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], hi)
                else:
                    joined.append([lo, hi])
            kept, at = [], 0
            for lo, hi in joined:
                kept.append(own[at:lo])
                at = hi
            rest = b"".join([*kept, own[at:]])
            rows.append((len(own), len(own) - len(rest), joined, rest))
        yield pa.RecordBatch.from_arrays(
            [table["doc_id"].combine_chunks(), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[{"lo": a, "hi": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array([r[3] for r in rows], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "removed", "kept"],
        )


def remove_repeats(docs: DataFrame, bucket_bytes: int = 1 << 18) -> DataFrame:
    """Marks every byte covered by ``WIDTH`` bytes that also start elsewhere.

    Returns for each row ``doc_id, n_bytes, n_removed, removed`` (the maximal
    runs as byte offsets, end exclusive) and ``kept`` (the remaining bytes).

    Null or empty text: nothing to remove.  Repeated rows are texts of their
    own and so repeat each other; null doc_ids are returned as they are; texts
    shorter than ``WIDTH`` bytes are left alone.  There are no ties: every place
    of a repeated string goes, none is chosen to stay.  Texts may have any
    length: a task holds one text, and only regions that may be repeated are
    shuffled.  An empty table gives an empty one; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", "text", F.unhex(F.md5(text)).alias("text_id"), F.xxhash64(text).alias("name"), F.xxhash64("doc_id").alias("row"))
    # Equal texts: one is indexed; of two or more all bytes are repeated.
    again = materialize(named.select("text_id", "name").groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.first("name").alias("name")).where("n > 1").select("text_id", "name"), "texts")
    long = named.where(F.octet_length("text") >= WIDTH)
    sides = long.select("text", "name").mapInArrow(_sides, "key long, low long, high long")
    repeated = materialize(sides.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("key"), "sides")
    found = long.select("text_id", "row", "text").mapInArrow(_find(id_filter(repeated)), "text_id binary, row long, anchor long, at long, size int, content binary, inner boolean")
    places = materialize(found, "regions")
    # Places of equal texts count once.
    one = places.groupBy("anchor", "content", "text_id", "at", "size").agg(F.max("inner").alias("inner"), F.min("row").alias("row"))
    classes = materialize(one.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_id", "row", "at", "size")).alias("one"), F.max("inner").alias("inner")), "classes")
    # A class found twice is repeated as a whole; an anchor with such classes alone has nothing left to find.
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"), F.max("inner").alias("inner"), F.min("n").alias("least")).where("least = 1 and (classes > 1 or inner)")
    indexed = classes.join(several.select("anchor"), "anchor").select(F.col("one.text_id").alias("text_id"), F.col("one.row").alias("row"), F.struct("anchor", "content", F.col("one.at").alias("at"), F.col("one.size").alias("size")).alias("place"))
    wanted = indexed.groupBy("text_id", "row").agg(F.collect_list("place").alias("places"))
    names = named.select("text_id", "name")
    sources = split_by_names(long.select("text_id", "row", "text", "name"), names.join(wanted.select("text_id"), "text_id", "left_semi").select("name").distinct()).where("maybe")
    texts = sources.select("text_id", "row", "text").join(wanted, ["text_id", "row"]).select("text", "places")
    fetched = materialize(texts.mapInArrow(_fetch, "anchor long, content binary, region binary"), "fetched")
    total = fetched.agg(F.sum(F.octet_length("region"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    within = fetched.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    inner = within.groupBy("bucket").applyInPandas(_index(WIDTH), "anchor long, content binary, lo long, hi long")
    whole = classes.where("n > 1").select("anchor", "content", F.lit(0).cast("long").alias("lo"), F.col("one.size").cast("long").alias("hi"))
    marks = materialize(whole.unionByName(inner), "marks")
    spans = (
        places.select("text_id", "anchor", "content", "at").join(marks, ["anchor", "content"])
        .select("text_id", F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")).alias("span"))
        .groupBy("text_id").agg(F.collect_set("span").alias("spans"))
    )
    about = again.select("text_id", F.lit(True).alias("again")).join(spans, "text_id", "full").select(F.col("text_id").alias("of"), F.coalesce("again", F.lit(False)).alias("again"), "spans")
    about = materialize(about, "about")
    # Texts that nothing is known of are left where they are; the others meet their spans.
    split = split_by_names(named, names.join(about.select(F.col("of").alias("text_id")), "text_id", "left_semi").select("name").distinct())
    columns = ("doc_id", "text", "again", "spans")
    joined = split.where("maybe").join(about, F.col("text_id") == F.col("of"), "left").select(*columns)
    plain = split.where("not maybe").select("doc_id", "text", F.lit(False).alias("again"), F.lit(None).cast("array<struct<lo: long, hi: long>>").alias("spans"))
    return joined.unionByName(plain.select(*columns)).mapInArrow(_remove, f"doc_id {id_type}, n_bytes long, n_removed long, removed array<struct<lo: long, hi: long>>, kept binary")
