"""A conversation prefix trie by Patricia construction.

Sequences of turns are sorted by the digests of their turns, dealt out by
ranges, and each range is swept once.  The sweep makes points only where
sequences branch or end, with one compressed edge above each, and adds up
every point's subtree when it is left.  Nodes with one child on an edge are
made at the end, their sums from suffix sums along the edge.

Points on the path of a range's first or last sequence may go on in the next
range.  These alone, at most as many as two paths have points, go to a last
sweep over all ranges in order, which joins them by the same rules.  A group
of equal sequences or a common first turn is thus split over many ranges, and
no task holds more than one path and the ids that end on it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.ranges import bounds, dealt, partitions
from wordloom.llm.shared import materialize

#: Bytes of a turn's digest; ids of one row in what ranges hand on.
WIDE, CHUNK = 16, 1 << 15
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_struct(role: Column, text: Column) -> Column:
    """(``digest``, ``words``) of a turn; nulls count as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.struct(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def conversations(rows: DataFrame) -> DataFrame:
    """(``conv_id``, ``turns``: array of (digest, words)) of (conv_id, turn,
    role, text), by turn, nulls first, ties by digest.  Texts aren't shuffled.
    Rows without a conv_id take no part."""
    own = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), turn_struct(F.col("role"), F.col("text")).alias("t")).alias("row"))
    return own.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["t"]).alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin alike with."""
    low, high = 0, min(len(a), len(b)) // WIDE
    if a[: high * WIDE] == b[: high * WIDE]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDE : middle * WIDE] == b[low * WIDE : middle * WIDE]:
            low = middle
        else:
            high = middle - 1
    return low


class Point:
    """A branch, end or leaf at ``depth`` with sums over what is below it."""

    __slots__ = ("children", "convs", "depth", "ends", "least", "leaves", "saved", "sha")

    def __init__(self, depth: int):
        self.depth, self.convs, self.least, self.children, self.leaves, self.saved = depth, 0, None, 0, 0, 0
        self.ends, self.sha = array("q"), None

    def count(self, convs: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.convs += convs
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def feed(self, ids) -> None:
        """Takes ids that end here into the digest, in order."""
        if len(ids):
            comma = "," if self.sha else ""
            self.sha = self.sha or hashlib.sha256()
            self.sha.update((comma + ",".join(map(str, ids))).encode())


class Path:
    """The points on the path of the present sequence."""

    def __init__(self):
        self.key, self.words = b"", [0]  # words[d]: of the turn at depth d
        self.points = [Point(0)]

    def node_id(self, depth: int) -> bytes:
        return hashlib.md5(self.key[: depth * WIDE]).digest()

    def at(self, depth: int) -> Point:
        """The point at a depth of the path, made where there is none."""
        i = len(self.points)
        while self.points[i - 1].depth > depth:
            i -= 1
        if self.points[i - 1].depth == depth:
            return self.points[i - 1]
        point = Point(depth)
        self.points.insert(i, point)  # cuts an edge in two, if it isn't the last
        return point

    def leave(self) -> tuple[Point, dict]:
        """Takes the last point off and adds it to the one above: its row."""
        point, above = self.points.pop(), self.points[-1] if self.points else None
        top = above.depth if above else -1
        leaves = point.leaves if point.children else 1
        sums, total = [], point.saved
        for d in range(point.depth, top, -1):
            total += (point.convs - 1) * self.words[d]
            sums.append(total)
        sums.reverse()
        if above:
            above.count(point.convs, point.least, 1, leaves, total)
        if point.sha is None:
            point.feed(point.ends)
        row = {"node": self.node_id(point.depth), "parent": self.node_id(top) if above else None, "top": top, "depth": point.depth, "conv_id": point.least, "n_convs": point.convs}
        row |= {"n_children": point.children, "n_leaves": leaves, "saved": sums, "ends": point.sha.hexdigest() if point.sha else NO_ENDS, "done": True}
        return point, row

    def go(self, key: bytes, words: list[int]) -> None:
        self.key, self.words = key, [0, *words]


def _sweep(schema: pa.Schema):
    """Sweeps one range at a time; points on its first and last paths are
    handed on with their own sums, without what hangs below on the same path;
    others are done."""

    def handed(part: int, side: int, point: Point) -> list[dict]:
        base = {"done": False, "part": part, "side": side, "depth": point.depth}
        rows = [base | {"conv_id": point.least, "n_convs": point.convs, "n_children": point.children, "n_leaves": point.leaves, "saved": [point.saved], "ids": point.ends[:CHUNK].tolist()}]
        for i in range(CHUNK, len(point.ends), CHUNK):
            rows.append(base | {"n_convs": 0, "n_children": 0, "n_leaves": 0, "saved": [0], "ids": point.ends[i : i + CHUNK].tolist()})
        return rows

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, part, first, first_words, low = Path(), None, b"", [], 0
        out: list[dict] = []

        def finish() -> list[dict]:
            head = {"done": False, "part": part, "depth": -1}
            rows = [head | {"side": 0, "node": first, "words": first_words}, head | {"side": 1, "node": path.key, "words": path.words[1:]}]
            for point in path.points:
                rows += handed(part, 1, point)
            return rows

        def cut(depth: int) -> None:
            nonlocal low
            while path.points[-1].depth > depth:
                if path.points[-2].depth < depth:
                    path.at(depth)
                point = path.points[-1]
                if point.depth <= low:  # on the first sequence's path: what it has is handed on, not closed
                    path.points.pop()
                    out.extend(handed(part, 0, point))
                else:
                    out.append(path.leave()[1])
            low = min(low, depth)

        for frame in frames:
            for p, key, conv_id, words in zip(*(frame.column(frame.schema.get_field_index(n)).to_pylist() for n in ("part", "key", "conv_id", "words")), strict=True):
                depth = len(key) // WIDE
                if p != part:
                    if part is not None:
                        out.extend(finish())
                    path, part, first, first_words, low = Path(), p, key, words, depth
                    path.go(key, words)
                elif key != path.key:
                    cut(_common(path.key, key))
                    path.go(key, words)
                end = path.at(depth)
                end.count(1, conv_id, 0, 0, 0)
                end.ends.append(conv_id)
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if part is not None:
            out.extend(finish())
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _join(schema: pa.Schema):
    """Joins what the ranges hand on, range by range and path by path."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out = Path(), []

        def cut(depth: int) -> None:
            while path.points[-1].depth > depth:
                if path.points[-2].depth < depth:
                    path.at(depth)
                out.append(path.leave()[1])

        for frame in frames:
            for r in frame.to_pylist():
                if r["depth"] < 0:  # the path of a range's first sequence (side 0) or last one (side 1)
                    cut(_common(path.key, r["node"]))
                    path.go(r["node"], r["words"])
                    continue
                point = path.at(r["depth"])
                point.count(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved"][0])
                point.feed(r["ids"])
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        while path.points and (path.points[0].convs or len(path.points) > 1):
            out.append(path.leave()[1])
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


FIELDS = "node binary, parent binary, top int, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved array<long>, ends string, done boolean, part int, side int, words array<long>, ids array<long>"


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Every node of the trie of ``sequences`` (``conv_id`` long, ``turns``
    array of (hex ``digest``, ``words``)): ``conv_id`` (the smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.

    A row without turns belongs to the root; null turns count as none; rows
    without a conv_id take no part; a conv_id that comes again counts again;
    sequences may have any length (a task holds one); an empty table has no
    node, not even a root; other columns are ignored.
    """
    parts = partitions(sequences)
    turns = F.coalesce(F.col("turns"), F.array().cast("array<struct<digest:string,words:bigint>>"))
    own = sequences.where("conv_id is not null").select(F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), "")).alias("key"), F.col("conv_id").cast("long").alias("conv_id"), F.transform(turns, lambda t: t["words"]).alias("words"))
    own = materialize(own, "sequences")
    ordered = dealt(own, ["key", "conv_id"], bounds(own, ["key", "conv_id"], parts)).repartitionById(parts, "part").sortWithinPartitions("part", "key", "conv_id")
    schema = pa.schema([
        ("node", pa.binary()), ("parent", pa.binary()), ("top", pa.int32()), ("depth", pa.int32()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
        ("saved", pa.list_(pa.int64())), ("ends", pa.string()), ("done", pa.bool_()), ("part", pa.int32()), ("side", pa.int32()), ("words", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())),
    ])
    swept = materialize(ordered.mapInArrow(_sweep(schema), FIELDS), "swept")
    open_points = swept.where("not done").repartition(1).sortWithinPartitions("part", "side", "depth", "ids")
    joined = open_points.mapInArrow(_join(schema), FIELDS)
    points = materialize(swept.where("done").unionByName(joined).drop("done", "part", "side", "words", "ids"), "points")
    above = points.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    linked = points.where("depth > 0").join(above, "parent", "left").unionByName(points.where("depth = 0").withColumn("above", F.lit(None).cast("long")))
    opened = linked.select("*", F.posexplode("saved").alias("k", "saved_tokens"))
    depth = F.col("top") + 1 + F.col("k")
    last = depth == F.col("depth")
    return opened.select(
        "conv_id",
        depth.cast("long").alias("depth"),
        F.when(F.col("k") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.when(last, F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
