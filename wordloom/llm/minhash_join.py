"""Near-duplicate documents by an inverted join of MinHash coordinates.

1. A task hashes each text's five-word shingles and takes ``K`` minima.
   Documents with one shingle set form a class; only classes are joined.
2. Every class is posted under each (coordinate, value) token.  Tokens are
   ordered by how many classes hold them, rarest first.  Two signatures that
   agree in at least ``t`` of K coordinates share a token among the first
   K - t + 1 of either (prefix rule), so only those are joined, and tokens
   that one class holds are skipped.
3. In each posting list the class whose tokens are most common is the pivot.
   The others are paired with it alone, coordinates are counted, pairs below
   ``t`` are skipped and the rest confirmed on the full sets.  Their
   components hold nearly all links, with rows in proportion to postings.
4. Lists that still hold several components are gone through once more:
   classes outside the pivot's component are compared with all others of the
   list, in blocks, but for pairs already connected, pairs whose set sizes
   rule a link out and pairs with fewer than ``t`` equal coordinates.  A task
   returns at most one link for each class and component, never all pairs.

``t`` is the largest threshold that a pair at exactly the wanted similarity
misses with a probability of at most 1e-9.  No link is cut off by a cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.bloom import id_filter, may_hold
from wordloom.llm.components import components
from wordloom.llm.shared import materialize
from wordloom.llm.textcols import batches, hash_binary, mix, words_of

K = 64
BLOCK = 4096
_ODD = mix(np.arange(1, K + 1, dtype=np.uint64), 77) | np.uint64(1)


def match_threshold(percent: int, coordinates: int = K, miss: float = 1e-9) -> int:
    p, total = percent / 100, 0.0
    for t in range(coordinates + 1):
        total += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if total > miss:
            return max(t, 1)
    return coordinates


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted different shingle hashes (64 bits)."""
    words = words_of(texts, lower=True)
    h = hash_binary(words.vocabulary)[words.codes] if len(words.start) else np.zeros(0, np.uint64)
    shingles = h.copy()
    for j in range(1, width):
        shingles[: len(h) - j] = mix(shingles[: len(h) - j]) + h[j:]
    shingles = mix(shingles)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(shingles[a : b - width + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K 32-bit minima for each set; sets are worked on in cache-sized runs."""
    sig = np.zeros((len(sets), K), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(some):
        size, end = 0, at
        while end < len(some) and (end == at or size + len(sets[some[end]]) <= 1 << 16):
            size += len(sets[some[end]])
            end += 1
        flat = np.concatenate([sets[i] for i in some[at:end]])
        starts = np.cumsum([0, *(len(sets[i]) for i in some[at : end - 1])])
        rows = some[at:end]
        for k in range(K):
            sig[rows, k] = np.minimum.reduceat(((flat * _ODD[k]) >> np.uint64(32)).astype(np.uint32), starts)
        at = end
    return sig


def _sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in batches(frames, size=4 << 20):
        sets = shingle_sets(table["text"])
        sig = signatures(sets).view(np.int32)
        ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * K), pa.array(sig.reshape(-1)))
        yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), flat], ["doc_id", "n_shingles", "set_id", "sig"])


def _sets(wanted):
    """The full sets of the documents that a filter of ids lets through."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(frames, size=4 << 20):
            ids = table["doc_id"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
            texts = table["text"].combine_chunks().filter(pa.array(may_hold(wanted.value, ids), pa.bool_()))
            for k in range(0, len(texts), 1024):
                sets = shingle_sets(texts.slice(k, 1024))
                names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_id", "members"])

    return run


def _confirm(percent: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            cols = [frame.column(i).to_pylist() for i in range(4)]
            keep = []
            for x, y in zip(cols[2], cols[3], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([frame.column(0).filter(keep), frame.column(1).filter(keep)], ["a", "b"])

    return run


def _near(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, left: int, rights: slice, t: int, percent: int) -> np.ndarray:
    """Rows among ``rights`` that may be linked with row ``left``."""
    size = n[rights]
    ok = (comp[rights] != comp[left]) & (100 * np.minimum(size, n[left]) >= percent * np.maximum(size, n[left]))
    at = np.flatnonzero(ok)
    return rights.start + at[(sig[rights][at] == sig[left]).sum(axis=1) >= t]


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    pdf.sort_values(["is_left", "node"], ascending=[False, True], inplace=True, ignore_index=True)
    sig = np.stack([np.asarray(s, np.int32) for s in pdf["sig"]])
    return sig, pdf["n_shingles"].to_numpy(), pdf["comp"].to_numpy(), int(pdf["is_left"].sum())


def _open_nodes(t: int, percent: int):
    """Of a block: the rows that may be linked across components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, n, comp, lefts = _unpack(pdf)
        found = np.zeros(len(n), bool)
        for i in range(lefts):
            near = _near(sig, n, comp, i, slice(lefts, len(n)), t, percent)
            if len(near):
                found[i] = found[near] = True
        return pdf.loc[found, ["pivot", "node"]].drop_duplicates()

    return run


def _block_links(t: int, percent: int):
    """Of a block: for each left row one confirmed link to each component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, n, comp, lefts = _unpack(pdf)
        sets = [np.frombuffer(m, np.uint64) for m in pdf["members"]]
        starts = np.cumsum([0, *map(len, sets)])
        known, codes = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(known), bool)
        node, out = pdf["node"].to_numpy(), []
        for i in range(lefts):
            mine = codes[starts[i] : starts[i + 1]]
            mark[mine] = True
            linked: set[int] = set()
            for j in _near(sig, n, comp, i, slice(lefts, len(n)), t, percent).tolist():
                if comp[j] in linked:
                    continue
                both = int(mark[codes[starts[j] : starts[j + 1]]].sum())
                if 100 * both >= percent * (n[i] + n[j] - both):
                    linked.add(comp[j])
                    out.append((node[i], node[j]))
            mark[mine] = False
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """Lays a group's rows out as (left block, right block) tasks.  Left rows
    are those outside the pivot's component; right rows are all."""
    sizes = members.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.col("outside").cast("long")).alias("lefts"), F.min("comp").alias("c1"), F.max("comp").alias("c2")
    ).where("c1 <> c2")
    laid = members.join(sizes.select("pivot", F.ceil(F.col("size") / BLOCK).alias("nr"), F.ceil(F.col("lefts") / BLOCK).alias("nl")), "pivot")
    salt = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    left = laid.where("outside").select("*", F.lit(True).alias("is_left"), (salt % F.col("nl")).alias("lb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1)).alias("rb"))
    right = laid.select("*", F.lit(False).alias("is_left"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nl") - 1)).alias("lb"), (salt % F.col("nr")).alias("rb"))
    return left.unionByName(right)


def _same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes that one doc_id has texts of."""
    several = signed.groupBy("doc_id").agg(F.min("set_id").alias("one"), F.max("set_id").alias("other")).where("one <> other").select("doc_id", "one")
    pairs = materialize(signed.select("doc_id", "set_id").join(several, "doc_id").select("set_id", "one").where("set_id <> one").distinct(), "same-document")
    named = classes.select("set_id", "node")
    a = pairs.join(named.withColumnRenamed("node", "a"), "set_id").select("a", F.col("one").alias("set_id"))
    return a.join(named.withColumnRenamed("node", "b"), "set_id").select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Links documents with 100 * |A & B| >= percent * |A | B| over their sets
    of five-word shingles (A-Z lower-cased, words without ASCII white space;
    with fewer words the whole sequence is the only shingle).

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id
    reachable) and ``kept`` (doc_id = component_id), a row for each row.

    Null or empty text, or text without a word: an empty set, linked with
    nothing.  Null doc_id: linked with nothing, component_id null, kept.
    Repeated rows: one class, each row returned; different texts under one
    doc_id are linked through it.  A similarity of exactly ``percent`` is a
    link; of texts that tie for smallest doc_id all are kept.  Texts may have
    any length: a task holds one text's shingles.  An empty table gives an
    empty one.  Other columns are ignored.
    """
    t = match_threshold(percent)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = materialize(docs.select("doc_id", "text").mapInArrow(_sign, f"doc_id {id_type}, n_shingles long, set_id binary, sig array<int>"), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(
        some.groupBy("set_id")
        .agg(F.min("doc_id").cast("long").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    token = F.shiftleft(F.col("value").cast("long"), 6) + F.col("coordinate")
    posted = classes.select("node", F.posexplode("sig").alias("coordinate", "value")).select("node", token.alias("token"))
    common = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    prefix = (
        posted.join(common, "token")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"), F.sum("df").alias("weight"))
        .select("node", "weight", F.expr(f"slice(held, 1, greatest(0, {K - t + 1} - ({K} - least({K}, size(held)))))").alias("held"))
        .select("node", "weight", F.explode("held.token").alias("token"))
    )
    prefix = materialize(prefix, "prefix")
    pivots = prefix.groupBy("token").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("pivot"), F.count(F.lit(1)).alias("df")).where("df > 1")
    stars = materialize(prefix.join(pivots, "token").where("node <> pivot").select("pivot", "node").distinct(), "stars")

    # Texts are not shuffled: a filter of bounded size picks those to read again.
    involved = materialize(stars.select("node").union(stars.select("pivot")).distinct(), "involved")
    rows = classes.join(involved, "node", "left_semi")
    wanted = id_filter(rows.select("least").distinct())
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sets(wanted), "set_id binary, members binary")
    members = read.join(rows.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.first("members").alias("members"))
    full = materialize(rows.join(members, "set_id").select("node", "n_shingles", "sig", "members"), "sets")

    left = full.select(F.col("node").alias("pivot"), F.col("sig").alias("sig_a"))
    right = full.select("node", F.col("sig").alias("sig_b"))
    counted = (
        stars.join(left, "pivot").join(right, "node")
        .where(F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x)) >= t)
        .select("pivot", "node").distinct()
    )
    counted = materialize(counted, "counted")
    pairs = (
        counted.join(full.select(F.col("node").alias("pivot"), F.col("members").alias("x")), "pivot")
        .join(full.select("node", F.col("members").alias("y")), "node")
        .select("pivot", "node", "x", "y")
    )
    links = pairs.mapInArrow(_confirm(percent), "a long, b long")
    found = components(links.unionByName(_same_document(some, classes)))

    def labelled(nodes: DataFrame) -> DataFrame:
        return nodes.join(found, "node", "left").select(*[c for c in nodes.columns], F.coalesce("component", "node").alias("comp"))

    groups = stars.unionByName(stars.select("pivot", F.col("pivot").alias("node")).distinct())
    heads = labelled(stars.select(F.col("pivot").alias("node")).distinct()).select(F.col("node").alias("pivot"), F.col("comp").alias("head"))
    grouped = labelled(groups).join(heads, "pivot").withColumn("outside", F.col("comp") != F.col("head"))
    grouped = materialize(grouped.select("pivot", "node", "comp", "outside"), "groups")
    briefly = _blocks(grouped).join(full.select("node", "n_shingles", "sig"), "node")
    open_nodes = materialize(
        briefly.groupBy("pivot", "lb", "rb").applyInPandas(_open_nodes(t, percent), "pivot long, node long").distinct(), "open"
    )
    still = grouped.join(open_nodes, ["pivot", "node"], "left_semi")
    more = _blocks(still).join(full, "node").groupBy("pivot", "lb", "rb").applyInPandas(_block_links(t, percent), "a long, b long")
    more = materialize(more, "more-links")
    if not more.isEmpty():
        a = labelled(more.select(F.col("a").alias("node"), "b")).select(F.col("comp").alias("a"), F.col("b").alias("node"))
        b = labelled(a).select("a", F.col("comp").alias("b"))
        joined = components(b).select(F.col("node").alias("component"), F.col("component").alias("top"))
        all_nodes = labelled(classes.select("node").distinct()).select("node", F.col("comp").alias("component"))
        found = materialize(all_nodes.join(joined, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")
    placed = classes.select("set_id", "node", "least").join(found, "node", "left").select("set_id", "least", F.coalesce("component", "node").alias("component"))
    tops = placed.groupBy("component").agg(F.min("least").cast(id_type).alias("top"))
    of_set = placed.join(tops, "component").select(F.col("set_id").alias("of_set"), F.col("top").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(of_set, F.col("set_id") == F.col("of_set"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast(id_type)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
