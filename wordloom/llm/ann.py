"""Nearest neighbours by score-aware (anisotropic) quantisation.

Vectors are scaled to length one, and what is left of each after its nearest
coarse centre is cut into subspaces of two dimensions with 16 codewords each,
so a code takes four bits for each pair of dimensions.  Codes and codebooks
minimise a loss that weighs the residual parallel to the vector ``eta`` times
as much as the rest, since only the parallel part moves large inner products;
what parallel residual remains is stored as one number and divided out.

A scan adds up table entries over the four-bit codes of a block of rows for
each query of a block of queries.  The best ``rerank`` rows are measured on the
original vectors; the angle between a row and what its code stands for, stored
with it, then says which others may be as near as the last of the best.  These
are measured too, so no near row is lost, whatever the rows are like.  Each
block hands on its ``k`` best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.shared import materialize

WORDS, CENTRES = 16, 256
#: Rows and queries of a block, for vectors of up to 64 components; longer ones make smaller blocks.
ROWS, QUERIES = 1 << 14, 1024


@dataclass
class Books:
    """``centres`` (n, d) and codebooks (subspaces, 16, 2)."""

    centres: np.ndarray
    words: np.ndarray
    weight: float


def eta(dimensions: int, threshold: float = 0.2) -> float:
    """The parallel weight for inner products above ``threshold``."""
    return max(1.0, (dimensions - 1) * threshold**2 / (1 - threshold**2))


def _unit(x: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` components of rows brought to length one, with a zero
    column more if the number is odd."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)
    x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    x = np.pad(x, ((0, 0), (0, max(0, size - x.shape[1]))))[:, :size]
    return np.pad(x, ((0, 0), (0, size % 2)))


def _cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def _codes(x: np.ndarray, y: np.ndarray, words: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes of the residuals ``y`` of unit rows ``x``: nearest codewords
    first, then coordinate descent on the anisotropic loss."""
    n, m = len(x), len(words)
    own, parts = x.reshape(n, m, 2), y.reshape(n, m, 2)
    codes, along = np.empty((n, m), np.uint8), np.zeros(n, np.float32)
    rows = np.arange(n)
    for sweep in range(sweeps + 1):
        for s in range(m):
            gap = parts[:, s, None, :] - words[s]
            parallel = (gap * own[:, s, None, :]).sum(axis=2)
            loss = (gap * gap).sum(axis=2)
            if sweep:
                along -= parallel[rows, codes[:, s]]
                loss += (weight - 1) * (along[:, None] + parallel) ** 2
            codes[:, s] = loss.argmin(axis=1)
            along += parallel[rows, codes[:, s]]
    return codes


def encode(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cell, codes, gain and reach of unit rows, or of the first components of
    such rows.

    A code stands for a vector c of length a along its row and w across it.  The
    row's inner product with a unit query q is (q c) * gain, give or take reach
    times the sine of the angle between row and query: gain is 1 / a, reach w / a."""
    single = x.astype(np.float32)
    cell = _cells(single, books.centres)
    codes = _codes(single, single - books.centres[cell], books.words, books.weight)
    m = len(books.words)
    coded = books.centres[cell].astype(np.float64) + np.concatenate([books.words[s][codes[:, s]] for s in range(m)], axis=1)
    along = (coded * x).sum(axis=1)
    across = np.sqrt(np.maximum((coded * coded).sum(axis=1) - along * along, 0)) + 2e-8  # more than rounding takes away
    told = along > 0.01
    gain = 1 / np.where(told, along, 1)
    return cell, codes, np.where(told, gain, 0), np.where(told, across * gain, np.inf)


def fit(x: np.ndarray, rounds: int = 4, threshold: float = 0.2) -> Books:
    """Centres by Lloyd's rounds and codebooks by alternating codes and
    codewords, from unit rows."""
    n, d = x.shape
    m, weight = d // 2, eta(d, threshold)
    start = np.lexsort((np.arange(n), (x @ np.cos(np.arange(d, dtype=np.float32)))))
    centres = x[start[np.linspace(0, n - 1, max(1, min(CENTRES, n // 32))).astype(int)]].copy()
    for _ in range(10):
        cell = _cells(x, centres)
        count = np.bincount(cell, minlength=len(centres))
        total = np.stack([np.bincount(cell, x[:, k], len(centres)) for k in range(d)], axis=1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres).astype(np.float32)
    y = x - centres[_cells(x, centres)]
    own, parts = x.reshape(n, m, 2), y.reshape(n, m, 2)
    order = np.linspace(0, n - 1, WORDS).astype(int)
    words = np.stack([parts[np.lexsort((parts[:, s, 1], parts[:, s, 0]))[order], s] for s in range(m)]).astype(np.float32)
    for step in range(rounds + 6):
        plain = step < 6  # without the parallel part, for a start
        codes = _codes(x, y, words, weight, 0 if plain else 2)
        gaps = np.stack([((parts[:, s] - words[s][codes[:, s]]) * own[:, s]).sum(axis=1) for s in range(m)], axis=1)
        w = 0.0 if plain else weight - 1
        for s in range(m):
            # Each codeword of a subspace solves two equations, the others fixed.
            others = gaps.sum(axis=1) - gaps[:, s]
            pull = w * (others + (parts[:, s] * own[:, s]).sum(axis=1))
            code = codes[:, s]
            count = np.bincount(code, minlength=WORDS)
            a = np.zeros((WORDS, 2, 2))
            b = np.zeros((WORDS, 2))
            for i in range(2):
                b[:, i] = np.bincount(code, parts[:, s, i] + pull * own[:, s, i], WORDS)
                for j in range(2):
                    a[:, i, j] = np.bincount(code, w * own[:, s, i] * own[:, s, j], WORDS) + (count + 1e-6) * (i == j)
            words[s] = np.where(count[:, None] > 0, np.linalg.solve(a, b[:, :, None])[:, :, 0], words[s])
            gaps[:, s] = ((parts[:, s] - words[s][code]) * own[:, s]).sum(axis=1)
    return Books(centres, words, weight)


def _matrix(vectors: list, size: int = 1) -> np.ndarray:
    """Rows filled up with zeros to one length, ``size`` at least, each times
    a power of two that brings its largest component near one: cosines stay as
    they are to the last bit, and no square over- or underflows."""
    out = np.zeros((len(vectors), max([size, *map(len, vectors)])))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, keepdims=True))[1])


def _stored(column: pd.Series, size: int) -> np.ndarray:
    return _matrix([np.frombuffer(b) for b in column], size)


def _encode(shared, size: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if not frame.num_rows:
                continue
            vectors = frame.column("embedding").to_pylist()
            x = _matrix(vectors, size)
            cell, codes, gain, reach = encode(_unit(x, size), shared.value)
            codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
            packed = codes[:, 0::2] | (codes[:, 1::2] << 4)
            yield pa.RecordBatch.from_arrays(
                [
                    frame.column("rid"),
                    frame.column("vec_id"),
                    pa.array([row[: len(v)].tobytes() for row, v in zip(x, vectors, strict=True)], pa.binary()),
                    pa.array(cell.astype(np.int32)),
                    pa.array([p.tobytes() for p in packed], pa.binary()),
                    pa.array(gain),
                    pa.array(reach),
                ],
                ["rid", "vec_id", "vector", "cell", "code", "gain", "reach"],
            )

    return run


def _dots(columns: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up from the first component to
    the last; ``columns`` has a row for each component."""
    total = np.zeros(columns.shape[1])
    for own, other in zip(columns, q, strict=True):
        total += own * other
    return total


def _scan(shared, size: int, k: int, rerank: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        books = shared.value
        out: list[tuple[np.ndarray, ...]] = []
        if len(rows) and len(queries):
            rids, ids, cell, gain, reach = (rows[c].to_numpy() for c in ("rid", "vec_id", "cell", "gain", "reach"))
            codes = np.stack([np.frombuffer(c, np.uint8) for c in rows["code"]]).T.copy()
            x, asked = _stored(rows["vector"], size), _stored(queries["vector"], size)
            width = max(x.shape[1], asked.shape[1])
            x, asked = (np.pad(a, ((0, 0), (0, width - a.shape[1]))).T.copy() for a in (x, asked))
            norms, lengths = (np.sqrt(sum((c * c for c in a), np.zeros(a.shape[1]))) for a in (x, asked))
            words, centres = books.words.astype(np.float64), books.centres.astype(np.float64)
            low, high = np.arange(256) & 15, np.arange(256) >> 4
            for i, (query, q_id, q) in enumerate(zip(queries["rid"].tolist(), queries["vec_id"].tolist(), _unit(asked.T, size), strict=True)):
                tables = (q.reshape(len(words), 1, 2) * words).sum(axis=2)
                tables = np.pad(tables, ((0, len(tables) % 2), (0, 0)))
                score = (centres @ q)[cell]
                for s in range(len(codes)):
                    score += (tables[2 * s][low] + tables[2 * s + 1][high])[codes[s]]
                score *= gain
                own = rids == query
                score[own] = -np.inf
                best = np.argpartition(score, -rerank)[-rerank:] if len(score) > rerank else np.arange(len(score))
                best = best[~own[best]]
                exact = _dots(x[:, best], asked[:, i]) / (norms[best] * lengths[i])
                if len(score) > rerank and len(best) >= k:
                    # Whatever is as near as the k-th so far is nearer to the query than this angle.
                    last = np.partition(exact, -k)[-k]
                    sine = max(np.sqrt(max(1 - max(last, 0.0) ** 2, 0.0)), 1e-9)
                    may = score + sine * reach >= last - 1e-11
                    may[best] = may[own] = False
                    more = np.flatnonzero(may)
                    best = np.concatenate([best, more])
                    exact = np.concatenate([exact, _dots(x[:, more], asked[:, i]) / (norms[more] * lengths[i])])
                at = np.lexsort((ids[best], -exact))[:k]
                out.append((np.full(len(at), query), np.full(len(at), q_id), ids[best[at]], exact[at]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
        kinds = (("query", np.int64), ("query_id", np.int64), ("vec_id", np.int64), ("score", np.float64))
        return pd.DataFrame({name: np.asarray(c, kind) for (name, kind), c in zip(kinds, cols, strict=True)})

    return run


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, rerank: int = 200, sample: int = 10_000, threshold: float = 0.2) -> DataFrame:
    """The ``k`` nearest rows found by cosine for each row whose vec_id is
    divisible by ``every``: ``query_id, rank, vec_id, score``, nearest first,
    ties to the smaller vec_id.

    Centres and codebooks are fitted on about ``sample`` rows (the documented
    bound); every row is indexed and scanned.  The best ``rerank`` rows of each
    query and block by their codes, and all that may be as near as the k-th of
    them, are measured exactly, so the result is that of brute force.  Rows
    that lie so close together that codes can't tell them apart cost more
    measures, not more memory: a task holds one block of rows and queries.

    Null ids or vectors, vectors of zeros or with null or non-finite
    components take no part.  Rows with one vec_id are rows of their own: each
    may be found, and each asks if its id does.  A vector shorter than another
    counts as ending in zeros; codes look at as many components as most rows
    have.  Fewer rows than ``k``: all of them.  An empty table gives an empty
    one; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(
        F.col("vec_id").isNotNull()
        & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("embedding", lambda c: c != 0)
    )
    sizes = fine.groupBy(F.size("embedding").alias("size")).count()
    all_of = sizes.agg(F.sum("count").alias("n"), F.max("size").alias("width")).first()
    n, width = all_of["n"] or 0, all_of["width"] or 1
    most = sizes.orderBy(F.desc("count"), "size").first()
    size = most["size"] if most else 1
    hashed = F.xxhash64("vec_id", "embedding", F.lit("sample"))
    u = F.pmod(hashed, F.lit(1 << 40)) / float(1 << 40)
    drawn = fine.where(u * n < sample).orderBy(hashed, "vec_id").limit(2 * sample).collect()
    taught = _unit(_matrix([r["embedding"][:size] for r in drawn if any(r["embedding"][:size])] or [[1.0]], size), size)
    shared = spark.sparkContext.broadcast(fit(taught.astype(np.float32), threshold=threshold))
    numbered = fine.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "embedding")
    index = materialize(numbered.mapInArrow(_encode(shared, size), "rid long, vec_id long, vector binary, cell int, code binary, gain double, reach double"), "index")
    asks = F.col("vec_id") % every == 0
    per_rows, per_queries = (max(1, block * 64 // max(64, width)) for block in (ROWS, QUERIES))
    row_blocks, query_blocks = max(1, -(-n // per_rows)), max(1, -(-n // (every * per_queries)))
    over = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    rows = index.select("rid", "vec_id", "vector", "cell", "code", "gain", "reach", F.pmod(F.xxhash64("rid"), F.lit(row_blocks)).alias("rb"), over(query_blocks).alias("qb"))
    asked = index.where(asks).select("rid", "vec_id", "vector", F.pmod(F.xxhash64("rid"), F.lit(query_blocks)).alias("qb"), over(row_blocks).alias("rb"))
    found = rows.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInPandas(_scan(shared, size, k, rerank), "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
