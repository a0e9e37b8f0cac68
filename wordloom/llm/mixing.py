"""Mixing of sources to target weights by the cube method.

Each source's target is a multiple of its size, so each of its documents is
taken ``floor(multiple)`` times for sure and once more with the remaining
fraction as probability.  The cube method settles these fractions.  A flight
keeps a few documents active and moves their probabilities along a vector in
the null space of the balancing constraints (number of documents and number
of words), until one of them reaches 0 or 1; so both totals stay where they
are.  Flights run in blocks of a bounded number of documents of one source.
Each block leaves two documents undecided at most, which meet in the flights
of the next level, until a single block of the source is left.  Its last two
documents and a dozen held back are the landing problem: the choice of
roundings whose word total is nearest to the target.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.shared import materialize

BLOCK, LANDING = 20_000, 12
EPS = 1e-9
#: Slots for each row and at most in ``taken_rows``: two bits of each are broadcast, so 32 MB at most.
SLOTS, MOST_SLOTS = 8, 1 << 27
#: Fixed value: the bits of one of Spark's bitmaps.
BITS = 32768
#: A slot whose rows are not taken equally often.
OPEN = 3


def _direction(size: tuple[float, float, float]) -> tuple[float, float, float]:
    """A vector orthogonal to (1, 1, 1) and to the sizes."""
    a, b, c = size
    v = (c - b, a - c, b - a)
    return v if any(v) else (1.0, -1.0, 0.0)


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Moves probabilities until at most two are fractional.  ``draw`` holds
    a uniform number for each document, used for the step that settles it."""
    p = p.copy()
    active: list[int] = []
    for nxt in np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist():
        active.append(nxt)
        if len(active) < 3:
            continue
        i, j, k = active
        v = _direction((float(size[i]), float(size[j]), float(size[k])))
        up = down = np.inf
        for at, s in zip(active, v, strict=True):
            if s > 0:
                up, down = min(up, (1 - p[at]) / s), min(down, p[at] / s)
            elif s < 0:
                up, down = min(up, p[at] / -s), min(down, (1 - p[at]) / -s)
        step = up if draw[nxt] < down / (up + down) else -down
        for at, s in zip(active, v, strict=True):
            p[at] += step * s
        near = np.abs(p[active] - np.round(p[active]))
        settled = [at for at, d in zip(active, near.tolist(), strict=True) if d <= 1e-7]
        for at in settled or [active[int(near.argmin())]]:
            p[at] = round(p[at])
            active.remove(at)
    return p


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["draw", "size", "key"], kind="stable", ignore_index=True)
    pdf["p"] = flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(np.float64), pdf["draw"].to_numpy())
    return pdf


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    """A last flight without ``LANDING`` documents of evenly spread sizes,
    then the rounding of these and of the at most two left over whose words,
    and then whose documents, come nearest to what is expected of them."""
    pdf = pdf.sort_values(["size", "draw", "key"], kind="stable", ignore_index=True)
    held = np.unique(np.linspace(0, len(pdf) - 1, LANDING).astype(int))
    flown = _fly(pdf.drop(index=held))
    pdf = pd.concat([flown, pdf.loc[held]], ignore_index=True)
    p, size = pdf["p"].to_numpy().copy(), pdf["size"].to_numpy(np.float64)
    rest = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    choices = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    words = np.abs(choices @ size[rest] - (p[rest] * size[rest]).sum())
    documents = np.abs(choices.sum(axis=1) - p[rest].sum())
    p[rest] = choices[np.lexsort((documents, words))[0]]
    pdf["p"] = np.round(p)
    return pdf


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """(``source``, ``source_size``, ``target``): the sources by code point,
    null last, weigh ``weights`` in turn and share ``share`` times all words;
    no target passes ``cap`` times its source, the excess is shared again by
    weight.  The k-th source to reach its cap does so at the k-th smallest
    ratio of cap to weight, so windows over the sources find the level."""
    by = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    rank = F.pmod(F.row_number().over(by) - 1, F.lit(n))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = (
        ranked.withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.col("capped")) / (F.col("all_weight") - F.col("used")))
    )
    # The level that holds is that of the first source below its cap.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(everything)
    return stepped.withColumn("final", level["level"]).select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("final") * F.col("weight"), F.col("most"))).alias("target"))


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: int = 1) -> DataFrame:
    """Returns ``doc_id, source, size, source_size, target, copies, taken`` for
    each row; a document is taken ``copies`` times (0, 1 or 2 with a cap of 2).

    Null text has size 0 and is never taken; null source is a source, the last
    one.  Repeated rows are documents of their own; where rows agree in
    doc_id, source and size they are told apart by a running number.  All draws
    come from hashes of these, so reruns agree; ties between hashes go by
    doc_id and that number.  Only the sizes of texts are moved, so texts may
    have any length.  An empty table gives an empty one; other columns are
    ignored.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"))
    twins = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))
    rows = materialize(sized.withColumn("twin", F.row_number().over(twins).cast("long")), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    targets = source_targets(totals.select("source", "source_size"), share, cap, weights).withColumnRenamed("source", "of")
    known = totals.join(targets.drop("source_size"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    known = materialize(known.withColumnRenamed("source", "of").withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    # One row for each source; Spark broadcasts it only if it is small.
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    key = F.xxhash64("doc_id", "twin", F.lit(seed))
    draw = F.pmod(F.xxhash64("doc_id", "twin", "size", F.lit(seed + 1)), F.lit(1 << 52)) / float(1 << 52)
    base = F.when(F.col("size") > 0, F.floor(F.col("ratio") + EPS)).otherwise(0).cast("long")
    ready = materialize(
        joined.withColumn("base", base)
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("ratio") - F.col("base"))).otherwise(0.0))
        .withColumn("key", key)
        .withColumn("draw", draw),
        "inclusion",
    )
    columns = ready.columns
    fractional = f"p > {EPS} and p < 1 - {EPS}"
    done = ready.where(f"not ({fractional})")
    left = ready.where(fractional).withColumn("left", F.col("documents"))
    level = 0
    while True:
        blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("left") / BLOCK))
        dealt = left.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks")))
        schema = dealt.schema
        many = dealt.where("blocks > 1")
        landed = dealt.where("blocks = 1").groupBy("source").applyInPandas(_land, schema)
        done = done.unionByName(materialize(landed, "landed").select(*columns))
        flown = materialize(many.groupBy("source", "block").applyInPandas(_fly, schema), "flown")
        if flown.isEmpty():
            break
        done = done.unionByName(flown.where(f"not ({fractional})").select(*columns))
        # A block leaves two documents at most, so the next level has at most that many.
        left = flown.where(fractional).select(*columns, (F.col("blocks") * 2).alias("left"))
        level += 1
    copies = F.col("base") + F.round("p").cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "twin")


def _placed(rows: DataFrame, slots: int) -> DataFrame:
    """``rows`` with the ``bucket`` and the bit ``at`` of the slot that the hash of id and source gives."""
    slot = F.pmod(F.xxhash64("doc_id", "source"), F.lit(slots)) + 1
    return rows.withColumn("bucket", F.bitmap_bucket_number(slot)).withColumn("at", F.bitmap_bit_position(slot))


def _slot_bits(mixed: DataFrame, slots: int) -> DataFrame:
    """(``bucket``, ``low``, ``high``): two bits for each slot, 0 to 2 where
    all of its rows are taken that often, else ``OPEN``."""
    alike = (F.min("copies") == F.max("copies")) & (F.max("copies") < OPEN)
    states = _placed(mixed, slots).repartition("bucket").groupBy("bucket", "at").agg(F.when(alike, F.max("copies")).otherwise(OPEN).cast("int").alias("state"))
    bits = [F.expr(f"bitmap_construct_agg(at) FILTER (WHERE (state & {k}) > 0)").alias(name) for k, name in ((1, "low"), (2, "high"))]
    return states.where("state > 0").groupBy("bucket").agg(*bits)


def taken_rows(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows that the mix takes, with ``copies``.

    ``rows``: what was mixed, with ``doc_id``, ``source``, ``text`` and any
    other columns; ``mixed``: ``doc_id, source, size, twin, copies`` as
    ``mix_sources`` returns them, written.  Rows are dealt out to slots by a
    hash of id and source.  A slot whose rows are all taken equally often says
    so in two broadcast bits, and such rows stay where they are.  Only rows of
    other slots (about 6 in 100; more where ``MOST_SLOTS`` are filled) are
    shuffled, to meet their numbers of copies.  Rows that agree in id, source
    and size lie in one slot and are told apart by the order of their texts'
    hashes.
    """
    slots = min(MOST_SLOTS, BITS * max(1, -(-SLOTS * mixed.count() // BITS)))
    bits = materialize(_slot_bits(mixed, slots), "slots")

    def bit(name: str) -> Column:
        byte = F.conv(F.hex(F.substring(name, (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        return F.coalesce(F.getbit(byte.cast("int"), F.pmod("at", F.lit(8)).cast("int")).cast("int"), F.lit(0))

    def seen(df: DataFrame) -> DataFrame:
        found = _placed(df, slots).join(F.broadcast(bits), "bucket", "left")
        return found.select(*df.columns, (bit("low") + 2 * bit("high")).alias("state"))

    keys = ("doc_id", "source", "size", "twin")
    sure = seen(rows).where(f"state > 0 and state < {OPEN}").select(*rows.columns, F.col("state").cast("long").alias("copies"))
    order = Window.partitionBy(*keys[:-1]).orderBy(F.xxhash64("text"), *rows.columns)
    numbered = seen(rows).where(f"state = {OPEN}").withColumn("size", word_count()).withColumn("twin", F.row_number().over(order).cast("long"))
    wanted = seen(mixed).where(f"state = {OPEN} and copies > 0").select("copies", *(F.col(k).alias(f"of_{k}") for k in keys))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    return sure.unionByName(numbered.join(wanted, same).select(*rows.columns, "copies"))
