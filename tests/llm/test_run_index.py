"""The run index against plain Python, and what it is spared."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import run_index


@pytest.mark.parametrize("width", [1, 2, 3, 8, 153, 300])
def test_window_minima(width):
    x = np.random.default_rng(width).integers(0, 50, 300).astype(np.uint64)
    assert run_index.window_minima(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


def rounds_of(index, monkeypatch):
    sorts = []
    plain = np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **b: sorts.append(1) or plain(*a, **b))
    order = index._sort()
    monkeypatch.undo()
    return order, len(sorts)


def test_suffix_order_and_its_rounds(monkeypatch):
    rng = random.Random(5)
    passage = bytes(rng.choices(b"abcdefgh ", k=900))
    regions = [bytes(rng.choices(b"ab", k=rng.randrange(1, 60))) for _ in range(40)] + [passage + b"x", b"y" + passage, passage[:500], passage[3:] * 2]
    group = np.array([*(i % 3 for i in range(40)), 3, 3, 3, 4], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in regions])])
    index = run_index.RunIndex(np.frombuffer(b"".join(regions), np.uint8), starts, group)
    places = [(i, k) for i, r in enumerate(regions) for k in range(len(r))]
    want = sorted(range(len(places)), key=lambda p: (group[places[p][0]], regions[places[p][0]][places[p][1] :], p))
    order, sorts = rounds_of(index, monkeypatch)
    assert order.tolist() == want
    # Prefixes of 900 bytes are told apart in six sorts; doubling takes nine.
    assert sorts <= 6
    got = index.matching_statistics()
    for p, (i, k) in enumerate(places):
        own, best = regions[i][k:], 0
        for j, o in places:
            if group[j] == group[i] and (i, k) != (j, o):
                while best < len(own) and regions[j][o : o + best + 1] == own[: best + 1]:
                    best += 1
        assert got[p] == best


def test_classes_that_are_all_repeated_are_not_indexed(spark, monkeypatch):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    a, b, c, d, p = (some(400) for _ in range(5))
    texts = [some(300) + x + p + y + some(300) for x, y in ((a, b), (a, b), (c, d), (c, d))] + [some(500)]
    kept = {}
    write = run_index.materialize
    monkeypatch.setattr(run_index, "materialize", lambda df, label: kept.setdefault(label, write(df, label)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = run_index.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute.repeats(texts) and got[0]["n_removed"] >= 1200
    least = kept["classes"].groupBy("anchor").agg(F.count("*").alias("classes"), F.min("n").alias("least"))
    whole = {r["anchor"] for r in least.where("classes > 1 and least > 1").collect()}
    assert whole and not whole & {r["anchor"] for r in kept["fetched"].collect()}
