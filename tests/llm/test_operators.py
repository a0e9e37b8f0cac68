"""The operators against plain Python on whole small tables."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wordloom.llm import queries as q  # noqa: E402
from wordloom.llm.line_rules import clean_lines  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in q.table(spark, sf, "documents").select("doc_id", "text").collect()}


def rows(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.select("doc_id", *names).collect()}


def test_quality_rules(spark, sf, docs):
    query = q.op2_quality_rules(spark, sf)
    got = rows(query, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {d: brute.quality(t) for d, t in docs.items()}
    assert all(not (k and b) for k, b in rows(query, "kept", "base_failed").values())
    out = clean_lines(q.table(spark, sf, "documents"))
    assert rows(out, "kept", "words_left", "clean_text") == {d: brute.line_rules(t) for d, t in docs.items()}
    quality = {r["doc_id"]: r["quality"] for r in q.table(spark, sf, "labels").collect()}
    kept = rows(out, "kept")
    for label, least in ((1, 0.97), (0, 0.6)):
        known = [kept[d][0] == label for d, x in quality.items() if x == label and d in kept and len(brute.WORD.findall(docs[d] or "")) >= 10]
        assert sum(known) >= least * len(known), (label, sum(known), len(known))


def test_line_rules_by_hand(spark):
    texts = ["About the war.\nWe went home.", "Home\nAbout us\nLogin\nIt is a fine day today.", "a | b | c | d", "These words have no sentence end at all", "Über uns\nImpressum\nSo ist es.", "All Rights Reserved 2020.\nFine.", "wow! so! big!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["clean_text"] for r in clean_lines(df).collect()}
    assert got == {0: texts[0], 1: "It is a fine day today.", 2: "", 3: "", 4: "So ist es.", 5: "Fine.", 6: ""}


def test_near_duplicates(spark, sf, docs):
    got = rows(q.op3_minhash_near_dedup(spark, sf), "n_shingles", "component_id")
    want = brute.near(docs.items())
    assert got == want
    assert any(d != c for d, (_, c) in want.items())


def test_line_dedup(spark, sf, docs):
    assert rows(q.op4_line_dedup(spark, sf), "n_lines", "n_dropped", "kept_sha256") == brute.lines_kept(docs.items())


def test_packing(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from wordloom.llm.packing import lower_bound, pack_documents

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = pack_documents(q.table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=True).toPandas()
    by = {d: p.sort_values("piece") for d, p in out.groupby("doc_id")}
    names = list(docs)
    for d, e in zip(names, tok.encode_batch([docs[d] or "" for d in names], add_special_tokens=False), strict=True):
        p = by[d]
        assert np.frombuffer(b"".join(p["ids"]), "<u4").tolist() == [*e.ids, 1]
        assert p["start"].tolist() == [0, *p["length"].cumsum().tolist()[:-1]]
        assert (p["length"].iloc[:-1] == 4096).all()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 4096
    assert out["sequence_id"].nunique() <= lower_bound(out["length"].to_numpy(), 4096) + 1


def test_packing_over_partitions(spark):
    from wordloom.llm import packing

    lengths = np.random.default_rng(3).integers(1, 3000, 4000)
    bins, offsets, fill = packing.best_fit_decreasing(np.sort(lengths)[::-1], 4096)
    assert fill.max() <= 4096 and fill.sum() == lengths.sum() and len(np.unique(bins)) == len(fill)
    assert len(fill) >= packing.lower_bound(lengths, 4096)
    # Three pieces of over a third of a sequence each never share one by threes.
    assert packing.lower_bound(np.array([2049] * 7), 4096) == 7


def test_mixing(spark, sf, docs):
    out = q.op6_mix_sources(spark, sf).toPandas()
    source = {r["doc_id"]: r["source"] for r in q.table(spark, sf, "documents").select("doc_id", "source").collect()}
    size = {d: len(brute.WORD.findall(t or "")) for d, t in docs.items()}
    totals = defaultdict(int)
    for d, s in source.items():
        totals[s] += size[d]
    want = brute.targets(totals)
    assert dict(zip(out["doc_id"], out["size"], strict=True)) == size
    taken = Counter()
    for r in out.itertuples():
        assert abs(r.target - want[source[r.doc_id]]) <= 1e-6 * max(1, r.target) and r.source_size == totals[source[r.doc_id]]
        assert r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 2), (s, taken[s], t)
    again = q.op6_mix_sources(spark, sf).toPandas()
    assert dict(zip(out["doc_id"], out["taken"], strict=True)) == dict(zip(again["doc_id"], again["taken"], strict=True))


def test_run_index(spark, sf, docs):
    got = rows(q.op7_run_index_dedup(spark, sf), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == dict(zip(docs, brute.repeats(docs.values()), strict=True))


def test_run_index_runs(spark):
    """Overlaps with itself, period strings, and matches that share anchors."""
    from wordloom.llm.run_index import remove_repeats

    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh ij"), n))
    p, r = text(230), text(500)
    texts = ["a" * 1000, "ab" * 300, text(300) + p + text(90), p + text(400), r[:260] + text(100) + r[240:], text(50) + r + text(20), "é" * 150, text(150) + "é" * 120, None, "", "x" * 199, "y" * 200, "z" * 201, text(210)]
    texts += [texts[3]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = remove_repeats(df).select("doc_id", "n_bytes", "n_removed", F.size("removed").alias("n"), F.sha2("kept", 256).alias("sha"))
    assert [tuple(r)[1:] for r in out.orderBy("doc_id").collect()] == brute.repeats(texts)


def test_nearest(spark, sf):
    table = q.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    ids = np.array([r["vec_id"] for r in table])
    x = np.array([r["embedding"] for r in table], np.float64)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    got = q.op9_nearest_neighbours(spark, sf).toPandas().sort_values(["query_id", "rank"])
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        mine = got[got["query_id"] == ids[i]]
        assert mine["rank"].tolist() == list(range(1, len(order) + 1))
        for v, s in zip(mine["vec_id"], mine["score"], strict=True):
            assert abs(s - score[ids == v][0]) < 1e-12
        hits += len(set(mine["vec_id"]) & set(ids[order]))
        total += len(order)
    assert hits >= 0.9 * total


def test_secret_scan(spark, sf, docs):
    got = {r["doc_id"]: r for r in q.op10_secret_scan(spark, sf).collect()}
    for d, t in docs.items():
        n = brute.secrets(t)
        r = got[d]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == n[:4], d
        mine, base = r["spans"].split(","), n[4].split(",") if n[4] else []
        assert set(base) <= set(mine) and [x for x in mine if not x.startswith("markov")] == (base or [x for x in mine if x == ""])


def test_secret_scan_adds_random_tokens(spark, sf):
    """A random key without a pattern is found; long ordinary names aren't."""
    from wordloom.llm.secrets import find_secrets, train

    model = train(q.table(spark, sf, "documents"), documents=500)
    rng = np.random.default_rng(7)
    keys = ["".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"), 32)) for _ in range(60)]
    names = ["the_configuration_of_the_first_server_2", "international-understanding-of-2024-conditions", "thereandthereandthereand1"]
    texts = [f"here is {k} and then" for k in keys] + [f"see {n} here" for n in names]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in find_secrets(df, model).collect()}
    assert sum([(s["start"], s["end"]) for s in got[i]] == [(8, 40)] for i in range(60)) >= 57
    assert all(not got[60 + i] for i in range(len(names)))


def test_toxicity_held_out(spark, sf):
    labels = {r["doc_id"]: r["toxic"] for r in q.table(spark, sf, "labels").collect()}
    got = q.op1_toxicity(spark, sf).toPandas()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    assert all((brute.fold(d, 3) == 1) == h for d, h in zip(got["doc_id"], got["held_out"], strict=True))
    held = [(labels[d], p) for d, h, p in zip(got["doc_id"], got["held_out"], got["predicted"], strict=True) if h and labels.get(d) is not None]
    right = sum(a == b for a, b in held) / len(held)
    found = [p for t, p in held if t == 1]
    print("toxicity held out", len(held), right, sum(found), len(found))
    assert right >= 0.9 and sum(found) >= 0.7 * len(found)


def test_language_held_out(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in q.table(spark, sf, "documents").select("doc_id", "lang").collect()}
    got = q.op8_language_id(spark, sf).toPandas()
    held = [(lang[d], p) for d, h, p in zip(got["doc_id"], got["held_out"], got["lang_pred"], strict=True) if h and lang[d] is not None]
    right = sum(a == b for a, b in held) / len(held)
    print("language held out", len(held), right)
    assert right >= 0.95
