"""What each method promises, beyond the digest of its query."""

import glob
import hashlib
import itertools
import os
import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wordloom.llm import ann, crf  # noqa: E402
from wordloom.llm import queries as q  # noqa: E402
from wordloom.llm.langid import identify  # noqa: E402
from wordloom.llm.line_dedup import drop_shared_lines  # noqa: E402
from wordloom.llm.minhash_join import near_duplicates  # noqa: E402
from wordloom.llm.run_index import RunIndex  # noqa: E402
from wordloom.llm.secrets import ALPHABET, UUID, find_secrets, shortest, train  # noqa: E402


def test_long_chains_are_unbroken():
    draw, labels = np.random.default_rng(1), 4
    model = crf.Crf(np.zeros((crf.SIZE + 1, labels), np.float32), draw.normal(0, 2, (labels, labels)).astype(np.float32), draw.normal(0, 1, labels).astype(np.float32))
    bounds = np.concatenate([[0], np.cumsum([0, 1, 64, 65, 128, 1000, 63, 5000, 3])])
    emission = draw.normal(0, 3, (bounds[-1], labels)).astype(np.float32)
    got, pairs = model.marginals(emission, *crf.chains_of(bounds), expected=True)
    want, both, move = np.zeros(got.shape), np.zeros((labels, labels)), np.exp(model.step.astype(float))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        b = np.exp(emission[a:z].astype(float))
        alpha, beta = b.copy(), np.ones_like(b)
        for t in range(len(b)):
            alpha[t] = b[t] * (np.exp(model.start) if t == 0 else alpha[t - 1] @ move)
            alpha[t] /= alpha[t].sum()
        for t in range(len(b) - 2, -1, -1):
            beta[t] = move @ (b[t + 1] * beta[t + 1])
            beta[t] /= beta[t].sum()
            x = alpha[t][:, None] * move * (b[t + 1] * beta[t + 1])
            both += x / x.sum()
        if z > a:
            want[a:z] = alpha * beta / (alpha * beta).sum(axis=1, keepdims=True)
    assert np.abs(got - want).max() < 1e-5 and np.abs(pairs - both).max() < 1e-3


def test_switched_languages(spark, sf):
    """Stretches of texts that change their language half way."""
    docs = q.table(spark, sf, "documents")
    held = docs.where(q.fold(4) == 2).where("lang is not null and text is not null and length(text) < 3000").orderBy("doc_id").collect()
    held = [(r["lang"], [w for w in r["text"].split() if w.isalpha() and len(w) > 2][:15]) for r in held]
    held = [h for h in held if len(h[1]) == 15]
    draw, texts, turns = np.random.default_rng(3), [], []
    for _ in range(100):
        (a, x), (b, y) = (held[i] for i in draw.choice(len(held), 2))
        texts.append(" ".join(x + y))
        turns.append((a, b, len(" ".join(x))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    right = total = 0
    for r in identify(df, docs.where(q.fold(4) != 2), with_spans=True).collect():
        a, b, turn = turns[r["doc_id"]]
        for s in r["spans"]:
            total += s["end"] - s["start"]
            right += sum(s["lang"] == (a if x < turn else b) for x in range(s["start"], s["end"]))
    assert right >= 0.97 * total


def recall(spark, x):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    got = ann.nearest(df).toPandas()
    x = x.astype(np.float32).astype(float)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    hits = total = 0
    for i in range(0, len(x), 50):
        score = unit @ unit[i]
        score[i] = -2
        hits += len(set(np.argsort(-score)[:5]) & set(got[got["query_id"] == i]["vec_id"]))
        total += 5
    return hits / total


def test_nearest_in_clusters_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 2000)
    monkeypatch.setattr(ann, "QUERIES", 50)
    draw = np.random.default_rng(0)
    for centres, spread in ((5, 0.05), (200, 0.5), (1, 0.01)):
        c = draw.normal(size=(centres, 64))
        assert recall(spark, c[draw.integers(centres, size=8192)] + draw.normal(size=(8192, 64)) * spread) >= 0.95


def test_nearest_among_rows_that_codes_cannot_tell_apart(spark, monkeypatch):
    """Very close rows, rows of several lengths, components of any size."""
    monkeypatch.setattr(ann, "ROWS", 3000)
    draw = np.random.default_rng(5)
    close = draw.normal(size=(1, 64)) + 1e-4 * draw.normal(size=(6000, 64))
    mixed = [v[:n] for v, n in zip(draw.normal(size=(4000, 64)), draw.choice([31, 64], 4000, p=[0.7, 0.3]), strict=True)]
    huge = draw.normal(size=(1000, 9)) * 10.0 ** draw.integers(-250, 250, size=(1000, 1))
    for rows in (list(close), mixed, list(huge)):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
        got = ann.nearest(df).orderBy("query_id", "rank").toPandas()
        x = np.array([np.pad(v, (0, 64 - len(v))) for v in rows])
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        for i in range(0, len(x), 50):
            score = x @ x[i]
            score[i] = -2
            assert score[got[got["query_id"] == i]["vec_id"]].min() >= np.sort(score)[-5] - 1e-15


def test_nearest_rows_of_one_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert Counter(r["query_id"] for r in got) == {50: 8}
    # Of the tie at 1 / sqrt(1.01) the smaller id is first.
    assert [sorted(r["vec_id"] for r in got if r["rank"] == k) for k in (1, 2)] == [[3, 3], [50, 50]] and all(-1 <= r["score"] <= 1 + 1e-12 for r in got)


def test_near_copies_through_one_id(spark):
    text = lambda a: " ".join(f"w{i}" for i in range(a, a + 50))
    df = spark.createDataFrame([(1, text(0)), (4, text(0)), (4, text(100)), (9, text(100)), (7, text(300))], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(1, 1, True), (4, 1, False), (4, 1, False), (7, 7, True), (9, 1, False)]


def test_pairs_near_the_limit(spark):
    """Each pair of 85 to 88 in a hundred is found."""
    draw, rows, want = np.random.default_rng(11), [], 0
    for k in range(300):
        words = [f"k{k}w{i}" for i in range(400)]
        rows.append((2 * k, " ".join(words)))
        for at in draw.choice(np.arange(10, 390, 6), int(draw.integers(5, 8)), replace=False):
            words[at] = f"x{k}y{at}"
        rows.append((2 * k + 1, " ".join(words)))
        a, b = brute.shingles(rows[-1][1]), brute.shingles(rows[-2][1])
        want += 100 * len(a & b) >= 85 * len(a | b)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert 50 < want < 300 and sum(not r["kept"] for r in got) == want


def test_saturated_filter_stays_exact(spark, sf):
    docs = q.table(spark, sf, "documents").select("doc_id", "text")
    want = brute.lines_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    out = drop_shared_lines(docs, max_bits=1 << 16)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in out.collect()}
    assert got == want


def test_runs_are_fewer_in_repetitive_text():
    one = np.random.default_rng(2).integers(97, 123, 400).astype(np.uint8)
    copies = np.tile(one, 20)
    starts = np.arange(21) * 400
    index = RunIndex(copies, starts, np.zeros(20, np.int64))
    assert index.runs < 2 * 400 and index.runs < len(copies) / 8
    assert (index.matching_statistics() == np.tile(np.arange(400, 0, -1), 20)).all()


def test_long_texts_of_tokens(spark):
    draw = np.random.default_rng(4)
    keys = ["".join(draw.choice(list("abcdeABCDE0123456789"), 16)) for _ in range(8000)]
    text = "token=abcdefgh " + " ".join(keys)
    r = find_secrets(spark.createDataFrame([(1, text), (2, "x" * 200_000)], "doc_id long, text string"), dict.fromkeys(map("".join, itertools.product(ALPHABET, repeat=2)), 1.0)).orderBy("doc_id").collect()
    spans = [(s["start"], s["end"]) for s in r[0]["spans"] if s["rank"] == 3]
    assert spans == [(15 + 17 * i, 31 + 17 * i) for i in range(8000)] and r[0]["n_assign"] == 1
    assert [(s["start"], s["end"]) for s in r[1]["spans"]] == [(0, 200_000)]


NAMES = """MAX_BUFFER_SIZE_IN_BYTES JSONObjectMapperFactory GL_TEXTURE_CUBE_MAP_POSITIVE_X 550e8400-e29b-41d4-a716-446655440000 f47ac10b-58cc-4372-a567-0e02b2c3d479
AbstractSingletonProxyFactoryBean org/apache/spark/sql/functions HTTP_500_INTERNAL_SERVER_ERROR getElementsByClassName XMLHttpRequest addEventListener NullPointerException
utf8_general_ci SQLITE_CONSTRAINT_PRIMARYKEY WM_LBUTTONDBLCLK EXIT_FAILURE std_vector_iterator kube-controller-manager x86_64-unknown-linux-gnu aarch64-apple-darwin sha256sum
ISO-8859-1 java/util/concurrent/ConcurrentHashMap DEFAULT_INITIAL_CAPACITY createUserWithEmailAndPassword CVE-2021-44228 RFC-7231 2021-03-04T12 __attribute__ __init_subclass__
pthread_mutex_lock EPOLLONESHOT IPPROTO_ICMPV6 QAbstractItemModel QXmlStreamReader NSMutableAttributedString UIViewController kCGColorSpaceModelRGB CFBundleShortVersionString
ERR_SSL_PROTOCOL_ERROR LC_MESSAGES numpy_dtype_float64 BigDecimal_ROUND_HALF_UP application/x-www-form-urlencoded Content-Security-Policy X-Forwarded-For Access-Control-Allow-Origin
jquery-3-6-0-min bootstrap-4-bundle node_modules/webpack/lib DJANGO_SETTINGS_MODULE PYTHONDONTWRITEBYTECODE 20211231T235959 1234567890123456 us-east-1a-subnet-public i18n_messages_en_US""".split()


def test_secrets_against_plain_python(spark, sf):
    """Spans of the Markov part token by token, identifiers and keys."""
    import random

    import public_tokenizers

    model = train(q.table(spark, sf, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(11)
    key = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    keys = {n: [key(n) for _ in range(300)] for n in (6, 8, 10, 16)}
    texts = [" ".join(NAMES), *(f"é {a}, {b} {a}" for a, b in zip(keys[6], keys[10], strict=True)), *(f"token={a} {b}:{a}" for a, b in zip(keys[16], keys[8], strict=True)), None, "", "a", "AKIA" + "A1" * 10 + "_" + keys[16][0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_secrets(df, model).collect()}
    found = set()
    for i, text in enumerate(texts):
        base = [(s["start"], s["end"]) for s in got[i]["base"]]
        want = []
        for m in re.finditer(r"[A-Za-z0-9_+/=-]+", text or ""):
            total = sum(round(model[m[0][k : k + 2]], 6) for k in range(len(m[0]) - 1))
            if total >= 12.0 and not re.search(UUID, m[0]) and not any(a < m.end() and m.start() < b for a, b in base):
                want.append((m.start(), m.end()))
                found.add(m[0])
        assert sorted((s["start"], s["end"]) for s in got[i]["spans"] if s["rank"] == 3) == want
    assert not found & set(NAMES)
    share = {n: sum(k in found for k in keys[n]) / 300 for n in (8, 10)}
    assert share[10] >= 0.8 and share[8] >= 0.5
    score = lambda w: sum(model[w[k : k + 2]] for k in range(len(w) - 1))
    assert sum(score(k) >= 12 for k in keys[16]) >= 0.95 * 300


def test_shortest_token():
    flat = dict.fromkeys(map("".join, itertools.product(ALPHABET, repeat=2)), -1.0)
    assert shortest(flat | {"ab": 5.0, "ba": 2.0}, 12.0) == 4 and shortest(flat | {"ab": 5.0, "ba": -4.5}, 8.0) == 5 and shortest(flat | {"ab": 5.0}, 5.0) == 2 and shortest(flat, 1.0) > 1000
    assert shortest(flat | {"aa": 4.0}, 12.0) == 4


@pytest.mark.parametrize("name", ["quality_base", "secret_base", "mix_targets", "op4_line_dedup", "op11_repair_conversations", "op12_url_rules", "op13_prefix_trie"])
def test_queries_with_sql(spark, sf, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = q.queries()[name](spark, sf)
    names = sorted(df.columns)
    want = c.sql(q.oracle_sql()[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_pipeline_values(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = q.table(spark, sf, "documents")
    steps = {}
    for name, stage in p.STAGES:
        steps[name] = docs = spark.createDataFrame(stage(spark, docs, sf).toPandas()) if name == "packing" else p.materialize(stage(spark, docs, sf), name)
    texts = {k: Counter((r["doc_id"], r["text"]) for r in v.collect()) for k, v in steps.items() if k != "packing"}
    first = {(r["doc_id"], r["text"]) for r in q.table(spark, sf, "documents").collect()}
    assert set(texts["toxicity"]) <= first and len(texts["toxicity"]) >= 0.8 * len(first)
    kept = brute.lines_kept(texts["toxicity"])
    assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in texts["line_dedup"]} == {d: v[2] for d, v in kept.items()}
    near = brute.near(texts["line_dedup"], 80)
    assert {d for d, _ in texts["near_dedup"]} == {d for d, (_, c) in near.items() if d == c}
    assert set(texts["mix"]) <= set(texts["near_dedup"]) and max(texts["mix"].values()) <= 2
    packed = docs.toPandas()
    assert Counter(packed[packed["piece"] == 0]["doc_id"]) == Counter({d: n for (d, _), n in texts["mix"].items()})
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096
