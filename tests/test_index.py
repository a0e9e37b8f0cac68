"""The written index, proximity by one merge, deep pages, neighbours, ranks."""

import random
import time
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F
from wordloom.functions import folding, text
from wordloom.operators import filters, idsets, index, lookups, order, search, tree
from wordloom.operators.hops import Hop


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = ["The ring of Été and the blue bolt", "ete nation, station Nation", "ringing rings of THE nation", "", None, "of of the the ring", "Eté ring nation the of", "a the b of c ring"]


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    docs = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string")
    path = str(tmp_path_factory.mktemp("index"))
    index.written(docs, path=f"{path}/i")
    return text.tokens(docs), index.open_written(spark, f"{path}/i")


MODES = {"exact": "nation", "begin": "NA*", "end": "*Tion", "scan": "*in?", "both": "r*g"}


@pytest.mark.parametrize("folded", [False, True])
@pytest.mark.parametrize("mode", MODES)
def test_words_by_pruned_ranges(held, mode, folded):
    rows, written = held
    pattern = MODES[mode] if folded else MODES[mode].lower()
    found = index.find_written(written, pattern, folded)
    want = index.find_words(index.lexicon(rows), pattern, folded=folded)
    assert sorted(tuple(r) for r in found.select("word", "n_docs", "n_occ").collect()) == sorted(tuple(r) for r in want.select("word", "n_docs", "n_occ").collect())
    key = {"exact": "word", "begin": "word", "end": "rev", "scan": "word", "both": "word"}[mode]
    key = {"word": "fold", "rev": "rev_fold"}[key] if folded else key
    assert f"by_{key}" in plan(found)
    pushed = plan(found).split("PushedFilters: ")[1].split("]")[0]
    if mode == "exact":
        assert f"EqualTo({key},nation)" in pushed
    elif mode != "scan":
        assert f"GreaterThanOrEqual({key}," in pushed and f"LessThan({key}," in pushed
    got = index.find_postings(written, pattern, folded)
    assert {r["word"] for r in got.collect()} == {r["word"] for r in want.collect()}
    assert "PartitionFilters: [" in plan(got) and "bucket" in plan(got).split("PartitionFilters: [")[1].split("]")[0]


QUERIES = ["ring", "ring and of", "RING near of", "the before ring", '"of the"', '"of the" or nation', "of not ring", "na* and *ing", "ring or of and the not bolt", '"the ring" near of', 'of near "the ring"', '"of the the" before ring', "zebra", "ring and zebra", "?f and ring"]


@pytest.mark.parametrize("query", QUERIES)
def test_search_in_the_index_equals_search_in_tokens(spark, held, query):
    rows, written = held
    others = ({"folded": False}, {"near": 2}, {"with_positions": False}, {"stop_words": frozenset({"the"})})
    for rules in ({}, others[QUERIES.index(query) % len(others)]):
        want = search.search(rows, query, **rules).collect()
        got = search.search_written(written, query, **rules).collect()
        assert sorted((r["doc_id"], r["n_occ"], r["marked"]) for r in got) == sorted((r["doc_id"], r["n_occ"], r["marked"]) for r in want)


def test_record_filter_and_forms(spark, held):
    rows, written = held
    few = spark.createDataFrame([(0,), (2,), (99,)], "id long")
    assert sorted(r["doc_id"] for r in search.search_written(written, "ring or rings", only=few).collect()) == [0, 2]
    links = spark.createDataFrame([("ring", "ringing"), ("ring", "rings"), ("ring", "ring"), ("station", "nation")], "a string, b string").select(index.word_id(F.col("a")).alias("a"), index.word_id(F.col("b")).alias("b"))
    path = [Hop(links, "a", "b", many=True)]
    ids = lambda q: sorted(r["doc_id"] for r in search.search_written(written, q, path=path).collect() if r["doc_id"] < len(TEXTS))
    assert ids("ring") == [0, 2, 5, 6, 7] and ids("nation") == [] and ids("station") == [1, 2, 6] and ids("ring and station") == [2, 6]
    assert ids('"rings of"') == [2] and ids('station and "ring nation"') == [6] and ids("stat* not ring") == [1]


def test_needed_words():
    numbers = lambda q: search.needed(search.parse(q))
    assert numbers("a") == [0] and numbers("a and b near c") == [0, 1, 2] and numbers("a or b") == [] and numbers("a or b and c") == [2]
    assert numbers('"a b" not c and d') == [0, 1, 3] and numbers("not a and b") == [1] and numbers('a before "b c"') == [0, 1, 2]


def test_the_rarest_word_prunes(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common words of all "), F.when(F.col("id") % 1000 == 7, "rare").otherwise("often")).alias("text"))
    written = index.written(docs, path=str(tmp_path / "i"))
    found = search.search_written(written, "common and rare")
    assert sorted(r["doc_id"] for r in found.collect()) == [7, 1007, 2007, 3007]
    assert "LeftSemi" in plan(found) and "LeftSemi" not in plan(search.search_written(written, "common and words"))


def brute_near(p, o, before, after):
    return [x for x in sorted(p) if any(0 <= x - e <= before or 0 <= e - x <= after for e in o)]


def brute_runs(p, o, near):
    """The same for long sorted lists without common places."""
    return [x for x in p if any(abs(x - e) <= near for e in o[max(0, bisect_left(o, x) - 1) : bisect_left(o, x) + 1])]


def test_near_positions(spark):
    draw = random.Random(1)
    cases = [(draw.sample(range(40), draw.randint(0, 9)), draw.sample(range(40), draw.randint(0, 9)), draw.randint(0, 6), draw.randint(-1, 6)) for _ in range(200)]
    df = spark.createDataFrame([(i, p, o, b, a) for i, (p, o, b, a) in enumerate(cases)], "i int, p array<int>, o array<int>, b int, a int")
    got = {r["i"]: r["n"] for r in df.select("i", filters.near_positions(F.col("p"), F.col("o"), F.col("b"), F.col("a")).alias("n")).collect()}
    assert got == {i: brute_near(*c) for i, c in enumerate(cases)}


def test_time_is_free_of_the_distance(spark):
    words = random.Random(2).choices(["of", "the", "x", "y"], k=60_000)
    rows = text.tokens(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"))
    at = {w: [i for i, x in enumerate(words) if x == w] for w in ("of", "the")}
    took = {}
    for near in (10, 50_000, 10, 50_000):
        began = time.time()
        got = search.search(rows, "of near the", near=near).collect()
        took[near] = min(took.get(near, 1e9), time.time() - began)
        assert len(got) == 1 and got[0]["n_occ"] == len(at["of"]) + len(at["the"])
        assert got[0]["marked"] == sorted(brute_runs(at["of"], at["the"], near) + brute_runs(at["the"], at["of"], near))
    assert took[50_000] < 2 * took[10] + 0.5


def test_phrases_beside_near_and_of_stop_words(spark):
    docs = spark.createDataFrame(list(enumerate(["the big ring is far away from a blue bolt", "blue bolt big ring", "big blue ring bolt"])), "doc_id long, text string")
    ids = lambda q, **k: sorted(r["doc_id"] for r in search.search(text.tokens(docs), q, **k).collect())
    assert ids('"big ring" near "blue bolt"', near=6) == [0, 1] and ids('"big ring" near "blue bolt"', near=5) == [1] and ids('"big ring" before "blue bolt"', near=9) == [0]
    assert ids('bolt before "big ring"', near=1) == [1]
    stop = frozenset({"the", "is"})
    assert ids('"the is" ring', stop_words=stop) == [0, 1, 2] and ids('ring not "the is" bolt', stop_words=stop) == []
    with pytest.raises(ValueError):
        search.parse('"the is"', stop)


def test_scores_of_phrases_go_word_by_word(spark):
    docs = spark.createDataFrame([(1, "big ring"), (2, "ring big big"), (3, "none")], "doc_id long, text string")
    got = {r["id"]: r["score"] for r in search.score(index.postings(docs), '"big ring"').collect()}
    assert got == {1: 200, 2: 300}


@pytest.fixture
def parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def to(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)

    yield to
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_deep_pages(spark, parts):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 50).alias("k"))
    keys = [F.col("k").desc(), F.col("id").asc()]
    want = sorted(((-(i * 7919 % 50), i) for i in range(5000)))
    for n in (1, 16):
        parts(n)
        pages = order.paged(rows, keys)
        assert pages.total == 5000
        for begin, size in ((0, 10), (2490, 25), (4995, 10), (6000, 5), (0, 5000), (100, 0)):
            got = sorted((r["pos"], -r["k"], r["id"]) for r in order.page_at(pages, begin, size).collect())
            assert got == [(begin + i, *w) for i, w in enumerate(want[begin : begin + size])]
    page = plan(order.page_at(pages, 2490, 25))
    read = page.split("PartitionFilters: [")[1].split("]")[0]
    assert read.count(",") <= 3 and "SinglePartition" not in page
    assert order.page_at(order.paged(rows.limit(0), keys), 0, 5).collect() == []


def test_neighbours(spark, parts):
    draw = random.Random(4)
    for n, size in ((1, 30), (16, 500), (16, 9), (4, 0)):
        parts(n)
        values = [draw.randint(0, 5) for _ in range(size)]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long")
        got = {r["i"]: (r["v_m2"], r["v_m1"], r["v_p1"], r["v_p2"], r["v_p3"]) for r in order.with_neighbours(df, [F.col("i").asc()], ["v"], before=2, after=3).collect()}
        at = lambda i: values[i] if 0 <= i < size else None  # noqa: B023, E731
        assert got == {i: (at(i - 2), at(i - 1), at(i + 1), at(i + 2), at(i + 3)) for i in range(size)}


def test_ranks(spark, parts):
    parts(8)
    words = spark.createDataFrame([(w,) for w in ["b", "d", "d", "f", None, *map(str, range(200))]], "w string")
    keys = sorted({"b", "d", "f", *map(str, range(200))})
    held = lookups.ranks(words, "w")
    typed = ["", "0", "100", "a", "d", "e", "z"]
    want = [min(sum(k < t for k in keys), len(keys) - 1) for t in typed]
    assert [lookups.position_in(held, t).first()[0] for t in typed] == want
    many = lookups.list_positions(words, "w", spark.createDataFrame([(t,) for t in typed], "t string"), "t")
    assert {r["t"]: r["position"] for r in many.collect()} == dict(zip(typed, want, strict=True))
    assert plan(lookups.position_in(held, "d")).count("PartitionFilters: [isnotnull(_part") == 1


def test_bitmaps(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    sets = [(), (0, 1, -1, 5, 32768, 32769, -32767, -32768), (1, 5, 70_000, 1 << 40, -(1 << 40)), tuple(range(-40_000, 70_000, 977))]
    for a in sets:
        assert sorted(r["id"] for r in idsets.from_bitmap(idsets.as_bitmap(ids(*a))).collect()) == sorted(a)
    for a, b in ((sets[1], sets[2]), (sets[2], sets[1]), (sets[0], sets[1]), (sets[3], sets[0])):
        for name, want in (("or", {*a} | {*b}), ("and", {*a} & {*b}), ("not", {*a} - {*b})):
            got = idsets.bitmap_combine(name, idsets.as_bitmap(ids(*a)), idsets.as_bitmap(ids(*b)))
            assert sorted(r["id"] for r in idsets.from_bitmap(got).collect()) == sorted(want)
    with pytest.raises(ValueError):
        idsets.bitmap_combine("seqand", idsets.as_bitmap(ids()), idsets.as_bitmap(ids()))


def test_many_paths(spark):
    dirs = spark.createDataFrame([(0, "", None), (1, "a", 0), (2, "b", 1), (7, "b", 1), (8, "x", 7), (3, "f", 2)], "dir_id long, name string, parent_id long")
    files = spark.createDataFrame([(5, "a", 0, "T", "C"), (6, "f", 2, "U", "D"), (9, "g", 2, "U", "D"), (4, "g", 2, "", "")], "file_id long, name string, parent_id long, title string, content string")
    want = {"/a": ("dir", 1), "//a/./b/f": ("dir", 3), "a/b/g": ("file", 4), "": ("dir", 0), "/": ("dir", 0), "/..": (None, None), "a/b/x": (None, None), "a/../a/b/..": ("dir", 1), "a/g/../..": ("dir", 0), None: (None, None)}
    paths = spark.createDataFrame([(p, 1) for p in [*want, "/a"]], "p string, kind_of int")
    got = [(r["p"], (r["kind"], r["id"])) for r in tree.resolve_many(dirs, files, paths, "p").collect()]
    assert sorted(got, key=repr) == sorted([*want.items(), ("/a", ("dir", 1))], key=repr)
    for p in ("/a", "//a/./b/f", "a/b/g", "/", "/..", "a/b/x"):
        one = [tuple(r) for r in tree.resolve(dirs, files, p).collect()]
        assert one == [w for w in [want[p]] if w[0]]


def test_folded_order(spark):
    changes = {"æ": "ae", "ß": "ss"}
    pairs = [("Æther", "aether", 0), ("straße", "STRASSE", 0), ("æ", "af", -1), ("af", "ä", 1), ("été", "Ete", 0), ("", "a", -1)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    got = df.select("want", folding.compare_folded(F.col("a"), F.col("b"), changes).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
