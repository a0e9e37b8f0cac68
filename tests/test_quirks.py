"""One test for each rule that this library settles, on literal values."""

import pytest
from pyspark.sql import functions as F
from wordloom.functions import folding, marks, text
from wordloom.operators import filters, idsets, index, links, lookups, order, search, tree
from wordloom.operators.filters import BitRule
from wordloom.sources import records, sinks

BIG = 1 << 31


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def listed(df, name="id"):
    return sorted(r[name] for r in df.collect())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def table_of(spark, *keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, rid long")


def found(spark, keys, mode, targets):
    df = lookups.lookup_many(table_of(spark, *keys), "key", "rid", spark.createDataFrame([(t,) for t in targets], "target long"), "target", mode)
    return {r["target"]: r["rid"] for r in df.collect()}


def test_q1_absent_numbers_are_compared_three_ways(spark):
    keys, targets = [10, 20, 30], [5, 10, 15, 30, 35]
    assert found(spark, keys, "exact", targets) == {5: None, 10: 0, 15: None, 30: 2, 35: None}
    assert found(spark, keys, "last_before", targets) == {5: None, 10: None, 15: 0, 30: 1, 35: 2}
    assert found(spark, keys, "first_after", targets) == {5: 0, 10: 1, 15: 1, 30: None, 35: None}
    assert found(spark, keys, "exact_or_before", targets) == {5: None, 10: 0, 15: 0, 30: 2, 35: 2}
    assert found(spark, keys, "exact_or_after", targets) == {5: 0, 10: 0, 15: 1, 30: 2, 35: None}


def test_q2_first_after_the_only_row(spark):
    assert found(spark, [7], "first_after", [7]) == {7: None}
    assert lookups.lookup(table_of(spark, 7), "key", "rid", 7, "first_after").collect() == []


def test_q3_equal_keys_give_the_first(spark):
    assert found(spark, [4, 4, 4, 9], "exact", [4]) == {4: 0}
    assert found(spark, [4, 4, 4, 9], "last_before", [9]) == {9: 0}


def test_q4_empty_text_keys(spark):
    words = spark.createDataFrame([("b", 0), ("d", 1)], "key string, rid long")
    with pytest.raises(ValueError):
        lookups.lookup(words, "key", "rid", "")
    with pytest.raises(ValueError):
        lookups.lookup(words, "key", "rid", "b", "nearest")
    assert [lookups.list_position(words, "key", t).first()[0] for t in ("", "b", "c", "z")] == [0, 0, 1, 1]


def test_q5_signs_are_kept(spark):
    df = spark.createDataFrame([(-1, 0), (-128, 1), (3, 2)], "key long, rid long").withColumn("key", F.col("key").cast("byte"))
    assert lookups.lookup(df, "key", "rid", 0, "last_before").first()["key"] == -1


def test_q6_q7_set_algebra(spark):
    a, b, none = ids(spark, 1, 1, 2, 70_000, BIG + 5), ids(spark, 2, BIG + 5), ids(spark)
    assert listed(idsets.combine("or", a, b)) == [1, 2, 70_000, BIG + 5]
    assert listed(idsets.combine("and", a, b)) == [2, BIG + 5] and listed(idsets.combine("not", a, b)) == [1, 70_000]
    assert listed(idsets.combine("append", a, b)) == [1, 1, 2, 2, 70_000, BIG + 5, BIG + 5]
    assert listed(idsets.both(a, none)) == [] and listed(idsets.any_of(none, a)) == [1, 2, 70_000, BIG + 5]
    assert idsets.bitmap_count(idsets.as_bitmap(a)).first()["n"] == 4 and idsets.bitmap_count(idsets.as_bitmap(none)).first()["n"] == 0
    with pytest.raises(ValueError):
        idsets.combine("seqand", a, b)


DOCS = ["a x b", "b a", "a x x x b", "b", "a the b", "A b"]


def hits(spark, query, docs=DOCS, **rules):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return listed(search.search(text.tokens(df), query, **rules), "doc_id")


def test_q8_near_without_a_side(spark):
    assert hits(spark, "a near zebra") == [] and hits(spark, "zebra near a") == []


def test_near_and_before_distances(spark):
    assert hits(spark, "a near b", near=2) == [0, 1, 4, 5] and hits(spark, "a near b", near=1) == [1, 5] and hits(spark, "a near b", near=0) == []
    assert hits(spark, "a before b", near=2) == [0, 4, 5] and hits(spark, "b before a", near=2) == [1]
    assert hits(spark, "a near a", near=0) == [0, 1, 2, 4, 5]
    assert hits(spark, "a near b", with_positions=False) == [0, 1, 2, 4, 5]


def test_q9_near_marks_look_at_all_partners(spark):
    got = value(spark, filters.near_positions(F.array(*map(F.lit, (1, 5, 9))), F.array(*map(F.lit, (3, 10))), 1, 1))
    assert got == [9]


def test_q10_stop_words(spark):
    assert hits(spark, "a near the b", near=2, stop_words=frozenset({"the"})) == [0, 1, 4, 5]
    with pytest.raises(ValueError):
        search.parse("the", frozenset({"the"}))


def test_q11_large_ids_and_scores(spark):
    df = spark.createDataFrame([(BIG + 1, BIG), (2, BIG), (3, -BIG)], "id long, score long")
    assert [r["id"] for r in order.top(df, order.by_score(), 0, 3).orderBy("pos").collect()] == [2, BIG + 1, 3]


def test_q12_word_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("First\nmiddle\r\nLAST")
    got = listed(records.word_set(records.lines(spark, str(tmp_path / "w.txt"))), "word")
    assert got == ["first", "last", "middle"]


WORDS = ["a", "abc", "aéc", "ac", "ab", "xa", "été"]


def words(spark, pattern, kind="wildcard", folded=False):
    df = index.with_keys(spark.createDataFrame([(w,) for w in WORDS], "word string"))
    return listed(index.find_words(df, pattern, kind, folded), "word")


def test_q13_wildcards_count_code_points(spark):
    assert words(spark, "a?c") == ["abc", "aéc"] and words(spark, "a*") == ["a", "ab", "abc", "ac", "aéc"]
    assert words(spark, "*a") == ["a", "xa"] and words(spark, "?t?") == ["été"] and words(spark, "ETE", folded=True) == ["été"]
    for bad in ("", "*", "?", "**"):
        with pytest.raises(ValueError):
            text.wildcard(bad)


def test_q14_slices_reach_the_end(spark):
    df = spark.range(5).withColumnRenamed("id", "rid")
    assert listed(order.slice_rows(df, "rid", 3, 2), "rid") == [3, 4]
    assert [r["rid"] for r in order.page(df, [F.col("rid").asc()], 4, 3).orderBy("pos").collect()] == [3, 4]
    assert order.top(df, [F.col("rid").asc()], 9, 2).collect() == []


def test_q15_regular_expressions_match_whole_words(spark):
    assert words(spark, "(a|ab)", "regex") == ["a", "ab"] and words(spark, "a|ab", "regex") == ["a", "ab"]
    assert words(spark, "abc", "regex") == ["abc"] and words(spark, ".*c", "regex") == ["abc", "ac", "aéc"] and words(spark, "a.*", "regex") == ["a", "ab", "abc", "ac", "aéc"]
    assert words(spark, r"\w", "regex") == ["a"]


def test_q16_phrases(spark):
    assert hits(spark, '"a b"') == [] + [i for i, d in enumerate(DOCS) if "a b" in d]
    assert hits(spark, '"a a"') == [] and hits(spark, '"A b"') == [5] and hits(spark, '"a x b"') == [0]
    assert hits(spark, '"a the b"', stop_words=frozenset({"the"})) == [0, 4]


def test_q18_q19_places_and_ties(spark):
    df = spark.createDataFrame([(3, 1), (1, 1), (2, 0)], "rid long, k long")
    placed = order.numbered(df, order.chain(("k", True), reverse=True)).orderBy("pos")
    assert [(r["rid"], r["pos"]) for r in placed.collect()] == [(1, 0), (3, 1), (2, 2)]
    assert records.point_read(df, "rid", 4).collect() == []


def test_q20_marks_and_their_ordinals(spark):
    marked = marks.mark_words(F.array(F.lit("one"), F.lit("two"), F.lit("three")))
    at = lambda *n: F.array(*map(F.lit, n)) if n else F.array().cast("array<int>")
    assert tuple(value(spark, marks.highlight(marked, at()))) == ("one two three", True)
    assert tuple(value(spark, marks.highlight(marked, at(0, 2)))) == ("<b>one</b> two <b>three</b>", True)
    assert tuple(value(spark, marks.highlight(marked, at(1, 7)))) == ("one <b>two</b> three", False)
    assert value(spark, marks.highlight_anchored(marked, at(1)))["text"] == 'one <a name="skhlt_1"></a><b>two</b> three'


def test_fold_order_is_from_left_to_right(spark):
    docs = ["a", "b c", "a c", "b", "c"]
    assert hits(spark, "a or b and c", docs) == [1, 2] and hits(spark, "a not b or c", docs) == [0, 1, 2, 4]
    with pytest.raises(ValueError):
        search.parse("a or and b")
    with pytest.raises(ValueError):
        search.parse("a or")


def test_words_and_exceptions(spark):
    split = lambda s, **k: value(spark, text.words(F.lit(s), **k))
    assert split("L'ami d'Aujourd'hui") == ["L", "ami", "d", "Aujourd'hui"] and split("aujourd'huit") == ["aujourd", "huit"] and split("AUJOURD'HUI''x'") == ["AUJOURD'HUI", "x"]
    assert split("a--b,,c d") == ["a", "b", "c", "d"] and split("") == []
    assert split("x &amp; y", entities=True) == ["x", "&amp;", "y"]


def test_folds(spark):
    fold = lambda s, **k: value(spark, folding.fold(F.lit(s), **k))
    assert fold("Été") == "ete" and fold("æ") == "æ" and fold("ΣΑΣ") == "σασ" and len(fold("İ")) == 1
    assert fold("a b", spaces=True) == "a b" and fold("Strauß", changes={"ß": "ss"}) == "strauss"
    assert value(spark, folding.same_folded(F.lit("ÉTÉ"), F.lit("ete")))
    assert value(spark, folding.sloppy_capitals(F.lit("Ete"), "Été")) is False and value(spark, folding.sloppy_capitals(F.lit("Été"), "Eté"))


def test_bit_rules(spark):
    rules = [BitRule(False, 1, 1, mask=1), BitRule(True, 1, 3, mask=3)]
    got = [value(spark, filters.bit_rules(F.lit(v), rules, default=d)) for v, d in ((1, True), (3, True), (2, False), (4, True), (4, False))]
    assert got == [False, False, True, True, False]


def test_scores(spark):
    points = [value(spark, search.relevance(F.lit(level << 2 | style), F.lit(2), bold=3, italic=5)) for level, style in ((0, 0), (1, 0), (7, 0), (7, 1), (7, 2), (7, 3))]
    assert points == [200, 40, 2, 6, 10, 30]


def test_strings(spark):
    assert text.next_string("ab") == "ac" and text.next_string("") is None
    assert text.next_string("a\U0010ffff") == "b" and text.next_string("\ud7ff") == "\ue000" and text.next_string("\U0010ffff") is None
    assert value(spark, text.reverse_bytes(F.lit("é"))) == b"\xa9\xc3" and value(spark, text.strip_marks(F.lit("ˈæpl"))) == "æpl"
    assert value(spark, records.code_points(F.lit("baa"))) == [97, 98]
    assert value(spark, lookups.lower_bound(F.array(*map(F.lit, (1, 3, 3, 7))), F.lit(3))) == 1
    assert value(spark, text.content_url(F.lit("sk://fs/2.0/main!/a/b#c"))) == ("main", "a/b", "c") and value(spark, text.content_url(F.lit("http://x"))) is None


def test_settings_and_paths():
    got = records.settings("a=1\n// note\n[ X ]\nbad line\n k = v=w \n")
    assert got == {"": {"a": "1"}, "X": {"k": "v=w"}}
    assert records.search_path("f", "/a;/b", exists=lambda p: p == "/b/f") == "/b/f" and records.search_path("g", "/a", exists=lambda p: False) is None


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", b"\x01\x02"), ("d/y", b"")], "name string, data binary")
    df.createOrReplaceTempView("quirk_view")
    assert records.open_table(spark, "cursor:quirk_view").count() == 2
    with pytest.raises(ValueError):
        records.open_table(spark, "zip:quirk_view")
    sinks.write_blobs(df, "name", "data", str(tmp_path / "blobs"))
    back = records.blobs(spark, str(tmp_path / "blobs"))
    assert {(r["name"], bytes(r["data"])) for r in back.collect()} == {("x", b"\x01\x02"), ("d/y", b"")}
    sinks.write_text(df, "name", str(tmp_path / "t"))
    sinks.write_text(df, "name", str(tmp_path / "t"), mode="append")
    assert listed(records.lines(spark, str(tmp_path / "t")), "line") == ["d/y", "d/y", "x", "x"]
    assert value(spark, records.integers(F.lit(b"\x05\x00\x00\x00\x01\x00\x00\x80"))) == [5, BIG + 1]
    assert value(spark, records.hex_integers(F.lit("1F 0a\n1f"))) == [10, 31]


def test_tree_names(spark):
    dirs = spark.createDataFrame([(0, "", None), (1, "a", 0), (2, "b", 1)], "dir_id long, name string, parent_id long")
    files = spark.createDataFrame([(5, "a", 0, "T", "C"), (6, "f", 2, "U", "D")], "file_id long, name string, parent_id long, title string, content string")
    at = lambda p: [tuple(r) for r in tree.resolve(dirs, files, p).collect()]
    assert at("/a") == [("dir", 1)] and at("//a/./b/f") == [("file", 6)] and at("/a/b/..") == [("dir", 1)] and at("/") == [("dir", 0)]
    assert at("/..") == [] and at("/a/none") == []
    urls = spark.createDataFrame([("sk://fs/2.0/x!/@6",), ("sk://fs/2.0/x!/@9",), ("sk://fs/2.0/x!/@z",)], "url string")
    assert {(r["url"][-1], r["title"], r["content"]) for r in tree.content(files, urls, "url").collect()} == {("6", "U", "D"), ("9", None, None), ("z", None, None)}


def test_inflected_forms(spark):
    rows = spark.createDataFrame([(1, "ring"), (2, "rings"), (3, "blue")], "rid long, word string")
    forms = spark.createDataFrame([("rings", [1]), ("rang", [1]), ("bluer", [3, 8])], "form string, clids array<long>")
    assert listed(links.search_inflected(rows, "rid", ["rings"], forms, "clids")) == [1, 2]
    assert listed(links.search_inflected(rows, "rid", ["rings"], forms, "clids", "advanced")) == [2]
    assert listed(links.search_inflected(rows, "rid", ["blue*"], forms, "clids")) == [3, 8]


def test_adjacent_rows_over_partitions(spark):
    rows = [(u, t, t // 3 % 2) for u in (1, 2) for t in range(60)]
    df = spark.createDataFrame(rows, "user long, t long, v long")
    got = {(r["user"], r["t"]) for r in idsets.drop_adjacent(df, ["t"], "v", ["user"]).collect()}
    assert got == {(u, t) for u in (1, 2) for t in range(0, 60, 3)}
