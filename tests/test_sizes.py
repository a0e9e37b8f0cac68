"""Long texts, absent directories and what larger tables showed."""

import time

import pytest
from pyspark.sql import functions as F
from wordloom.functions import marks, text
from wordloom.llm import queries as llm
from wordloom.operators import idsets, index, search
from wordloom.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_highlights_of_a_long_text_take_one_pass(spark):
    words = [("of" if i % 3 == 0 else f"w{i}") for i in range(20_000)]
    df = spark.createDataFrame([(words, [i for i, w in enumerate(words) if w == "of"])], "w array<string>, at array<int>")
    began = time.time()
    got = df.select(marks.highlight(marks.mark_words(F.col("w")), F.col("at")).alias("h")).first()["h"]
    assert time.time() - began < 20
    assert got["text"] == " ".join(f"<b>{w}</b>" if w == "of" else w for w in words) and got["complete"]


def test_highlights_by_value(spark):
    a, b = marks.START, marks.STOP
    rows = [(f"x {a}p{b} y {a}q{b}", [1, 1]), (f"{a}p{b}", [0, -1]), (f"x {a}p{b}", [1, None]), ("x", []), ("", [0]), (None, [0]), (f"{a}p{b}", None)]
    df = spark.createDataFrame(rows, "t string, at array<int>").coalesce(1)
    got = [tuple(r["h"]) for r in df.select(marks.highlight(F.col("t"), F.col("at")).alias("h")).collect()]
    assert got == [("x p y <b>q</b>", True), ("<b>p</b>", False), ("x p", False), ("x", True), ("", False), (None, None), ("p", None)]


def test_hilite_text_of_long_texts(spark, tmp_path):
    text = " ".join(("OF" if i % 5 == 0 else f"w{i}") for i in range(20_000))
    spark.createDataFrame([(1, text), (2, "none here"), (3, ""), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = catalogue.queries()["hilite_text"](spark, str(tmp_path)).collect()
    assert time.time() - began < 20
    assert [r["doc_id"] for r in got] == [1] and got[0]["text"].startswith('<a name="skhlt_0"></a><b>OF</b> w1 w2 w3 w4 <a name="skhlt_5"></a><b>OF</b> w6') and got[0]["complete"]


def test_a_directory_without_pages_is_listed(spark, tmp_path):
    urls = {"none": ["http://www.spam-farm.example.org/a", "https://x.org/y/z"], "some": ["http://spam-farm.example.org/a", "http://spam-farm.example.org/b/c", "http://x.org/spam-farm.example.org/d"]}
    for name, own in urls.items():
        spark.createDataFrame(list(enumerate(own)), "page_id long, url string").write.parquet(f"{tmp_path}/{name}/pages.parquet")
        got = sorted(tuple(r) for r in catalogue.queries()["tree_by_id"](spark, f"{tmp_path}/{name}").collect())
        assert got == [("dir", "spam-farm.example.org"), *([("file", "a")] if name == "some" else [])]


def test_postings_are_made_where_texts_are_read(spark):
    rows = [(1, "b a b"), (2, "a"), (3, ""), (4, None), (None, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert "Exchange" not in plan(index.postings(docs))
    again = docs.unionByName(docs.where("doc_id = 1 or doc_id is null"))
    for df in (docs, again, docs.limit(0)):
        want = text.tokens(df).groupBy("word", "doc_id").agg(F.count("pos").alias("n_occ"), F.sort_array(F.collect_list("pos")).alias("positions"))
        got = index.postings(df).select("word", "doc_id", "n_occ", "positions")
        assert got.schema["n_occ"].dataType == want.schema["n_occ"].dataType
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_a_frequent_word_is_never_one_task(spark, tmp_path, monkeypatch, few):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the nation of The "), F.col("id") % 7).alias("text"))
    written = index.written(docs, path=str(tmp_path / "i"))
    monkeypatch.setattr(index, "BROADCAST_WORDS", few)
    for q in ("the or of", "TH* and *Tion", "the before 3"):
        found = search.search_written(written, q)
        assert "hashpartitioning(word#" not in plan(found)
        want = search.search(text.tokens(docs), q)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    ended = index.find_postings(written, "*tion")
    assert "hashpartitioning(word#" not in plan(ended) and ended.count() == 3000


def test_bitmaps_are_built_after_ids_are_dealt_out(spark):
    ids = spark.range(5000).select((F.col("id") * 40_000 - 7).alias("id"))
    shown = plan(idsets.as_bitmap(ids))
    assert shown.rindex("bitmap_construct_agg") < shown.index("Exchange")
    assert sorted(r["id"] for r in idsets.from_bitmap(idsets.as_bitmap(ids)).collect()) == sorted(r["id"] for r in ids.collect())


def test_texts_are_cut_into_words_once(spark, sf):
    assert "regexp_extract_all" not in plan(catalogue.queries()["lookup_folded"](spark, sf))


def test_base_spans_need_no_scan_of_tokens(spark, sf):
    assert "Exchange" not in plan(llm.queries()["secret_base"](spark, sf))
